"""The comparison of pages by what a model can have read: pools around a cutoff, the control's gate, gains between conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .measures import ratio


def exposure_pool(pages: DataFrame, *, key: str, created: str, views: str, cutoff: str, famous: int = 15) -> DataFrame:
    """(key, group, days): pages made after the cutoff, as many closest before it (ties by key), and the most viewed of the rest.

    Rows are counted by day, and a running sum over days finds the day where the number is reached; only the rows of that
    day are ranked. Keys must be distinct; a page without a date can only be famous, its days null.
    """
    cut = F.lit(cutoff).cast("date")
    d = pages.select(F.col(key).alias("key"), F.datediff(F.col(created), cut).alias("days"), F.col(views).alias("views"))
    new, old = d.where("days > 0"), d.where("days <= 0")
    wanted = new.agg(F.count(F.lit(1)).alias("wanted"))
    upto = F.sum("n").over(Window.orderBy(F.desc("days")))
    by_day = old.groupBy("days").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", upto).crossJoin(wanted).where("upto - n < wanted")
    near = old.join(by_day, "days")
    place = F.row_number().over(Window.partitionBy("days").orderBy("key"))
    last = near.where("upto > wanted").withColumn("place", place).where("place <= wanted - (upto - n)")
    chosen = near.where("upto <= wanted").select("key", "days").union(last.select("key", "days"))
    pool = chosen.withColumn("group", F.lit("exposed")).union(new.select("key", "days", F.lit("unexposed").alias("group")))
    rest = d.where(F.col("views").isNotNull()).join(pool.select("key"), "key", "left_anti").orderBy(F.desc("views"), "key").limit(famous)
    return pool.union(rest.select("key", "days", F.lit("famous"))).withColumnRenamed("key", key)


def control_gate(df: DataFrame, *, group: str, truth: str, given: str, reference: list[str], control: str) -> DataFrame:
    """n, the median error, that of always saying the reference groups' median, the share within 2, and ok: for the control's row, whether its error is half of that guess's at most."""
    d = df.where(F.col(truth).isNotNull() & F.col(given).isNotNull()).select(F.col(group).alias("group"), F.col(truth).cast("double").alias("t"), F.abs(F.col(given) - F.col(truth)).cast("double").alias("e"))
    guess = d.where(F.col("group").isin(reference)).agg(F.median("t").alias("guess"))
    out = d.crossJoin(F.broadcast(guess)).groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.median("e").alias("error"), F.median(F.abs(F.col("guess") - F.col("t"))).alias("guess_error"), F.count_if(F.col("e") <= 2).alias("close"))
    return out.select("group", "n", "error", "guess_error", ratio(F.col("close"), F.col("n")).alias("within_2"), F.when(F.col("group") == control, F.col("error") <= F.col("guess_error") / 2).alias("ok"))


def gains(df: DataFrame, *, by: list[str], condition: str, value: str, low: str, high: str) -> DataFrame:
    """by, the mean value under each of two conditions, and the gain of high over low; null where a condition is missing."""
    mean = lambda c: F.avg(F.when(F.col(condition) == c, F.col(value)))
    return df.groupBy(*by).agg(mean(low).alias(low), mean(high).alias(high)).withColumn("gain", F.col(high) - F.col(low))


def letter_shares(df: DataFrame, letters: str, among: str = "ABCD") -> DataFrame:
    """(letter, n, share) of the letters of a text column; letters that aren't among those asked for don't count."""
    n = [F.coalesce(F.sum(F.length(letters) - F.length(F.replace(F.col(letters), F.lit(x), F.lit("")))), F.lit(0)).alias(x) for x in among]
    total = sum((F.col(x) for x in among), F.lit(0))
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("letter"), F.col(x).alias("n"), total.alias("total")) for x in among]))
    return df.agg(*n).select(rows.alias("x")).select("x.letter", F.col("x.n").alias("n"), F.coalesce(ratio(F.col("x.n"), F.col("x.total")), F.lit(0.0)).alias("share"))


def compact_map(df: DataFrame, *, by: str, name: str, values: list[str]) -> DataFrame:
    """(by, json): {"name":[values]} of each group, without blanks, in the order of names; df holds one row for each name of a group."""
    entry = F.struct(F.col(name).cast("string").alias("k"), F.array(*values).alias("v"))
    return df.groupBy(by).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("json"))
