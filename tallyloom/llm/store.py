"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.shared import fresh_path

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: a lost executor costs no earlier stage. In a scratch block it goes when that ends."""
    path = fresh_path(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_UP, "false")
    conf.set(CLEAN_UP, "true")  # the shuffle files have served
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEAN_UP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_keys(counts: DataFrame, keys: list[str], total: int, floor: int = 20_000) -> DataFrame:
    """(keys, salts) of the keys with more than max(floor, total / 100,000) of all rows; counts: (keys, n).

    At most 100,000 keys can have so many, whatever the table, so the result may be broadcast.
    """
    most = max(floor, total // 100_000)
    return cut(counts.where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("salts")))


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], how: str, hot: DataFrame, spread: Column) -> DataFrame:
    """big join small on keys, the rows of a hot key in as many parts as hot says: big by spread, small once in each. hot: by keys or some of them."""
    salts, salt = free_names(big, "salts", "salt")
    marks = F.broadcast(hot.withColumnRenamed("salts", salts))
    by = [c for c in hot.columns if c != "salts"]
    n = F.coalesce(salts, F.lit(1))
    b = big.join(marks, by, "left").withColumn(salt, F.pmod(F.xxhash64(spread), n).cast("int")).drop(salts)
    s = small.join(marks, by, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), n - 1))).drop(salts)
    return b.join(s.hint("merge"), [*keys, salt], how).drop(salt)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names for internal use that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def bounded_sample(rows: DataFrame, id_col: str, n: int, chars: int) -> DataFrame:
    """At most n rows of (text, ...), no more than chars characters together, chosen by md5 of id and text's hash.

    Only keys and lengths are ordered; the texts of the chosen few, a bounded number, are then looked up. Rows that
    repeat count once. A text longer than chars is passed over.
    """
    h = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.xxhash64("text").cast("string")))
    rows = rows.where(F.col("text").isNotNull()).withColumn("_h", h)
    keys = rows.select("_h", F.length("text").alias("_n")).where(F.col("_n") <= chars).distinct().orderBy("_h").limit(n)
    total = F.sum("_n").over(Window.orderBy("_h").rowsBetween(Window.unboundedPreceding, 0))
    keys = keys.withColumn("_t", total).where(F.col("_t") <= chars).select("_h")
    return rows.join(F.broadcast(keys), "_h").dropDuplicates(["_h"]).orderBy("_h").drop("_h")


def stratified_sample(rows: DataFrame, id_col: str, by: str, n: int, chars: int) -> DataFrame:
    """At most n rows of (text, by, ...), no more than chars characters together, dealt to the values of by in turn.

    Each value, rare or frequent, gives its first row by md5 of id, text's hash and value, then each its second, and so on; what a
    value lacks goes to the others. Of frequent values only rows with small hashes are numbered, about 2 * n + 40 each, so that
    no window grows with the table. Repeated rows count once, null texts and values not at all; a text longer than chars is passed over.
    """
    h, size, total, turn, share = free_names(rows, "h", "size", "total", "turn", "share")
    key = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.xxhash64("text").cast("string"), F.col(by).cast("string")))
    rows = rows.where(F.col("text").isNotNull() & F.col(by).isNotNull()).withColumn(h, key)
    fit = rows.select(by, h, F.length("text").alias(size)).where(F.col(size) <= chars)
    counts = cut(fit.groupBy(by).agg((F.lit(2.0 * n + 40) / F.count(F.lit(1))).alias(share)))
    low = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    fit = fit.join(counts, by).where(low < F.col(share)).select(by, h, size).distinct()
    fit = fit.withColumn(turn, F.row_number().over(Window.partitionBy(by).orderBy(h))).where(F.col(turn) <= n)
    chosen = fit.orderBy(turn, h).limit(n)
    running = F.sum(size).over(Window.orderBy(turn, h).rowsBetween(Window.unboundedPreceding, 0))
    chosen = chosen.withColumn(total, running).where(F.col(total) <= chars).select(h, turn)
    return rows.join(F.broadcast(chosen), h).dropDuplicates([h]).orderBy(turn, h).drop(h, turn)
