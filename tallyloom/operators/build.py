"""The public build, the release's rows and its gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import schools as H
from tallyloom.functions import text as X

#: Statuses that stay, codes for no grade, labels of types and settings, and what marks totals.
OPERATING = ("Open", "New", "Added", "Changed Boundary/Agency", "Reopened")
NO_GRADE = ("N", "M")
TYPES = {"Regular School": "Regular", "Special Education School": "Special Education", "Career and Technical School": "Vocational", "Alternative School": "Other/Alternative"}
LOCALES = {
    "11": "City, Large", "12": "City, Midsize", "13": "City, Small", "21": "Suburban, Large", "22": "Suburban, Midsize", "23": "Suburban, Small",
    "31": "Town, Fringe", "32": "Town, Distant", "33": "Town, Remote", "41": "Rural, Fringe", "42": "Rural, Distant", "43": "Rural, Remote",
}
TOTAL, ADULT, FREE, REDUCED, DIRECT = "Education Unit Total", "Adult Education", "Free lunch qualified", "Reduced-price lunch qualified", "Direct Certification"


def count_text(c: Column) -> Column:
    """A count as text: whole, or with two decimals; '' for codes below zero and for what is no number."""
    v = c.try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (v < 0), "").when(v == F.floor(v), v.cast("long").cast("string")).otherwise(F.format_string("%.2f", v))


def last_where(value: str, holds: Column) -> Column:
    """The value of the last row (by ordinal) for which holds."""
    return F.max_by(F.when(holds, F.col(value)), F.when(holds, F.col("ordinal")))


def public_build(directory: DataFrame, membership: DataFrame, staff: DataFrame, lunch: DataFrame, places: DataFrame) -> DataFrame:
    """One row per operating school of the directory, with counts, ratio, lunch and place; all text, '' for missing.

    All tables have school and ordinal. directory: status, low, high, charter, type, state, location_state;
    membership: grade, count, indicator; staff: teachers, indicator; lunch: data_group, program, count;
    places: locale, county, lat, lon. Of repeated rows the last counts.
    """
    m = membership.groupBy("school").agg(last_where("count", F.col("indicator") == TOTAL).alias("total"), last_where("count", F.startswith("indicator", F.lit("Subtotal 4")) & (F.col("grade") == ADULT)).alias("adult"))
    t = staff.groupBy("school").agg(last_where("teachers", F.col("indicator") == TOTAL).alias("teachers"))
    direct = F.col("data_group") == DIRECT
    u = lunch.groupBy("school").agg(last_where("count", ~direct & (F.col("program") == FREE)).alias("free"), last_where("count", ~direct & (F.col("program") == REDUCED)).alias("reduced"), last_where("count", direct).alias("direct"))
    p = places.groupBy("school").agg(F.max_by(F.struct("locale", "county", "lat", "lon"), "ordinal").alias("p"))
    d = directory.where(F.col("status").isin(*OPERATING))
    for side in (m, t, u, p):
        d = d.join(side, "school", "left")
    n, a = count_text(F.col("total")), count_text(F.col("adult"))
    students = F.when((n != "") & (a != ""), (n.try_cast("double") - a.try_cast("double")).cast("long").cast("string")).otherwise(n)
    d = d.withColumns({"students": count_text(students), "fte": count_text(F.col("teachers")), "locale": F.trim(H.blank(F.col("p.locale")))})
    x, y = F.col("students").try_cast("double"), F.col("fte").try_cast("double")
    grade = lambda c: F.when(F.col(c).isin(*NO_GRADE), "").otherwise(H.blank(F.col(c)))
    return d.select(
        "school",
        grade("low").alias("low_grade"),
        grade("high").alias("high_grade"),
        F.when(H.blank(F.col("location_state")) != "", F.col("location_state")).otherwise(H.blank(F.col("state"))).alias("state"),
        H.blank(F.col("p.county")).alias("county"),
        F.col("locale").alias("locale_code"),
        F.coalesce(H.lookup(LOCALES, F.col("locale")), F.lit("")).alias("locale"),
        F.when(F.col("charter").isin("Yes", "No"), F.col("charter")).otherwise("").alias("charter"),
        "students",
        F.col("fte").alias("teachers"),
        F.when((x > 0) & (y > 0), F.format_string("%.2f", x / y)).otherwise("").alias("ratio"),
        *[count_text(F.col(c)).alias(c) for c in ("free", "reduced", "direct")],
        F.coalesce(H.lookup(TYPES, F.col("type")), H.blank(F.col("type"))).alias("type"),
        "status",
    )


def skipped_by_status(directory: DataFrame) -> DataFrame:
    return directory.where(~F.coalesce(F.col("status").isin(*OPERATING), F.lit(False))).groupBy("status").count()


#: Where an article's page is, and the two licenses.
PAGE, ARTICLE_LICENSE, RECORD_LICENSE = "https://en.wikipedia.org/wiki/", "CC-BY-SA-4.0", "CC0-1.0"


def release_rows(generated: DataFrame, matches: DataFrame, texts: DataFrame, min_chars: int, source: str = "NCES") -> DataFrame:
    """generated (id, name, state, sector, text) with the matched article's text where policy allows, and why not where it doesn't.

    matches: (id, page, title, qid); texts: (page, title, text, revision). reason: '' if there is no match or the article
    is taken; else no_text, short_text or closed_school.
    """
    t = texts.select("page", F.col("title").alias("page_title"), F.col("text").alias("page_text"), "revision")
    d = generated.join(matches.select("id", "page", "title", "qid"), "id", "left").join(t, "page", "left")
    text = F.col("page_text")
    reason = F.when(F.col("page").isNull(), "").when(H.blank(text) == "", "no_text").when(F.length(text) < min_chars, "short_text").when(X.closed_opening(text, any_case=True), "closed_school").otherwise("")
    d = d.withColumn("reason", reason).withColumn("taken", F.col("page").isNotNull() & (F.col("reason") == ""))
    title = F.when(H.blank(F.col("page_title")) != "", F.col("page_title")).otherwise(H.blank(F.col("title")))
    either = lambda a, b: F.when(F.col("taken"), a).otherwise(b)
    return d.select(
        "id", "name", "state", "sector", either(text, F.col("text")).alias("text"), F.col("taken").cast("tinyint").alias("from_article"),
        either(title, F.lit("")).alias("title"), either(H.blank(F.col("qid")), F.lit("")).alias("qid"), either(H.blank(F.col("revision").cast("string")), F.lit("")).alias("revision"),
        either(F.concat(F.lit(PAGE), F.replace(title, F.lit(" "), F.lit("_"))), F.lit(source)).alias("source"), either(F.lit(ARTICLE_LICENSE), F.lit(RECORD_LICENSE)).alias("license"), "reason",
    )


FIELDS = ["id", "name", "state", "sector", "text", "from_article", "title", "qid", "revision", "source", "license"]


def release_gate(rows: DataFrame, spans: DataFrame, *, expect: int = 0, baseline: DataFrame | None = None, max_delta: float = 0.05, card: str | None = None) -> DataFrame:
    """(check, ok, n_bad, examples): the checks that a release passes, with five examples at most of what fails.

    spans: (id, span_levels), the first of an id by order counts. Row checks are one pass; keys, titles and states are counted
    by themselves. A null state is one of its own, on both sides.
    """
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    mine = F.col("from_article") == 1
    said = lambda c: H.blank(F.col(c)) != ""
    provenance = F.when(mine, said("title") & said("qid") & said("revision") & F.startswith("source", F.lit(PAGE)) & (F.col("license") == ARTICLE_LICENSE)).otherwise((F.col("from_article") == 0) & ~said("title") & ~said("qid") & ~said("revision") & F.startswith("source", F.lit("NCES")) & (F.col("license") == RECORD_LICENSE))
    level = H.overlap_or_open(H.name_levels(X.norm_name(F.col("title"))), F.coalesce("span_levels", F.array().cast("array<string>")))
    good = {
        "key_present": key != "",
        "sector_and_state": F.col("sector").isin("public", "private") & F.col("state").rlike("^[A-Z]{2}$"),
        "text_present": F.trim(F.col("text")) != "",
        "no_markup": ~mine | ~X.has_markup(F.col("text")),
        "provenance": provenance,
        "level_fits": ~mine | level,
    }
    marks = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(n).alias("check"), key.alias("example"))) for n, ok in good.items()]))
    bad = rows.join(spans.groupBy("id").agg(F.min("span_levels").alias("span_levels")), "id", "left").select(F.explode(marks).alias("b")).select("b.*")
    keys = rows.groupBy(key.alias("example")).count().where("count > 1").select(F.lit("key_unique").alias("check"), "example")
    titles = rows.where(mine).groupBy("title").count().where("count > 1").select(F.lit("one_article_per_school").alias("check"), F.concat("title", F.lit(" x"), "count").alias("example"))
    bad = bad.unionByName(keys).unionByName(titles)
    names = [*good, "key_unique", "one_article_per_school"]
    if baseline is not None:
        of = lambda d, name: d.groupBy(F.coalesce("state", F.lit("none")).alias("state")).agg(F.count(F.lit(1)).alias(name))
        both = of(baseline, "old").join(of(rows, "new"), "state", "full").na.fill(0, ["old", "new"])
        moved = (F.abs((F.col("new") - F.col("old")) / F.greatest("old", F.lit(1))) > max_delta) & (F.greatest("old", "new") >= 20)
        bad = bad.unionByName(both.where(moved).select(F.lit("state_counts").alias("check"), F.concat("state", F.lit(" "), "old", F.lit(" -> "), "new").alias("example")))
        names.append("state_counts")
    w = Window.partitionBy("check").orderBy("example")
    some = bad.withColumn("n", F.row_number().over(w)).where("n <= 5").groupBy("check").agg(F.array_sort(F.collect_list("example")).alias("examples"))
    counts = bad.groupBy("check").agg(F.count(F.lit(1)).alias("n_bad")).join(some, "check")
    wide = [f"{c}:{'tinyint' if c == 'from_article' else 'string'}" for c in FIELDS]
    have = {f"{f.name}:{f.dataType.simpleString()}" for f in rows.schema}
    missing = [f for f in wide if f.split(":")[0] != "id" and f not in have]
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    fixed = [("schema", len(missing), missing[:5])]
    more = n.select(F.lit("rows").alias("check"), F.greatest(F.lit(expect) - F.col("n"), F.lit(0)).alias("n_bad"), F.array(F.col("n").cast("string")).alias("examples"))
    if card is not None:
        shown = F.startswith(F.lit(card), F.lit("---")) & ~F.contains(F.lit(card), F.lit("@@")) & F.contains(F.lit(card), F.format_number("n", 0))
        more = more.unionByName(n.select(F.lit("card").alias("check"), F.when(shown, F.lit(0).cast("long")).otherwise(1).alias("n_bad"), F.array().cast("array<string>").alias("examples")))
    every = rows.sparkSession.createDataFrame([(x,) for x in names], "check string").join(counts, "check", "left")
    out = every.select("check", F.coalesce("n_bad", F.lit(0).cast("long")).alias("n_bad"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))
    out = out.unionByName(rows.sparkSession.createDataFrame(fixed, "check string, n_bad bigint, examples array<string>")).unionByName(more)
    return out.select("check", (F.col("n_bad") == 0).alias("ok"), "n_bad", "examples")
