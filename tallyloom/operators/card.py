"""A release's card: its numbers in one row, its text from a template, tables in Markdown, and runs of jobs with their size."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.schools import NAMES, lookup

from .measures import quantiles


def percent(part: Column, whole: Column) -> Column:
    return F.format_string("%.1f", 100 * part.cast("double") / F.greatest(whole, F.lit(1)))


def named_shares(items: Column) -> Column:
    """array<struct<share, state>> as "1.2% (Ohio), 3.0% (Utah) and 4.5% (Iowa)"; n/a for none."""
    shown = F.transform(items, lambda x: F.concat(F.format_string("%.1f", 100 * x["share"]), F.lit("% ("), F.coalesce(lookup(NAMES, x["state"]), x["state"]), F.lit(")")))
    n = F.size(shown)
    most = F.concat(F.array_join(F.slice(shown, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.try_element_at(shown, F.lit(-1)))
    return F.when(n == 0, "n/a").when(n == 1, F.get(shown, 0)).otherwise(most)


def date_range(dates: Column) -> tuple[Column, Column]:
    """Aggregates: the first and last day of ISO dates; blank ones don't count."""
    day = F.nullif(F.substring(dates, 1, 10), F.lit(""))
    return F.min(day), F.max(day)


def card_values(rows: DataFrame, texts: DataFrame, methods: tuple[str, ...], least: int = 100) -> DataFrame:
    """One row of text columns for a card's places.

    rows: (id, state, sector, text, from_article, title, method, reason); texts: (title, fetched_at). States of at least least
    rows are compared by their share of articles, ties by code.
    """
    mine = F.col("from_article") == 1
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    whole = rows.agg(
        F.count(F.lit(1)).alias("n"), count(mine).alias("articles"), count(F.col("method").isin(*methods)).alias("matched"), count(F.col("sector") == "public").alias("public"), count(F.col("sector") == "private").alias("private"),
        F.count_distinct(F.coalesce("state", F.lit(""))).alias("states"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), count(F.col("reason") == "closed_school").alias("closed"), count(F.col("reason").isin("no_text", "short_text")).alias("without"),
        *[count(F.col("method") == m).alias(f"m_{m}") for m in methods],
    )
    per = rows.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("from_article"), F.lit(0)).alias("k")).where(F.col("n") >= least)
    every = F.sort_array(F.collect_list(F.struct((F.col("k") / F.col("n")).alias("share"), "state")))  # a state each
    cover = per.agg(every.alias("all")).select(named_shares(F.slice("all", 1, 3)).alias("coverage_low"), named_shares(F.slice("all", F.greatest(F.size("all") - 1, F.lit(1)), F.lit(2))).alias("coverage_high"))
    used = rows.where(mine).select("title").distinct()
    first, last = date_range(F.col("fetched_at"))
    days = texts.join(used, "title", "left_semi").agg(first.alias("a"), last.alias("b"))
    fetched = days.select(F.when(F.col("a").isNull(), "n/a").when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.concat("a", F.lit(" to "), "b")).alias("fetched"))
    lengths = quantiles(rows.select(F.coalesce("from_article", F.lit(0)).alias("k"), F.length("text").alias("chars")), "chars", [0.5], ["k"], "q")
    middle = lengths.agg(*[F.coalesce(F.format_number(F.bround(F.max(F.when(F.col("k") == v, F.get("q", 0))), 0), 0), F.lit("n/a")).alias(name) for v, name in ((1, "median_articles"), (0, "median_records"))])
    n = F.col("n")
    number = lambda c: F.format_number(F.col(c), 0).alias(c)
    one = whole.select(
        F.format_number("n", 0).alias("rows"), number("articles"), percent(F.col("articles"), n).alias("articles_percent"), F.format_number(n - F.col("articles"), 0).alias("records"), percent(F.col("matched"), n).alias("matched_percent"),
        number("public"), number("private"), F.col("states").cast("string").alias("states"), F.format_string("%.1f", F.col("chars") / 1e6).alias("text_m"), number("closed"), number("without"), *[number(f"m_{m}") for m in methods],
    )
    return one.crossJoin(F.broadcast(cover)).crossJoin(F.broadcast(fetched)).crossJoin(F.broadcast(middle))  # one row each


def render_card(template: str, values: Mapping[str, str]) -> str:
    """template with each @@name@@ filled in, without its own comment; a place that stays is an error."""
    text = re.sub(r"<!-- Template:.*?-->\n", "", template, flags=re.S)
    text = re.sub(r"@@(\w+)@@", lambda m: str(values[m[1]]) if m[1] in values else m[0], text)
    left = sorted(set(re.findall(r"@@(\w+)@@", text)))
    if left:
        raise ValueError(f"unfilled: {', '.join(left)}")
    return text


def markdown_rows(df: DataFrame, decimals: int = 3) -> DataFrame:
    """A column line: each row of df as a row of a Markdown table, numbers with so many decimals, nulls blank."""
    shown = lambda c, t: F.format_string(f"%.{decimals}f", F.col(c)) if t in ("double", "float") else F.col(c).cast("string")
    cells = [F.when(F.col(c).isNotNull(), shown(c, t)).otherwise("") for c, t in df.dtypes]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown, in the order it has; more than most rows are an error."""
    lines = [r.line for r in markdown_rows(df).limit(most + 1).collect()]
    if len(lines) > most:
        raise ValueError(f"over {most} rows")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *lines])


def jobs(rows: DataFrame, key: str, models: list[str], tasks: list[str], repeats: int, done: DataFrame | None = None) -> DataFrame:
    """key, model, task, rep of every call that isn't done; done: the same columns and error, a row with an error isn't done."""
    kinds = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(t).alias("task"), F.lit(k).alias("rep")) for m in models for t in tasks for k in range(repeats)])
    every = rows.select(key).distinct().select(key, F.inline(kinds))
    if done is None:
        return every
    good = done.where(F.coalesce("error", F.lit("")) == "").select(key, "model", F.coalesce("task", F.lit("facts")).alias("task"), F.coalesce("rep", F.lit(0)).alias("rep"))
    return every.join(good.distinct(), [key, "model", "task", "rep"], "left_anti")


def estimate(todo: DataFrame, *, tokens_in: int = 350, tokens_out: int = 250) -> DataFrame:
    """model, task, calls, tokens_in, tokens_out of what is to do."""
    n = todo.groupBy("model", "task").agg(F.count(F.lit(1)).alias("calls"))
    return n.select("model", "task", "calls", (F.col("calls") * tokens_in).alias("tokens_in"), (F.col("calls") * tokens_out).alias("tokens_out"))


def statuses(asked: str | None) -> tuple[str, ...] | None:
    """"school, unverified" as its names; None, no filter, for all or nothing."""
    names = tuple(sorted({x.strip() for x in (asked or "").split(",")} - {""}))
    return None if not names or "all" in names else names


def with_status(df: DataFrame, column: str, asked: str | None) -> DataFrame:
    names = statuses(asked)
    return df if names is None else df.where(F.col(column).isin(*names))


def prominence(matches: DataFrame, enriched: DataFrame, articles: DataFrame, *, now: int = 2026) -> DataFrame:
    """id, views, log_views, log_chars, age, has_website of each matched record.

    matches: (id, page, ordinal), the first of an id counts; enriched: (page, views, founded, website); articles: (page, chars).
    An age is known for years after 1600 up to now.
    """
    m = matches.groupBy("id").agg(F.min_by("page", "ordinal").alias("page"))
    d = m.join(enriched.dropDuplicates(["page"]), "page", "left").join(articles.groupBy("page").agg(F.max("chars").alias("chars")), "page", "left")
    views = F.col("views").try_cast("double")
    year = F.nullif(F.regexp_extract("founded", "([0-9]{4})", 1), F.lit("")).cast("int")
    chars = F.col("chars").cast("double")
    return d.select(
        "id", views.alias("views"), F.log1p(views).alias("log_views"), F.when(chars > 0, F.log(chars)).alias("log_chars"),
        F.when((year > 1600) & (year <= now), F.lit(now) - year).alias("age"), F.coalesce(F.length("website") > 3, F.lit(False)).alias("has_website"),
    )


def entity_facts(matches: DataFrame, items: DataFrame, trusted: tuple[str, ...] = ("id", "id_stale", "name_state")) -> DataFrame:
    """id, json {q, f, u}: the entity, its year and website, of records that a trusted tier matched; empty fields are left out.

    matches: (id, qid, method, ordinal), the last of an id counts; items: (qid, tag, founded, website, ordinal), of those that are schools the last of a qid.
    """
    school = items.where((F.col("tag") == "school") & (F.coalesce("qid", F.lit("")) != "")).groupBy("qid").agg(F.max_by(F.struct("founded", "website"), "ordinal").alias("x"))
    d = matches.where(F.col("method").isin(*trusted)).join(school, "qid")
    founded = F.when(F.col("x.founded").rlike("^[0-9]+$"), F.col("x.founded"))
    site = F.when(F.col("x.website").rlike("^https?://"), F.col("x.website"))
    return d.groupBy("id").agg(F.max_by(F.to_json(F.struct(F.col("qid").alias("q"), founded.alias("f"), site.alias("u"))), "ordinal").alias("json"))
