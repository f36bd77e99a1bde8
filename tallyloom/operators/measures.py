"""Closed-form statistics on columns and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_names, running_totals


def ratio(a: Column, b: Column) -> Column:
    """a / b where b isn't 0, in double; else null."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = ratio(hits, n)
    m = n.cast("double")
    mid, half, d = p + z * z / 2 / m, z * F.sqrt(p * (1 - p) / m + F.lit(z * z / 4) / (m * m)), 1 + F.lit(z * z) / m
    return (mid - half) / d, (mid + half) / d


def quantiles(df: DataFrame, value: str, at: list[float], by: list[str] | None = None, name: str = "quantiles") -> DataFrame:
    """by and name: the exact quantiles of each group, interpolated; nulls are left out, a group without values isn't there.

    Equal values are counted, the counts summed up in order by ranges, and each quantile's two neighbours are picked by their
    places: no buffer holds a group's values.
    """
    by = by or []
    v, n, first, total = free_names(by, "v", "n", "first", "total")
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias(v)).agg(F.count(F.lit(1)).alias(n))
    placed = running_totals(counts, by, [v], n, first)
    keys = free_names([*by, v, n, first, total], *by)
    totals = counts.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]).agg(F.sum(n).alias(total))
    same = F.lit(True)
    for c, k in zip(by, keys, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(k))
    placed = placed.join(totals, same) if by else placed.crossJoin(F.broadcast(totals))  # one row
    picks = []
    for p in at:
        place = F.lit(p) * (F.col(total) - 1)
        low, high = F.floor(place), F.ceil(place)
        value_at = lambda i: F.max(F.when(F.col(first) <= i, F.col(v)))
        picks += [value_at(low), value_at(high), F.max(place - low)]
    got = placed.groupBy(*by).agg(*[c.alias(f"q{i}") for i, c in enumerate(picks)], F.count(F.lit(1)).alias("rows"))
    between = [F.when(F.col(f"q{3 * i + 2}") == 0, F.col(f"q{3 * i}")).otherwise((1 - F.col(f"q{3 * i + 2}")) * F.col(f"q{3 * i}") + F.col(f"q{3 * i + 2}") * F.col(f"q{3 * i + 1}")) for i in range(len(at))]
    return got.where(F.col("rows") > 0).select(*by, F.array(*between).alias(name))


def quantile_bins(df: DataFrame, value: str, n: int, name: str = "bin") -> DataFrame:
    """Right-closed bins between exact quantiles; equal values share a bin, the lowest edge is in bin 1. Without any value no row has a bin."""
    (e,) = free_names(df.columns, "edges")
    edges = quantiles(df, value, [i / n for i in range(1, n)], name=e)  # one row
    above = F.when(F.col(value).isNotNull(), (F.size(F.filter(e, lambda x: F.col(value) > x)) + 1).cast("int"))
    return df.join(F.broadcast(edges), F.lit(True), "left").withColumn(name, above).drop(e)


def average_rank(order: str, *by: str) -> Column:
    """Ranks with ties averaged."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, order)) - 1) / F.lit(2.0)


def with_average_rank(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """df with the ranks of value among its group, ties averaged: ranks are summed over counts of equal values, and rows meet theirs in a join.

    Neither a group's rows nor its distinct values are one task.
    """
    v, n, first = free_names([*df.columns, name], "v", "n", "first")
    keys = free_names([*df.columns, name, v, n, first], *by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias(v)).agg(F.count(F.lit(1)).alias(n))
    counts = running_totals(counts, by, [v], n, first)
    ranks = counts.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], v, (F.col(first) + (F.col(n) + 1) / F.lit(2.0)).alias(name))
    on = F.col(value) == F.col(v)
    for c, k in zip(by, keys, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(k))
    return df.join(ranks, on, "left").select(*df.columns, name)


def kappa(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """by, n, exact agreement, agreement within one, quadratic-weighted kappa of two integer ratings, over rows that have both.

    kappa is null where chance alone gives no disagreement: all rows have one and the same rating.
    """
    d = F.col(a).cast("double") - F.col(b).cast("double")
    s = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by or []).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(d == 0).alias("same"), F.count_if(F.abs(d) <= 1).alias("close"), F.sum(d * d).alias("dd"),
        F.sum(F.col(a).cast("double")).alias("sa"), F.sum(F.col(b).cast("double")).alias("sb"),
        F.sum(F.pow(F.col(a).cast("double"), 2)).alias("saa"), F.sum(F.pow(F.col(b).cast("double"), 2)).alias("sbb"),
    )
    chance = F.col("saa") + F.col("sbb") - 2 * F.col("sa") * F.col("sb") / F.col("n")
    return s.select(*by or [], "n", ratio(F.col("same"), F.col("n")).alias("exact"), ratio(F.col("close"), F.col("n")).alias("within_one"), F.when(chance != 0, 1 - F.col("dd") / chance).alias("kappa"))


def confusion(df: DataFrame, a: str, b: str, ratings: list[int], by: list[str] | None = None) -> DataFrame:
    """by, a, and a column r_<rating> for each rating of b: how often b has it where a has this; rows without both are left out.

    Each group has a line for every rating, with zeros where a never has it; ratings outside the list aren't counted.
    """
    by = by or []
    (rating,) = free_names([*df.columns, *by], "rating")
    valid = df.where(F.col(a).isin(ratings) & F.col(b).isin(ratings))
    cells = valid.groupBy(*by, a).agg(*[F.count_if(F.col(b) == r).alias(f"r_{r}") for r in ratings])
    columns = [f"r_{r}" for r in ratings]
    lines = F.explode(F.array(*[F.lit(r) for r in ratings])).alias(rating)
    groups = cells.select(*by).distinct() if by else cells.groupBy().agg(F.count(F.lit(1)).alias(rating)).where(F.col(rating) > 0)
    whole = groups.select(*by, lines)
    empty = whole.select(*by, F.col(rating).alias(a), *[F.lit(0).cast("long").alias(c) for c in columns])
    return cells.select(*by, F.col(a).cast("int").alias(a), *columns).union(empty).groupBy(*by, a).agg(*[F.sum(c).alias(c) for c in columns])


def smd(df: DataFrame, flag: str, value: str) -> DataFrame:
    """Standardised mean difference between flag 1 and 0, by sample variances."""
    g = lambda f, v: f(F.when(F.col(flag) == v, F.col(value)))
    s = df.agg(g(F.avg, 1).alias("m1"), g(F.avg, 0).alias("m0"), g(F.var_samp, 1).alias("v1"), g(F.var_samp, 0).alias("v0"))
    return s.select("m1", "m0", ((F.col("m1") - F.col("m0")) / F.sqrt((F.col("v1") + F.col("v0")) / 2)).alias("smd"))
