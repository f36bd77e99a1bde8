"""Duplicate handling, claims and remainders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_names


def pick_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by order: first wins (ascending ordinal) or last wins (descending)."""
    (n,) = free_names(df.columns, "n")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n)


def first_wins_upgraded(df: DataFrame, keys: list[str], order: list[str], field: str, weak: tuple[str, ...]) -> DataFrame:
    """One row per key, the first by order (no two rows of a key share it), but its field is taken on from later rows while it is weak.

    A null counts as blank, and blank is weak. While what is kept is weak, the next value that isn't blank replaces it; so the
    first strong value stands, or else the last that isn't blank. Three ordered aggregates over one shuffle.
    """
    at = F.struct(*order)
    value = F.coalesce(F.col(field), F.lit(""))
    strong = ~value.isin("", *weak)
    row = F.min_by(F.struct(*df.columns), at).alias("row")
    first = F.min_by(F.when(strong, value), F.when(strong, at)).alias("first")
    last = F.max_by(F.when(value != "", value), F.when(value != "", at)).alias("last")
    got = df.select(*df.columns).groupBy(*[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)]).agg(row, first, last)
    return got.select(*[F.coalesce("first", "last", F.lit("")).alias(c) if c == field else F.col("row")[c].alias(c) for c in df.columns])


def claim_resolution(df: DataFrame, target: str, order: list[Column]) -> DataFrame:
    """The winning claim of each target, and n_losers; losers are not tried elsewhere."""
    (n,) = free_names(df.columns, "n")
    w = Window.partitionBy(target)
    return df.withColumns({n: F.row_number().over(w.orderBy(*order)), "n_losers": F.count(F.lit(1)).over(w) - 1}).where(F.col(n) == 1).drop(n)


def drop_all_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key no other row has."""
    (n,) = free_names(df.columns, "n")
    return df.withColumn(n, F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col(n) == 1).drop(n)


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose key is not among those done."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def flag(df: DataFrame, ids: DataFrame, key: str, name: str) -> DataFrame:
    """df with name = 1 where the key is among ids, else 0."""
    marked = ids.select(key).distinct().withColumn(name, F.lit(1))
    return df.join(marked, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def waterfall(items: DataFrame, tiers: list, key: str) -> DataFrame:
    """Matches of the first tier that has any for an item; each tier is a function of the items that are left."""
    left, out = items, None
    for name, tier in tiers:
        got = tier(left).withColumn("tier", F.lit(name))
        out = got if out is None else out.unionByName(got)
        left = left.join(got.select(key).distinct(), key, "left_anti")
    return out
