"""Joins that count what they lose and stop at what must not be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .shared import free_names


def with_hit(left: DataFrame, right: DataFrame, keys: list[str], hit: str) -> DataFrame:
    return left.join(right.withColumn(hit, F.lit(True)), keys, "left")


def counted_join(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, Observation]:
    """The inner join, and an observation that after the first action holds n_rows (with a partner) and n_missed.

    Both are counted in the pass that writes the join. Rows with a null key have no partner.
    """
    (hit,) = free_names(left.columns + right.columns, "hit")
    seen = Observation()
    out = with_hit(left, right, keys, hit).observe(seen, F.count_if(F.col(hit).isNotNull()).alias("n_rows"), F.count_if(F.col(hit).isNull()).alias("n_missed"))
    return out.where(F.col(hit).isNotNull()).drop(hit), seen


def join_counts(left: DataFrame, right: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """by, n_rows, n_missed: how many rows of left have a partner, and how many have none."""
    (hit,) = free_names(left.columns + right.columns, "hit")
    marked = with_hit(left, right.select(*keys), keys, hit)
    return marked.groupBy(*by).agg(F.count_if(F.col(hit).isNotNull()).alias("n_rows"), F.count_if(F.col(hit).isNull()).alias("n_missed"))


def asserted(df: DataFrame, holds: Column, message: str, *shown: str) -> DataFrame:
    """df; whatever reads it fails at the first row for which holds isn't true (null counts as false), and names the columns shown."""
    (ok,) = free_names(df.columns, "ok")
    told = F.concat(F.lit(message), *[x for c in shown for x in (F.lit(f" {c}="), F.coalesce(F.col(c).cast("string"), F.lit("null")))])
    checked = F.when(F.coalesce(holds, F.lit(False)), F.lit(True)).otherwise(F.raise_error(told).cast("boolean"))
    return df.withColumn(ok, checked).where(F.col(ok)).drop(ok)


def asserted_join(left: DataFrame, right: DataFrame, keys: list[str], same: dict[str, str], message: str = "columns differ:") -> DataFrame:
    """The inner join, in which each column of left that same names equals its column of right, null only where both are."""
    joined = left.join(right, keys)
    holds = F.lit(True)
    for a, b in same.items():
        holds = holds & F.col(a).eqNullSafe(F.col(b))
    return asserted(joined, holds, message, *keys, *same, *same.values())


def restricted_to(df: DataFrame, cell: dict[str, object]) -> DataFrame:
    """Rows whose columns equal a cell's values; null equals null."""
    holds = F.lit(True)
    for name, value in cell.items():
        holds = holds & F.col(name).eqNullSafe(F.lit(value))
    return df.where(holds)


def in_cells(df: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys, all together, are a row of cells; null equals null."""
    names = free_names(df.columns, *keys)
    other = cells.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).distinct()
    holds = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        holds = holds & F.col(k).eqNullSafe(F.col(n))
    return df.join(other, holds, "left_semi")


def with_fallback(df: DataFrame, texts: DataFrame, keys: list[str], text: str, fallback: str, name: str) -> DataFrame:
    """df with name: the text of its key, or, where there is none or it is blank, the column fallback. The last text of a key by the text's order counts once."""
    (got,) = free_names(df.columns + keys, "got")
    one = texts.groupBy(*keys).agg(F.max(text).alias(got))
    return df.join(one, keys, "left").withColumn(name, F.coalesce(F.nullif(F.col(got), F.lit("")), F.col(fallback))).drop(got)
