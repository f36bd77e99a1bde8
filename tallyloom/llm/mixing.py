"""Mixing sources to target weights by systematic sampling.

Every source has a target in words. Each of its documents is expected target / size-of-source times, at
most max_repeats. The documents of a source stand in one order; expected copies are summed up along it, one
offset in [0, 1) is added, and a document is taken once for each integer that its step crosses. The order is
by size, then md5 of the id. Of neighbours in that order one is taken a word more often where the other is a word
less, so the words taken from a source differ from its target by less than twice the size of its largest document.

Positions come in levels, none of which is one task over a source: counts of (source, size class), of sizes within a
class, of the first two hex digits of the md5 within a size, and row numbers within those.

A null text has size 0; a null source is a source, the last one. Rows that repeat, or share an id, are taken each by
itself. An empty table gives no rows. Other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, free_names

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[float, ...], max_repeats: float) -> DataFrame:
    """One row (key, source, size) per source -> also target: the weights' share of all words, by water filling.

    The only window over all rows here is over one row per source.
    """
    n = len(weights)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % n + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("cap", F.col("size") * F.lit(float(max_repeats)))
    by_room = Window.orderBy(F.col("cap") / F.col("w"), F.col("key"))
    every = Window.partitionBy(F.lit(0))
    s = s.withColumn("cap_before", F.sum("cap").over(by_room) - F.col("cap")).withColumn("w_before", F.sum("w").over(by_room) - F.col("w"))
    s = s.withColumn("level", (F.sum("size").over(every).cast("double") - F.col("cap_before")) / (F.sum("w").over(every) - F.col("w_before")))
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(every))
    return s.select("key", "source", F.col("size").alias("source_size"), F.least("cap", F.col("level") * F.col("w")).alias("target"))


def positions(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """rows (key, size, digest, ...) -> also position, from 1 within key by size and digest, and the columns of their source's target.

    The rows meet their source's columns by (key, size, digits), never by the key alone.
    """
    bits = F.bin("size")
    band = F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 2, 2))
    fine = rows.withColumn("d2", F.substring("digest", 1, 2))
    cells = cut(fine.groupBy("key", "size", "d2").agg(F.count(F.lit(1)).alias("n")).withColumn("band", band))
    sizes = cells.groupBy("key", "band", "size").agg(F.sum("n").alias("n"))
    bands = sizes.groupBy("key", "band").agg(F.sum("n").alias("n"))
    before = lambda *by: F.sum("n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1])) - F.col("n")
    bands = bands.select("key", "band", before("key", "band").alias("b1")).join(targets, "key")
    sizes = sizes.select("key", "band", "size", before("key", "band", "size").alias("b2")).join(bands, ["key", "band"])
    cells = cells.select("key", "size", "d2", before("key", "size", "d2").alias("b3")).join(sizes, ["key", "size"])
    cells = cells.withColumn("before", F.col("b1") + F.col("b2") + F.col("b3")).drop("band", "b1", "b2", "b3")
    order = [c for c in ("digest", "row") if c in rows.columns]
    row = F.row_number().over(Window.partitionBy("key", "size", "d2").orderBy(*order))
    out = fine.withColumn("rank", row).join(cells, ["key", "size", "d2"])
    return out.withColumn("position", F.col("rank") + F.col("before")).drop("d2", "rank", "before")


def unit_offset(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a key and a seed, the same on each run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    max_repeats: float = 3,
    seed: int = 42,
    row_col: str | None = None,
) -> DataFrame:
    """One row per row of docs: id, size, source_size, target of its source, copies, taken (words, repeats counted).

    row_col: a column of docs that tells rows apart where ids don't; it is then given back as well.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    row = [F.col(row_col).alias("row")] if row_col else []
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), *row))
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    rows = rows.withColumns({"key": key, "digest": F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))})
    sizes = rows.groupBy("key", "source").agg(F.sum("size").alias("size"))
    targets = source_targets(sizes, weights, max_repeats).drop("source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("rate", rate).withColumn("u", unit_offset(F.col("key"), seed))
    at = positions(rows.drop("source"), targets)
    copies = F.floor(F.col("rate") * F.col("position") + F.col("u")) - F.floor(F.col("rate") * (F.col("position") - 1) + F.col("u"))
    out = [F.col("id").alias(id_col), "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken")]
    return at.select(*out, *([F.col("row").alias(row_col)] if row_col else []))


def emit_copies(docs: DataFrame, mixed: DataFrame, *, row_col: str) -> DataFrame:
    """docs with each row as often as mixed says, matched by row_col, which tells all rows apart. A copy keeps all columns."""
    copies, key = free_names(docs, "copies", "mixed_row")
    m = mixed.select(F.col(row_col).alias(key), F.col("copies").alias(copies)).where(F.col(copies) > 0)
    both = docs.join(m, F.col(row_col) == F.col(key))
    return both.withColumn(copies, F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


def mix_documents(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """docs with each row as often as mix_sources takes it; null and repeated ids are no matter, as rows get a key of their own."""
    row, = free_names(docs, "mix_row")
    keyed = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    return emit_copies(keyed, mix_sources(keyed, id_col=id_col, row_col=row, **options), row_col=row).select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), r AS (
  SELECT *, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS key,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM d
), s AS (
  SELECT key, source, CAST(sum(size) AS BIGINT) AS size FROM r GROUP BY key, source
), w AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w, CAST(size AS DOUBLE) * 3.0 AS cap FROM s
), f AS (
  SELECT *, (CAST(sum(size) OVER () AS DOUBLE) - (sum(cap) OVER o - cap)) / (sum(w) OVER () - (sum(w) OVER o - w)) AS level
  FROM w WINDOW o AS (ORDER BY cap / w, key)
), l AS (
  SELECT max(level) AS level FROM f WHERE level <= cap / w
), t AS (
  SELECT key, f.size AS source_size, least(cap, l.level * w) AS target FROM f, l
), p AS (
  SELECT doc_id, size, key, row_number() OVER (PARTITION BY key ORDER BY size, digest) AS k FROM r
), c AS (
  SELECT p.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    CAST(CAST('0x' || substr(md5('42:' || p.key), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM p JOIN t ON p.key = t.key
)
SELECT doc_id, size, source_size, target, CAST(floor(rate * k + u) - floor(rate * (k - 1) + u) AS BIGINT) AS copies,
  CAST(floor(rate * k + u) - floor(rate * (k - 1) + u) AS BIGINT) * size AS taken
FROM c
"""
