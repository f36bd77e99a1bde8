"""Matched stratified samples: room is shared out over cells, and in each cell treated rows take near controls one to one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, free_names, running_totals


def same(a: list[str], b: list[str]):  # noqa: ANN201
    """Columns a equal columns b, null equal to null."""
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & F.col(x).eqNullSafe(F.col(y))
    return out


def matched(df: DataFrame, other: DataFrame, cell: list[str], how: str = "inner") -> DataFrame:
    """df joined with other on the columns cell, null equal to null; other's are dropped."""
    names = free_names([*df.columns, *other.columns], *cell)
    renamed = other.select(*[F.col(c).alias(n) for c, n in zip(cell, names, strict=True)], *[c for c in other.columns if c not in cell])
    return df.join(renamed, same(cell, names), how).drop(*names)


def allocate(room: DataFrame, cell: list[str], n: int) -> DataFrame:
    """cell and take: n units dealt one to each cell in turn, in order, until a cell's room is used up; what it can't take goes to the others.

    room: one row a cell, with its room. In whole turns each cell takes as many as the highest level at which the sum stays within
    n; what is left goes to the first cells in order that have more room. Levels are found from counts of equal rooms.
    """
    sizes = room.where("room > 0").groupBy("room").agg(F.count(F.lit(1)).alias("cells"), F.sum("room").alias("units"))
    placed = running_totals(running_totals(sizes, [], ["room"], "cells", "cells_below"), [], ["room"], "units", "units_below")
    total = sizes.agg(F.coalesce(F.sum("cells"), F.lit(0)).alias("cells"), F.coalesce(F.sum("units"), F.lit(0)).alias("units")).first()
    if total.units <= n:
        return room.select(*cell, F.greatest("room", F.lit(0)).cast("long").alias("take"))
    # up to its own room r, a level l gives units_below + l * (cells not below); the first such r that passes n holds the level
    passing = placed.select((F.col("units_below") + F.col("room") * (total.cells - F.col("cells_below"))).alias("at"), "units_below", "cells_below").where(F.col("at") > n)
    first = passing.agg(F.min(F.struct("at", "units_below", "cells_below")).alias("x")).first().x
    level, left = divmod(n - first.units_below, total.cells - first.cells_below)
    (one,) = free_names([*room.columns, "take"], "one")
    more = running_totals(room.where(F.col("room") > level).select(*cell, F.lit(1).alias(one)), [], cell, one, "place").where(F.col("place") < left).select(*cell, F.lit(1).alias("extra"))
    out = matched(room, more, cell, "left")
    return out.select(*cell, (F.greatest(F.least("room", F.lit(level)), F.lit(0)) + F.coalesce("extra", F.lit(0))).cast("long").alias("take"))


def greedy(value: np.ndarray, ids: np.ndarray, treated: np.ndarray, order: np.ndarray, caliper: float) -> list[tuple[int, int]]:
    """Positions of (treated, control): in order each treated takes the nearest control that is left, ties by id, if it is within caliper."""
    pool = np.flatnonzero(~treated)
    pool = pool[np.argsort(ids[pool], kind="stable")]
    at, free = value[pool], np.ones(len(pool), bool)
    out = []
    for i in np.flatnonzero(treated)[np.lexsort((ids[treated], order[treated]))]:
        gap = np.where(free, np.abs(at - value[i]), np.inf)
        if len(gap) and gap.min() <= caliper:
            j = int(gap.argmin())
            free[j] = False
            out.append((int(i), int(pool[j])))
    return out


def matched_pairs(df: DataFrame, *, cell: list[str], treated: str, value: str, id_col: str, caliper: float, seed: int = 1, chunk_rows: int = 4096) -> DataFrame:
    """cell, a (treated), b (control), gap, order: pairs one to one within caliper, by id_col, which no two rows share.

    In a cell of at most chunk_rows rows treated rows, in the random order of a hash of seed and id, take the nearest control that is
    left. A larger cell is cut by value into runs of chunk_rows rows, in each of which this happens; the rows that are left
    are run together and cut anew, now at the middles, until neither cut finds a pair. Then no treated row has a free
    control within caliper, as after one sequential pass, and no task holds more than chunk_rows rows. Rows whose value is
    null or not a number, or whose treated is neither 0 nor 1, take no part.
    """
    spark = df.sparkSession
    named = [f"c{i}" for i in range(len(cell))]
    rows = df.select(*[F.col(c).alias(x) for c, x in zip(cell, named, strict=True)], F.col(id_col).alias("id"), F.col(value).cast("double").alias("v"), F.col(treated).cast("int").alias("t"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("order"))
    left = cut(rows.where(F.col("v").isNotNull() & ~F.isnan("v") & F.col("t").isin(0, 1) & F.col("id").isNotNull()))
    kinds = ", ".join(f"`{x}` {left.schema[x].dataType.simpleString()}" for x in named)
    kind = left.schema["id"].dataType.simpleString()
    columns = [*named, "a", "b", "gap", "order"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        v, ids, order = g["v"].to_numpy(float), g["id"].to_numpy(), g["order"].to_numpy(np.int64)
        pairs = greedy(v, ids, g["t"].to_numpy() == 1, order, caliper)
        return pd.DataFrame([(*[g[x].iloc[0] for x in named], ids[i], ids[j], abs(v[i] - v[j]), order[i]) for i, j in pairs], columns=columns)

    found, shift, idle = None, 0, 0
    while idle < 2:
        placed = running_totals(left.withColumn("one", F.lit(1)), named, ["v", "id"], "one", "place")
        sizes = left.groupBy(*named).agg(F.count(F.lit(1)).alias("rows"))
        placed = matched(placed, sizes, named)
        chunk = F.when(F.col("rows") <= chunk_rows, 0).otherwise(F.floor((F.col("place") + shift) / chunk_rows)).alias("chunk")
        new = cut(placed.select(*named, "id", "v", "t", "order", chunk).groupBy(*named, "chunk").applyInPandas(run, f"{kinds}, a {kind}, b {kind}, gap double, order bigint"))
        if new.isEmpty():
            idle += 1
        else:
            idle = 0
            found = new if found is None else found.unionByName(new)
            left = cut(left.join(new.select(F.explode(F.array("a", "b")).alias("id")), "id", "left_anti"))
        if sizes.where(F.col("rows") > chunk_rows).isEmpty():
            break
        shift = chunk_rows // 2 - shift
    found = spark.createDataFrame([], f"{kinds}, a {kind}, b {kind}, gap double, order bigint") if found is None else found
    return found.select(*[F.col(x).alias(c) for c, x in zip(cell, named, strict=True)], "a", "b", "gap", "order")


def draw_pairs(df: DataFrame, n: int, *, cell: list[str], treated: str, value: str, id_col: str, caliper: float, seed: int = 1, chunk_rows: int = 4096) -> DataFrame:
    """cell, pair_id, sample_id, id, treated, gap: two rows for each pair of a matched stratified sample.

    A cell's room is the smaller of its treated and control rows. Of its pairs the first take stand, by the random
    order of the treated rows; a cell that finds fewer gives nothing to the others. pair_id follows cell and order, sample_id the id.
    """
    c = F.col(treated).cast("int")
    room = df.groupBy(*cell).agg(F.least(F.count_if(c == 1), F.count_if(c == 0)).alias("room"))
    take = allocate(cut(room), cell, n)
    pairs = cut(matched_pairs(df, cell=cell, treated=treated, value=value, id_col=id_col, caliper=caliper, seed=seed, chunk_rows=chunk_rows).withColumn("one", F.lit(1)))
    ranked = matched(running_totals(pairs, cell, ["order", "a"], "one", "place"), take, cell).where(F.col("place") < F.col("take"))
    numbered = running_totals(ranked.select(*cell, "a", "b", "gap", "order", F.lit(1).alias("one")), [], [*cell, "order", "a"], "one", "pair_id")
    both = numbered.select(*cell, "pair_id", "gap", F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("treated")), F.struct(F.col("b").alias("id"), F.lit(0).alias("treated")))).alias("x"))
    both = both.select(*cell, "pair_id", "x.id", "x.treated", "gap", F.lit(1).alias("one"))
    return running_totals(both, [], ["id"], "one", "sample_id").select(*cell, "pair_id", "sample_id", "id", "treated", "gap")
