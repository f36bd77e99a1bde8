"""Approximate nearest neighbours along shifted space-filling curves.

Each curve projects the vectors to a few orthogonal directions of its own, shifts them by a random vector and orders them by
their place on a Hilbert curve. Spark sorts all curves by range, so that every vector has a position on each. A query meets the
vectors whose positions differ from its own by at most a window, on every curve; what the curves find is merged, and ranked by the
distance of the original vectors.

The window isn't set by hand: of a bounded sample of queries the true neighbours are found by comparing them with all vectors,
and the window is what would have found the wanted share of these on the curve that suits each best. On vectors with structure it
stays small whatever the table; on vectors without any, such as independent random ones in 64 dimensions, no ordering brings
neighbours together, and the window grows with the table.

Equal vectors are one point of the curves, with their k + 1 smallest ids: a vector that a third of all rows hold is searched
once. A vector that is null, zero, or holds a null or non-finite component takes no part, nor does a row with a null id.
Shorter vectors count as padded with zeros. A query's own rows are all with its id; rows that repeat are candidates and queries
each. Equal distances are ordered by id. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut

BITS = 16
SIGN = np.uint64(1 << 63)


def hilbert_keys(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each row of cells (n by d of BITS bits) on the Hilbert curve, as two signed longs in order.

    Gray-coded axes are undone bit plane by bit plane, after Skilling (2004).
    """
    axes = cells.astype(np.uint64).T.copy()
    d, n = axes.shape
    zero = np.uint64(0)
    for b in range(BITS - 1, 0, -1):
        bit, below = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(d):
            high = (axes[i] & bit) != 0
            swap = np.where(high, zero, (axes[0] ^ axes[i]) & below)
            axes[0] ^= np.where(high, below, swap)
            axes[i] ^= np.where(high, zero, swap)
    for i in range(1, d):
        axes[i] ^= axes[i - 1]
    flip = np.zeros(n, np.uint64)
    for b in range(BITS - 1, 0, -1):
        flip ^= np.where((axes[d - 1] & np.uint64(1 << b)) != 0, np.uint64((1 << b) - 1), zero)
    axes ^= flip
    words = np.zeros((2, n), np.uint64)
    for place, (b, i) in enumerate((b, i) for b in range(BITS - 1, -1, -1) for i in range(d)):
        words[place // 64] |= ((axes[i] >> np.uint64(b)) & np.uint64(1)) << np.uint64(63 - place % 64)
    return (words[0] ^ SIGN).view(np.int64), (words[1] ^ SIGN).view(np.int64)


class Curves:
    """Directions, origin, side and shift of each curve; directions are orthogonal within a rotation of the whole space."""

    def __init__(self, sample: np.ndarray, curves: int, dims: int, seed: int) -> None:
        width = sample.shape[1]
        dims = min(dims, width)
        rng = np.random.default_rng(seed)
        self.curves = []
        for c in range(curves):
            at = c % (width // dims)
            if at == 0:
                turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
            basis = turn[:, at * dims : (at + 1) * dims]
            y = sample @ basis
            side = float((y.max(0) - y.min(0)).max()) or 1.0
            self.curves.append((basis, y.min(0) - side / 2 - rng.random(dims) * side, side))

    def keys(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for c, (basis, origin, side) in enumerate(self.curves):
            cells = np.clip((x @ basis - origin) / (3 * side), 0, 1 - 2.0**-BITS) * (1 << BITS)
            yield c, *hilbert_keys(cells)


def packed(v: pd.Series, width: int) -> np.ndarray:
    """Vectors as lists, padded, or as the bytes of doubles."""
    if len(v) and isinstance(v.iloc[0], bytes):
        return np.frombuffer(b"".join(v), np.float64).reshape(len(v), width)
    return np.array([np.pad(np.asarray(e, np.float64), (0, width - len(e))) for e in v], np.float64).reshape(len(v), width)


def nearest(q: np.ndarray, x: np.ndarray, k: int, ok: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q and x and their distance: for each q the k nearest x (where ok), and all that rounding doesn't tell from the kth."""
    size = (x * x).sum(1)
    far = (q * q).sum(1)[:, None] + size - 2 * (q @ x.T)
    if ok is not None:
        far[~ok] = np.inf
    if far.shape[1] > k:
        worst = np.partition(far, k - 1, axis=1)[:, k - 1]
        close = far <= (worst + 1e-9 * ((q * q).sum(1) + size.max()))[:, None]
    else:
        close = np.ones(far.shape, bool)
    r, c = np.nonzero(close & np.isfinite(far))
    return r, c, np.sqrt(((x[c] - q[r]) ** 2).sum(1))


def usable(v: Column) -> Column:
    """v as doubles; null if it takes no part."""
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(v.isNotNull() & ~bad & F.exists(v, lambda c: c != 0), F.transform(v, lambda c: c.cast("double")))


def points(rows: DataFrame, k: int) -> DataFrame:
    """cls, v, members (the k + 1 smallest ids, with at most k of each one's rows counted), asked: one row for each distinct vector.

    A common vector's ids are thinned out in 64 parts before they meet.
    """
    part = F.pmod(F.xxhash64("id"), F.lit(64)).alias("part")
    pairs = rows.select("v", "id", "asked", part).repartition("v", "part").groupBy("v", "part", "id")
    pairs = pairs.agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"), F.max("asked").alias("asked"))
    w = Window.partitionBy("v", "part")
    some = pairs.withColumn("asked", F.max("asked").over(w)).withColumn("r", F.row_number().over(w.orderBy("id"))).where(F.col("r") <= k + 1)
    out = some.groupBy("v").agg(F.slice(F.sort_array(F.collect_list(F.struct("id", "n"))), 1, k + 1).alias("members"), F.max("asked").alias("asked"))
    return cut(out.withColumn("cls", F.monotonically_increasing_id()))


def positioned(keyed: DataFrame) -> DataFrame:
    """keyed (curve, hi, lo, cls, ...) with pos, from 0 in the order of these four."""
    by = ["curve", "hi", "lo", "cls"]
    placed = cut(keyed.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("i")))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return placed.join(F.broadcast(before), "part").withColumn("pos", F.col("before") + F.col("i").bitwiseAND((1 << 33) - 1)).drop("part", "i", "before", "hi", "lo")


def search(
    vectors: DataFrame,
    queries: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    curves: int = 12,
    dims: int = 8,
    recall: float = 0.95,
    sample_rows: int = 4096,
    sample_queries: int = 200,
    block_rows: int = 1024,
    query_rows: int = 2048,
    seed: int = 1,
) -> DataFrame:
    """query_id, rank, id, score: the k nearest found of each row for which queries holds, with their distance.

    sample_rows and sample_queries bound what fits the curves and the window; every vector is on every curve.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), usable(F.col(vector_col)).alias("v"), F.coalesce(queries, F.lit(False)).alias("asked"))
    rows = rows.where(F.col("v").isNotNull() & F.col("id").isNotNull())
    classes = points(rows, k)
    n, width = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    order = [F.xxhash64("cls"), F.col("cls")]
    sample = classes.select("v").orderBy(*order).limit(sample_rows).toPandas()
    fitted = Curves(packed(sample["v"], width), curves, min(dims, 128 // BITS), seed)

    def on_curves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for i in range(0, len(d), 4096):
                some = d.iloc[i : i + 4096]
                x = packed(some["v"], width)
                v = [e.tobytes() for e in x]
                for c, hi, lo in fitted.keys(x):
                    yield pd.DataFrame({"curve": np.int32(c), "hi": hi, "lo": lo, "cls": some["cls"].to_numpy(), "asked": some["asked"].to_numpy(), "v": v})

    placed = positioned(classes.select("cls", "asked", "v").mapInPandas(on_curves, "curve int, hi bigint, lo bigint, cls bigint, asked boolean, v binary"))
    few = classes.where("asked").select("cls", "v").orderBy(*order).limit(sample_queries).toPandas()
    few_x, few_cls = packed(few["v"], width), few["cls"].to_numpy()

    def truth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for i in range(0, len(d), 4096):
                some = d.iloc[i : i + 4096]
                cls = some["cls"].to_numpy()
                r, c, far = nearest(few_x, packed(some["v"], width), k, few_cls[:, None] != cls)
                yield pd.DataFrame({"query": few_cls[r], "cls": cls[c], "far": far})

    w = Window.partitionBy("query").orderBy("far", "cls")
    true = classes.select("cls", "v").mapInPandas(truth, "query bigint, cls bigint, far double")
    true = true.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("query", "cls")
    at = placed.select("curve", "cls", "pos")
    gaps = at.join(F.broadcast(true), "cls").join(at.select("curve", F.col("cls").alias("query"), F.col("pos").alias("own")), ["curve", "query"])
    gaps = gaps.groupBy("query", "cls").agg(F.min(F.abs(F.col("pos") - F.col("own"))).alias("gap"))
    window = gaps.agg(F.percentile("gap", F.lit(recall))).first()[0]  # of k rows for each of sample_queries
    window = max(int(np.ceil(window or 0)), 4 * (k + 1))

    start = F.col("curve") * F.lit(n)
    visits = placed.where("asked").select(F.col("cls").alias("query"), F.col("v").alias("of"), F.greatest(F.col("pos") - window, start).alias("lo"), F.least(F.col("pos") + window, start + n - 1).alias("hi"))
    block = lambda c: F.expr(f"{c} div {int(block_rows)}")
    visits = visits.withColumn("block", F.explode(F.sequence(block("lo"), block("hi"))))
    salts = visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("salts"))
    visits = visits.join(salts, "block").withColumn("salt", F.pmod(F.xxhash64("query"), F.col("salts")).cast("int")).drop("salts")
    data = placed.select(block("pos").alias("block"), "pos", "cls", "v").join(salts, "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    keep = k + 1

    def meet(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(d) or not len(q):
            return pd.DataFrame({"query": np.zeros(0, np.int64), "cls": np.zeros(0, np.int64), "far": np.zeros(0)})
        pos, cls = d["pos"].to_numpy(), d["cls"].to_numpy()
        ok = (pos >= q["lo"].to_numpy()[:, None]) & (pos <= q["hi"].to_numpy()[:, None])
        r, c, far = nearest(packed(q["of"], width), packed(d["v"], width), keep, ok)
        return pd.DataFrame({"query": q["query"].to_numpy()[r], "cls": cls[c], "far": far})

    found = data.groupBy("block", "salt").cogroup(visits.groupBy("block", "salt")).applyInPandas(meet, "query bigint, cls bigint, far double")
    found = found.groupBy("query", "cls").agg(F.min("far").alias("far")).join(classes.select("cls", "members"), "cls")
    w = Window.partitionBy("query").orderBy("far", F.col("members")[0]["id"])
    found = cut(found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 4 * keep).select("query", "far", "members"))
    asks = rows.where("asked").groupBy("v", "id").agg(F.count(F.lit(1)).cast("int").alias("times")).join(classes.where("asked").select("v", F.col("cls").alias("query")), "v")
    asks = asks.select("query", F.col("id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time"))
    out = asks.join(found, "query").select("query", "query_id", "time", "far", F.explode("members").alias("m"))
    out = out.where(F.col("m.id") != F.col("query_id")).select("*", F.explode(F.sequence(F.lit(1), F.col("m.n"))).alias("copy"))
    w = Window.partitionBy("query", "query_id", "time").orderBy("far", F.col("m.id"))
    out = out.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("m.id").alias(id_col), F.col("far").alias("score"))
