"""Exact top-k by inner product: two cover trees, one of queries and one of data, searched together.

The top of the tree is a net of at most max_centres vectors, chosen from a bounded sample by farthest-first traversal;
every vector belongs to its nearest centre, every cell has a covering radius, and cells of more than block_rows vectors
are split at random. Each query first searches the block whose centre suits it best, which gives it a kth score. Then
it visits the blocks whose centre and radius allow a product as large as that score, and no others. A block and a group
of queries meet in one task: both trees are built there, node pairs are walked best bound first, and a pair is pruned if
the largest product that its centres and covering radii allow is below the worst kth score of the query node's members.
Products are whole numbers, exact in float64 (below 2**53). Ties go to the smaller id.

A vector that is null, or holds a null or non-finite component, takes no part. Shorter vectors count as padded
with zeros. Rows that repeat are candidates each; a query's own are all rows with its id. Query rows that share an id
are queries each. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .store import cut


class CoverTree:
    """Nodes in arrays: centre (a point), radius (largest distance of a point below), children or points.

    A node's children are centres of a net: each lies farther than the level's distance from the others, every
    point is within it of its child, and the node's own centre is the first child. A level's distance is a
    fixed share of the one above. Children of few points are pooled into leaves around the node's own centre, so
    that data without structure cost whole products and not single ones.
    """

    def __init__(self, x: np.ndarray, leaf: int = 48, base: float = 1.3) -> None:
        self.x = x
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.points: list[np.ndarray] = []
        self.square = (x * x).sum(1)
        stack = [(np.arange(len(x)), 0, -1, np.inf)] if len(x) else []
        while stack:
            points, centre, parent, reach = stack.pop()
            far = self._distances(centre, points)
            node = len(self.centre)
            self.centre.append(centre)
            self.radius.append(float(far.max()))
            self.children.append([])
            self.points.append(points)
            if parent >= 0:
                self.children[parent].append(node)
            if len(points) <= leaf or self.radius[node] == 0:
                continue
            within = min(reach, self.radius[node])
            parts: list[tuple[np.ndarray, int]] = []
            while len(parts) < 2:  # a level where all stay with the centre is passed over
                within /= base
                rest, near, parts, c = points, far, [], centre
                while True:
                    inside = near <= within
                    parts.append((rest[inside], c))
                    rest = rest[~inside]
                    if not len(rest):
                        break
                    c = int(rest[0])
                    near = self._distances(c, rest)
            few = [p for p, _ in parts if len(p) <= leaf]
            stack += [(p, c, node, within) for p, c in parts if len(p) > leaf]
            if few:
                pool = np.concatenate(few)
                pool = pool[np.argsort(self._distances(centre, pool), kind="stable")]
                for p in np.array_split(pool, -(-len(pool) // (8 * leaf))):
                    self.centre.append(centre)
                    self.radius.append(float(self._distances(centre, p).max()))
                    self.children.append([])
                    self.points.append(p)
                    self.children[node].append(len(self.centre) - 1)

    def _distances(self, c: int, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.square[points] + self.square[c] - 2 * (self.x[points] @ self.x[c]), 0))


def slack(q_norm: np.ndarray | float, x_norm: np.ndarray | float) -> np.ndarray | float:
    """What rounding may take from a bound."""
    return 1 + 1e-6 * q_norm * x_norm


def dual_search(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best (scores, ids) of each query, padded with -inf; and the number of products taken. Scores below a query's floor may be left out."""
    floor = np.full(len(q), -np.inf) if floor is None else floor
    score = np.full((len(q), k), -np.inf)
    found = np.zeros((len(q), k), x_ids.dtype)
    if not len(q) or not len(x):
        return score, found, 0
    a, b = CoverTree(q, 16), CoverTree(x)
    size = lambda t: np.sqrt(t.square[t.centre])
    norm_a, norm_b = size(a), size(b)
    products = 0

    def bounds(n: int, others: list[int]) -> np.ndarray:
        c = np.array(others)
        rb = np.array([b.radius[i] for i in others])
        mid = x[[b.centre[i] for i in others]] @ q[a.centre[n]]
        return mid + norm_a[n] * rb + norm_b[c] * a.radius[n] + a.radius[n] * rb + slack(norm_a[n] + a.radius[n], norm_b[c] + rb)

    def worst(rows: np.ndarray) -> float:
        return np.maximum(score[rows, k - 1], floor[rows]).min()

    queue = [(-bounds(0, [0])[0], 0, 0)]
    while queue:
        bound, n, m = heapq.heappop(queue)
        rows = a.points[n]
        if -bound < worst(rows):
            continue
        if a.children[n] and (not b.children[m] or a.radius[n] >= b.radius[m]):
            for c in a.children[n]:
                heapq.heappush(queue, (-bounds(c, [m])[0], c, m))
        elif b.children[m]:
            for c, v in zip(b.children[m], bounds(n, b.children[m]), strict=True):
                if v >= worst(rows):
                    heapq.heappush(queue, (-v, n, c))
        else:
            cols = b.points[m]
            s = q[rows] @ x[cols].T
            products += s.size
            s[q_ids[rows][:, None] == x_ids[cols][None, :]] = -np.inf
            hit = np.flatnonzero((s >= score[rows, k - 1][:, None]).any(1))
            if len(hit):
                all_s = np.concatenate([score[rows[hit]], s[hit]], 1)
                all_i = np.concatenate([found[rows[hit]], np.broadcast_to(x_ids[cols], (len(hit), len(cols)))], 1)
                order = np.lexsort((all_i, -all_s), axis=-1)[:, :k]
                score[rows[hit]] = np.take_along_axis(all_s, order, 1)
                found[rows[hit]] = np.take_along_axis(all_i, order, 1)
    return score, found, products


def whole_vector(v: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null if the vector takes no part."""
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(v.isNotNull() & ~bad, F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("double")))


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """n or fewer distinct rows of x, each the farthest from those before it."""
    if not len(x):
        return x
    chosen = [0]
    far = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def matrix(vs: pd.Series, width: int) -> np.ndarray:
    return np.array([np.pad(v, (0, width - len(v))) for v in vs], np.float64).reshape(len(vs), width)


def top_k(
    vectors: DataFrame,
    queries: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    scale: int = 1024,
    block_rows: int = 16384,
    query_rows: int = 16384,
    max_centres: int = 1024,
    sample_rows: int = 4096,
) -> DataFrame:
    """query_id, rank, id, score: the k best candidates of each row for which queries holds.

    max_centres and sample_rows bound what chooses the cells; every vector is in one and every query is answered exactly.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), whole_vector(F.col(vector_col), scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    rows = cut(rows.where(F.col("v").isNotNull() & F.col("id").isNotNull()).withColumn("row", F.monotonically_increasing_id()))
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    sample = rows.select("row", "v").orderBy(F.xxhash64("row"), "row").limit(sample_rows).toPandas()
    centres = farthest_first(matrix(sample["v"], width), min(max_centres, max(1, -(-n // block_rows))))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = (centres * centres).sum(1)
        for d in batches:
            for i in range(0, len(d), 4096):
                some = d.iloc[i : i + 4096]
                x = matrix(some["v"], width)
                far = np.maximum((x * x).sum(1)[:, None] + own - 2 * (x @ centres.T), 0)
                cell = far.argmin(1)
                yield some.assign(cell=cell.astype(np.int32), far=np.sqrt(far[np.arange(len(x)), cell]))

    placed = cut(rows.mapInPandas(place, "id long, v array<double>, is_query boolean, row long, cell int, far double"))
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"), F.count_if("is_query").alias("q")).orderBy("cell").collect()  # max_centres rows at most
    net = centres[[c.cell for c in cells]]
    norms = np.sqrt((net * net).sum(1))
    radius = np.array([c.radius for c in cells])
    parts = np.array([max(1, -(-c.n // block_rows)) for c in cells], np.int64)
    first = np.cumsum(parts) - parts  # the first block of each cell
    index = {c.cell: i for i, c in enumerate(cells)}
    of = F.create_map(*[F.lit(x) for c in cells for x in (c.cell, int(first[index[c.cell]]))])
    n_of = F.create_map(*[F.lit(x) for c in cells for x in (c.cell, int(parts[index[c.cell]]))])
    data = placed.select("id", "v", (F.try_element_at(of, F.col("cell")) + F.pmod(F.xxhash64("row"), F.try_element_at(n_of, F.col("cell")))).cast("int").alias("block"))
    asked = placed.where("is_query")

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            best = (matrix(d["v"], width) @ net.T).argmax(1)
            yield pd.DataFrame({"row": d["row"], "id": d["id"], "v": d["v"], "block": first[best].astype(np.int32), "floor": -np.inf})

    fields = "row long, id long, v array<double>, block int, floor double"
    found_fields = "row long, query_id long, id long, score long"

    def search(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(d) or not len(q):
            return pd.DataFrame({c: [] for c in ("row", "query_id", "id", "score")}).astype("int64")
        ids = q["id"].to_numpy(np.int64)
        score, found, _ = dual_search(matrix(q["q"], width), ids, matrix(d["v"], width), d["id"].to_numpy(np.int64), k, q["floor"].to_numpy(np.float64))
        r, c = np.nonzero(np.isfinite(score))
        return pd.DataFrame({"row": q["row"].to_numpy(np.int64)[r], "query_id": ids[r], "id": found[r, c], "score": score[r, c].astype(np.int64)})

    def meet(visits: DataFrame) -> DataFrame:
        """Each block that is visited meets its queries, query_rows of them at a time: it is sent as often as that takes, whatever cells they come from."""
        groups = visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("groups"))
        own = visits.select("row", "id", F.col("v").alias("q"), "block", "floor").join(groups, "block").withColumn("grp", F.pmod(F.xxhash64("row"), F.col("groups")).cast("int"))
        pairs = groups.select("block", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("grp"))
        return data.join(pairs, "block").groupBy("block", "grp").cogroup(own.groupBy("block", "grp")).applyInPandas(search, found_fields)

    home = cut(asked.mapInPandas(homes, fields))
    one = cut(meet(home))
    have = one.groupBy("row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).otherwise(F.lit(float("-inf"))).alias("kth"))

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for i in range(0, len(d), 256):
                some = d.iloc[i : i + 256]
                x = matrix(some["v"], width)
                size = np.sqrt((x * x).sum(1))[:, None]
                most = x @ net.T + size * radius + slack(size, norms + radius)
                q, c = np.nonzero(most >= some["kth"].to_numpy()[:, None])
                q, block = np.repeat(q, parts[c]), np.repeat(first[c], parts[c]) + K.ramps(parts[c])
                go = block != some["block"].to_numpy()[q]
                out = some.iloc[q[go]]
                yield pd.DataFrame({"row": out["row"], "id": out["id"], "v": out["v"], "block": block[go].astype(np.int32), "floor": out["kth"]})

    kth = home.drop("floor").join(have, "row", "left").na.fill(float("-inf"), ["kth"])
    rest = meet(cut(kth.mapInPandas(others, fields)))
    w = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("id"))
    ranked = one.union(rest).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
