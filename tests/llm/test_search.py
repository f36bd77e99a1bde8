import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_rows import prose, row
from pyspark.sql import functions as F

from tallyloom.llm import blockmax, hilbert


def words(text):
    fold = str.maketrans(blockmax.UPPER, blockmax.LOWER)
    return re.findall(blockmax.TERM, (text or "").translate(fold))


def ranked(docs, items, k):
    """By the definition, every document for every item."""
    bags = [(d[0], Counter(words(d[1]))) for d in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, total = len(bags), sum(s for _, _, s in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = Counter()
    for item, text in items:
        scores = []
        for i, b, size in bags:
            m = 100 - 90 + (90 * size * n) // total
            scores.append((sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 8 * m)) for t in set(words(text)) if t in b), i))
        best = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1]))[:k]
        out.update((item, r + 1, i, s) for r, (s, i) in enumerate(best))
    return out


def test_lexical_search(spark, frame, edge_rows):
    docs = [row(i, prose(i, 20 + i)) for i in range(60)] + edge_rows + [row(100 + i, prose(7, 50)) for i in range(15)] + [row(200, "Straße Été9 x-y_z été9"), row(201, "ÉTÉ9\0Straße")]
    items = [(1, prose(7, 30)), (2, "the THE of"), (3, None), (4, ""), (5, "not.there"), (6, "Été9 Straße"), (6, "x y z"), (7, prose(1, 40))]
    table = spark.createDataFrame(items, "item_id bigint, text string").withColumn("rank", F.lit(3))
    for block, first, groups in ((4, 2, 20_000), (64, 4, 3)):
        out = blockmax.search(frame(docs).repartition(3), table, k=5, block_docs=block, first_blocks=first, group_items=groups).collect()
        assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in out) == ranked(docs, items, 5)
    assert blockmax.search(frame([]), table).count() == 0
    assert blockmax.search(frame(docs), table.where("false")).count() == 0
    assert blockmax.search(frame([row(1, None)]), table).count() == 0


def test_blocks_are_pruned():
    rng = np.random.default_rng(5)
    block = np.repeat(np.arange(40), 10)
    doc = np.repeat(np.arange(400), 3)
    term = np.where(doc < 10, rng.integers(0, 3, 1200), rng.integers(3, 50, 1200))
    pair, tf = np.unique(doc * 50 + term, return_counts=True)
    b = blockmax.Blocks(block, np.full(400, 3), pair // 50, pair % 50, tf, np.full(50, 700), 400, 1200)
    items = blockmax.Items([np.array([0, 1, 2, 9])], 50)
    bound = b.bounds(items)[:, 0]
    best = [b.scores(i, items.terms[0]).max() for i in range(40)]
    assert (bound >= best).all() and bound[0] > sorted(bound)[-2] and (bound[1:] < best[0]).any()


def test_pieces_keep_terms_whole():
    buf = np.frombuffer(b"aa bb cccccccccc dd" + b"e" * 30, np.uint8)
    at, of = blockmax.pieces(buf, np.array([0, 19, 49]), 8)
    assert of.tolist() == [0] * (len(at) - 2) + [1] and at[0] == 0 and at[-1] == 49
    assert all(at[i] in (19, 49) or blockmax.APART[buf[at[i] - 1]] or blockmax.APART[buf[at[i]]] for i in range(1, len(at)))


def test_hilbert_curve_is_one_step_a_time():
    bits, hilbert.BITS = hilbert.BITS, 3
    try:
        cells = np.array(np.meshgrid(*[range(8)] * 3, indexing="ij")).reshape(3, -1).T
        hi, lo = hilbert.hilbert_keys(cells)
    finally:
        hilbert.BITS = bits
    path = cells[np.lexsort((lo, hi))]
    assert len(set(zip(hi, lo))) == 512 and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def nearest_rows(rows, asked, k):
    """By the definition, for each query row; vectors padded with zeros."""
    good = [(i, np.pad(np.array(v, float), (0, 6 - len(v)))) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = []
    for i, v in good:
        if asked(i):
            out.append((i, sorted((math.sqrt(((v - w) ** 2).sum()), j) for j, w in good if j != i)[:k]))
    return out


@pytest.mark.parametrize("kind", ["clustered", "one common vector", "few"])
def test_nearest_along_curves(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(7, 6))[rng.integers(0, 7, 500)] * 5 + 0.1 * rng.normal(size=(500, 6))
    if kind == "one common vector":
        x[rng.random(500) < 0.4] = x[0]
    if kind == "few":
        x = x[:8]
    rows = [(i % 490, [float(v) for v in e]) for i, e in enumerate(x)]  # some ids twice
    rows += [(600, None), (610, [1.0, None]), (620, [math.nan] * 6), (630, [math.inf] * 6), (640, [0.0] * 6), (None, [1.0] * 6), (650, []), (660, [2.0, 1.0])]
    d = spark.createDataFrame([(*r, 5, 1.0) for r in rows], "vec_id bigint, embedding array<double>, rank int, score double")
    out = defaultdict(list)
    for r in hilbert.search(d, F.col("vec_id") % 10 == 0, curves=6, dims=3, sample_rows=200, block_rows=64, query_rows=5).collect():
        out[r.query_id].append((r["rank"], r.score, r.vec_id))
    want = nearest_rows(rows, lambda i: i % 10 == 0, 10)
    asked = Counter(i for i, _ in want)
    hits = 0
    for i, best in want:
        got = sorted(out[i])
        assert len(got) == asked[i] * len(best)
        if asked[i] == 1:
            assert [g[0] for g in got] == list(range(1, len(best) + 1)) and got == sorted(got, key=lambda g: g[1:])
        hits += len({b[1] for b in best} & {g[2] for g in got}) / max(1, len({b[1] for b in best}))
    assert set(out) <= set(asked) and hits >= (1 if kind == "few" else 0.9) * len(want)
    assert hilbert.search(d.where("false"), F.lit(True)).count() == 0


def test_scores_are_distances(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 64)).astype(np.float32)
    d = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "vec_id bigint, embedding array<float>")
    found = hilbert.search(d, F.col("vec_id") % 5 == 0, sample_queries=30, block_rows=32).collect()
    hits = 0
    for r in found:
        assert r.score == pytest.approx(math.dist(x[r.query_id].astype(float), x[r.vec_id].astype(float)), rel=1e-12)
    for i in range(0, 300, 5):
        far = ((x - x[i]) ** 2).sum(1)
        far[i] = np.inf
        hits += len(set(np.argsort(far)[:10].tolist()) & {r.vec_id for r in found if r.query_id == i})
    assert hits >= 0.9 * 600
