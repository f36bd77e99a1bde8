import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from llm_rows import prose, row
from pyspark.sql import functions as F

from tallyloom.llm import covertree, crf, mil, recurrent, store


def test_chain_is_forward_backward():
    rng = np.random.default_rng(1)
    k, lengths = 3, np.array([4, 1, 6])
    chain = crf.Chain(lengths)
    emit = rng.normal(size=(lengths.sum(), k))
    start, move = rng.normal(size=k), rng.normal(size=(k, k))
    placed = np.empty_like(emit)
    placed[chain.place] = emit
    post, total = chain.posteriors(placed, start, move)
    post = post[chain.place]
    at, logs = 0, 0.0
    for n in lengths:
        paths = np.array(np.meshgrid(*[range(k)] * n)).reshape(n, -1).T
        s = np.exp([start[p[0]] + emit[at, p[0]] + sum(move[p[i - 1], p[i]] + emit[at + i, p[i]] for i in range(1, n)) for p in paths])
        logs += math.log(s.sum())
        for i in range(n):
            assert post[at + i] == pytest.approx([s[paths[:, i] == c].sum() / s.sum() for c in range(k)])
        at += n
    assert total == pytest.approx(logs)


def test_language(frame, edge_rows):
    rows = [row(i, prose(i, 60, lang), lang) for i, lang in enumerate(["en", "fr"] * 60)]
    model = crf.fit_languages(frame(rows))
    mixed = row(900, prose(1, 90, "fr") + " " + prose(2, 30, "en"))
    tests = [row(500 + i, prose(500 + i, 40, lang), lang) for i, lang in enumerate(["en", "fr"] * 20)]
    out = {r.doc_id: r for r in crf.identify(frame([*tests, mixed]), model).collect()}
    assert all(out[t[0]].lang_pred == t[2] for t in tests)
    assert out[900].lang_pred == "fr" and 0.6 < out[900].score < 0.9
    edge = crf.identify(frame(edge_rows), model).collect()
    assert len(edge) == len(edge_rows) and all(0 <= r.score <= 1 for r in edge)
    assert {r.doc_id: r.lang_pred for r in edge if r.doc_id in (1, 2, 3, 5)} == dict.fromkeys((1, 2, 3, 5), "und")
    runs = {r.doc_id: r.runs for r in crf.label_words(frame([mixed, *edge_rows]), model).collect()}
    truth = ["fr"] * 90 + ["en"] * 30
    said = [x.lang for x in runs[900] for _ in range(x["from"], x["to"])]
    assert len(said) == 120 and sum(a == b for a, b in zip(said, truth)) >= 116
    assert runs[1] == runs[2] == runs[3] == [] and sum(x["to"] - x["from"] for x in runs[4]) == 30_000
    nothing = crf.fit_languages(frame([]))
    assert all(not r.runs for r in crf.label_words(frame(edge_rows), nothing).collect())
    assert {r.lang_pred for r in crf.identify(frame(edge_rows), nothing).collect()} == {"und"}


def test_languages_are_sampled_in_turn(frame):
    """A rare language gives all its rows; hot ones share what is left; rows in any order and dealing give the same."""
    rows = [row(i, prose(i, 20), "en") for i in range(400)] + [row(i, prose(i, 20, "fr"), "fr") for i in range(400, 403)]
    extra = [row(403, prose(403, 20, "fr") * 50, "fr"), row(404, None, "fr"), row(405, prose(405, 20), None), rows[0], rows[-1]]
    table = frame(rows + extra)
    got = [(r.doc_id, r.lang) for r in store.stratified_sample(table, "doc_id", "lang", 10, 5_000).collect()]
    hashed = {lang: sorted((hashlib.md5(f"{r.doc_id}|{r.h}|{lang}".encode()).hexdigest(), r.doc_id) for r in table.select("doc_id", "lang", F.xxhash64("text").alias("h"), F.length("text").alias("n")).where("n <= 5000").distinct().where(F.col("lang") == lang).collect()) for lang in ("en", "fr")}
    turns = sorted((i, h, d, lang) for lang in hashed for i, (h, d) in enumerate(hashed[lang]))
    assert got == [(d, lang) for _, _, d, lang in turns[:10]] and [x for _, x in got].count("fr") == 3
    assert got == [(r.doc_id, r.lang) for r in store.stratified_sample(table.repartition(7), "doc_id", "lang", 10, 5_000).collect()]
    few = store.stratified_sample(table, "doc_id", "lang", 10, 400).collect()
    assert 2 <= len(few) < 10 and sum(len(r.text) for r in few) <= 400 and [r.doc_id for r in few] == [d for d, _ in got][: len(few)]
    model = crf.fit_languages(table, sample_rows=40)
    assert model.labels == ["en", "fr"]
    assert {r.lang_pred for r in crf.identify(frame([row(900, prose(900, 40, "fr"))]), model).collect()} == {"fr"}
    assert store.stratified_sample(frame([]), "doc_id", "lang", 10, 400).count() == 0


def test_quality(spark, frame, edge_rows):
    junk = lambda i: re.sub(" ", "### ", prose(i, 50)) + " 12 $$$ | | |"
    rows = [row(i, prose(i, 150) if i % 2 else prose(i, 70) + " " + junk(i)) for i in range(160)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)], "doc_id bigint, quality int")
    model = mil.fit_quality(frame(rows), labels)
    tests = [row(900 + i, prose(900 + i, 150) if i % 2 else prose(900 + i, 70) + " " + junk(900 + i)) for i in range(40)]
    out = {r.doc_id: r for r in mil.score_quality(frame(tests), model).collect()}
    assert sum((out[900 + i].score >= 0.5) == bool(i % 2) for i in range(40)) >= 38
    assert sum(out[900 + i].top_passage > 0 for i in range(0, 40, 2)) >= 15  # the junk is in the later passages
    edge = mil.score_quality(frame(edge_rows), model).collect()
    assert len(edge) == len(edge_rows) and all(0 <= r.score <= 1 for r in edge)
    assert all(r.score == 0 for r in edge if r.doc_id in (1, 2, 3))
    assert mil.score_quality(frame([]), mil.fit_quality(frame([]), labels.where("false"))).count() == 0


def test_attention_by_hand():
    rng = np.random.default_rng(6)
    net = mil.Attention(4)
    x, at, label, cost = rng.normal(size=(7, mil.N_FEATURES)), np.array([0, 3, 4]), np.array([1.0, 0, 1]), np.array([0.5, 0.2, 0.3])
    p, y = net.p, []
    for i, j in ((0, 3), (3, 4), (4, 7)):
        h = [np.tanh(v @ p["w"] + p["b"]) for v in x[i:j]]
        e = np.exp([sum(p["a"][k] * math.tanh(v @ p["v"][:, k]) / (1 + math.exp(-(v @ p["u"][:, k]))) for k in range(4)) for v in h])
        z = sum(w * v for w, v in zip(e / e.sum(), h))
        y.append(1 / (1 + math.exp(-(z @ p["c"] + p["c0"][0]))))
    assert net.forward(x, at)["y"] == pytest.approx(np.array(y))
    loss = lambda: float(-(cost * np.where(label == 1, np.log(f := net.forward(x, at)["y"]), np.log(1 - f))).sum())
    grad = net.gradients(x, at, label, cost)
    for k, v in p.items():
        for i in rng.choice(v.size, min(v.size, 6), False):
            before = v.flat[i]
            v.flat[i] = before + 1e-6
            up = loss()
            v.flat[i] = before - 1e-6
            down = loss()
            v.flat[i] = before
            assert grad[k].flat[i] == pytest.approx((up - down) / 2e-6, abs=1e-7)


def test_passages_hold_their_words():
    import pyarrow as pa

    from tallyloom.llm import kernels as K

    f, text = mil.passage_features(*K.packed(pa.array(["alpha beta gamma delta", "delta gamma beta alpha", "alpha beta gamma omega", None])), 64)
    assert list(text) == [0, 1, 2] and (f[0, -mil.N_HASHED :] == f[1, -mil.N_HASHED :]).all() and (f[0, -mil.N_HASHED :] != f[2, -mil.N_HASHED :]).any()


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\0"]


def test_language_model(frame, edge_rows):
    rows = [row(i, prose(i, 120).title() + " Ärger") for i in range(80)] + edge_rows
    out = recurrent.score_texts(frame(rows), F.col("doc_id") < 70, head_words=50).collect()
    assert len(out) == len(rows)
    count = Counter(w for r in rows if r[0] is not None and r[0] < 70 for w in tokens(r[1]))
    n, v = sum(count.values()), len(count)
    base = lambda t: sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t))
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 5), r.train_tokens) for r in out) == sorted((len(tokens(r[1])), sum(count[w] > 0 for w in tokens(r[1])), round(base(r[1]), 5), n) for r in rows)
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert recurrent.score_texts(frame([]), F.lit(True)).count() == 0


def test_windows_carry_the_state():
    rng = np.random.default_rng(2)
    net = recurrent.GatedLM(8)
    words, lengths = rng.integers(0, recurrent.VOCABULARY + 1, 300), np.array([200, 1, 99])
    assert net.score(words, lengths, 7) == pytest.approx(net.score(words, lengths, 1000), rel=1e-4)
    h = np.zeros((1, 8), np.float32)  # one step's probabilities add up to one, the rare class among them
    each = net.outputs(np.repeat(h, recurrent.VOCABULARY + 1, 0), np.arange(recurrent.VOCABULARY + 1))[0]
    assert np.exp(each.astype(float)).sum() == pytest.approx(1, rel=1e-3)


def test_backpropagation():
    rng = np.random.default_rng(3)
    net = recurrent.GatedLM(6)
    words, lengths = rng.integers(0, 40, 3000), np.full(30, 100)
    words[1::2] = (words[::2] + 1) % 40  # every second word follows from the one before
    before = net.score(words, lengths).sum()
    net.fit(words, lengths, turns=30)
    assert net.score(words, lengths).sum() > 0.6 * before


def test_recurrent_step_by_step_and_its_gradient():
    rng = np.random.default_rng(8)
    net = recurrent.GatedLM(3)
    net.p = {k: v.astype(np.float64) + 0.1 for k, v in net.p.items()}
    p, words, lengths = net.p, rng.integers(0, recurrent.VOCABULARY + 1, 23), np.array([9, 14])
    words[3] = words[12] = recurrent.RARE
    soft = lambda e: np.exp(e - e.max()) / np.exp(e - e.max()).sum()

    def by_hand():
        out, at = [], 0
        for size in lengths:
            h, total = np.zeros(3), 0.0
            for w in words[at : at + size]:
                c = min(w // recurrent.CLASS_WORDS, recurrent.CLASSES)
                total += math.log(soft(h @ p["c"] + p["cb"])[c])
                if c < recurrent.CLASSES:
                    some = slice(c * recurrent.CLASS_WORDS, (c + 1) * recurrent.CLASS_WORDS)
                    total += math.log(soft(p["w"][some] @ h + p["wb"][some])[w % recurrent.CLASS_WORDS])
                x, y = p["x"][w], h @ p["u"]
                z, r = (1 / (1 + np.exp(-(x[i : i + 3] + y[i : i + 3]))) for i in (0, 3))
                h = (1 - z) * np.tanh(x[6:] + r * y[6:]) + z * h
            out.append(total)
            at += size
        return out

    assert net.score(words, lengths, 4) == pytest.approx(by_hand(), rel=1e-5)
    chain = crf.Chain(lengths)
    ids = np.empty(len(words), np.int64)
    ids[chain.place] = words
    grad, _, n = net.window(chain, ids, 0, len(chain.active), np.zeros((2, 3)))
    assert n == 23
    for k, v in p.items():
        live = np.flatnonzero(grad[k].ravel())
        for i in rng.choice(live, min(len(live), 8), False):
            before = v.flat[i]
            v.flat[i] = before + 1e-5
            up = sum(by_hand())
            v.flat[i] = before - 1e-5
            down = sum(by_hand())
            v.flat[i] = before
            assert grad[k].flat[i] == pytest.approx(-(up - down) / 2e-5, abs=1e-5)


def test_training_goes_over_all_texts(frame):
    rows = [row(i, prose(i, 80)) for i in range(60)]
    small = [recurrent.score_texts(frame(rows).repartition(3), F.col("doc_id") < n, sample_rows=5).agg(F.sum("score")).first()[0] for n in (60,)]
    one = recurrent.learn_everywhere
    try:
        recurrent.learn_everywhere = lambda *a: None
        without = recurrent.score_texts(frame(rows).repartition(3), F.lit(True), sample_rows=5).agg(F.sum("score")).first()[0]
    finally:
        recurrent.learn_everywhere = one
    assert small[0] > without


def test_texts_above_the_limits_are_learned_from(spark, frame):
    rows = [row(i, prose(i % 3, 80)) for i in range(40)]
    scored = lambda **k: recurrent.score_texts(frame(rows), F.col("doc_id") < 30, **k).agg(F.sum("score"), F.sum("base_score")).first()
    usual, base = scored()
    long, same = scored(sample_chars=10)  # every text is longer than what the start may take
    assert base == pytest.approx(same) and usual > base and long > 1.1 * base  # one short pass alone comes near the counts
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    small = mil.fit_quality(frame(rows), labels, sample_chars=2000)
    assert small.mean is not None and mil.score_quality(frame(rows), mil.fit_quality(frame(rows), labels, sample_chars=10)).count() == 40


def test_top_k(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8)) * 3
    x = np.floor(1024 * (centres[rng.integers(0, 6, 900)] + 0.05 * rng.normal(size=(900, 8))))
    ids = np.arange(900)
    score, found, products = covertree.dual_search(x[::30], ids[::30], x, ids, 10)
    s = x[::30] @ x.T
    s[np.arange(30), ids[::30]] = -np.inf
    want = np.array([sorted(range(900), key=lambda j: (-row[j], j))[:10] for row in s])
    assert (found == want).all() and products < 0.9 * s.size
    rows = [(i, [float(v) for v in rng.integers(-2, 3, 4) / 4]) for i in range(60)] + [(60, None), (61, [1.0, None, 0.0, 0.0]), (62, [float("nan")] * 4), (63, [float("inf")] * 4)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, score int")
    out = covertree.top_k(d, F.col("vec_id") % 10 == 0, block_rows=16, query_rows=3).collect()
    good = {i: [math.floor(1024 * v) for v in e] for i, e in rows[:60]}
    for q in range(0, 60, 10):
        best = sorted((-sum(a * b for a, b in zip(good[q], good[i])), i) for i in good if i != q)[:10]
        assert [(-r.score, r.vec_id) for r in sorted(out, key=lambda r: r.rank) if r.query_id == q] == best
    assert {r.query_id for r in out} == set(range(0, 60, 10))
    assert covertree.top_k(d.where("false"), F.lit(True)).count() == 0


@pytest.mark.parametrize("kind", ["clustered", "random", "one common vector"])
def test_top_k_by_blocks(spark, kind):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 6))
    if kind == "clustered":
        x = rng.normal(size=(7, 6))[rng.integers(0, 7, 400)] * 4 + 0.02 * x
    if kind == "one common vector":
        x[rng.random(400) < 0.4] = x[0]
    ids = [i % 390 for i in range(400)]  # some ids twice
    d = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in zip(ids, x)], "vec_id bigint, embedding array<double>")
    v = np.floor(1024 * x)
    out = covertree.top_k(d, F.col("vec_id") % 10 == 0, block_rows=32, query_rows=7, sample_rows=100).collect()
    got = Counter((r.query_id, r.rank, r.vec_id, r.score) for r in out)
    want = Counter()
    for q in range(400):
        if ids[q] % 10 == 0:
            best = sorted((-int(v[q] @ v[i]), ids[i]) for i in range(400) if ids[i] != ids[q])[:10]
            want.update((ids[q], n + 1, i, -s) for n, (s, i) in enumerate(best))
    assert got == want
