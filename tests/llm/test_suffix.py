import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from llm_rows import prose, row

from tallyloom.llm import suffix


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone[1:-1]].tobytes()
        out.append((len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def check(frame, rows, **options):
    got = suffix.removed_spans(frame(rows), **options).collect()
    length = options.get("length", 400)
    want = brute([r[1] for r in rows], length)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((str(r[0]), *w) for r, w in zip(rows, want, strict=True))


def mixture(seed, n, length):
    """Texts that share passages around the limit, with edits, overlaps and periodic parts."""
    r = random.Random(seed)
    pool = [prose(i, 200)[: length + d] for i, d in enumerate((-60, -1, 0, 1, 30, 300))]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(1, 5)):
            p = r.choice([*pool, prose(r.randint(0, 10**6), 60), "ab" * r.randint(10, length), "é"])
            if r.random() < 0.3 and len(p) > 5:
                k = r.randrange(len(p))
                p = p[:k] + "#" + p[k + 1 :]
            parts.append(p)
        rows.append(row(i, r.choice(["", " "]).join(parts)))
    return rows


def test_against_brute_force(frame):
    check(frame, mixture(1, 40, 400))


def test_short_length_and_large_buckets(frame):
    check(frame, mixture(2, 40, 80), length=80)
    check(frame, mixture(3, 30, 80), length=80, bucket_rows=1)


def test_sort_is_a_suffix_sort():
    r = random.Random(4)
    buf = np.array([r.choice((97, 98)) for _ in range(400)], np.uint8)
    at = np.array(r.sample(range(400), 120))
    bucket = np.sort(np.array([r.randint(0, 6) for _ in at]))
    e = suffix.Extensions(buf)
    size = 400 - at
    order, ext = suffix.neighbours(e, at, size, bucket)
    raw = buf.tobytes()
    assert [(bucket[i], raw[at[i] :]) for i in order] == sorted((bucket[i], raw[at[i] :]) for i in range(len(at)))
    for i in range(1, len(order)):
        a, b = (raw[at[k] :] for k in order[i - 1 : i + 1])
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert ext[i] == (n if bucket[order[i]] == bucket[order[i - 1]] else -1)


def test_edges(frame, edge_rows):
    check(frame, edge_rows)
    assert suffix.removed_spans(frame([])).count() == 0


def test_equal_hashes_are_compared_by_bytes(frame):
    rows = mixture(5, 25, 80)
    assert suffix.attempt(frame(rows).selectExpr("doc_id as id", "text", "cast(doc_id as string) as ik", "xxhash64(text) as th"), 80, 20_000, 0, 3) is None
    check(frame, rows, length=80, hash_bits=3)


def test_hot_keys_are_joined_in_parts(frame, monkeypatch):
    from tallyloom.llm import store

    monkeypatch.setattr(suffix, "hot_keys", lambda counts, keys, total: store.hot_keys(counts, keys, total, floor=3))
    check(frame, mixture(6, 40, 80), length=80)
    check(frame, mixture(7, 30, 80), length=80, bucket_rows=1)


def steps(frame, monkeypatch):
    """The functions that attempt runs in the tasks, by name."""
    found, kind = {}, type(frame([]))
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **k: found.setdefault(f.__name__, f) and plain(self, f, *a, **k))
    rows = frame([row(1, prose(1, 100)), row(2, prose(1, 100) + "x")]).selectExpr("doc_id as id", "text", "cast(doc_id as string) as ik", "xxhash64(text) as th")
    assert suffix.attempt(rows, 400, 20_000, 0, 64) is not None
    return found


def peak_mb(step, batch):
    for _ in step(iter([batch.slice(0, 1)])):  # tables that a worker makes once don't count
        pass
    tracemalloc.start()
    for _ in step(iter([batch])):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6


def test_a_batch_takes_little_memory(frame, monkeypatch):
    """Whole batches of 10,000 rows, as Spark sends them, with as many parts and bytes as check_l has, and more."""
    step = steps(frame, monkeypatch)
    n, each = 10_000, 40
    ids = [pa.array([str(i) for i in range(n)]), pa.array(range(n), pa.int64())]

    part = pa.struct([("shift", pa.int32()), ("from", pa.int32()), ("to", pa.int32())])
    start = np.tile(np.arange(each) * 100, n)
    values = pa.StructArray.from_arrays([pa.array(np.zeros(n * each), pa.int32()), pa.array(start, pa.int32()), pa.array(start + 450, pa.int32())], fields=list(part))
    claims = pa.RecordBatch.from_arrays([*ids, *ids, pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * each, pa.int32()), values)], ["ik", "th", "rik", "rth", "parts"])
    assert pa.Table.from_batches(step["merge"](iter([claims]))).column("parts").to_pylist() == [[{"shift": 0, "from": 0, "to": (each - 1) * 100 + 450}]] * n
    assert peak_mb(step["merge"], claims) < 40

    text = prose(9, 60_000)
    texts = pa.RecordBatch.from_arrays([pa.array(["0", "1"]), pa.array(["", text * (1 + 3_000_000 // len(text))]), pa.array([0, 1], pa.int64())], ["ik", "text", "th"])
    assert peak_mb(step["find"], texts) < 100

    size, core = 500, np.arange(n) // 2
    data = np.random.default_rng(0).integers(97, 123, (n, size)).astype(np.uint8)
    wordings = pa.RecordBatch.from_arrays([pa.array(core), pa.array(range(n)), pa.array(np.full(n, size - 400), pa.int16()), pa.array(np.full(n, 100), pa.int16()), pa.array([d.tobytes() for d in data], pa.binary())], ["core", "whole", "more", "anchor", "data"])
    assert peak_mb(step["compare"], wordings) < 120


def test_long_texts_come_in_pieces(frame, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 150)
    monkeypatch.setattr(suffix, "BUCKETS", 500)
    monkeypatch.setattr(suffix, "PARTS", 2)
    check(frame, mixture(8, 40, 80), length=80)
    check(frame, [row(1, prose(1, 300)), row(2, prose(2, 40) + prose(1, 300)), row(3, "ab" * 700), row(4, "x" + "ab" * 700)])
