"""Quality by attention-based multiple-instance learning.

A text is a bag of passages of passage_words words. Each passage is encoded from its words, hashed with a sign into
N_HASHED slots, and from shares of byte classes, word shapes and repetition; a gated attention weighs the passages, and the weighted
sum is scored. Encoder, gates and classifier are learned together, from labels of whole documents alone, in
numpy on a bounded sample (sample_rows labelled rows, those with the smallest md5 of their id).

A null text, or one without words, has no passage and scores 0. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K

N_CLASSES = 9


def byte_classes() -> np.ndarray:
    c = np.full(256, 7, np.int64)  # symbols
    c[0x61:0x7B], c[0x41:0x5B], c[0x30:0x3A] = 0, 1, 2
    c[[0x20, 0x09, 0x0B, 0x0C, 0x0D]], c[0x0A] = 3, 4
    c[[ord(x) for x in ".,;:?!'\"()-"]] = 5
    c[[ord(x) for x in "|<>=_{}[]\\/"]] = 8
    c[0x80:] = 6
    return c


N_HASHED = 64
N_FEATURES = N_CLASSES + 8 + N_HASHED


def passage_features(buf: np.ndarray, offsets: np.ndarray, words_each: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of N_FEATURES per passage, and the text of each."""
    starts, ends, text = K.word_spans(buf, offsets)
    if not len(starts):
        return np.zeros((0, N_FEATURES), np.float32), np.zeros(0, np.int64)
    first = np.searchsorted(text, np.arange(len(offsets) - 1))
    inside = np.arange(len(text)) - first[text]
    head = inside % words_each == 0
    passage = np.cumsum(head) - 1
    n = int(passage[-1]) + 1
    of_text = text[head]
    words = np.bincount(passage, minlength=n).astype(np.float64)
    begin = starts[head]
    bounds = np.append(begin, len(buf))
    stop = np.where(np.append(of_text[1:], -1) == of_text, bounds[1:], offsets[of_text + 1])
    size = (stop - begin).astype(np.float64)
    of_byte = np.zeros(len(buf) + 1, np.int64)
    of_byte[begin] = 1
    of_byte = np.cumsum(of_byte[:-1]) - 1
    valid = np.flatnonzero(of_byte >= 0)
    counts = np.bincount(of_byte[valid] * N_CLASSES + K.per_worker("mil classes", byte_classes)[buf[valid]], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    h = K.span_hashes(K.prefix_hashes(buf), starts, ends)
    key = K.mix(h + passage.astype(np.uint64) * K.BASE)
    _, one = np.unique(key, return_index=True)
    mean = lambda x: np.bincount(passage, x, n) / words
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & ~head[1:]
    begins, finals = buf[starts], buf[ends - 1]
    second = buf[np.minimum(starts + 1, ends - 1)]
    upper = lambda b: (b >= 0x41) & (b <= 0x5A)
    letter = lambda b: upper(b) | ((b >= 0x61) & (b <= 0x7A)) | (b >= 0x80)
    sign = np.where(h >> np.uint64(63) == 0, 1.0, -1.0)
    slot = passage * N_HASHED + (h % np.uint64(N_HASHED)).astype(np.int64)
    hashed = np.bincount(slot, sign, n * N_HASHED).reshape(n, N_HASHED) / np.sqrt(words)[:, None]
    f = np.column_stack([
        counts / size[:, None],
        mean((ends - starts).astype(float)) / 10,
        np.bincount(passage[one], minlength=n) / words,
        mean(same),
        mean(upper(begins).astype(float)),
        mean((upper(begins) & upper(second) & (ends - starts > 1)).astype(float)),
        mean((finals == 0x2E).astype(float)),
        mean((~letter(begins)).astype(float)),
        np.log1p(words) / 5,
        hashed,
    ])
    return f.astype(np.float32), of_text


class Attention:
    """The network; params are named arrays, so that they pickle."""

    def __init__(self, hidden: int = 16, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        shape = {"w": (N_FEATURES, hidden), "b": (hidden,), "v": (hidden, hidden), "u": (hidden, hidden), "a": (hidden,), "c": (hidden,), "c0": (1,)}
        self.p = {k: rng.normal(0, 0.3, s) if len(s) > 1 or k in "ac" else np.zeros(s) for k, s in shape.items()}
        self.mean, self.sd = np.zeros(N_FEATURES), np.ones(N_FEATURES)

    def forward(self, x: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        """x: passages, bag after bag; at: each bag's first passage."""
        p = self.p
        x = np.clip((x - self.mean) / self.sd, -8, 8)
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["a"]
        size = np.diff(np.append(at, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), size))
        weight = e / np.repeat(np.add.reduceat(e, at), size)
        z = np.add.reduceat(h * weight[:, None], at)
        return {"x": x, "h": h, "t": t, "g": g, "weight": weight, "z": z, "size": size, "y": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["c0"], -30, 30)))}

    def gradients(self, x: np.ndarray, at: np.ndarray, label: np.ndarray, cost: np.ndarray) -> dict[str, np.ndarray]:
        """Of the sum of cost times log loss, by each parameter."""
        p, f = self.p, self.forward(x, at)
        d = (f["y"] - label) * cost
        dz = np.repeat(d[:, None] * p["c"], f["size"], 0)
        dh = dz * f["weight"][:, None]
        dw = (dz * f["h"]).sum(1)
        de = f["weight"] * (dw - np.repeat(np.add.reduceat(f["weight"] * dw, at), f["size"]))
        tg = de[:, None] * p["a"]
        dt, dg = tg * f["g"] * (1 - f["t"] ** 2), tg * f["t"] * f["g"] * (1 - f["g"])
        dh += dt @ p["v"].T + dg @ p["u"].T
        dx = dh * (1 - f["h"] ** 2)
        return {"w": f["x"].T @ dx, "b": dx.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ d, "c0": np.array([d.sum()])}

    def fit(self, x: np.ndarray, at: np.ndarray, label: np.ndarray, *, turns: int = 300, rate: float = 0.02, decay: float = 1e-4) -> None:
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-3
        share = label.mean() if 0 < label.mean() < 1 else 0.5
        cost = np.where(label == 1, 0.5 / share, 0.5 / (1 - share)) / len(label)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        p = self.p
        for turn in range(1, turns + 1):
            for k, v in self.gradients(x, at, label, cost).items():
                v = v + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.999 * s[k] + 0.001 * v * v
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**turn)) / (np.sqrt(s[k] / (1 - 0.999**turn)) + 1e-8)


def bags(buf: np.ndarray, offsets: np.ndarray, words_each: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j in K.groups(offsets):
        yield i, j, *passage_features(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words_each)


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 3000, sample_chars: int = 40_000_000, passage_words: int = 64) -> Attention:
    """A model from at most sample_rows labelled rows of together at most sample_chars characters, by md5 of their ids.

    Only their passages' features come to the driver, some number for each passage_words words. A text that is longer than all the
    room there is, is passed over, here alone; an id with several labels has the smallest.
    """
    picked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    picked = picked.orderBy(F.md5(F.col("id").cast("string")), "id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "id").select("id", "text", "label")
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    room = rows.select("id", size.alias("size")).where(F.col("size") <= sample_chars).groupBy("id").agg(F.sum("size").alias("size"))  # sample_rows rows at most
    total = F.sum("size").over(Window.orderBy(F.md5(F.col("id").cast("string")), "id").rowsBetween(Window.unboundedPreceding, 0))
    fitting = room.withColumn("total", total).where(F.col("total") <= sample_chars).select("id")
    rows = rows.where(size <= sample_chars).join(F.broadcast(fitting), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = K.packed(batch.column(1))
            for i, j, f, text in bags(buf, offsets, passage_words):
                parts = np.split(f, np.searchsorted(text, np.arange(1, j - i)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array([x.tobytes() for x in parts], pa.binary())], ["id", "label", "f"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = rows.mapInArrow(run, f"id {kind}, label int, f binary").where(F.length("f") > 0).orderBy(F.md5(F.col("id").cast("string")), "id").limit(sample_rows).collect()
    model = Attention()
    if not got:
        return model
    x = [np.frombuffer(r.f, np.float32).reshape(-1, N_FEATURES) for r in got]
    at = np.cumsum([0, *map(len, x)])[:-1]
    model.fit(np.concatenate(x).astype(np.float64), at, np.array([r.label for r in got], float))
    return model


def score_quality(docs: DataFrame, model: Attention, *, id_col: str = "doc_id", text_col: str = "text", passage_words: int = 64) -> DataFrame:
    """id, score (0 to 1), n_passages, top_passage (the one of most weight, from 0; null if none)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = K.packed(batch.column(1))
            for i, j, f, text in bags(buf, offsets, passage_words):
                score, top = np.zeros(j - i), np.full(j - i, -1)
                n = np.bincount(text, minlength=j - i)
                if len(f):
                    has = np.flatnonzero(n)
                    at = np.searchsorted(text, has)
                    out = model.forward(f.astype(np.float64), at)
                    score[has] = out["y"]
                    best = np.maximum.reduceat(out["weight"], at)
                    is_best = np.flatnonzero(out["weight"] == np.repeat(best, out["size"]))[::-1]
                    top[text[is_best]] = is_best - np.searchsorted(text, text[is_best])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score), pa.array(n, pa.int64()), pa.array(top, pa.int64(), mask=top < 0)], ["id", "score", "n_passages", "top_passage"])

    out = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, score double, n_passages bigint, top_passage bigint")
    return out.withColumnRenamed("id", id_col)
