"""Scoring by a gated recurrent language model, with smoothed unigram counts of the whole training corpus.

Counts of all training words are gathered by a shuffle, keyed by a 64-bit hash. The commonest VOCABULARY words
are the network's own, in classes of neighbours by frequency; every other word is of the class "rare", and within
it has its smoothed share of the rare words' counts. So the model gives every text a probability. A text's tokens
are its words (A-Z in lower case) and one end.

The network (one layer of gated recurrent units) is trained by truncated backpropagation through time in numpy. It
starts on a bounded sample at the driver (sample_rows rows chosen by hash, sample_chars characters together), and then
every task goes on from there over all its training texts, whole; the weights that the tasks end with are averaged by
tokens, in a sum that Spark combines before the shuffle. So what the network learns from grows with the corpus. In
scoring, texts run window after window with their state carried on, so a text is scored whole whatever its length.

Counts reach the texts in two ways: the commonest head_words words are sent to every task, a bounded table;
rarer words meet their counts in a join keyed by word, in which no word is common.

A null text counts as empty: one token, the end. Rows that repeat are scored each. Extra columns are ignored.
With no training text all counts are 0.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .crf import Chain
from .store import bounded_sample, cut

END = np.uint64(0x5E0FE4D0F7E87A11)
CLASS_WORDS, CLASSES = 32, 32
VOCABULARY = CLASS_WORDS * CLASSES
RARE = VOCABULARY


def ascii_lower(buf: np.ndarray) -> np.ndarray:
    out = buf.copy()
    out[(buf >= 0x41) & (buf <= 0x5A)] += 0x20
    return out


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, text after text with its end, and the number of tokens of each text."""
    buf = ascii_lower(buf)
    starts, ends, text = K.word_spans(buf, offsets)
    n = len(offsets) - 1
    count = np.bincount(text, minlength=n).astype(np.int64)
    h = K.span_hashes(K.prefix_hashes(buf), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    out = np.full(len(h) + n, END)
    out[np.arange(len(h)) + text] = h
    return out, count + 1


def count_tokens(docs: DataFrame, text_col: str, flush: int = 1_000_000) -> DataFrame:
    """(word, c): the 64-bit hash of each token and its count; counted in the task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def batch_of() -> pa.RecordBatch:
            words, back = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([c for _, c in parts]), len(words)).astype(np.int64)
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "c"])

        for batch in batches:
            buf, offsets = K.packed(batch.column(0))
            for i, j in K.groups(offsets):
                h, _ = tokens(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                parts.append(np.unique(h, return_counts=True))
                if sum(len(w) for w, _ in parts) > flush:
                    yield batch_of()
        if parts:
            yield batch_of()

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word bigint, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def soft(e: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp of e less each row's largest, the rows' sums, and the log of a row's sum with what was taken off; in place. most: a bound of e."""
    if most < 80:  # no exp can overflow
        q = np.exp(e, out=e)
        total = q @ np.ones(q.shape[1], q.dtype)
        return q, total, np.log(total)
    top = e.max(1)
    e -= top[:, None]
    q = np.exp(e, out=e)
    total = q @ np.ones(q.shape[1], q.dtype)
    return q, total, np.log(total) + top


class GatedLM:
    """Input vectors, gates (update, reset, candidate side by side), class and word outputs; float32."""

    def __init__(self, hidden: int = 24, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        s = lambda *n: rng.normal(0, 0.15, n).astype(np.float32)
        self.h = hidden
        self.p = {"x": s(VOCABULARY + 1, 3 * hidden), "u": s(hidden, 3 * hidden), "c": s(hidden, CLASSES + 1), "cb": np.zeros(CLASSES + 1, np.float32), "w": s(VOCABULARY, hidden), "wb": np.zeros(VOCABULARY, np.float32)}

    def start_from(self, counts: np.ndarray, rare: float) -> None:
        """Output biases that give the words' shares."""
        c = np.append(counts, np.zeros(VOCABULARY - len(counts))) + 1
        by_class = np.append(c.reshape(CLASSES, CLASS_WORDS).sum(1), rare + 1)
        self.p["cb"] = np.log(by_class / by_class.sum()).astype(np.float32)
        self.p["wb"] = np.log(c).astype(np.float32)

    def step(self, word: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        n = self.h
        x, y = self.p["x"].take(word, 0), h @ self.p["u"]
        g = sigmoid(x[:, : 2 * n] + y[:, : 2 * n])
        z, r = g[:, :n], g[:, n:]
        new = r * y[:, 2 * n :]
        new += x[:, 2 * n :]
        np.tanh(new, out=new)
        out = h - new
        out *= z
        out += new
        return z, r, y[:, 2 * n :], new, out

    def outputs(self, h: np.ndarray, word: np.ndarray, grad: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each word (for a rare one: of the class), and the gradient for h if grad is given."""
        p = self.p
        row = np.arange(len(word))
        cls = np.minimum(word // CLASS_WORDS, CLASSES)
        most = lambda w, b: float(np.abs(w).sum(0 if len(w) == self.h else 1).max() + np.abs(b).max())  # noqa: E731  states lie between -1 and 1
        e = h @ p["c"]
        e += p["cb"]
        out = e[row, cls]
        q, total, log = soft(e, most(p["c"], p["cb"]))
        out -= log
        dh = None
        if grad is not None:
            d = q
            d /= total[:, None]
            d[row, cls] -= 1
            grad["c"] += h.T @ d
            grad["cb"] += d.sum(0)
            dh = d @ p["c"].T
        order = np.argsort(cls, kind="stable")
        bounds = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        limit = most(p["w"], p["wb"])
        for k in range(CLASSES):
            at = order[bounds[k] : bounds[k + 1]]
            if not len(at):
                continue
            some = slice(k * CLASS_WORDS, (k + 1) * CLASS_WORDS)
            x = h.take(at, 0)
            e = x @ p["w"][some].T
            e += p["wb"][some]
            mine = (np.arange(len(at)), word[at] - k * CLASS_WORDS)
            said = e[mine]
            q, total, log = soft(e, limit)
            out[at] += said - log
            if grad is not None:
                d = q
                d /= total[:, None]
                d[mine] -= 1
                grad["w"][some] += d.T @ x
                grad["wb"][some] += np.ones(len(d), d.dtype) @ d
                dh[at] += d @ p["w"][some]
        return out, dh

    def window(self, chain: Chain, ids: np.ndarray, t0: int, t1: int, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, int]:
        """The gradient of the steps t0 to t1 for the state h before them, summed over tokens; the state after them; the number of tokens."""
        n = self.h
        kept, states = [], []
        for t in range(t0, t1):
            w = ids[chain.at[t] : chain.at[t + 1]]
            h = h[: len(w)]
            states.append(h)
            kept.append((w, *self.step(w, h)))
            h = kept[-1][-1]
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        _, d_out = self.outputs(np.concatenate(states), ids[chain.at[t0] : chain.at[t1]], grad)
        ends = np.cumsum([len(s) for s in states])
        dh = np.zeros((0, n), np.float32)
        sides, for_u, back = [], [], np.ascontiguousarray(self.p["u"].T)
        for i in range(len(states) - 1, -1, -1):
            w, z, r, y, new, _ = kept[i]
            d = dh
            if len(dh) < len(w):
                d = np.zeros((len(w), n), h.dtype)
                d[: len(dh)] = dh
            kept_part = d - d * z
            d_new = new * new
            np.subtract(1, d_new, out=d_new)
            d_new *= kept_part
            d_z = states[i] - new
            d_z *= kept_part
            d_z *= z
            d_r = 1 - r
            d_r *= r
            d_r *= y
            d_r *= d_new
            side = np.concatenate([d_z, d_r, d_new], 1)
            sides.append(side)
            side = side.copy()
            side[:, 2 * n :] *= r
            for_u.append(side)
            dh = side @ back
            dh += d * z
            dh += d_out[ends[i] - len(w) : ends[i]]
        grad["u"] += np.concatenate(states[::-1]).T @ np.concatenate(for_u)
        words = np.concatenate([k[0] for k in kept[::-1]])
        by_word = np.argsort(words, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(words[by_word]) > 0))
        grad["x"][words[by_word[first]]] = np.add.reduceat(np.concatenate(sides).take(by_word, 0), first)
        return grad, h, int(ends[-1])

    def fit(self, words: np.ndarray, lengths: np.ndarray, *, window: int = 32, turns: int = 10, rate: float = 0.01) -> None:
        """Truncated backpropagation: gradients stop at a window's start, the state doesn't."""
        chain = Chain(lengths)
        ids = np.empty(len(words), np.int64)
        ids[chain.place] = words
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        turn = 0
        for _ in range(turns):
            h = np.zeros((chain.active[0] if len(chain.active) else 0, self.h), np.float32)
            for t0 in range(0, len(chain.active), window):
                grad, h, size = self.window(chain, ids, t0, min(t0 + window, len(chain.active)), h)
                turn += 1
                for k, g in grad.items():
                    g = np.clip(g / size, -1, 1)
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.99 * m2[k] + 0.01 * g * g
                    self.p[k] -= (rate * (m1[k] / (1 - 0.9**turn)) / (np.sqrt(m2[k] / (1 - 0.99**turn)) + 1e-6)).astype(np.float32)

    def score(self, words: np.ndarray, lengths: np.ndarray, window: int = 64) -> np.ndarray:
        """Natural log probability of each sequence; rare words by their class."""
        chain = Chain(lengths)
        ids = np.empty(len(words), np.int64)
        ids[chain.place] = words
        logs = np.empty(len(words), np.float32)
        h = np.zeros((chain.active[0] if len(chain.active) else 0, self.h), np.float32)
        for t0 in range(0, len(chain.active), window):
            states = []
            for t in range(t0, min(t0 + window, len(chain.active))):
                w = ids[chain.at[t] : chain.at[t + 1]]
                h = h[: len(w)]
                states.append(h)
                h = self.step(w, h)[-1]
            i, j = chain.at[t0], chain.at[min(t0 + window, len(chain.active))]
            logs[i:j] = self.outputs(np.concatenate(states), ids[i:j])[0]
        return np.add.reduceat(logs[chain.place].astype(np.float64), np.cumsum(lengths) - lengths) if len(lengths) else np.zeros(0)


def pieces_of(size: np.ndarray, piece: int) -> np.ndarray:
    """Texts of size tokens cut into training sequences of piece tokens, the last of each text shorter."""
    parts = -(-size // piece)
    out = np.full(int(parts.sum()), piece)
    out[np.cumsum(parts) - 1] = size - (parts - 1) * piece
    return out


def learn_everywhere(taught: DataFrame, text_col: str, scorer: Scorer, piece: int, rate: float) -> None:
    """One pass over all training texts: each task goes on from the network as it is; the mean of their weights, by tokens, is the new one."""
    names = sorted(scorer.net.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = copy.deepcopy(scorer.net)
        seen = 0
        for batch in batches:
            buf, offsets = K.packed(batch.column(0))
            for i, j in K.groups(offsets, 2 * K.CHUNK_BYTES):
                h, size = tokens(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                net.fit(scorer.vocabulary_ids(h), pieces_of(size, piece), turns=1, rate=rate)
                seen += len(h)
        if seen:
            flat = np.concatenate([net.p[k].ravel() for k in names]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * seen), pa.array(np.full(len(flat), seen, np.int64))], ["i", "weighted", "n"])

    done = taught.select(F.col(text_col).cast("string")).mapInArrow(run, "i int, weighted double, n bigint")
    mean = done.groupBy("i").agg((F.sum("weighted") / F.sum("n")).alias("v")).orderBy("i").toPandas()["v"].to_numpy()
    at = 0
    for k in names:
        shape = scorer.net.p[k].shape
        size = int(np.prod(shape))
        if len(mean):
            scorer.net.p[k] = mean[at : at + size].reshape(shape).astype(np.float32)
        at += size


class Scorer:
    """The network with the head of the counts."""

    def __init__(self, words: np.ndarray, counts: np.ndarray) -> None:
        order = np.lexsort((words, -counts))
        vocabulary = order[:VOCABULARY]
        if END not in words[vocabulary]:
            vocabulary = np.append(vocabulary[: VOCABULARY - 1], np.flatnonzero(words == END))
        ids = np.full(len(words), RARE)
        ids[vocabulary] = np.arange(len(vocabulary))
        by_word = np.argsort(words)
        self.words, self.counts, self.ids = words[by_word], counts[by_word], ids[by_word].astype(np.int32)
        self.own_counts = counts[vocabulary]
        mine = self.ids != RARE
        self.own, self.own_ids = self.words[mine], self.ids[mine].astype(np.int64)
        self.net = GatedLM()

    def vocabulary_ids(self, h: np.ndarray) -> np.ndarray:
        """The tokens' ids in the vocabulary; its few words are looked up by themselves."""
        if not len(self.own):
            return np.full(len(h), RARE)
        i = np.minimum(np.searchsorted(self.own, h), len(self.own) - 1)
        return np.where(self.own[i] == h, self.own_ids[i], RARE)

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each token is in the head, its count and its id in the vocabulary."""
        if not len(self.words):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64), np.full(len(h), RARE)
        i = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        has = self.words[i] == h
        return has, np.where(has, self.counts[i], 0), np.where(has, self.ids[i], RARE)


def score_texts(
    docs: DataFrame,
    training: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    head_words: int = 1 << 17,
    sample_rows: int = 600,
    sample_chars: int = 2_000_000,
    piece: int = 512,
    rate: float = 0.005,
) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score of each row; training: the rows learned from, all of them."""
    taught = docs.where(F.coalesce(training, F.lit(False)))
    counts = cut(count_tokens(taught, text_col))
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    level = F.floor(F.log2("c") * 16).cast("int")
    least = 0
    have = 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        have += r["count"]
        if have > head_words:
            break
        least = r["level"]
    head = counts.where((level >= least) | (F.col("word") == int(END.view(np.int64)))).limit(head_words + 1).toPandas()
    scorer = Scorer(head["word"].to_numpy(np.int64).view(np.uint64), head["c"].to_numpy(np.int64))
    n_rare, v_rare = whole.n - int(scorer.own_counts.sum()), whole.v - len(scorer.own_counts)

    texts = taught.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = [r.text for r in bounded_sample(texts, "id", sample_rows, sample_chars).collect()]
    scorer.net.start_from(scorer.own_counts, n_rare)
    if sample:  # texts longer than sample_chars are learned from in the pass over all of them alone
        h, size = tokens(*K.packed(pa.array(sample, pa.string())))
        scorer.net.fit(scorer.look_up(h)[2], pieces_of(size, piece))
    learn_everywhere(taught, text_col, scorer, piece, rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = K.packed(batch.column(1))
            for i, j in K.groups(offsets, 4 * K.CHUNK_BYTES):
                h, size = tokens(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                text = np.repeat(np.arange(j - i), size)
                has, c, ids = scorer.look_up(h)
                logs = np.log10(c + 1.0)
                rare = ids == RARE
                tail = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(text[~has], minlength=j - i))]), pa.int32()), pa.array(h[~has].view(np.int64)))
                sums = [np.bincount(text, x, j - i) for x in (logs, logs * rare)]
                known, n_of_rare = (np.bincount(text, x, j - i).astype(np.int64) for x in (c > 0, rare))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(size, pa.int64()), pa.array(known), pa.array(n_of_rare), pa.array(sums[0]), pa.array(sums[1]), pa.array(scorer.net.score(ids, size) / np.log(10)), tail],
                    ["id", "n_tokens", "known", "n_rare", "logs", "rare_logs", "net", "tail"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    fields = f"id {kind}, n_tokens bigint, known bigint, n_rare bigint, logs double, rare_logs double, net double, tail array<bigint>"
    scored = cut(docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, fields).withColumn("row", F.monotonically_increasing_id()))
    found = scored.select("row", F.explode("tail").alias("word")).join(counts, "word")
    found = found.groupBy("row").agg(F.sum(F.log10(F.col("c") + 1)).alias("tail_logs"), F.count(F.lit(1)).alias("tail_known"))
    out = scored.drop("tail").join(found, "row", "left").na.fill(0, ["tail_logs", "tail_known"])
    base = F.col("logs") + F.col("tail_logs") - F.col("n_tokens") * F.lit(float(np.log10(whole.n + whole.v + 1)))
    score = F.col("net") + F.col("rare_logs") + F.col("tail_logs") - F.col("n_rare") * F.lit(float(np.log10(n_rare + v_rare + 1)))
    return out.select(F.col("id").alias(id_col), "n_tokens", (F.col("known") + F.col("tail_known")).alias("n_known"), F.lit(int(whole.n)).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
