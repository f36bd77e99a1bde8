"""Language identification by a linear-chain conditional random field over the words of a text.

A word's features are its affixes (one to three bytes at either end), its byte 2- and 3-grams, and its entry
in a lexicon of training words. Their weights and the transitions between labels are learned together by the
gradient of the likelihood, with forward-backward for the expected counts. Only documents are labelled, so the
training sequences are spliced: runs of words from documents of different languages, each with the label of its
document. That teaches the transitions what a switch costs. A text's words get posteriors by forward-backward
over the whole text; the text's language is the one with the largest mean over words with a letter.

A null text, or one without a letter, is und with score 0. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import stratified_sample

UNKNOWN = "und"
GRAM_BITS, AFFIX_BITS = 15, 14


def folded(buf: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals in lower case."""
    out = buf.copy()
    out[(buf >= 0x41) & (buf <= 0x5A)] += 0x20
    if len(buf) > 1:
        wide = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
        out[wide] += 0x20
    return out


def slots(x: np.ndarray, kind: int, bits: int) -> np.ndarray:
    return ((x.astype(np.uint64) | np.uint64(kind << 40)) * K.BASE >> np.uint64(64 - bits)).astype(np.int64)


class Features:
    """Feature slots of distinct words: grams by byte, affixes by word."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        self.n = len(starts)
        self.at = np.cumsum(sizes) - sizes
        self.sizes = sizes
        b = np.append(buf[np.repeat(starts, sizes) + K.ramps(sizes)].astype(np.int64) + 1, [0, 0])
        n = len(b) - 2
        left = np.repeat(self.at + sizes, sizes) - np.arange(n)  # bytes to the word's end
        one = np.where(left > 1, b[1 : n + 1], 0)
        two = np.where(left > 2, b[2 : n + 2], 0)
        self.grams = (slots(b[:n] | one << 9, 1, GRAM_BITS), slots(b[:n] | one << 9 | two << 18, 2, GRAM_BITS))
        end = self.at + sizes - 1
        first, last = [b[self.at]], [b[end]]
        for k in (1, 2):
            first.append(first[-1] | np.where(sizes > k, b[np.minimum(self.at + k, end)], 0) << 9 * k)
            last.append(last[-1] | np.where(sizes > k, b[np.maximum(end - k, self.at)], 0) << 9 * k)
        self.affixes = tuple(slots(x, 10 + i, AFFIX_BITS) for i, x in enumerate((*first, *last)))


def distinct_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text of each word, its index among the distinct words, and their starts, sizes and hashes; buf: folded."""
    starts, ends, text = K.word_spans(buf, offsets)
    h = K.span_hashes(K.prefix_hashes(buf), starts, ends)
    keys, first, which = np.unique(h, return_index=True, return_inverse=True)
    return text, which, starts[first], (ends - starts)[first], keys


class Chain:
    """Sequences laid side by side, longest first, so that each turn is one slice."""

    def __init__(self, lengths: np.ndarray) -> None:
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        step = K.ramps(lengths)
        self.active = np.bincount(step) if len(step) else np.zeros(0, np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        self.place = self.at[step] + np.repeat(rank, lengths)

    def posteriors(self, emit: np.ndarray, start: np.ndarray, move: np.ndarray, expected: np.ndarray | None = None) -> tuple[np.ndarray, float]:
        """Posterior of each label at each place (in the order of place), and the log of all sequences' sums; adds to expected the moves."""
        top = emit.max(1, keepdims=True)
        e = np.exp(emit - top)
        a = np.empty_like(e)
        scale = np.empty((len(e), 1), e.dtype)
        at, m = self.at, np.exp(move)
        begin = np.exp(start - start.max())
        for t in range(len(self.active)):
            i, j = at[t], at[t + 1]
            x = begin * e[i:j] if t == 0 else (a[at[t - 1] : at[t - 1] + j - i] @ m) * e[i:j]
            s = x.sum(1, keepdims=True)
            scale[i:j] = s
            a[i:j] = x / s
        back = np.ones_like(e)
        for t in range(len(self.active) - 2, -1, -1):
            i, j, k = at[t], at[t + 1], at[t + 2]
            n = k - j
            nxt = e[j:k] * back[j:k] / scale[j:k]
            back[i : i + n] = nxt @ m.T
            if expected is not None:
                expected += (a[i : i + n].T @ nxt) * m
        n0 = self.active[0] if len(self.active) else 0
        return a * back, float(np.log(scale).sum() + top.sum() + n0 * start.max())


class LanguageCRF:
    def __init__(self, labels: list[str]) -> None:
        k = len(labels)
        self.labels = labels
        self.p = {"gram": np.zeros((1 << GRAM_BITS, k), np.float32), "affix": np.zeros((1 << AFFIX_BITS, k), np.float32), "lex": np.zeros((1, k), np.float32), "start": np.zeros(k, np.float32), "move": np.zeros((k, k), np.float32)}
        self.lexicon = np.zeros(0, np.uint64)

    def entries(self, keys: np.ndarray) -> np.ndarray:
        """Rows of the lexicon's weights; the last is of words that it lacks."""
        if not len(self.lexicon):
            return np.zeros(len(keys), np.int64)
        i = np.minimum(np.searchsorted(self.lexicon, keys), len(self.lexicon) - 1)
        return np.where(self.lexicon[i] == keys, i, len(self.lexicon))

    def emissions(self, f: Features, entry: np.ndarray) -> np.ndarray:
        p = self.p
        if not f.n:
            return np.zeros((0, len(self.labels)), np.float32)
        out = np.add.reduceat(p["gram"][f.grams[0]] + p["gram"][f.grams[1]], f.at)
        for x in f.affixes:
            out += p["affix"][x]
        return out + p["lex"][entry]

    def fit(self, texts: list[str], langs: list[str], *, turns: int = 30, rate: float = 0.15, decay: float = 2e-6, lexicon_words: int = 30_000, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        raw, offsets = K.packed(pa.array(texts, pa.string()))
        buf = folded(raw)
        text, which, starts, sizes, keys = distinct_words(buf, offsets)
        y_doc = np.array([self.labels.index(x) for x in langs], np.int64)
        n_docs = np.bincount(which, minlength=len(keys))
        often = np.argsort(-n_docs, kind="stable")[:lexicon_words]
        self.lexicon = np.sort(keys[often[n_docs[often] > 2]])
        k = len(self.labels)
        self.p["lex"] = np.zeros((len(self.lexicon) + 1, k), np.float32)
        f, entry = Features(buf, starts, sizes), self.entries(keys)
        # splices: runs of 8 to 40 words in random order, some ten to a sequence
        cuts = np.zeros(len(text), bool)
        i = 0
        while i < len(text):
            cuts[i] = True
            i += int(rng.integers(8, 41))
        cuts |= np.append(True, text[1:] != text[:-1])
        run_at = np.flatnonzero(cuts)
        run_size = np.diff(np.append(run_at, len(text)))
        order = rng.permutation(len(run_at))
        words = np.repeat(run_at[order], run_size[order]) + K.ramps(run_size[order])
        part = np.arange(len(order)) // 10
        chain = Chain(np.bincount(part, run_size[order]).astype(np.int64))
        word_at, y = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        word_at[chain.place], y[chain.place] = which[words], y_doc[text[words]]
        one = np.eye(k, dtype=np.float32)[y]
        seen = np.zeros((k, k), np.float32)
        for t in range(len(chain.active) - 1):
            i, j, q = chain.at[t], chain.at[t + 1], chain.at[t + 2]
            np.add.at(seen, (y[i : i + q - j], y[j:q]), 1)
        first = one[: chain.active[0]].sum(0)
        owner = np.repeat(np.arange(f.n), f.sizes)
        m1 = {n: np.zeros_like(v) for n, v in self.p.items()}
        m2 = {n: np.zeros_like(v) for n, v in self.p.items()}
        for turn in range(1, turns + 1):
            moves = np.zeros((k, k), np.float32)
            emit = self.emissions(f, entry)[word_at]
            post, _ = chain.posteriors(emit, self.p["start"], self.p["move"], moves)
            d = post - one
            g = np.stack([np.bincount(word_at, d[:, c], f.n) for c in range(k)], 1)
            rows = {"gram": (f.grams, owner), "affix": (f.affixes, slice(None)), "lex": ((entry,), slice(None))}
            grad = {n: sum(np.stack([np.bincount(x, g[own, c], len(self.p[n])) for c in range(k)], 1) for x in xs) for n, (xs, own) in rows.items()}
            grad |= {"start": post[: chain.active[0]].sum(0) - first, "move": moves - seen}
            for n, v in grad.items():
                v = v / len(words) + decay * self.p[n]
                m1[n] = 0.8 * m1[n] + 0.2 * v
                m2[n] = 0.99 * m2[n] + 0.01 * v * v
                self.p[n] = (self.p[n] - rate * (m1[n] / (1 - 0.8**turn)) / (np.sqrt(m2[n] / (1 - 0.99**turn)) + 1e-7)).astype(np.float32)

    def words(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, posterior of each label and whether it has a letter, of every word."""
        n, k = len(offsets) - 1, len(self.labels)
        buf = folded(raw)
        text, which, starts, sizes, keys = distinct_words(buf, offsets)
        if not len(text) or not k:
            return np.zeros(0, np.int64), np.zeros((0, k)), np.zeros(0, bool)
        f = Features(buf, starts, sizes)
        emit = self.emissions(f, self.entries(keys))
        b = buf[np.repeat(starts, sizes) + K.ramps(sizes)]
        letters = np.add.reduceat(((b >= 0x61) & (b <= 0x7A)) | (b >= 0x80), f.at) > 0
        chain = Chain(np.bincount(text, minlength=n))
        placed = np.empty(len(text), np.int64)
        placed[chain.place] = which
        post, _ = chain.posteriors(emit[placed], self.p["start"], self.p["move"])
        return text, post[chain.place], letters[which]

    def label(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean posterior of each label over each text's words with a letter, and the number of these words."""
        n, k = len(offsets) - 1, len(self.labels)
        text, post, letters = self.words(raw, offsets)
        post = post * letters[:, None]
        count = np.bincount(text, letters, n)
        share = np.array([np.bincount(text, post[:, c], n) for c in range(k)]).reshape(k, n).T / np.maximum(count, 1)[:, None]
        return share, count.astype(np.int64)


def fit_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 1000, sample_chars: int = 4_000_000) -> LanguageCRF:
    """A model from labelled rows chosen by hash, each language in turn: sample_rows at most, and no more than sample_chars together.

    So a rare language is learned as well, as long as there are no more languages than sample_rows.
    """
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    got = stratified_sample(rows, "id", "lang", sample_rows, sample_chars).collect()
    model = LanguageCRF(sorted({r.lang for r in got}))
    if len(model.labels) > 1:
        model.fit([r.text for r in got], [r.lang for r in got])
    return model


def identify(docs: DataFrame, model: LanguageCRF, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, n_words (with a letter), shares (label to mean posterior)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.labels, UNKNOWN], object)
        for batch in batches:
            buf, offsets = K.packed(batch.column(1))
            for i, j in K.groups(offsets):
                part, at = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                share, count = model.label(part, at)
                plain = np.concatenate([[0], np.cumsum(((part | 0x20) >= 0x61) & ((part | 0x20) <= 0x7A))])
                known = plain[at[1:]] > plain[at[:-1]]
                for r in np.flatnonzero(~known & (count > 0)):
                    known[r] = any(c.isalpha() for c in part[at[r] : at[r + 1]].tobytes().decode("utf-8", "replace"))
                known &= len(model.labels) > 0
                best = share.argmax(1) if len(model.labels) else np.zeros(j - i, np.int64)
                score = np.where(known, share[np.arange(j - i), best] if len(model.labels) else 0.0, 0.0)
                shares = pa.MapArray.from_arrays(pa.array(np.arange(j - i + 1) * len(model.labels), pa.int32()), pa.array(model.labels * (j - i), pa.string()), pa.array(share.ravel().astype(np.float64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names[np.where(known, best, -1)], pa.string()), pa.array(np.clip(score, 0, 1).astype(np.float64)), pa.array(count), shares], ["id", "lang_pred", "score", "n_words", "shares"])

    out = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, lang_pred string, score double, n_words bigint, shares map<string,double>")
    return out.withColumnRenamed("id", id_col)


def label_words(docs: DataFrame, model: LanguageCRF, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, runs: the words of each text in stretches of one language, as array<struct<lang, from, to, score>>.

    from and to count words from 0, to is not included; score is the mean posterior of the label. Words without a letter
    go with the likelier label, too. A null text, or a text without words, has no run.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = pa.list_(pa.struct([("lang", pa.string()), ("from", pa.int32()), ("to", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = K.packed(batch.column(1))
            for i, j in K.groups(offsets):
                text, post, _ = model.words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                best = post.argmax(1) if len(post) else np.zeros(0, np.int64)
                at = np.flatnonzero(np.append(True, (np.diff(best) != 0) | (np.diff(text) != 0))[: len(text)])
                stop = np.append(at[1:], len(text))
                begin = np.searchsorted(text, text[at])
                mean = np.add.reduceat(post[np.arange(len(post)), best], at) / (stop - at) if len(at) else np.zeros(0)
                out = [[] for _ in range(i, j)]
                for t, c, a, b, m in zip(text[at], best[at], at - begin, stop - begin, mean, strict=True):
                    out[t].append({"lang": model.labels[c], "from": int(a), "to": int(b), "score": float(m)})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(out, run_type)], ["id", "runs"])

    out = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, runs array<struct<lang:string,`from`:int,`to`:int,score:double>>")
    return out.withColumnRenamed("id", id_col)
