"""Exact byte-level BPE without running merges, and decoding through an offset table.

Encoding: an Aho-Corasick automaton over the reversed vocabulary gives, at every byte, the longest
token that starts there. A backtracking search lays tokens one after the other, and takes a token
only if the pair with its predecessor is compatible, that is if merging the bytes of both gives just
these two tokens. A position from which no way led on is never tried twice, so the work is linear in
the length. A chain of compatible pairs is what the merge rules give, and there is only one.
Short pieces run through arrays, many at a time; longer ones one by one.

Decoding: the ids index a table of offsets into one string of all tokens' bytes.

Null texts count as empty: no tokens, the hashes of an empty string. Rows that repeat are encoded
each. Other columns are left alone.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

NONE = -1
SHORT = 63  # bytes: a piece's dead ends fit the bits of one integer


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as they are, and the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables made of a tokenizer file: pairs, splits, automaton, prefixes and offsets."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        if spec["model"].get("type") != "BPE" or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"{path}: only byte-level BPE with its usual pattern, without a normalizer or a space in front, is read")
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.special = [(x["content"].encode(), x["id"]) for x in spec.get("added_tokens", [])]
        size = 1 + max([*vocab.values(), *(i for _, i in self.special)])
        if size > 1 << 17:
            raise ValueError(f"{path}: ids go up to {size - 1}; pairs are packed by 17 bits each")
        self.bytes = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special:
            self.bytes[i] = token
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.rank = np.full(size, NONE, np.int64)  # of the merge that makes a token; -1: a byte
        self.left, self.right = np.arange(size), np.arange(size)
        for r in range(len(merges) - 1, -1, -1):
            self.rank[made[r]], self.left[made[r]], self.right[made[r]] = r, left[r], right[r]
        self.merge_rank = {pair: r for r, pair in reversed([*enumerate(zip(left.tolist(), right.tolist(), strict=True))])}
        self._pair_table(left, right)
        self.seen = np.full(1 << 20, -1, np.int64)
        plain = np.array(sorted(vocab.values()))
        whole = self.compatible(self.left[plain], self.right[plain], self.rank[plain]) | (self.rank[plain] == NONE)
        usable = {self.bytes[i]: int(i) for i in plain[whole]}
        while True:  # a token whose parts can't occur can't occur
            lost = [t for t, i in usable.items() if self.rank[i] != NONE and not (self.bytes[self.left[i]] in usable and self.bytes[self.right[i]] in usable)]
            if not lost:
                break
            for t in lost:
                del usable[t]
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.shorter = np.full(size, NONE, np.int64)  # the longest token that is a proper prefix
        for t, i in usable.items():
            self.shorter[i] = next((usable[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in usable), NONE)
        self._automaton(usable)
        digits = [f"{i},".encode() for i in range(size)]
        width = max(map(len, digits))
        self.decimal = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in digits), np.uint8).reshape(size, width)
        self.classes = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\p{White_Space}+")):
            text = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(0x110000))
            for m in regex.finditer(pattern, text):
                self.classes[m.start() : m.end()] = kind
        self.classes[0x20] = 4

    def _pair_table(self, left: np.ndarray, right: np.ndarray) -> None:
        """Two tables, the second for pairs whose place in the first is taken, so that a lookup reads two places."""
        keys = (left << 17 | right).astype(np.uint64)
        ranks = np.arange(len(keys))
        self.bits = np.uint64(64 - max(16, int(len(keys)).bit_length() + 4))
        self.tables = []
        rng = np.random.default_rng(7)
        while True:
            factor = np.uint64(int(rng.integers(1, 1 << 62)) * 2 + 1)
            slot = ((keys * factor) >> self.bits).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            if len(self.tables) == 1 and len(first) < len(keys):
                continue
            table_key = np.full(1 << (64 - int(self.bits)), np.uint64(0xFFFFFFFFFFFFFFFF))
            table_rank = np.full(len(table_key), np.iinfo(np.int64).max)
            table_key[slot[first]], table_rank[slot[first]] = keys[first], ranks[first]
            self.tables.append((factor, table_key, table_rank))
            if len(self.tables) == 2:
                return
            rest = np.setdiff1d(np.arange(len(keys)), first)
            keys, ranks = keys[rest], ranks[rest]

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of two tokens; the largest integer if there is none."""
        keys = (a << 17 | b).astype(np.uint64)
        out = np.full(len(keys), np.iinfo(np.int64).max)
        for factor, table_key, table_rank in self.tables:
            slot = (keys * factor) >> self.bits
            out = np.where(table_key[slot] == keys, table_rank[slot], out)
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge across the border comes before the merges that make both tokens.

        Time runs backwards: of the two tokens at the border, the one made later is taken apart. A merge
        across the border would have come first if its rank is below that of the merge taken back; at the
        same rank the one further left comes first.
        """
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max) if limit is None else limit.copy()
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            across = self.pair_rank(x, y) < limit[live]
            good[live[across]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~across & ((rx != NONE) | (ry != NONE))
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            first = rx > ry
            a[live] = np.where(first, self.right[x], x)
            b[live] = np.where(first, y, self.left[y])
            limit[live] = np.where(first, rx, ry + 1)
        return good

    def compatible_kept(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible() through a table of a fixed size that keeps the pairs seen last."""
        keys = a << 17 | b
        slot = ((keys.astype(np.uint64) * K.BASE) >> np.uint64(44)).astype(np.int64)
        kept = self.seen[slot]
        out = (kept & 1).astype(bool)
        new = np.flatnonzero(kept >> 1 != keys)
        if len(new):
            out[new] = self.compatible(a[new], b[new])
            self.seen[slot[new]] = keys[new] << 1 | out[new]
        return out

    def compatible_pair(self, a: int, b: int) -> bool:
        """compatible() for one pair."""
        limit = len(self.merge_rank)
        while True:
            if self.merge_rank.get((a, b), limit) < limit:
                return False
            ra, rb = int(self.rank[a]), int(self.rank[b])
            if ra == rb == NONE:
                return True
            if ra > rb:
                a, limit = int(self.right[a]), ra
            else:
                b, limit = int(self.left[b]), rb + 1

    def _automaton(self, usable: dict[bytes, int]) -> None:
        """Goto with failures folded in, over reversed tokens; self.longest: the longest token that a state ends."""
        children: list[dict[int, int]] = [{}]
        ends = [NONE]
        depth_nodes: list[list[tuple[int, int, int]]] = []
        for token, i in usable.items():
            node = 0
            for d, byte in enumerate(reversed(token)):
                child = children[node].get(byte)
                if child is None:
                    child = len(children)
                    children[node][byte] = child
                    children.append({})
                    ends.append(NONE)
                    if d == len(depth_nodes):
                        depth_nodes.append([])
                    depth_nodes[d].append((child, node, byte))
                node = child
            ends[node] = i
        self.goto = np.zeros((len(children), 256), np.int32)
        self.longest = np.array(ends, np.int32)
        fail = np.zeros(len(children), np.int64)
        for child, _, byte in depth_nodes[0] if depth_nodes else []:
            self.goto[0, byte] = child
        for d, level in enumerate(depth_nodes):
            node, parent, byte = np.array(level, np.int64).T
            if d:
                fail[node] = self.goto[fail[parent], byte]
            self.longest[node] = np.where(self.longest[node] == NONE, self.longest[fail[node]], self.longest[node])
            if d + 1 < len(depth_nodes):
                down = np.array(depth_nodes[d + 1], np.int64).T
                self.goto[node] = self.goto[fail[node]]
                self.goto[down[1], down[2]] = down[0]
            else:
                self.goto[node] = self.goto[fail[node]]

    # pieces

    def pieces(self, raw: bytes, cuts: np.ndarray) -> np.ndarray:
        """Starts of the pieces that no merge crosses; cuts: byte positions where a piece surely starts.

        The pieces are those of 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+.
        """
        cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        cls = self.classes[cp]
        kind = np.minimum(cls, 3)
        n = len(cp)
        cut = np.zeros(n + 1, bool)
        cut[np.searchsorted(lead, cuts)] = True
        cut[0] = cut[n] = True
        run = cut[:n].copy()
        run[1:] |= kind[1:] != kind[:-1]
        spaced = np.zeros(n, bool)  # a space stands before, in the same part
        spaced[1:] = (cls[:-1] == 4) & ~cut[1:n]
        start = run & ~(spaced & (kind != 3))
        last = np.zeros(n, bool)
        last[:-1] = (kind[:-1] == 3) & (kind[1:] != 3) & ~cut[1:n]
        start |= last
        for i in np.flatnonzero((cp == 0x27) & start & run):
            for tail in ("s", "t", "re", "ve", "m", "ll", "d"):
                j = i + 1 + len(tail)
                if j <= n and not cut[i + 1 : j].any() and all(cp[i + 1 + k] == ord(c) for k, c in enumerate(tail)):
                    start[i + 1] = False
                    if j < n and not cut[j] and kind[j] == 1:
                        start[j] = True
                    break
        return lead[start]

    # encoding of pieces

    def encode_short(self, matrix: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens (rows padded) and their number, for pieces as rows of bytes, all of them at most SHORT long."""
        n, width = matrix.shape
        best = np.empty((n, width), np.int32)
        state = np.zeros(n, np.int32)
        for col in range(width - 1, -1, -1):
            inside = col < length
            state = np.where(inside, self.goto[state, matrix[:, col]], 0)
            best[:, col] = self.longest[state]
        out = np.zeros((n, width), np.int32)
        count = np.zeros(n, np.int64)
        pos = np.zeros(n, np.int64)
        dead = np.zeros(n, np.uint64)
        token = best[:, 0].astype(np.int64)
        live = np.flatnonzero(length > 0)
        while len(live):
            t, p, c = token[live], pos[live], count[live]
            after = p + self.length[t]
            fine = (dead[live] >> after.astype(np.uint64)) & np.uint64(1) == 0
            later = np.flatnonzero(fine & (c > 0))
            fine[later] = self.compatible_kept(out[live[later], c[later] - 1].astype(np.int64), t[later])
            yes = live[fine]
            out[yes, count[yes]] = token[yes]
            count[yes] += 1
            pos[yes] = after[fine]
            on = yes[pos[yes] < length[yes]]
            token[on] = best[on, pos[on]]
            no = live[~fine]
            less = self.shorter[token[no]]
            token[no] = np.where(less != NONE, less, token[no])
            back = no[less == NONE]
            dead[back] |= np.uint64(1) << pos[back].astype(np.uint64)
            count[back] -= 1
            token[back] = out[back, count[back]]
            pos[back] -= self.length[token[back]]
            live = live[(pos[live] < length[live])]
        return out, count

    def encode_long(self, piece: bytes) -> list[int]:
        """One piece of any length, in linear time."""
        state, best = 0, [0] * len(piece)
        goto, longest = self.goto, self.longest
        for i in range(len(piece) - 1, -1, -1):
            state = goto[state, piece[i]]
            best[i] = longest[state]
        known: dict[tuple[int, int], bool] = {}
        out: list[int] = []
        dead: set[int] = set()
        pos, token = 0, int(best[0])
        while True:
            after = pos + len(self.bytes[token])
            fine = after not in dead
            if fine and out:
                pair = (out[-1], token)
                fine = known.get(pair)
                if fine is None:
                    fine = known[pair] = self.compatible_pair(*pair)
            if fine:
                out.append(token)
                pos = after
                if pos == len(piece):
                    return out
                token = int(best[pos])
            elif self.shorter[token] != NONE:
                token = int(self.shorter[token])
            else:
                dead.add(pos)
                token = out.pop()
                pos -= len(self.bytes[token])

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and each text's number of ids."""
        n = len(offsets) - 1
        if not len(buf):
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        raw = buf.tobytes()
        marks: dict[int, int] = {}
        cuts = [offsets[(offsets < len(buf))]]
        for mark, i in self.special:
            at = raw.find(mark)
            while at >= 0:
                text = np.searchsorted(offsets, at, "right") - 1
                inside = at + len(mark) <= offsets[text + 1]
                if inside:
                    marks[at] = i
                    cuts.append(np.array([at, at + len(mark)]))
                at = raw.find(mark, at + (len(mark) if inside else 1))
        cuts = np.unique(np.concatenate(cuts))
        starts = self.pieces(raw, cuts[cuts < len(buf)])
        if marks:  # a mark is a piece of its own, whatever it is made of
            inner = np.zeros(len(buf), bool)
            for at, i in marks.items():
                inner[at + 1 : at + len(self.bytes[i])] = True
            starts = starts[~inner[starts]]
        ends = np.append(starts[1:], len(buf))
        size = ends - starts
        c = K.prefix_hashes(buf)
        key = K.span_hashes(c, starts, ends)
        if marks:
            is_mark = np.isin(starts, np.fromiter(marks, np.int64))
            key[is_mark] ^= np.uint64(0xA5A5A5A5A5A5A5A5)
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        ids, counts = self._encode_unique(buf, starts[first], size[first], {k: marks[s] for k, s in enumerate(starts[first]) if s in marks} if marks else {})
        at = np.cumsum(counts) - counts
        each = counts[back]
        flat = ids[np.repeat(at[back], each) + K.ramps(each)]
        text = np.searchsorted(offsets, starts, "right") - 1
        return flat, np.bincount(text, each, n).astype(np.int64)

    def _encode_unique(self, buf: np.ndarray, starts: np.ndarray, size: np.ndarray, marks: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros(len(starts), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        plain = np.ones(len(starts), bool)
        plain[list(marks)] = False
        padded = np.append(buf, np.zeros(SHORT + 1, np.uint8))
        low = 0
        for high in (4, 8, 12, 20, 32, SHORT):
            rows = np.flatnonzero(plain & (size > low) & (size <= high))
            low = high
            for some in np.array_split(rows, max(1, len(rows) // 100_000)):
                if len(some):
                    matrix = padded[starts[some][:, None] + np.arange(high)]
                    out, counts[some] = self.encode_short(matrix, size[some])
                    parts.append((some, out[np.arange(high) < counts[some][:, None]]))
        for k in np.flatnonzero(plain & (size > SHORT)):
            ids = self.encode_long(buf[starts[k] : starts[k] + size[k]].tobytes())
            counts[k] = len(ids)
            parts.append((np.array([k]), np.array(ids, np.int32)))
        for k, i in marks.items():
            counts[k] = 1
            parts.append((np.array([k]), np.array([i], np.int32)))
        at = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), np.int32)
        for rows, ids in parts:
            flat[np.repeat(at[rows], counts[rows]) + K.ramps(counts[rows])] = ids
        return flat, counts

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids: one gather through the offset table."""
        size = self.length[ids]
        return self.blob[np.repeat(self.offset[ids], size) + K.ramps(size)]


def vocabulary(path: str) -> Vocabulary:
    return K.per_worker(f"bpe {path}", lambda: Vocabulary(path))


def encode_texts(texts: list[str | None], path: str) -> list[list[int]]:
    """Ids of each text, for callers without Spark."""
    ids, counts = vocabulary(path).encode(*K.packed(pa.array(texts, pa.string())))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if len(texts) else []


def decode_ids(ids: list[int], path: str) -> str:
    return vocabulary(path).decode(np.array(ids, np.int64)).tobytes().decode("utf-8", "replace")


def bpe_encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Each row's id, ids (array, if with_ids), n_tokens, ids_sha256, and decoded_sha256 of the ids decoded again.

    One pass without a shuffle; memory is bounded by CHUNK_BYTES of text, or the longest text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    out = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            buf, offsets = K.packed(batch.column(1))
            for i, j in K.groups(offsets):
                part = buf[offsets[i] : offsets[j]]
                ids, counts = v.encode(part, offsets[i : j + 1] - offsets[i])
                at = np.concatenate([[0], np.cumsum(counts)])
                digits = v.decimal[ids]
                used = digits != 0
                text = digits[used].tobytes()
                text_at = np.concatenate([[0], np.cumsum(used.sum(1))])
                data = v.decode(ids).tobytes()
                data_at = np.concatenate([[0], np.cumsum(v.length[ids])])
                columns = [
                    batch.column(0).slice(i, j - i),
                    pa.array(counts, pa.int64()),
                    pa.array([hashlib.sha256(text[text_at[a] : max(text_at[a], text_at[b] - 1)]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string()),
                    pa.array([hashlib.sha256(data[data_at[a] : data_at[b]].decode("utf-8", "replace").encode()).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string()),
                ]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, out).withColumnRenamed("id", id_col)
