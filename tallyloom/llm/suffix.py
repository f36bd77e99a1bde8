"""Exact removal of byte strings that occur twice, by suffix sorting with hashed comparisons.

A string of length bytes that starts at s is settled where its anchor is: the smallest hash of a gram within it,
which depends on the string alone, so equal strings meet at equal anchors. Starts in a row with one anchor form a
run, and a run is cut in two by how far its anchor lies from the start; the strings of one half share a core of over
half their length. Runs whose core stands nowhere else are done. Runs that are equal from end to end to another are
repeated in whole. What is left are the edges of repeats: runs with a core that others have too, and that differ
somewhere around it. One run of each wording is sent, with its bytes, to the bucket of its core.

In a bucket the suffixes at the anchors are sorted, and so are the reversed prefixes before them: a mergesort in which
two suffixes are compared by their longest common extension, found by binary search over prefix polynomial hashes.
The common extensions of neighbours are verified byte by byte; where a hash has lied, the bucket is sorted by its
bytes. Two strings with the same distance to their anchor are equal if nothing between them in either order has a
shorter extension than that distance, so classes of equal strings follow from both orders at once.
Buckets of more wordings than bucket_rows are not gathered: there equal strings are found by hashes of 128 bits.

Whatever was found equal by hashes alone, whole runs or the strings of those buckets, is then compared by its bytes
with one occurrence of each wording; equal stretches of two texts are joined first, so that a byte travels once. If any
differs, all is done anew with other hashes.

Keys that hold a large share of all rows are joined in parts (store.salted_join).
A null text counts as empty. Rows that repeat are occurrences each; rows with equal id and text get equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import cut, hot_keys, salted_join

GRAM = 32
PIECE = 1 << 18  # bytes of texts whose runs are found together; some 120 bytes are held for each
BUCKETS = 1 << 20  # bytes of wordings that are compared together; a larger bucket comes alone
PARTS = 1 << 17  # parts of claims that are joined together


def core_of(length: int, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distances lo to hi from start to anchor of each half."""
    width = length - GRAM + 1
    middle = (width + 1) // 2
    return np.where(half == 0, 0, middle), np.where(half == 0, middle - 1, width - 1)


def runs(buf: np.ndarray, offsets: np.ndarray, length: int, seed: int = 0) -> tuple[np.ndarray, ...]:
    """text, first start, last start, anchor (positions in the text), hash of the core and hash of the whole, for every half run."""
    width = length - GRAM + 1
    sizes = np.diff(offsets)
    n = len(buf)
    empty = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    if n < length or not (sizes >= length).any():
        return empty
    c = K.prefix_hashes(buf, K.byte_values(seed))
    grams = K.span_hashes(c, np.arange(n - GRAM + 1), np.arange(GRAM, n + 1))
    bits = np.uint64(max(1, int(n).bit_length()))
    v = grams >> bits << bits | np.arange(len(grams), dtype=np.uint64)
    blocks = -(-len(v) // width)
    full = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[: len(v)] = v
    ahead = np.minimum.accumulate(full.reshape(blocks, width), 1).ravel()
    behind = np.minimum.accumulate(full.reshape(blocks, width)[:, ::-1], 1)[:, ::-1].ravel()
    text = np.flatnonzero(sizes >= length)
    count = sizes[text] - length + 1
    s = np.repeat(offsets[text], count) + K.ramps(count)
    anchor = (np.minimum(behind[s], ahead[s + width - 1]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    half = (anchor - s >= (width + 1) // 2).astype(np.int64)
    new = np.ones(len(s), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (half[1:] != half[:-1])
    at = np.flatnonzero(new)
    first, last, anchor, half = s[at], s[np.append(at[1:], len(s)) - 1], anchor[at], half[at]
    text = np.repeat(text, count)[at]
    lo, hi = core_of(length, half)
    core = K.mix(K.span_hashes(c, anchor - lo, anchor - hi + length) + half.astype(np.uint64))
    whole = K.span_hashes(c, first, last + length)
    base = offsets[text]
    return text, first - base, last - base, anchor - base, core, whole


def pieces(offsets: np.ndarray, limit: int, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """First text and offsets of whole texts of limit bytes together; a longer text comes in pieces of limit starts each."""
    for i, j in K.groups(offsets, limit):
        if offsets[j] - offsets[i] <= limit:
            yield i, offsets[i : j + 1]
        else:
            for s in range(int(offsets[i]), int(offsets[j]) - length + 1, limit):
                yield i, np.array([s, min(s + limit + length - 1, int(offsets[j]))])


class Extensions:
    """Longest common extensions of positions in a byte string, each within its own limit.

    begins: where the members of the string start, ascending; no extension reaches into the next one.
    """

    def __init__(self, buf: np.ndarray, begins: np.ndarray | None = None) -> None:
        n = len(buf)
        begins = np.zeros(1, np.int64) if begins is None else begins
        sizes = np.diff(begins, append=n)
        self.buf = np.append(buf, np.zeros(1, np.uint8))
        self.place = np.arange(n + 1, dtype=np.int32)  # in the member: powers reach as far as the longest one
        self.place[:n] -= np.repeat(begins.astype(np.int32), sizes)
        self.place[n] = 0
        up, self.down = K.powers(int(sizes.max()))
        self.c = np.zeros(n + 1, np.uint64)
        values = K.byte_values()
        for i in range(0, n, PIECE):
            j = min(i + PIECE, n)
            self.c[i + 1 : j + 1] = values[buf[i:j]] * up[self.place[i:j]]
        np.cumsum(self.c, out=self.c)

    def common(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros(len(x), np.int64), most.copy()
        down_x, down_y = self.down[self.place[x]], self.down[self.place[y]]
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = (self.c[x + mid] - self.c[x]) * down_x == (self.c[y + mid] - self.c[y]) * down_y
            lo = np.where(same, mid, lo)
            hi = np.where(same, hi, mid - 1)
        return lo

    def less(self, x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
        """Whether the nx bytes at x come before the ny bytes at y; the shorter first; not if equal."""
        both = np.minimum(nx, ny)
        k = self.common(x, y, both)
        return np.where(k < both, self.buf[x + k] < self.buf[y + k], nx < ny)

    def sort(self, at: np.ndarray, size: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """A mergesort of the suffixes within each bucket, all buckets and runs side by side. bucket: ascending."""
        order = np.arange(len(at))
        begin = np.searchsorted(bucket, bucket)  # where each one's bucket starts
        end = np.searchsorted(bucket, bucket, "right")
        width = 1
        most = int((end - begin).max()) if len(at) else 0
        while width < most:
            place = np.arange(len(at))
            inner = place - begin
            left = inner // width % 2 == 0
            other = begin + inner // (2 * width) * 2 * width + np.where(left, width, 0)  # start of the run to merge with
            stop = np.minimum(other + width, end)
            lo, hi = np.minimum(other, end), np.maximum(stop, np.minimum(other, end))
            base = lo.copy()
            me = order[place]
            while True:
                live = np.flatnonzero(lo < hi)
                if not len(live):
                    break
                mid = (lo[live] + hi[live]) // 2
                a, b = me[live], order[mid]
                b_first = self.less(at[b], size[b], at[a], size[a])
                a_first = self.less(at[a], size[a], at[b], size[b]) if left[live].all() else None
                if a_first is None:
                    tie = ~b_first & ~left[live]  # of equals those of the left run come first
                    need = np.flatnonzero(tie)
                    equal = np.zeros(len(live), bool)
                    if len(need):
                        equal[need] = ~self.less(at[a[need]], size[a[need]], at[b[need]], size[b[need]])
                    b_first = b_first | equal
                lo[live] = np.where(b_first, mid + 1, lo[live])
                hi[live] = np.where(b_first, hi[live], mid)
            run = begin + inner // (2 * width) * 2 * width
            own = np.where(left, place - run, place - run - width)
            merged = np.empty_like(order)
            merged[run + own + lo - base] = me
            order = merged
            width *= 2
        return order


def neighbours(e: Extensions, at: np.ndarray, size: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order, and each one's verified common extension with the one before (-1 at a bucket's start)."""
    order = e.sort(at, size, bucket)
    for turn in range(2):
        x, y = order[:-1], order[1:]
        both = np.minimum(size[x], size[y])
        k = e.common(at[x], at[y], both)
        wrong = np.zeros(len(k), bool)
        for some in np.array_split(np.arange(len(k)), max(1, len(k) // 1000)):
            pick = np.repeat(some, k[some])
            step = K.ramps(k[some])
            bad = e.buf[at[x[pick]] + step] != e.buf[at[y[pick]] + step]
            wrong[pick[bad]] = True
        wrong |= (k < both) & (e.buf[at[x] + np.minimum(k, size[x])] == e.buf[at[y] + np.minimum(k, size[y])])
        wrong &= bucket[x] == bucket[y]
        if not wrong.any() or turn:
            break
        raw = e.buf.tobytes()
        for b in np.unique(bucket[x[wrong]]):  # a hash has lied: this bucket again, by its bytes
            i, j = np.searchsorted(bucket, [b, b + 1])
            order[i:j] = sorted(range(i, j), key=lambda r: raw[at[r] : at[r] + size[r]])
    for r in np.flatnonzero(wrong):
        a, b = order[r], order[r + 1]
        same = e.buf[at[a] : at[a] + both[r]] == e.buf[at[b] : at[b] + both[r]]
        k[r] = both[r] if same.all() else int(np.argmin(same))
    k = np.where(bucket[x] == bucket[y], k, -1)
    return order, np.append(-1, k)


def repeated_starts(buf: np.ndarray, ends: np.ndarray, anchor: np.ndarray, n_starts: np.ndarray, half: np.ndarray, bucket: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, start) of the strings that another member of the bucket has too.

    buf: the members' bytes one after the other, up to ends; anchor: its place in the member; bucket: ascending.
    """
    begins = np.append(0, ends[:-1])
    n = len(ends)
    right, right_ext = neighbours(Extensions(buf, begins), begins + anchor, ends - begins - anchor, bucket)
    backward = (ends[-1] - ends)[::-1]  # all bytes reversed: the last member comes first, the bytes before its anchor after its others
    left, left_ext = neighbours(Extensions(buf[::-1], backward), ends[-1] - begins - anchor, anchor, bucket)
    lo, hi = core_of(length, half)
    member, start = [], []
    class_left, class_right = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int((hi - lo).max()) + 1):
        distance = lo + d
        s = anchor - distance
        takes = np.flatnonzero((distance <= hi) & (s >= 0) & (s < n_starts))
        if len(takes) < 2:
            continue
        class_left[left] = np.cumsum(left_ext < distance[left])
        class_right[right] = np.cumsum(right_ext < length - distance[right])
        key = class_left[takes] * (n + 1) + class_right[takes]
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = takes[count[back] > 1]
        member.append(twice)
        start.append(s[twice])
    return (np.concatenate(member), np.concatenate(start)) if member else (np.zeros(0, np.int64),) * 2


def spans_of(member: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, from, to): maximal runs of starts, both included."""
    if not len(member):
        return (np.zeros(0, np.int64),) * 3
    order = np.lexsort((start, member))
    m, s = member[order], start[order]
    new = np.append(True, (m[1:] != m[:-1]) | (s[1:] != s[:-1] + 1))
    at = np.flatnonzero(new)
    return m[at], s[at], s[np.append(at[1:], len(s)) - 1]


def grouped_batches(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Sorted batches dealt anew, so that no key is in two tables."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches(([] if rest is None else rest.to_batches()) + [batch], batch.schema)
        k = table.column(key).to_numpy()
        if not len(k):
            continue
        differs = np.flatnonzero(k != k[-1])
        cut_at = int(differs[-1]) + 1 if len(differs) else 0
        if cut_at:
            yield table.slice(0, cut_at)
        rest = table.slice(cut_at)
    if rest is not None and len(rest):
        yield rest


def joined(claim: np.ndarray, shift: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """claim, shift, from, to, in order: parts of one claim and shift that meet or overlap are made one. All are 64-bit, offsets below 2**31."""
    order = np.lexsort((start, shift, claim))
    claim, shift, start, stop = claim[order], shift[order], start[order], stop[order]
    other = (claim[1:] != claim[:-1]) | (shift[1:] != shift[:-1])
    high = np.cumsum(np.append(np.zeros(min(1, len(claim)), np.int64), other)) << 32
    reach = np.maximum.accumulate(high + stop)
    at = np.flatnonzero(np.append(np.ones(min(1, len(claim)), bool), (high + start)[1:] > reach[:-1]))
    last = np.append(at[1:], len(claim)) - 1
    return claim[at], shift[at], start[at], (reach - high)[last[: len(at)]]


def removed_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, bucket_rows: int = 20_000, hash_bits: int = 64) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of from, to in bytes).

    hash_bits: of the hashes that tell wordings apart in the first attempt; fewer than 64 only to test the verification.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("ik", F.coalesce(F.col("id").cast("string"), F.lit(""))).withColumn("th", F.xxhash64("text"))
    for seed in range(8):
        out = attempt(rows, length, bucket_rows, seed, 64 if seed else hash_bits)
        if out is not None:
            return out.withColumnRenamed("id", id_col)
    raise RuntimeError("strings with equal hashes differ, whatever the seed")


def attempt(rows: DataFrame, length: int, bucket_rows: int, seed: int, hash_bits: int) -> DataFrame | None:
    """removed_spans of rows (id, text, ik, th) with one set of hashes; None if something that it took for equal is not."""
    kind = rows.schema["id"].dataType.simpleString()
    mask = np.uint64((1 << hash_bits) - 1)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = K.packed(batch.column(1))
            for i, at in pieces(offsets, PIECE, length):
                text, a, b, anchor, core, whole = runs(buf[at[0] : at[-1]], at - at[0], length, seed)
                pick = pa.array(text + i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pick), batch.column(2).take(pick), pa.array(a + (at[0] - offsets[i]), pa.int32()), pa.array(b - a, pa.int16()), pa.array(anchor - a, pa.int16()), pa.array(core.view(np.int64)), pa.array((whole & mask).view(np.int64))],
                    ["ik", "th", "a", "more", "anchor", "core", "whole"],
                )

    found = rows.select("ik", "text", "th").mapInArrow(find, "ik string, th bigint, a int, more smallint, anchor smallint, core bigint, whole bigint")
    shared = cut(found.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    hot = hot_keys(shared, ["core"], total)
    live = cut(salted_join(found, shared.select("core"), ["core"], "left_semi", hot, F.struct("ik", "a")))
    wordings = cut(live.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ik", "th", "a", "more", "anchor")).alias("one")))
    several = cut(wordings.groupBy("core").agg(F.count(F.lit(1)).alias("wordings")).where(F.col("wordings") > 1))
    asked = salted_join(wordings, several, ["core"], "inner", hot_keys(several.withColumnRenamed("wordings", "n"), ["core"], total), F.col("whole"))
    asked = asked.groupBy(F.col("one.ik").alias("ik"), F.col("one.th").alias("th")).agg(F.collect_list(F.struct("core", "whole", "one.a", "one.more", "one.anchor", "wordings")).alias("asked"))

    def carve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = K.packed(batch.column(0))
            lists = batch.column(3)
            parent = pc.list_parent_indices(lists).to_numpy()
            flat = lists.flatten()
            col = {n: flat.field(n) for n in ("core", "whole", "a", "more", "anchor", "wordings")}
            start = offsets[parent] + col["a"].to_numpy()
            size = col["more"].to_numpy().astype(np.int64) + length
            for some in np.array_split(np.arange(len(start)), max(1, len(start) // 8000)):
                data = [buf[s : s + z].tobytes() for s, z in zip(start[some], size[some], strict=True)]
                of = pa.array(parent[some])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(of), batch.column(2).take(of), *(col[n].take(pa.array(some)) for n in ("core", "whole", "a", "more", "anchor", "wordings")), pa.array(data, pa.binary())],
                    ["ik", "th", "core", "whole", "a", "more", "anchor", "wordings", "data"],
                )

    texts = rows.select("text", "ik", "th").hint("merge").join(asked, ["ik", "th"]).select("text", "ik", "th", "asked")
    carved = texts.mapInArrow(carve, "ik string, th bigint, core bigint, whole bigint, a int, more smallint, anchor smallint, wordings bigint, data binary")
    carved = cut(carved.dropDuplicates(["core", "whole"]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_batches(batches, "core"):
            cores = table.column("core").to_numpy()
            first = np.append(np.flatnonzero(np.append(True, cores[1:] != cores[:-1])), len(cores))
            sizes = np.append(0, np.cumsum(table.column("more").to_numpy().astype(np.int64) + length))
            for i, j in K.groups(sizes[first], BUCKETS):
                t = table.slice(int(first[i]), int(first[j] - first[i])).combine_chunks()
                core = t.column("core").to_numpy()
                _, bucket = np.unique(core, return_inverse=True)
                data = t.column("data").to_pylist()
                anchor = t.column("anchor").to_numpy().astype(np.int64)
                more = t.column("more").to_numpy().astype(np.int64)
                half = (anchor >= (length - GRAM + 2) // 2).astype(np.int64)
                member, start = repeated_starts(np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(d) for d in data]), anchor, more + 1, half, bucket, length)
                m, a, b = spans_of(member, start)
                yield pa.RecordBatch.from_arrays([pa.array(core[m]), pa.array(t.column("whole").to_numpy()[m]), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["core", "whole", "from", "to"])

    few = carved.where(F.col("wordings") <= bucket_rows).select("core", "whole", "more", "anchor", "data").repartition("core").sortWithinPartitions("core")
    edges = few.mapInArrow(compare, "core bigint, whole bigint, `from` int, `to` int")
    claims = []

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in range(0, batch.num_rows, 2000):
                t = batch.slice(some, 2000)
                data = t.column(6).to_pylist()
                buf = np.frombuffer(b"".join(data), np.uint8)
                n = t.column(5).to_numpy().astype(np.int64) + 1
                owner = np.repeat(np.arange(len(n)), n)
                start = K.ramps(n)
                at = (np.cumsum([len(d) for d in data]) - [len(d) for d in data])[owner] + start
                h1, h2 = (K.span_hashes(K.prefix_hashes(buf, K.byte_values(seed + k)), at, at + length) for k in (0, 100))
                pick = pa.array(owner)
                yield pa.RecordBatch.from_arrays([*(t.column(k).take(pick) for k in range(5)), pa.array(start, pa.int32()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["ik", "th", "core", "whole", "a", "from", "h1", "h2"])

    if several.where(F.col("wordings") > bucket_rows).limit(1).count():
        many = carved.where(F.col("wordings") > bucket_rows).select("ik", "th", "core", "whole", "a", "more", "data")
        many = cut(many.mapInArrow(strings, "ik string, th bigint, core bigint, whole bigint, a int, `from` int, h1 bigint, h2 bigint"))
        key = ["core", "h1", "h2"]
        twice = cut(many.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ik", "th", (F.col("a") + F.col("from")).alias("at"))).alias("rep")).where(F.col("n") > 1))
        met = cut(salted_join(many, twice.drop("n"), key, "inner", hot_keys(twice, key, many.count()), F.struct("ik", "a")))
        edges = edges.union(met.select("core", "whole", "from", F.col("from").alias("to")))
        at = F.col("a") + F.col("from")
        claims.append(met.select("ik", "th", F.col("rep.ik").alias("rik"), F.col("rep.th").alias("rth"), (F.col("rep.at") - at).alias("shift"), at.alias("from"), (at + length).alias("to")))

    edges = edges.groupBy("core", "whole").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    verdict = wordings.select("core", "whole", "n", "one").join(edges, ["core", "whole"], "left").where((F.col("n") > 1) | F.col("spans").isNotNull())
    verdict = cut(verdict.select("core", "whole", F.when(F.col("n") == 1, F.col("spans")).alias("spans"), F.when(F.col("n") > 1, F.struct("one.ik", "one.th", "one.a")).alias("rep")))
    hits = cut(salted_join(live.drop("anchor"), verdict, ["core", "whole"], "inner", hot, F.struct("ik", "a")).drop("core", "whole"))
    stop = F.col("a") + F.col("more") + length
    spans = F.coalesce(F.transform("spans", lambda s: F.struct((F.col("a") + s["from"]).alias("from"), (F.col("a") + s["to"] + length).alias("to"))), F.array(F.struct(F.col("a").alias("from"), stop.alias("to"))))
    by_text = hits.groupBy("ik", "th").agg(F.flatten(F.collect_list(spans)).alias("spans"))

    claims.append(hits.where("rep is not null").select("ik", "th", F.col("rep.ik").alias("rik"), F.col("rep.th").alias("rth"), (F.col("rep.a") - F.col("a")).alias("shift"), F.col("a").alias("from"), stop.alias("to")))
    claims = reduce(DataFrame.union, claims)
    claims = claims.where((F.col("shift") != 0) | (F.col("ik") != F.col("rik")) | (F.col("th") != F.col("rth")))
    claims = claims.groupBy("ik", "th", "rik", "rth").agg(F.collect_list(F.struct("shift", "from", "to")).alias("parts"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            fields = list(lists.type.value_type.fields)
            offsets = np.append(0, np.cumsum(lists.value_lengths().to_numpy().astype(np.int64)))
            flat = lists.flatten()
            for i, j in K.groups(offsets, PARTS):
                some = flat.slice(int(offsets[i]), int(offsets[j] - offsets[i]))
                claim = np.repeat(np.arange(j - i), np.diff(offsets[i : j + 1]))
                claim, *values = joined(claim, *(some.field(f.name).to_numpy().astype(np.int64) for f in fields))
                at = np.searchsorted(claim, np.arange(j - i + 1))
                parts = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(values, fields, strict=True)], fields=fields)
                parts = pa.ListArray.from_arrays(pa.array(at, pa.int32()), parts, type=lists.type)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:4]), parts], batch.schema.names)

    pairs = cut(claims.mapInArrow(merge, "ik string, th bigint, rik string, rth bigint, parts array<struct<shift:int,`from`:int,`to`:int>>"))
    reps = cut(pairs.groupBy("rik", "rth").agg(F.count(F.lit(1)).alias("n")))
    wanted = rows.select(F.col("ik").alias("rik"), F.col("th").alias("rth"), "text").hint("merge").join(reps.select("rik", "rth"), ["rik", "rth"], "left_semi").dropDuplicates(["rik", "rth"])
    met = salted_join(pairs, wanted, ["rik", "rth"], "inner", hot_keys(reps, ["rik", "rth"], pairs.count()), F.struct("ik", "th"))
    raw = F.col("text").cast("binary")
    met = met.select("ik", "th", F.transform("parts", lambda p: F.struct(p["from"].alias("from"), F.substring(raw, p["from"] + p["shift"] + 1, p["to"] - p["from"]).alias("data"))).alias("parts"))
    same = F.forall("parts", lambda p: F.substring(raw, p["from"] + 1, F.length(p["data"])) == p["data"])
    if cut(met.join(rows.select("ik", "th", "text").hint("merge"), ["ik", "th"]).where(~same).select("ik", "th")).limit(1).count():
        return None
    by_text = cut(by_text)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = K.packed(batch.column(1))
            out = []
            lists = batch.column(2)
            for r in range(batch.num_rows):
                text = buf[offsets[r] : offsets[r + 1]]
                if lists[r].is_valid:
                    v = lists[r].values
                    a, b = v.field("from").to_numpy(), v.field("to").to_numpy()
                    order = np.argsort(a, kind="stable")
                    a, reach = a[order], np.maximum.accumulate(b[order])
                    new = np.append(True, a[1:] > reach[:-1])
                    at = np.flatnonzero(new)
                    a, b = a[at], reach[np.append(at[1:], len(new)) - 1]
                    keep = np.ones(len(text), bool)
                    for x, y in zip(a, b, strict=True):
                        keep[x:y] = False
                    kept = text[keep]
                else:
                    a, b, kept = [], [], text
                out.append((len(text), len(text) - len(kept), len(a), hashlib.sha256(kept.tobytes()).hexdigest(), [{"from": int(x), "to": int(y)} for x, y in zip(a, b, strict=True)]))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    both = rows.hint("merge").join(by_text, ["ik", "th"], "left").select("id", "text", "spans")
    fields = f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<`from`:int,`to`:int>>"
    return both.mapInArrow(remove, fields)
