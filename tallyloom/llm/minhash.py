"""Near-duplicate groups by ProbMinHash over count-weighted word shingles, banding and verification.

Signature: each distinct shingle sends a Poisson process whose rate is its count; each arrival goes to one
register drawn by hash, and a register keeps its earliest. A shingle stops when its next arrival is later than
every register of the text, so most stop after one. Two texts agree on a register with the probability Jaccard
similarity of their counts. For texts without repeated shingles that is the Jaccard similarity.

Texts that are equal are one vertex from the start. Texts that share a band are linked to the smallest id of
the bucket, if the similarity of their whole texts is 0.8 or more. In buckets in which a text stays apart from the
others, all pairs that aren't joined yet are then compared in memory, by whole texts alike. Classes are the connected
components, found by joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import cut, free_names, hot_keys, salted_join

STEP = np.uint64(0x9FB21C651E98DF25)


def steps(k: int) -> np.uint64:
    return np.uint64(k * int(STEP) & 0xFFFFFFFFFFFFFFFF)


def shingles(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of size words, and their text; a shorter text with a word has one, of all its words."""
    starts, ends, text = K.word_spans(buf, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words = K.span_hashes(K.prefix_hashes(buf), starts, ends)
    total = words.copy()
    last = text  # the text of the word size - 1 further on
    for k in range(1, size):
        last = np.full(len(text), -1)
        last[:-k] = text[k:]
        here = last == text
        moved = np.zeros(len(words), np.uint64)
        moved[:-k] = words[k:]
        total += np.where(here, K.mix(moved + steps(k)), np.uint64(0))
    first = np.ones(len(text), bool)
    first[1:] = text[1:] != text[:-1]
    valid = (last == text) | (first & (np.bincount(text, minlength=len(offsets) - 1)[text] < size))
    return K.mix(total[valid]), text[valid]


def signatures(buf: np.ndarray, offsets: np.ndarray, *, size: int, registers: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of registers per text (32 bits each; zeros if there is no shingle), and the number of distinct shingles."""
    n = len(offsets) - 1
    element, text = shingles(buf, offsets, size)
    key = K.mix(element + text.astype(np.uint64) * STEP)
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    element, text, weight = element[first], text[first], count.astype(np.float64)
    distinct = np.bincount(text, minlength=n)
    when = np.full(n * registers, np.inf)
    who = np.zeros(n * registers, np.uint64)
    at = np.zeros(len(element))
    live = np.arange(len(element))
    turn = 0
    while len(live):
        turn += 1
        draw = K.mix(element[live] + steps(turn))
        at[live] -= np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[live]
        slot = text[live] * registers + (K.mix(draw) % np.uint64(registers)).astype(np.int64)
        x = at[live]
        np.minimum.at(when, slot, x)
        won = when[slot] == x
        who[slot[won]] = element[live[won]]
        latest = when.reshape(n, registers).max(1)
        live = live[x < latest[text[live]]]
    return (K.mix(who) >> np.uint64(32)).astype(np.uint32).reshape(n, registers), distinct


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Probability Jaccard of two multisets of hashes, exactly."""
    ka, xa = np.unique(a, return_counts=True)
    kb, xb = np.unique(b, return_counts=True)
    keys = np.union1d(ka, kb)
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[np.searchsorted(keys, ka)] = xa
    y[np.searchsorted(keys, kb)] = xb
    both = (x > 0) & (y > 0)
    if not both.any():
        return 0.0
    ratio = np.divide(x, y, out=np.full(len(keys), np.inf), where=y > 0)
    order = np.argsort(ratio)
    r, x, y, both = ratio[order], x[order], y[order], both[order]
    below = np.searchsorted(r, r, "left")
    left_y = np.concatenate([[0], np.cumsum(y)])[below]
    right_x = x.sum() - np.concatenate([[0], np.cumsum(x)])[below]
    total = right_x[both] / x[both] + left_y[both] / y[both]
    return float((1 / total).sum())


def signature_table(docs: DataFrame, *, id_col: str, text_col: str, size: int, bands: int, rows: int) -> DataFrame:
    """id, text_md5, n_shingles, bands (array<bigint>); one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = K.packed(batch.column(1))
            for i, j in K.groups(offsets):
                sig, count = signatures(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size=size, registers=bands * rows)
                wide = sig.reshape(j - i, bands, rows).astype(np.uint64)
                h = np.zeros((j - i, bands), np.uint64)
                for k in range(rows):
                    h = K.mix(h + wide[:, :, k] + steps(k + 1))
                h = K.mix(h + np.arange(1, bands + 1, dtype=np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(2).slice(i, j - i),
                        pa.array(count, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * bands, bands), pa.int32()), pa.array(h.ravel())),
                    ],
                    ["id", "text_md5", "n_shingles", "bands"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows_in = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_md5"))
    return rows_in.mapInArrow(run, f"id {kind}, text_md5 string, n_shingles bigint, bands array<bigint>")


def verified(pairs: DataFrame, docs: DataFrame, *, size: int, threshold: float) -> DataFrame:
    """The pairs (a, b) of ids whose whole texts are as similar as threshold; docs: id, text, one row an id.

    The larger side of both joins is keyed by one id of each pair, and Spark splits an id with very many.
    Both are merge joins at every size, so that small inputs show the shuffle of large ones.
    """
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for c in (2, 3):
                buf, offsets = K.packed(batch.column(c))
                parts = []
                for i, j in K.groups(offsets):
                    h, text = shingles(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                    parts += np.split(h, np.searchsorted(text, np.arange(1, j - i)))
                sides.append(parts)
            good = np.array([similarity(x, y) >= threshold - 1e-9 for x, y in zip(*sides, strict=True)], bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good))

    left = docs.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = docs.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """(id, label) for every id in links (a, b): the smallest id of its component.

    Each turn takes the smallest label around and then the label of the label; all by joins.
    """
    edges = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")))
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("label").alias("far"))
        after = cut(step.join(jump, "next", "left").select("id", "label", F.least("next", "far").alias("next")))
        changed = after.where(F.col("next") < F.col("label")).limit(1).count()
        labels = after.select("id", F.col("next").alias("label"))
        if not changed:
            return labels


def bounds(x: np.ndarray, total: int, ids: np.ndarray, counts: np.ndarray, starts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The most that the similarity of a text can be to each of others: x has its counts by shingle, the others lie end to end.

    Of a shared shingle i the sum over max(x_j / x_i, y_j / y_i) is max(x, y) / max(x_i, y_i) together or more. Exact if no shingle repeats.
    """
    mine = x[ids]
    both = np.where(mine > 0, np.maximum(mine, counts), 0)
    high, low = np.add.reduceat(both, starts), np.add.reduceat(np.minimum(mine, counts), starts)
    return high / (total + totals - low)


def links_within(ids: np.ndarray, labels: np.ndarray, sides: np.ndarray, bands: np.ndarray, bucket: int, texts: list[np.ndarray], threshold: float) -> tuple[list, list]:
    """Links that join all texts of a bucket as their similarities do; only pairs from both sides, or of the one side that there is.

    No pair is left out but those joined already and those that share an earlier band, which are met in its bucket.
    """
    a, b = [], []
    _, comp = np.unique(labels, return_inverse=True)
    if comp.max() == 0:
        return a, b
    band = int(np.argmax((bands == bucket).all(0)))
    hashed = [np.unique(t, return_counts=True) for t in texts]
    size = np.array([len(k) for k, _ in hashed])
    starts = np.concatenate([[0], np.cumsum(size)])
    shingle, column = np.unique(np.concatenate([k for k, _ in hashed]), return_inverse=True)
    counts = np.concatenate([c for _, c in hashed])
    totals = np.array([len(t) for t in texts])
    x = np.zeros(len(shingle), np.int64)
    one = sides.min() == sides.max()
    for i in range(len(ids) - 1):
        k = np.arange(i + 1, len(ids))
        k = k[(comp[k] != comp[i]) & (one | (sides[k] != sides[i])) & (size[k] > 0)]
        k = k[~(bands[k, :band] == bands[i, :band]).any(1)]
        if not len(k):
            continue
        mine = slice(starts[i], starts[i + 1])
        x[column[mine]] = counts[mine]
        begin = np.cumsum(size[k]) - size[k]
        at = np.arange(size[k].sum()) + np.repeat(starts[k] - begin, size[k])
        most = bounds(x, totals[i], column[at], counts[at], begin, totals[k])
        x[column[mine]] = 0
        for m in k[most >= threshold - 1e-9]:
            if comp[m] != comp[i] and similarity(texts[i], texts[m]) >= threshold - 1e-9:
                comp[comp == comp[m]] = comp[i]
                a.append(min(ids[i], ids[m]))
                b.append(max(ids[i], ids[m]))
    return a, b


def bucket_links(members: DataFrame, *, size: int, threshold: float) -> DataFrame:
    """members (part, bucket, side, id, label, bands, text), sorted by part in each partition -> links (a, b) of verified pairs.

    All texts of a part are compared in memory, so rows grow with the members and not with their square.
    """
    kind = members.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        schema = None

        def groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
            part, bucket, side = (table.column(c).to_numpy() for c in ("part", "bucket", "side"))
            cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                t = table.slice(i, j - i)
                ids, labels = (np.array(t.column(c).to_pylist(), object if kind == "string" else None) for c in ("id", "label"))
                if j - i < 2 or (labels == labels[0]).all():
                    continue
                bands = np.array(t.column("bands").to_pylist(), np.int64)
                buf, offsets = K.packed(t.column("text").combine_chunks())
                texts = []
                for m, n in K.groups(offsets):
                    h, text = shingles(buf[offsets[m] : offsets[n]], offsets[m : n + 1] - offsets[m], size)
                    texts += np.split(h, np.searchsorted(text, np.arange(1, n - m)))
                a, b = links_within(ids, labels, side[i:j], bands, bucket[i], texts, threshold)
                if a:
                    of = schema.field("id").type
                    yield pa.RecordBatch.from_arrays([pa.array(a, of), pa.array(b, of)], ["a", "b"])

        for batch in batches:
            schema = batch.schema
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch], schema)
            part = table.column("part").to_numpy()
            k = len(part) - int(np.argmax(part[::-1] != part[-1])) if len(part) and (part != part[-1]).any() else 0
            if k:
                yield from groups(table.slice(0, k))
            rest = table.slice(k)
        if rest is not None and len(rest):
            yield from groups(rest)

    return members.mapInArrow(run, f"a {kind}, b {kind}")


def split_buckets(rows: DataFrame) -> DataFrame:
    """Rows (bucket, label, ...) of the buckets that hold more than one label."""
    mixed = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where(F.col("low") < F.col("high"))
    return rows.join(mixed.select("bucket"), "bucket", "left_semi")


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    threshold: float = 0.8,
    bands: int = 20,
    rows: int = 5,
    block: int = 2048,
    block_shingles: int = 1 << 21,
) -> DataFrame:
    """One row per row of docs: id, class_id (the smallest id of its class), n_shingles, kept (one row of each class).

    A null text, or one without words, is a class by itself. A null id has a null class_id and is kept. Rows that
    repeat, id included, are in one class and kept alike. A bucket of over block texts, or block_shingles
    shingles, is searched by pairs of blocks, each pair a task of its own.
    """
    table = cut(signature_table(docs, id_col=id_col, text_col=text_col, size=size, bands=bands, rows=rows))
    texts = table.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
    vertices = cut(texts.groupBy("text_md5").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles")))
    banded = vertices.select("id", "n_shingles", F.explode("bands").alias("bucket"))
    centres = cut(banded.groupBy("bucket").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("mass")).where(F.col("n") > 1))
    # a bucket may hold a third of all texts: its rows meet its centre in many parts
    hot = hot_keys(centres, ["bucket"], vertices.count() * bands)
    members = salted_join(banded, centres, ["bucket"], "inner", hot, F.col("id"))
    pairs = members.where(F.col("id") != F.col("centre")).select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    pairs = cut(pairs)
    involved = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    text_of = cut(source.hint("merge").join(involved, "id", "left_semi"))
    links = cut(verified(pairs, text_of, size=size, threshold=threshold).distinct())
    labels = components(links)

    labelled = members.where(F.col("n") > 2).join(labels, "id", "left").select("bucket", "id", "n", "mass", F.coalesce("label", "id").alias("label"))
    open_rows = split_buckets(cut(labelled)).join(vertices.select("id", "bands"), "id")
    # each text meets those of every block: block i with block j is one part, of sides 0 and 1
    open_rows = open_rows.withColumn("blocks", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("mass") / block_shingles)))
    open_rows = open_rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    part = F.when(F.col("blocks") > 1, F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))).otherwise(F.col("bucket"))
    open_rows = cut(open_rows.select(part.alias("part"), "bucket", (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "label", "bands"))
    sorted_rows = open_rows.join(text_of.hint("merge"), "id").select("part", "bucket", "side", "id", "label", "bands", "text").repartition("part").sortWithinPartitions("part", "id")
    found = cut(bucket_links(sorted_rows, size=size, threshold=threshold))
    if found.limit(1).count():
        labels = components(links.union(found))

    classes = vertices.select("text_md5", "id").join(labels, "id", "left").select("text_md5", F.coalesce("label", "id").alias("class_id"))
    out = table.select("id", "text_md5", "n_shingles").join(classes, "text_md5", "left")
    out = out.withColumn("class_id", F.when(F.col("id").isNotNull() & (F.col("n_shingles") > 0), F.col("class_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), "class_id", "n_shingles", (F.col("class_id").isNull() | (F.col("id") == F.col("class_id"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each class: the one with the smallest id, a null one last. Rows get a key of their own, so null and repeated ids are no matter."""
    row, of, first = free_names(docs, "near_row", "near_class", "near_first")
    keyed = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    classes = near_duplicates(keyed.select(row, text_col), id_col=row, text_col=text_col, **options).select(F.col(row).alias(first), F.col("class_id").alias(of))
    ids = keyed.select(F.col(row), F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"))
    best = classes.join(ids, F.col(first) == F.col(row)).groupBy(of).agg(F.min(F.struct("no_id", "id", row)).alias("best"))
    return keyed.join(best.select(F.col(f"best.{row}").alias(row)), row, "left_semi").select(*docs.columns)
