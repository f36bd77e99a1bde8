"""Ranked lexical search with block-max pruning.

Documents, in the order of the table, form ranges of block_docs; their forward index holds the items' terms alone: of each
document the terms, how often each stands in it, and the document's length. A block's bound for an item is the sum of its terms'
largest impacts in the block, each times the term's weight. First the best few blocks of each item over the whole table are
scored, which gives the item a kth score. Then each task goes through its blocks, the best bound first, and scores their
documents until the bound drops below the kth score known so far. Scores are whole numbers of 64 bits and exact; a
block whose bound equals the kth score is scored too, so ties are right.

A block's maxima are taken as its documents are read: they depend on the table's mean length, which is known only once the index
is written. Terms are found by hashes and then compared by bytes. Items go in groups of at most group_items rows and about
group_terms terms, a bound on what is sent to every task; each group reads the documents once.

A null text has no terms, a null item none either; both take no part. Documents and items that repeat are ranked each. Equal scores
are ordered by id, null ids last. Other columns of both tables are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .store import cut

#: Terms are the longest runs of what isn't one of these; of the letters only A to Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
APART = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
PIECE = 1 << 20
LAST = np.iinfo(np.int64).max


class Terms:
    """The items' terms, found in a text by their hashes and then by their bytes."""

    def __init__(self, terms: list[bytes]) -> None:
        self.n = len(terms)
        self.size = np.array([len(t) for t in terms], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(terms), np.uint8)
        for self.seed in range(8):
            h = self.hashes(self.blob, self.at, self.at + self.size)
            self.order = np.argsort(h)
            self.sorted = h[self.order]
            if (self.sorted[1:] != self.sorted[:-1]).all():
                return
        raise RuntimeError("two terms have equal hashes, whatever the seed")

    def hashes(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return K.span_hashes(K.prefix_hashes(buf, K.byte_values(self.seed)), starts, ends)

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words of buf are terms, and which term each of these is."""
        h = self.hashes(buf, starts, ends)
        k = np.minimum(np.searchsorted(self.sorted, h), self.n - 1)
        hit = np.flatnonzero(self.sorted[k] == h)
        term = self.order[k[hit]]
        same = self.size[term] == (ends - starts)[hit]
        hit, term = hit[same], term[same]
        size = self.size[term]
        inside = K.ramps(size)
        wrong = buf[np.repeat(starts[hit], size) + inside] != self.blob[np.repeat(self.at[term], size) + inside]
        if wrong.any():
            good = np.bincount(np.repeat(np.arange(len(hit)), size), wrong, len(hit)) == 0
            hit, term = hit[good], term[good]
        return hit, term


def pieces(buf: np.ndarray, offsets: np.ndarray, limit: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """offsets with more of them inside long texts, none within a term; and the text of each piece."""
    cuts, of = [0], []
    for t in range(len(offsets) - 1):
        at, end = int(offsets[t]), int(offsets[t + 1])
        while end - at > limit:
            near = np.flatnonzero(APART[buf[at + limit // 2 : at + limit]])
            if len(near):
                at += limit // 2 + int(near[-1]) + 1
            else:
                far = np.flatnonzero(APART[buf[at + limit : end]])
                at = at + limit + int(far[0]) if len(far) else end
            if at >= end:
                break
            cuts.append(at)
            of.append(t)
        cuts.append(end)
        of.append(t)
    return np.array(cuts, np.int64), np.array(of, np.int64)


def whole_sums(keys: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers below 2**50 by key, exact: both halves are summed in doubles."""
    high = values >> 24
    return (np.bincount(keys, high, n).astype(np.int64) << 24) + np.bincount(keys, values - (high << 24), n).astype(np.int64)


class Items:
    """The items of one group: terms by item and items by term."""

    def __init__(self, terms: list[np.ndarray], n_terms: int) -> None:
        self.n = len(terms)
        self.terms = terms
        flat = np.concatenate(terms) if terms else np.zeros(0, np.int64)
        item = np.repeat(np.arange(self.n), [len(t) for t in terms])
        order = np.argsort(flat, kind="stable")
        self.items = item[order]
        self.count = np.bincount(flat, minlength=n_terms)
        self.at = np.cumsum(self.count) - self.count


class Blocks:
    """The blocks of some documents: postings in the order of block and term, with the largest impact of each pair."""

    def __init__(self, block: np.ndarray, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, docs: int, words: int) -> None:
        new = np.concatenate([[True], block[1:] != block[:-1]]) if len(block) else np.zeros(0, bool)
        self.first = np.flatnonzero(new)  # document of each block
        self.key = block[self.first]
        of = np.cumsum(new) - 1
        self.last = np.append(self.first[1:], len(block))
        length = 100 - 90 + (90 * n * docs) // max(words, 1)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * length[doc])
        pair = of[doc] * len(weight) + term
        order = np.argsort(pair, kind="stable")
        pair, self.doc, self.impact = pair[order], doc[order], impact[order]
        new = np.concatenate([[True], pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, bool)
        self.start = np.flatnonzero(new)
        self.end = np.append(self.start[1:], len(pair))
        self.of, self.term = np.divmod(pair[self.start], len(weight))
        self.most = np.maximum.reduceat(self.impact, self.start) if len(self.start) else np.zeros(0, np.int64)
        self.range = np.searchsorted(self.of, np.arange(len(self.first) + 1))
        self.weight = weight

    def bounds(self, items: Items) -> np.ndarray:
        """Blocks by items: no document of the block scores more."""
        count = items.count[self.term]
        who = items.items[np.repeat(items.at[self.term], count) + K.ramps(count)]
        value = np.repeat(self.most * self.weight[self.term], count)
        n = len(self.first)
        return whole_sums(np.repeat(self.of, count) * items.n + who, value, n * items.n).reshape(n, items.n)

    def scores(self, b: int, terms: np.ndarray) -> np.ndarray:
        """The score of each document of block b for the item of these terms."""
        lo, hi = self.range[b], self.range[b + 1]
        k = lo + np.searchsorted(self.term[lo:hi], terms)
        there = k < hi
        k, terms = k[there], terms[there]
        k = k[self.term[k] == terms]
        size = self.end[k] - self.start[k]
        p = np.repeat(self.start[k], size) + K.ramps(size)
        value = self.impact[p] * np.repeat(self.weight[self.term[k]], size)
        return whole_sums(self.doc[p] - self.first[b], value, int(self.last[b] - self.first[b]))


class Best:
    """The k best documents of each item so far, and the score below which nothing counts."""

    def __init__(self, floor: np.ndarray, k: int) -> None:
        self.floor, self.k = floor.copy(), k
        self.rows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, item: int, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        good = score >= self.floor[item]
        if not good.any():
            return
        have = self.rows.get(item)
        new = [x[good] for x in (score, ids, null)]
        score, ids, null = [np.concatenate(x) for x in zip(have, new, strict=True)] if have else new
        order = np.lexsort((ids, null, -score))[: self.k]
        self.rows[item] = score[order], ids[order], null[order]
        if len(order) == self.k:
            self.floor[item] = max(self.floor[item], score[order[-1]])


def search(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 10, block_docs: int = 64, first_blocks: int = 4, group_items: int = 20_000, group_terms: int = 1_000_000
) -> DataFrame:
    """item, rank, id, score: the k documents of highest score above 0 for each row of items."""
    spark = docs.sparkSession
    terms = F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(F.col(item_text_col).cast("string"), F.lit("")), UPPER, LOWER), F.lit(TERM), 0))
    asked = items.select(F.col(item_col).alias("item"), terms.alias("terms")).where(F.size("terms") > 0)
    asked = cut(asked.withColumn("item_row", F.monotonically_increasing_id()))
    n, total = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    n_groups = max(-(-n // group_items), -(-total // group_terms))
    found = None
    for g in range(n_groups):
        own = asked.where(F.pmod(F.xxhash64("item_row"), F.lit(n_groups)) == g).select("item_row", "terms").orderBy("item_row").collect()
        if own:
            part = of_group(spark, docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), own, k, block_docs, first_blocks)
            found = part if found is None else found.union(part)
    kind = items.schema[item_col].dataType.simpleString()
    if found is None:
        return spark.createDataFrame([], f"{item_col} {kind}, rank int, {id_col} long, score long")
    w = Window.partitionBy("item_row").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)
    return best.join(asked.select("item_row", "item"), "item_row").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def of_group(spark: SparkSession, docs: DataFrame, own: list, k: int, block_docs: int, first_blocks: int) -> DataFrame:
    """(item_row, id, score) of what may be among the k best, for the items of one group."""
    words = sorted({t.encode() for r in own for t in r.terms})
    number = {t: i for i, t in enumerate(words)}
    rows = np.array([r.item_row for r in own], np.int64)
    sent = spark.sparkContext.broadcast((words, [np.sort([number[t.encode()] for t in r.terms]) for r in own]))

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Terms(sent.value[0])
        for batch in batches:
            buf, offsets = K.packed(batch.column(1))
            n = np.zeros(batch.num_rows, np.int64)
            keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            at, of = pieces(buf, offsets)
            for i, j in K.groups(at):
                low = FOLD[buf[at[i] : at[j]]]
                starts, ends, piece = K.word_spans(low, at[i : j + 1] - at[i], APART)
                text = of[i:j][piece]
                n += np.bincount(text, minlength=len(n))
                hit, term = table.find(low, starts, ends)
                key, count = np.unique(text[hit] * table.n + term, return_counts=True)
                keys.append(key)
                counts.append(count)
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            doc, term = np.divmod(key, table.n)
            tf = np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)
            list_at = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(list_at, pa.array(x, pa.int32())) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], ["id", "n", "term", "tf"])

    index = docs.mapInArrow(forward, "id bigint, n bigint, term array<int>, tf array<int>")
    index = cut(index.select(F.expr(f"monotonically_increasing_id() div {int(block_docs)}").alias("block"), "*"))
    n_docs, n_words = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(words), np.int64)
    for r in index.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # a row for each term of the group at most
        df[r["term"]] = r["count"]
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)

    def read(batch: pa.RecordBatch, live: np.ndarray | None = None) -> tuple[Blocks, np.ndarray, np.ndarray]:
        col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        lists, tf = col["term"], col["tf"]
        doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        b = Blocks(col["block"].to_numpy(), col["n"].to_numpy(), doc, lists.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy().astype(np.int64), weight, n_docs, n_words)
        null = col["id"].is_null().to_numpy(zero_copy_only=False)
        return b, col["id"].fill_null(LAST).to_numpy(), null

    def group() -> Items:
        return Items(sent.value[1], len(sent.value[0]))

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks of the task with the best bounds for each item."""
        items = group()
        best = np.zeros((0, items.n), np.int64)
        key = np.zeros((0, items.n), np.int64)
        for batch in batches:
            b, _, _ = read(batch)
            best = np.concatenate([best, b.bounds(items)])
            key = np.concatenate([key, np.broadcast_to(b.key[:, None], (len(b.key), items.n))])
            top = np.argsort(-best, axis=0, kind="stable")[:first_blocks]
            best, key = np.take_along_axis(best, top, 0), np.take_along_axis(key, top, 0)
        r, i = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(key[r, i]), pa.array(best[r, i])], ["item", "block", "bound"])

    def told(best: Best) -> pa.RecordBatch:
        found = [(np.full(len(s), rows[i]), s, ids, null) for i, (s, ids, null) in best.rows.items()]
        item, score, ids, null = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
        return pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=null), pa.array(score)], ["item_row", "id", "score"])

    def score_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = group()
        best = Best(np.ones(items.n, np.int64), k)
        for batch in batches:
            b, ids, null = read(batch)
            who = batch.column(batch.schema.get_field_index("items"))
            for at in range(len(b.key)):
                some = slice(b.first[at], b.last[at])
                for i in who[int(b.first[at])].as_py():
                    best.add(i, b.scores(at, items.terms[i]), ids[some], null[some])
        yield told(best)

    w = Window.partitionBy("item").orderBy(F.col("bound").desc(), F.col("block"))
    chosen = index.select("block", "id", "n", "term", "tf").mapInArrow(promising, "item bigint, block bigint, bound bigint")
    chosen = chosen.withColumn("r", F.row_number().over(w)).where(F.col("r") <= first_blocks)
    chosen = chosen.groupBy("block").agg(F.collect_list("item").alias("items"))  # first_blocks entries an item of the group at most
    fields = "item_row bigint, id bigint, score bigint"
    started = index.join(F.broadcast(chosen), "block").select("block", "id", "n", "term", "tf", "items").mapInArrow(score_first, fields)
    w = Window.partitionBy("item_row").orderBy(F.col("score").desc())
    kth = started.select("item_row", "score").withColumn("r", F.row_number().over(w)).where(F.col("r") == k).collect()  # a row for each item of the group at most
    floor = np.ones(len(rows), np.int64)
    floor[np.searchsorted(rows, [r.item_row for r in kth])] = [r.score for r in kth]

    def score_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = group()
        best = Best(floor, k)
        for batch in batches:
            b, ids, null = read(batch)
            bound = b.bounds(items)
            for i in np.flatnonzero((bound >= best.floor).any(0)):
                own = bound[:, i]
                for at in np.argsort(-own, kind="stable"):
                    if own[at] < best.floor[i]:
                        break
                    some = slice(b.first[at], b.last[at])
                    best.add(i, b.scores(at, items.terms[i]), ids[some], null[some])
        yield told(best)

    return index.select("block", "id", "n", "term", "tf").mapInArrow(score_all, fields)


ORACLE = r"""
WITH t AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL
), d AS (
  SELECT row, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM t WHERE len(terms) > 0
), s AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words FROM d
), i AS (
  SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM benchmark WHERE text IS NOT NULL
), p AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) SEMI JOIN (SELECT DISTINCT term FROM i) q USING (term) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s
), f AS (
  SELECT row, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_words)) AS f FROM p JOIN d USING (row), s
), r AS (
  SELECT item_id, row, CAST(sum(w * f) AS BIGINT) AS score FROM i JOIN w USING (term) JOIN f USING (term) GROUP BY item_id, row HAVING sum(w * f) > 0
), k AS (
  SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r JOIN d USING (row)
)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
