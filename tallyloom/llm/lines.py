"""Rules on lines, in DataFrame functions only: quality by cross-document frequency, and line dedup by site-relative frequency.

Both hash each document's normalised lines once (trimmed, lower case), and count for every host and line the
documents that hold it. Documents of a host with equal texts are one page and count once, so that a page that was
copied a thousand times isn't taken for the site's frame; texts are told apart by 64 bits, and two that agree by
chance cost a count of one. Counting is over (host, line, page), so a line that stands in a third of all documents is
spread over as many keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut, free_names, hot_keys, salted_join

GAP = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"


def text_lines(text: Column) -> Column:
    """The \\n-split lines of a text; none for a null."""
    return F.coalesce(F.split(text, "\n", -1), F.array().cast("array<string>"))


def norm_line(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(" \t\r\x0b\x0c")))


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(norm_line(line)), 1, 15), 16, 10).cast("long")


def line_frequencies(docs: DataFrame, *, text_col: str, host_col: str) -> DataFrame:
    """(host, line, n_docs, n_smallest) of all lines with a word: the pages that hold it, and those of which it is the smallest."""
    text = F.col(text_col).cast("string")
    hashes = F.array_distinct(F.transform(F.filter(text_lines(text), lambda l: l.rlike(HAS_WORD)), line_hash))
    rows = docs.select(F.col(host_col).cast("string").alias("host"), F.xxhash64(text).alias("page"), hashes.alias("hashes")).where(F.size("hashes") > 0)
    rows = rows.select("host", "page", F.array_min("hashes").alias("smallest"), F.explode("hashes").alias("line"))
    seen = rows.groupBy("host", "line", "page").agg(F.max((F.col("line") == F.col("smallest")).cast("int")).alias("is_smallest"))
    # each page has one smallest line, so these add up to the number of pages
    counts = seen.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("is_smallest").alias("n_smallest"))
    return cut(counts)


def frequent_lines(counts: DataFrame, min_docs: int, max_ratio: float, max_docs: int | None = None) -> DataFrame:
    """(host, line, n_docs) of the lines in more than max_ratio of their host's pages and in min_docs at least, or in over max_docs.

    A host with p lines a page has at most p / max_ratio of the first kind, and pages * p / max_docs of the second.
    """
    hosts = counts.groupBy(F.col("host").alias("of_host")).agg(F.sum("n_smallest").alias("host_docs"))
    often = counts.where(F.col("n_docs") >= min_docs)
    above = F.col("n_docs") > F.col("host_docs") * F.lit(max_ratio)
    if max_docs is not None:
        above = above | (F.col("n_docs") > max_docs)
    return cut(often.join(hosts, F.col("host").eqNullSafe(F.col("of_host"))).where(above).select("host", "line", "n_docs"))


def with_own_frequent(docs: DataFrame, frequent: DataFrame, *, text_col: str, host_col: str, name: str, listed: int = 1000) -> DataFrame:
    """docs with name: the hashes of the document's lines that its host has too often, null or empty if there is none.

    A host of at most listed such lines sends them all to its documents as a list. Those of a larger host meet its pages line by
    line, common lines in salted parts, and are gathered by page; a page is a text, so its copies share what was found. Pages whose
    64-bit hashes agree by chance share theirs too, which changes nothing: all are frequent lines of the host.
    """
    host, page, found, at, of_page = free_names(docs, "frequent_host", "frequent_page", "frequent_found", "frequent_at", "of_page")
    sizes = frequent.groupBy(F.col("host").alias("of_host")).agg(F.count(F.lit(1)).alias("size"))
    marked = frequent.join(sizes, F.col("host").eqNullSafe(F.col("of_host")))
    lists = marked.where(F.col("size") <= listed).groupBy(F.col("host").alias(host)).agg(F.collect_list("line").alias(found))
    out = docs.join(lists, docs[host_col].cast("string").eqNullSafe(lists[host]), "left")
    lines = F.filter(text_lines(F.col(text_col).cast("string")), lambda l: l.rlike(HAS_WORD))
    own = F.array_intersect(F.transform(lines, line_hash), F.col(found))  # one hash set a document, and a short list to look up in
    large = cut(marked.where(F.col("size") > listed).select("host", "line", "n_docs"))
    if large.isEmpty():
        return out.withColumn(name, own).drop(host, found)
    text, blank = F.col(text_col).cast("string"), F.lit("\0")  # no host is called so
    of_host = F.coalesce(F.col(host_col).cast("string"), blank)
    large = large.withColumn("host", F.coalesce("host", blank))
    hashes = F.array_distinct(F.transform(lines, line_hash))
    pages = docs.select(of_host.alias("host"), F.xxhash64(text).alias("page"), hashes.alias("hashes")).join(large.select("host").distinct(), "host", "left_semi")
    pages = pages.select("host", "page", F.explode("hashes").alias("line")).distinct()
    hot = hot_keys(large.withColumnRenamed("n_docs", "n"), ["host", "line"], large.agg(F.sum("n_docs")).first()[0])
    met = salted_join(pages, large.select("host", "line"), ["host", "line"], "inner", hot, F.col("page"))
    met = met.groupBy(F.col("host").alias(at), F.col("page").alias(page)).agg(F.collect_list("line").alias(of_page))  # no more than the page has
    out = out.join(met, (of_host == F.col(at)) & (F.xxhash64(text) == F.col(page)), "left")
    return out.withColumn(name, F.coalesce(of_page, own)).drop(host, found, at, page, of_page)


def is_frequent(line: Column, own: Column) -> Column:
    return F.coalesce(F.array_contains(own, line_hash(line)), F.lit(False)) & line.rlike(HAS_WORD)


def drop_site_lines(
    docs: DataFrame, *, text_col: str = "text", host_col: str = "source", min_docs: int = 10, max_ratio: float = 0.04, stats: bool = False, listed: int = 1000
) -> DataFrame:
    """docs with text_col less the lines that stand in over max_ratio of their host's pages (and in min_docs pages).

    Lines without a word stay. A null text stays null; a text that loses all lines becomes empty; a null host is
    a host. Rows that repeat are one page. With stats, columns n_lines and n_dropped follow, in place of any that docs has.
    """
    counts = line_frequencies(docs, text_col=text_col, host_col=host_col)
    frequent = frequent_lines(counts, min_docs, max_ratio)
    lines, own, kept = free_names(docs, "lines", "own_frequent", "kept_lines")
    both = with_own_frequent(docs, frequent, text_col=text_col, host_col=host_col, name=own, listed=listed).withColumn(lines, text_lines(F.col(text_col)))
    untouched = F.coalesce(F.size(own), F.lit(0)) == 0
    both = both.withColumn(kept, F.when(F.col(own).isNull() | untouched, F.col(lines)).otherwise(F.filter(lines, lambda l: ~is_frequent(l, F.col(own)))))
    text = F.when(F.size(kept) == F.size(lines), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    new = {"n_lines", "n_dropped"} if stats else set()
    out = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c.lower() not in new]
    more = [F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(kept)).cast("long").alias("n_dropped")] if stats else []
    return both.select(*out, *more)


def quality_rules(
    docs: DataFrame,
    *,
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = 25,
    max_ratio: float = 0.04,
    max_docs: int = 5000,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    min_left_percent: int = 20,
    listed: int = 1000,
) -> DataFrame:
    """docs, text_col less its frequent lines, with the columns of COUNTS, base_failed and kept, in place of any that docs has.

    Lines above the limits (in min_docs pages of the host and over max_ratio of them, or in over max_docs) are taken away;
    the counts are of the text as it was. A document is depleted if less than min_left_percent of its words are left.
    kept: neither base_failed nor depleted. A null text has no words and fails.
    Three-word windows are sorted by hashes, less the bits of a position; neighbours that agree are compared by their words,
    and a text in which hashes of different words agree is counted anew by the words themselves.
    """
    own, words, lines, hashes, n, bits, keys, twins = free_names(docs, "own_frequent", "words", "lines_", "hashes", "n_triples", "bits", "keys", "twins")
    frequent = frequent_lines(line_frequencies(docs, text_col=text_col, host_col=host_col), min_docs, max_ratio, max_docs)
    d = with_own_frequent(docs, frequent, text_col=text_col, host_col=host_col, name=own, listed=listed)
    text = F.coalesce(F.col(text_col), F.lit(""))
    spaced = text
    for c in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    d = d.withColumns({
        words: F.array_remove(F.split(spaced, " "), ""),
        lines: F.filter(text_lines(F.col(text_col)), lambda l: l.rlike(HAS_WORD)),
    })
    size = F.size(words)
    d = d.withColumns({hashes: F.transform(words, lambda w: F.xxhash64(w)), bits: F.length(F.bin(size)).cast("int"), n: F.greatest(size - 2, F.lit(0))})
    pair = F.zip_with(F.slice(hashes, 1, F.col(n)), F.slice(hashes, 2, F.col(n)), lambda x, y: F.xxhash64(x, y))
    d = d.withColumn(keys, F.zip_with(pair, F.slice(hashes, 3, F.col(n)), lambda x, y: F.call_function("shiftleft", F.xxhash64(x, y), F.col(bits))))
    d = d.withColumn(keys, F.sort_array(F.transform(keys, lambda k, i: k.bitwiseOR(i.cast("long")))))
    m = F.greatest(F.col(n) - 1, F.lit(0))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(bits)) - 1
    near = F.zip_with(F.slice(keys, 1, m), F.slice(keys, 2, m), lambda x, y: F.when(F.call_function("shiftright", x.bitwiseXOR(y), F.col(bits)) == 0, F.array(x.bitwiseAND(mask), y.bitwiseAND(mask))))
    d = d.withColumn(twins, F.array_compact(near))
    at = lambda p, k: F.get(words, (p + k).cast("int"))
    lied = F.exists(twins, lambda t: (at(t[0], 0) != at(t[1], 0)) | (at(t[0], 1) != at(t[1], 1)) | (at(t[0], 2) != at(t[1], 2)))
    triples = F.sort_array(F.transform(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1), lambda i: F.struct(F.array_join(F.slice(words, i.cast("int") + 1, 3), " ").alias("w"), i.alias("i"))))
    exact = F.array_compact(F.zip_with(F.slice(triples, 1, m), F.slice(triples, 2, m), lambda x, y: F.when(x["w"] == y["w"], F.array(x["i"], y["i"]))))
    starts = F.sort_array(F.array_distinct(F.flatten(F.when(lied, exact).otherwise(F.col(twins)))))
    covered = F.aggregate(starts, F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n")), lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3).cast("long"), p - s["last"])).alias("n")))["n"]
    gone = F.aggregate(F.filter(lines, lambda l: is_frequent(l, F.col(own))), F.lit(0).cast("long"), lambda s, l: s + F.size(F.array_remove(F.split(l, GAP), "")))
    untouched = F.coalesce(F.size(own), F.lit(0)) <= 0
    counts = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.when(untouched, F.lit(0).cast("long")).otherwise(gone).alias("n_frequent_words"),
    )
    less = F.when(untouched, F.col(text_col)).otherwise(F.array_join(F.filter(text_lines(F.col(text_col)), lambda l: ~is_frequent(l, F.col(own))), "\n"))
    plain = [c for c in docs.columns if c.lower() not in {*COUNTS, "base_failed", "kept"}]
    # a generator: a filter on the verdict isn't pushed below it, where each use would work all this out again
    d = d.select(*(less.alias(c) if c == text_col else F.col(c) for c in plain), F.inline(F.array(counts)))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    left = (F.col("n_words") - F.col("n_frequent_words")) * 100 >= F.col("n_words") * min_left_percent
    return d.withColumn("base_failed", failed).withColumn("kept", ~failed & left)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_frequent_words")


#: Pages of a host are its distinct texts with a word, in SQL as above.
def oracle_frequent(min_docs: int, max_ratio: float, max_docs: int | None = None) -> str:
    also = "" if max_docs is None else f" OR n_docs > {max_docs}"
    return rf"""
lines AS (
  SELECT doc_id, source, text, line, CAST('0x' || substr(md5(lower(trim(line, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)))), 1, 15) AS BIGINT) AS h
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), counts AS (
  SELECT source, h, count(DISTINCT text) AS n_docs FROM lines GROUP BY source, h
), hosts AS (
  SELECT source, count(DISTINCT text) AS host_docs FROM documents WHERE regexp_matches(text, '[^\x20\x09-\x0D]') GROUP BY source
), frequent AS (
  SELECT c.source, h FROM counts c JOIN hosts s ON c.source IS NOT DISTINCT FROM s.source
  WHERE n_docs >= {min_docs} AND (n_docs > CAST(host_docs AS DOUBLE) * CAST({max_ratio} AS DOUBLE){also})
)"""


def oracle_drop(min_docs: int = 10, max_ratio: float = 0.04) -> str:
    return rf"""
WITH {oracle_frequent(min_docs, max_ratio)}, parts AS (
  SELECT doc_id, d.i, d.line, l.h IS NOT NULL AND regexp_matches(d.line, '[^\x20\x09-\x0D]') AS gone
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) d
  LEFT JOIN frequent l ON l.source IS NOT DISTINCT FROM d.source
    AND l.h = CAST('0x' || substr(md5(lower(trim(d.line, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)))), 1, 15) AS BIGINT)
), by_doc AS (
  SELECT doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS text FROM parts GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(b.text, '')) AS text_sha256
FROM documents d LEFT JOIN by_doc b USING (doc_id)
"""


def oracle_rules(min_docs: int = 25, max_ratio: float = 0.04, max_docs: int = 5000, min_words: int = 50, max_repeat_percent: int = 50, min_left_percent: int = 20) -> str:
    return rf"""
WITH {oracle_frequent(min_docs, max_ratio, max_docs)}, words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, coalesce(text, '') AS text FROM documents
), each AS (
  SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM words
), triples AS (
  SELECT doc_id, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM each WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM triples WHERE c IS NOT NULL) WHERE n >= 2
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id
), gone AS (
  SELECT l.doc_id, CAST(sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS BIGINT) AS n
  FROM lines l JOIN frequent f ON f.source IS NOT DISTINCT FROM l.source AND f.h = l.h GROUP BY l.doc_id
), base AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(d.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(g.n, 0) AS n_frequent_words
  FROM words w LEFT JOIN repeats r USING (doc_id) LEFT JOIN dups d USING (doc_id) LEFT JOIN gone g USING (doc_id)
), failed AS (
  SELECT *, n_words < {min_words} OR 100 * n_repeat_words > {max_repeat_percent} * n_words AS base_failed FROM base
)
SELECT *, NOT base_failed AND (n_words - n_frequent_words) * 100 >= n_words * {min_left_percent} AS kept FROM failed
"""
