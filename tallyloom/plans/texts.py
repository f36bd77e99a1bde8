"""Text functions, linkage, rules, rendering, gates and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import similarity as S
from tallyloom.functions import text as X
from tallyloom.operators import linkage as L
from tallyloom.operators import measures as M
from tallyloom.operators import phrases as PH

from .registry import Tables, query

NORM = rf"trim(regexp_replace(regexp_replace(replace(regexp_replace(lower(coalesce({{c}}, '')), '\([^)]*\)', ' ', 'g'), '&', ' and '), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
SPELLED = "array_to_string(list_transform(string_split({n}, ' '), lambda w: CASE w WHEN 'st' THEN 'saint' WHEN 'mt' THEN 'mount' WHEN 'jr' THEN 'junior' WHEN 'sr' THEN 'senior' WHEN 'ft' THEN 'fort' ELSE w END), ' ')"


@query(f"SELECT doc_id, {SPELLED.format(n=NORM.format(c='text'))} AS name FROM documents")
def norm_name(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.norm_name(F.col("text")).alias("name"))


@query(f"""SELECT p_partkey, array_to_string(list_filter(string_split({SPELLED.format(n=NORM.format(c='p_name'))}, ' '), lambda w: w <> '' AND w NOT IN ('the', 'of', 'red', 'blue')), ' ') AS core,
CAST(len(list_distinct(list_filter(string_split({SPELLED.format(n=NORM.format(c='p_name'))}, ' '), lambda w: w <> '' AND w NOT IN ('the', 'of', 'red', 'blue') AND length(w) >= 4))) AS INTEGER) AS n_significant FROM part""")
def core_tokens(t: Tables) -> DataFrame:
    core = X.core_tokens(F.col("p_name"), ["the", "of", "red", "blue"])
    return t.part.select("p_partkey", F.array_join(core, " ").alias("core"), F.size(X.significant_tokens(core)).alias("n_significant"))


@query(f"SELECT doc_id, trim(regexp_extract(coalesce('X (' || text || ') y', ''), '\\(([^)]*)\\)', 1)) AS inside FROM documents")
def title_paren(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.parenthesised(F.concat(F.lit("X ("), F.col("text"), F.lit(") y"))).alias("inside"))


@query("""SELECT c_custkey, array_to_string(list_transform(string_split(upper(c_name) || ' HS', ' '), lambda w: CASE WHEN w IN ('II', 'III', 'IV', 'HS', 'MS', 'ES', 'STEM', 'US', 'USA', 'NW', 'NE', 'SW', 'SE') THEN w
ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' ') AS title FROM customer""")
def abbrev_titlecase(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", X.title_case(F.concat(F.upper("c_name"), F.lit(" HS"))).alias("title"))


@query(r"""SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(url, '^[a-zA-Z]+://', ''), '^www\.', ''), '[/?#].*$', '')) AS host, contains(url, '?') AS has_query FROM pages""")
def url_host(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.host(F.col("url")).alias("host"), F.contains("url", F.lit("?")).alias("has_query"))


MARKED = "'{{note|x}} [[a page|label]] saw [[it]] [3] , ' || text || ' ]]'"
CLEANED = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({m}, '\{\{[^{}]*\}\}', '', 'g'), '\[\[[^\[\]|]*\|([^\[\]]*)\]\]', '\1', 'g'), '\[\[([^\[\]]*)\]\]', '\1', 'g'), '\[[0-9]+\]', '', 'g'), '\[\[|\]\]|\{\{|\}\}', '', 'g'), ' +([.,;:])', '\1', 'g'), ' +', ' ', 'g'))".replace("{m}", MARKED)


@query(f"SELECT doc_id, {CLEANED} AS clean, regexp_matches({CLEANED}, '\\{{\\{{|\\}}\\}}|\\[\\[|\\]\\]|\\[[0-9]+\\]') AS left_over FROM documents")
def clean_markup(t: Tables) -> DataFrame:
    marked = F.concat(F.lit("{{note|x}} [[a page|label]] saw [[it]] [3] , "), F.col("text"), F.lit(" ]]"))
    return t.documents.select("doc_id", X.clean_markup(marked).alias("clean")).withColumn("left_over", X.has_markup(F.col("clean")))


@query(r"""WITH f AS (SELECT doc_id, substr(regexp_replace(coalesce(text, ''), '\b([A-Z][a-z]{0,2})\.', '\1', 'g'), 1, 300) AS s FROM documents)
SELECT doc_id, regexp_matches(s, '^[^.]{0,200}?\b(was|were)\s+(a|an|the)\b') AND NOT regexp_matches(s, '^[^.]{0,200}?\b(is|are)\s+(a|an|the)\b') AS closed FROM f""")
def closed_opening(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.closed_opening(F.col("text")).alias("closed"))


PADDED = "CASE WHEN c_custkey % 3 = 0 THEN 'X' ELSE '' END || CAST(c_custkey * 7 AS VARCHAR)"


@query(f"""SELECT c_custkey, CASE WHEN regexp_matches({PADDED}, '^[0-9]+$') AND length({PADDED}) < 12 THEN lpad({PADDED}, 12, '0') ELSE {PADDED} END AS id,
regexp_replace(CAST(5550000000 + c_custkey AS VARCHAR), '^(...)(...)(....)$', '(\\1)\\2-\\3') AS phone FROM customer""")
def ids_and_phones(t: Tables) -> DataFrame:
    raw = F.concat(F.when(F.col("c_custkey") % 3 == 0, "X").otherwise(""), (F.col("c_custkey") * 7).cast("string"))
    return t.customer.select("c_custkey", X.zero_pad(raw).alias("id"), X.phone((F.lit(5550000000) + F.col("c_custkey")).cast("string")).alias("phone"))


PHRASES = "SELECT DISTINCT regexp_extract(lower(text), '^[a-z]+ [a-z]+', 0) AS phrase FROM benchmark"


@query(f"""WITH p AS ({PHRASES}) SELECT phrase, CAST(sum((length(text) - length(replace(text, phrase, ''))) // length(phrase)) AS BIGINT) AS n FROM documents, p WHERE phrase <> '' AND contains(text, phrase) GROUP BY phrase""")
def phrase_count(t: Tables) -> DataFrame:
    """The opening words of every benchmark item counted in all documents."""
    p = t.benchmark.select(F.regexp_extract(F.lower("text"), "^[a-z]+ [a-z]+", 0).alias("phrase"))
    return PH.count_phrases(t.documents, p)


GRAMS = "SELECT DISTINCT {id}, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT {id}, w, unnest(range(1, greatest(len(w) - 2, 1))) AS i FROM (SELECT {id}, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM {t}))"


@query(f"""WITH a AS ({GRAMS.format(id='doc_id', t='documents')}), b AS ({GRAMS.format(id='item_id', t='benchmark')}), n AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1),
h AS (SELECT doc_id, item_id, count(*) AS hits FROM a JOIN b USING (g) GROUP BY 1, 2) SELECT doc_id, item_id, hits, CAST(hits AS DOUBLE) / CAST(n AS DOUBLE) AS recall FROM h JOIN n USING (item_id) WHERE 2 * hits >= n""")
def ngram_recall(t: Tables) -> DataFrame:
    """A document's 4-grams are met as 64-bit hashes, only those of the benchmark go on, and its distinct hits are compared as text."""
    grams = lambda d, i: d.select(i, X.word_list(F.col("text")).alias("w")).select(i, F.explode(X.ngrams(F.col("w"), 4)).alias("g"))
    b = grams(t.benchmark, "item_id")
    keys = b.select(F.xxhash64("g").alias("h")).distinct()
    d = grams(t.documents, "doc_id").join(keys, F.xxhash64("g") == F.col("h"), "left_semi")
    hits = d.join(b, "g").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("hits"))
    return hits.join(b.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")), "item_id").where("2 * hits >= n").select("doc_id", "item_id", "hits", M.ratio(F.col("hits"), F.col("n")).alias("recall"))


@query()
def passage_runs(t: Tables) -> DataFrame:
    """The longest run of words that a document shares with a benchmark item, for the pairs that share half of the item's 4-grams."""
    pairs = ngram_recall(t).select("doc_id", "item_id", "recall")
    pairs = pairs.join(t.benchmark.select("item_id", F.col("text").alias("item")), "item_id").join(t.documents.select("doc_id", "text"), "doc_id")
    joined = lambda c: F.array_join(X.word_list(F.col(c)), " ")
    return pairs.select("doc_id", "item_id", "recall", S.common_run(joined("item"), joined("text")).alias("run"), F.size(X.word_list(F.col("item"))).alias("words"))


@query()
def lcs_run(t: Tables) -> DataFrame:
    a = t.benchmark.select("item_id", F.col("text").alias("x"))
    b = t.benchmark.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("y"))
    return a.join(b, "item_id").select("item_id", S.common_run(F.lower("x"), F.lower("y")).alias("run"), S.token_set_ratio(F.lower("x"), F.lower("y")).alias("set_ratio"), S.block_ratio(F.col("x"), F.col("y")).alias("block_ratio"))


def _parts(t: Tables, name: str) -> DataFrame:
    core = F.array_join(F.split(F.lower("p_name"), " "), " ")
    d = t.part.select(F.col("p_partkey").alias(name), "p_brand", core.alias(f"core_{name}"))
    return d.withColumn(f"tokens_{name}", X.significant_tokens(F.split(f"core_{name}", " ")))


@query("""WITH w AS (SELECT p_partkey, p_brand, unnest(list_distinct(list_filter(string_split(lower(p_name), ' '), lambda x: length(x) >= 4))) AS t FROM part)
SELECT p_brand, count(*) AS pairs FROM (SELECT DISTINCT a.p_brand, a.p_partkey AS x, b.p_partkey AS y FROM w a JOIN w b USING (p_brand, t) WHERE a.p_partkey < b.p_partkey) GROUP BY p_brand""")
def token_block_candidates(t: Tables) -> DataFrame:
    return L.count_token_pairs(_parts(t, "a"), tokens="tokens_a", block=["p_brand"])


@query()
def fuzzy_link(t: Tables) -> DataFrame:
    a, b = _parts(t, "a"), _parts(t, "b")
    return L.fuzzy_link(a, b, left_id="a", right_id="b", core_left="core_a", core_right="core_b", left_tokens="tokens_a", right_tokens="tokens_b", block=["p_brand"], threshold=80, other=True)


POINT = "CAST({k} * 7919 % 6000 AS DOUBLE) / 100.0 - 30.0 AS lat, CAST({k} * 104729 % 30000 AS DOUBLE) / 100.0 - 150.0 AS lon"


def _points(d: DataFrame, key: str) -> DataFrame:
    at = lambda f, m, o: (F.col(key) * f % m).cast("double") / 100.0 - o
    return d.select(key, at(7919, 6000, 30.0).alias("lat"), at(104729, 30000, 150.0).alias("lon"))


@query(f"""WITH a AS (SELECT c_custkey, {POINT.format(k='c_custkey')} FROM customer), b AS (SELECT s_suppkey, {POINT.format(k='s_suppkey')} FROM supplier),
d AS (SELECT c_custkey, s_suppkey, 111.0 * sqrt((a.lat - b.lat) * (a.lat - b.lat) + (a.lon - b.lon) * cos(radians(a.lat)) * (a.lon - b.lon) * cos(radians(a.lat))) AS km FROM a, b)
SELECT c_custkey, s_suppkey, CAST(floor(km) AS BIGINT) AS km FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY km, s_suppkey) AS n FROM d WHERE km <= 300) WHERE n = 1""")
def geo_nearest(t: Tables) -> DataFrame:
    near = L.geo_nearest(_points(t.customer, "c_custkey"), _points(t.supplier, "s_suppkey"), left_id="c_custkey", right_id="s_suppkey", radius=300)
    return near.select("c_custkey", "s_suppkey", F.floor("km").alias("km"))


@query("""WITH p AS (SELECT quality, CASE WHEN regexp_matches(text, '(###|%%%|&&&|!! )') THEN 0 ELSE 1 END AS guess FROM documents JOIN labels USING (doc_id)) SELECT quality, guess, count(*) AS n FROM p GROUP BY 1, 2""")
def baseline_predict(t: Tables) -> DataFrame:
    p = t.documents.join(t.labels, "doc_id").select("quality", F.when(F.col("text").rlike("(###|%%%|&&&|!! )"), 0).otherwise(1).alias("guess"))
    return p.groupBy("quality", "guess").agg(F.count(F.lit(1)).alias("n"))


ANSWER = "'A1: ' || role || chr(10) || 'A2: ' || CAST(turn AS VARCHAR) || ' to 12' || chr(10) || 'D1: ' || text"


@query(f"""SELECT conv_id, turn, nullif(trim(regexp_extract({ANSWER}, 'A1:[ \\t]*([^\\n]*)', 1)), '') AS a1, CAST(regexp_extract({ANSWER}, 'A2:[ \\t]*([0-9]+)', 1) AS INTEGER) AS lo,
CAST(regexp_extract({ANSWER}, 'A2:[^\\n]* ([0-9]+)', 1) AS INTEGER) AS hi FROM conversations""")
def answer_parse(t: Tables) -> DataFrame:
    answer = F.concat(F.lit("A1: "), F.col("role"), F.lit("\nA2: "), F.col("turn").cast("string"), F.lit(" to 12\nD1: "), F.col("text"))
    numbers = F.regexp_extract_all(X.labelled(answer, "A2"), F.lit("[0-9]+"), F.lit(0))
    return t.conversations.select("conv_id", "turn", X.labelled(answer, "A1").alias("a1"), F.element_at(numbers, 1).cast("int").alias("lo"), F.element_at(numbers, -1).cast("int").alias("hi"))


@query("""SELECT s_suppkey, 'Supplier ' || s_name || ' is in nation ' || CAST(s_nationkey AS VARCHAR) || '.' || CASE WHEN s_acctbal > 0 THEN ' It is owed ' || format('{:,}', CAST(floor(s_acctbal) AS BIGINT)) || '.' ELSE '' END AS text FROM supplier""")
def render_text(t: Tables) -> DataFrame:
    first = F.concat(F.lit("Supplier "), F.col("s_name"), F.lit(" is in nation "), F.col("s_nationkey").cast("string"), F.lit("."))
    owed = F.when(F.col("s_acctbal") > 0, F.concat(F.lit("It is owed "), F.format_number(F.floor("s_acctbal"), 0), F.lit(".")))
    return t.supplier.select("s_suppkey", F.concat_ws(" ", first, owed).alias("text"))


@query("""SELECT 'key_present' AS "check", count_if(doc_id IS NULL) = 0 AS ok, CAST(count_if(doc_id IS NULL) AS BIGINT) AS n_bad FROM documents
UNION ALL SELECT 'key_unique', count(*) = 0, CAST(count(*) AS BIGINT) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'text_present', count_if(coalesce(length(trim(text)), 0) = 0) = 0, CAST(count_if(coalesce(length(trim(text)), 0) = 0) AS BIGINT) FROM documents
UNION ALL SELECT 'lang_known', count_if(coalesce(lang, '') NOT IN ('en', 'de', 'fr', 'es')) = 0, CAST(count_if(coalesce(lang, '') NOT IN ('en', 'de', 'fr', 'es')) AS BIGINT) FROM documents
UNION ALL SELECT 'enough_rows', count(*) >= 100, CAST(count_if(FALSE) AS BIGINT) FROM documents
UNION ALL SELECT 'no_markup', count_if(regexp_matches(text, '\\[\\[|\\{\\{')) = 0, CAST(count_if(regexp_matches(text, '\\[\\[|\\{\\{')) AS BIGINT) FROM documents""".replace("\\\\", "\\"))
def gate_report(t: Tables) -> DataFrame:
    bad = lambda c: F.count_if(c)
    one = t.documents.agg(
        bad(F.col("doc_id").isNull()).alias("key_present"),
        bad(F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0).alias("text_present"),
        bad(~F.coalesce("lang", F.lit("")).isin("en", "de", "fr", "es")).alias("lang_known"),
        F.when(F.count(F.lit(1)) >= 100, F.lit(0).cast("long")).otherwise(1).alias("enough_rows"),
        bad(F.col("text").rlike(r"\[\[|\{\{")).alias("no_markup"),
    )
    keys = t.documents.groupBy("doc_id").count().where("count > 1").agg(F.count(F.lit(1)).alias("key_unique"))
    long = one.crossJoin(F.broadcast(keys)).unpivot([], ["key_present", "key_unique", "text_present", "lang_known", "enough_rows", "no_markup"], "check", "n_bad")
    return long.select("check", (F.col("n_bad") == 0).alias("ok"), "n_bad")


WILSON = "((p + 3.8416 / 2 / m) {s} 1.96 * sqrt(p * (1 - p) / m + (3.8416 / 4) / (m * m))) / (1 + 3.8416 / m)"


@query(f"""WITH g AS (SELECT lang, CAST(sum(quality) AS BIGINT) AS hits, count(*) AS n, CAST(sum(quality) AS DOUBLE) / count(*) AS p, CAST(count(*) AS DOUBLE) AS m FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, hits, n, CAST(floor(1e6 * {WILSON.format(s='-')}) AS BIGINT) AS low, CAST(floor(1e6 * {WILSON.format(s='+')}) AS BIGINT) AS high FROM g""")
def wilson(t: Tables) -> DataFrame:
    g = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.sum("quality").cast("long").alias("hits"), F.count(F.lit(1)).alias("n"))
    low, high = M.wilson(F.col("hits"), F.col("n"))
    return g.select("lang", "hits", "n", F.floor(low * 1e6).alias("low"), F.floor(high * 1e6).alias("high"))


@query("""WITH g AS (SELECT count(*) AS n, CAST(count_if(quality = toxic) AS DOUBLE) AS same, CAST(sum((quality - toxic) * (quality - toxic)) AS DOUBLE) AS dd, CAST(sum(quality) AS DOUBLE) AS sa, CAST(sum(toxic) AS DOUBLE) AS sb,
CAST(sum(quality * quality) AS DOUBLE) AS saa, CAST(sum(toxic * toxic) AS DOUBLE) AS sbb FROM labels) SELECT n, same / CAST(n AS DOUBLE) AS exact, CAST(1 AS DOUBLE) AS within_one, 1 - dd / (saa + sbb - 2 * sa * sb / n) AS kappa FROM g""")
def kappa(t: Tables) -> DataFrame:
    return M.kappa(t.labels, "quality", "toxic")


@query("""WITH d AS (SELECT quality, CAST(n_chars AS DOUBLE) AS v FROM labels JOIN documents USING (doc_id)), s AS (SELECT avg(v) FILTER (WHERE quality = 1) AS m1, avg(v) FILTER (WHERE quality = 0) AS m0, var_samp(v) FILTER (WHERE quality = 1) AS v1, var_samp(v) FILTER (WHERE quality = 0) AS v0 FROM d)
SELECT CAST(round(m1, 3) * 1000 AS BIGINT) AS m1, CAST(round(m0, 3) * 1000 AS BIGINT) AS m0, CAST(round(1e6 * (m1 - m0) / sqrt((v1 + v0) / 2)) AS BIGINT) AS smd FROM s""")
def smd(t: Tables) -> DataFrame:
    s = M.smd(t.labels.join(t.documents, "doc_id"), "quality", "n_chars")
    return s.select(*[F.round(F.round(c, 3) * 1000).cast("long").alias(c) for c in ("m1", "m0")], F.round(F.col("smd") * 1e6).cast("long").alias("smd"))


RATED = "SELECT o_orderstatus, CAST(substr(o_orderpriority, 1, 1) AS INT) AS said, CAST(least(5, 1 + floor(o_totalprice / 60000)) AS INT) AS held FROM orders"


def _rated(t: Tables) -> DataFrame:
    held = F.least(F.lit(5), 1 + F.floor(F.col("o_totalprice") / 60000)).cast("int")
    return t.orders.select("o_orderstatus", F.substring("o_orderpriority", 1, 1).cast("int").alias("said"), held.alias("held"))


@query(f"""WITH r AS ({RATED}), g AS (SELECT o_orderstatus, count(*) AS n, CAST(count_if(said = held) AS DOUBLE) AS same, CAST(count_if(abs(said - held) <= 1) AS DOUBLE) AS near, CAST(sum((said - held) * (said - held)) AS DOUBLE) AS dd, CAST(sum(said) AS DOUBLE) AS sa,
CAST(sum(held) AS DOUBLE) AS sb, CAST(sum(said * said) AS DOUBLE) AS saa, CAST(sum(held * held) AS DOUBLE) AS sbb FROM r WHERE said IS NOT NULL AND held IS NOT NULL GROUP BY 1)
SELECT o_orderstatus, n, same / n AS exact, near / n AS within_one, CAST(round(1e6 * (1 - dd / (saa + sbb - 2 * sa * sb / n))) AS BIGINT) AS kappa FROM g""")
def rating_agreement(t: Tables) -> DataFrame:
    """How far an order's priority and the class of its price agree, by status."""
    return M.kappa(_rated(t), "said", "held", ["o_orderstatus"]).withColumn("kappa", F.round(F.col("kappa") * 1e6).cast("long"))


@query(f"""WITH r AS ({RATED} WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL), g AS (SELECT DISTINCT o_orderstatus FROM r) SELECT g.o_orderstatus, x.said, {", ".join(f"CAST(count_if(held = {k}) AS BIGINT) AS r_{k}" for k in range(1, 6))}
FROM g CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS said) x LEFT JOIN r ON r.o_orderstatus IS NOT DISTINCT FROM g.o_orderstatus AND r.said = x.said GROUP BY 1, 2""")
def rating_confusion(t: Tables) -> DataFrame:
    """The same two ratings, counted pair by pair."""
    return M.confusion(_rated(t), "said", "held", [1, 2, 3, 4, 5], ["o_orderstatus"])


RANK = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


@query(f"""WITH d AS (SELECT lang, CAST(n_chars AS DOUBLE) AS a, quality AS b FROM labels JOIN documents USING (doc_id)),
r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY a) + (count(*) OVER (PARTITION BY lang, a) - 1) / 2.0 AS x, rank() OVER (PARTITION BY lang ORDER BY b) + (count(*) OVER (PARTITION BY lang, b) - 1) / 2.0 AS y FROM d)
SELECT lang, CAST(round(1e6 * corr(x, y)) AS BIGINT) AS rho FROM r GROUP BY lang""")
def spearman(t: Tables) -> DataFrame:
    d = t.labels.join(t.documents, "doc_id").select("lang", "n_chars", "quality")
    d = M.with_average_rank(M.with_average_rank(d, "n_chars", ["lang"], "x"), "quality", ["lang"], "y")
    return d.groupBy("lang").agg(F.round(F.corr("x", "y") * 1e6).cast("long").alias("rho"))


@query("""WITH k AS (SELECT min(event_type) AS lo, max(event_type) AS hi FROM events), m AS (SELECT user_id, event_type, avg(CAST(floor(value) AS BIGINT)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
d AS (SELECT a.v - b.v AS d FROM m a JOIN m b USING (user_id), k WHERE a.event_type = k.hi AND b.event_type = k.lo)
SELECT count(*) AS n, CAST(round(avg(d), 3) * 1000 AS BIGINT) AS mean, CAST(round(1000 * stddev_samp(d) / sqrt(count(*))) AS BIGINT) AS se FROM d HAVING count(*) >= 5""")
def paired_contrast(t: Tables) -> DataFrame:
    e = t.events.where("value IS NOT NULL")
    ends = t.events.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    m = e.groupBy("user_id", "event_type").agg(F.avg(F.floor("value")).alias("v")).crossJoin(F.broadcast(ends))
    d = m.where("event_type = hi").select("user_id", F.col("v").alias("a")).join(m.where("event_type = lo").select("user_id", F.col("v").alias("b")), "user_id").select((F.col("a") - F.col("b")).alias("d"))
    s = d.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd")).where("n >= 5")
    return s.select("n", F.round(F.round("mean", 3) * 1000).cast("long").alias("mean"), F.round(1000 * F.col("sd") / F.sqrt("n")).cast("long").alias("se"))
