"""Queries of claims, counted joins, samples, tests and regressions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import wikitext as K
from tallyloom.operators import claims as C
from tallyloom.operators import estimate as E
from tallyloom.operators import joins as J
from tallyloom.operators import resolve as R
from tallyloom.operators import sampling as S

from .registry import Tables, query

# -- claims and labels: orders are entities, their lines say what they are instances of, parts and nations have the labels


def _snak(value, kind=None):  # noqa: ANN001, ANN202
    return F.struct(F.struct((kind if kind is not None else F.lit("value")).alias("snaktype"), F.struct(value.alias("value")).alias("datavalue")).alias("mainsnak"))


def _entities(t: Tables) -> DataFrame:
    """(qid, claims) in JSON; lines of fewer than five units have a snak without a value, and every eleventh order broken JSON."""
    ordered = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))))
    lines = t.lineitem.groupBy("l_orderkey").agg(ordered.alias("lines"))
    o = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    k = F.col("o_orderkey")
    of = F.transform("lines", lambda x: _snak(F.struct(F.when(x["q"] >= 5, F.concat(F.lit("Q"), x["l_partkey"].cast("string"))).alias("id")), F.when(x["q"] >= 5, "value").otherwise("somevalue")))
    country = F.array(_snak(F.struct(F.lit(None).cast("string").alias("id")), F.lit("novalue")), _snak(F.struct(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("id"))))
    founded = F.array(_snak(F.struct(F.concat(F.when(k % 5 == 0, "-").otherwise("+"), F.date_format("o_orderdate", "yyyy"), F.lit("-00-00T00:00:00Z")).alias("time"))))
    gone = F.when(F.col("o_orderstatus") == "F", F.array(_snak(F.struct(F.lit("+1999").alias("time")))))
    site = F.when(k % 3 == 0, F.array(_snak(F.concat(F.lit("http://s"), k.cast("string")))))
    record = F.array(_snak(k.cast("string")), _snak(F.lit("other")))
    claims = F.to_json(F.struct(of.alias("P31"), country.alias("P17"), founded.alias("P571"), gone.alias("P576"), site.alias("P856"), record.alias("P2484")))
    return o.select(F.concat(F.lit("E"), k.cast("string")).alias("qid"), F.when(k % 11 == 0, F.lit("{broken")).otherwise(claims).alias("claims"))


def _labels(t: Tables) -> DataFrame:
    name = F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.col("p_name"))
    parts = t.part.select(F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("id"), name.alias("label"))
    return parts.union(t.nation.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")), "n_name"))


@query("""WITH l AS (SELECT l_orderkey, string_agg(p_name, '|' ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(floor(l_quantity) AS BIGINT)) AS names FROM lineitem JOIN part ON p_partkey = l_partkey WHERE floor(l_quantity) >= 5 AND p_partkey % 7 <> 0 GROUP BY 1)
SELECT 'E' || o_orderkey AS qid, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE coalesce(names, '') END AS instance_of, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE coalesce(n_name, '') END AS country, '' AS school_district,
o_orderkey % 11 <> 0 AND o_orderstatus = 'F' AS dissolved, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE '' END || strftime(o_orderdate, '%Y') END AS founded,
CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 3 = 0 THEN 'http://s' || o_orderkey ELSE '' END AS website, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS record_id, '' AS postal_code
FROM orders LEFT JOIN l ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def claim_labels(t: Tables) -> DataFrame:
    every = t.orders.select(F.concat(F.lit("E"), F.col("o_orderkey").cast("string")).alias("qid"))
    return C.enrich(every, _entities(t), _labels(t))


TAG = "CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN 'unverified' ELSE event_type END"


@query(f"""WITH e AS (SELECT user_id, event_id, ts, {TAG} AS tag FROM events), k AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(tag, (ts, event_id)) FILTER (WHERE tag NOT IN ('', 'unverified')) AS strong,
arg_max(tag, (ts, event_id)) FILTER (WHERE tag <> '') AS named FROM e GROUP BY user_id) SELECT user_id, event_id, coalesce(strong, named, '') AS tag FROM k""")
def first_upgraded(t: Tables) -> DataFrame:
    """Each user's first event, its tag taken on from later ones while it is blank or unverified."""
    tag = F.when(F.col("event_type") == "view", "").when(F.col("event_type") == "click", "unverified").otherwise(F.col("event_type"))
    return R.first_wins_upgraded(t.events.select("user_id", "event_id", "ts", tag.alias("tag")), ["user_id"], ["ts", "event_id"], "tag", ("unverified",)).drop("ts")


@query("""SELECT o_orderstatus, CAST(count_if(c_custkey IS NOT NULL) AS BIGINT) AS n_rows, CAST(count_if(c_custkey IS NULL) AS BIGINT) AS n_missed FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c_custkey = nullif(o_custkey, 5) GROUP BY 1""")
def counted_join(t: Tables) -> DataFrame:
    """Orders with and without a customer of positive balance, by status; orders of customer 5 have a null key."""
    orders = t.orders.select("o_orderstatus", F.nullif("o_custkey", F.lit(5).cast("long")).alias("c_custkey"))
    return J.join_counts(orders, t.customer.where("c_acctbal > 0"), ["c_custkey"], ["o_orderstatus"])


@query("SELECT c_mktsegment, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def asserted_join(t: Tables) -> DataFrame:
    """Orders joined with customers; the plan fails if the segment that both carry differs."""
    told = t.customer.select("c_custkey", F.col("c_mktsegment").alias("said"))
    left = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(told, "c_custkey")
    return J.asserted_join(left, t.customer.select("c_custkey", "c_mktsegment"), ["c_custkey"], {"said": "c_mktsegment"}).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT o.o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = o.o_orderkey % 25 AND c.c_mktsegment = CASE WHEN o.o_custkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AND c.c_acctbal > 9000)")
def cell_filter(t: Tables) -> DataFrame:
    """Orders whose nation and segment, both together, are those of a customer with a large balance."""
    o = t.orders.select("o_orderkey", (F.col("o_orderkey") % 25).cast("int").alias("c_nationkey"), F.when(F.col("o_custkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("c_mktsegment"))
    return J.in_cells(o, t.customer.where("c_acctbal > 9000"), ["c_nationkey", "c_mktsegment"]).select("o_orderkey")


@query("""SELECT doc_id, CASE WHEN coalesce(t, '') <> '' THEN md5(t) ELSE md5(coalesce(d.lang, '')) END AS body FROM documents d LEFT JOIN (SELECT doc_id AS k, max(CASE WHEN quality = 1 THEN 'good ' || doc_id ELSE '' END) AS t FROM labels GROUP BY 1) l ON k = doc_id""")
def text_fallback(t: Tables) -> DataFrame:
    """A text from the labels where one is there and isn't blank, else the document's language."""
    texts = t.labels.select("doc_id", F.when(F.col("quality") == 1, F.concat(F.lit("good "), F.col("doc_id").cast("string"))).otherwise("").alias("t"))
    d = t.documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    return J.with_fallback(d, texts, ["doc_id"], "t", "lang", "body").select("doc_id", F.md5(F.col("body").cast("binary")).alias("body"))


# -- samples

CELL_ROOM = "SELECT lang, source, least(count_if(quality = 1), count_if(quality = 0)) AS room FROM documents JOIN labels USING (doc_id) GROUP BY ALL"


@query(f"""WITH r AS ({CELL_ROOM}), n AS (SELECT CAST(floor(sum(room) * 0.6) AS BIGINT) AS n FROM r), u AS (SELECT lang, source, unnest(range(0, CAST(room AS BIGINT))) AS turn FROM r), d AS (SELECT *, row_number() OVER (ORDER BY turn, lang NULLS FIRST, source NULLS FIRST) AS i FROM u),
t AS (SELECT lang, source, count(*) AS take FROM d, n WHERE i <= n GROUP BY ALL) SELECT r.lang, r.source, CAST(coalesce(take, 0) AS BIGINT) AS take FROM r LEFT JOIN t ON r.lang IS NOT DISTINCT FROM t.lang AND r.source IS NOT DISTINCT FROM t.source""")
def cell_allocation(t: Tables) -> DataFrame:
    """Six tenths of all room dealt to cells of language and source in turn."""
    d = t.documents.join(t.labels, "doc_id")
    room = d.groupBy("lang", "source").agg(F.least(F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)).alias("room"))
    total = room.agg(F.sum("room")).first()[0] or 0
    return S.allocate(room, ["lang", "source"], total * 6 // 10)


@query()
def stratified_pairs(t: Tables) -> DataFrame:
    """A matched sample of good and bad documents in cells of language, by the log of their length."""
    d = t.documents.join(t.labels, "doc_id").select("doc_id", "lang", "quality", F.log(F.col("n_chars") + 1).alias("size"))
    return S.draw_pairs(d, 200, cell=["lang"], treated="quality", value="size", id_col="doc_id", caliper=0.35)


# -- estimates

PAIRED = "SELECT user_id // 2 AS pair, user_id % 2 AS arm, event_type, CAST(floor(value) AS DOUBLE) AS v FROM events WHERE value IS NOT NULL"


def _paired(t: Tables) -> DataFrame:
    return t.events.where("value IS NOT NULL").select(F.expr("user_id div 2").alias("pair"), (F.col("user_id") % 2).alias("arm"), "event_type", F.floor("value").cast("double").alias("v"))


@query(f"""WITH e AS ({PAIRED}), m AS (SELECT event_type, pair, avg(v) FILTER (WHERE arm = 1) - avg(v) FILTER (WHERE arm = 0) AS d FROM e GROUP BY ALL)
SELECT event_type, count(*) AS n, CAST(round(avg(d) * 1e6) AS BIGINT) AS gap FROM m WHERE d IS NOT NULL GROUP BY 1 HAVING count(*) >= 5""")
def paired_gap(t: Tables) -> DataFrame:
    out = E.paired_bootstrap(_paired(t), "v", pair="pair", arm="arm", by=["event_type"], draws=50)
    return out.select("event_type", "n", F.round(F.col("mean") * 1e6).cast("long").alias("gap"))


@query()
def paired_intervals(t: Tables) -> DataFrame:
    return E.paired_bootstrap(_paired(t), "v", pair="pair", arm="arm", by=["event_type"], draws=500)


@query()
def paired_contrasts(t: Tables) -> DataFrame:
    return E.paired_contrasts(_paired(t), "v", pair="pair", arm="arm", model="event_type", draws=500)


SIZES = "SELECT lang, CAST(n_chars AS DOUBLE) AS x, quality AS f FROM documents JOIN labels USING (doc_id) WHERE n_chars IS NOT NULL AND quality IS NOT NULL"


@query(f"""WITH d AS ({SIZES}), r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY x) + (count(*) OVER (PARTITION BY lang, x) - 1) / 2.0 AS r FROM d), t AS (SELECT lang, sum(n * n * n - n) AS t FROM (SELECT lang, x, CAST(count(*) AS DOUBLE) AS n FROM d GROUP BY ALL) GROUP BY 1),
s AS (SELECT lang, count_if(f = 1) AS n1, count_if(f = 0) AS n0, sum(r) FILTER (WHERE f = 1) AS r FROM r GROUP BY 1), u AS (SELECT s.lang, CAST(n1 AS BIGINT) AS n1, CAST(n0 AS BIGINT) AS n0, r - n1 * (n1 + 1) / 2.0 AS u, n1 * n0 / 12.0 * (n1 + n0 + 1 - t / ((n1 + n0) * (n1 + n0 - 1.0))) AS v FROM s JOIN t ON s.lang IS NOT DISTINCT FROM t.lang)
SELECT lang, n1, n0, CAST(round(2 * u) AS BIGINT) AS u2, CAST(round(1e6 * sign(u - n1 * n0 / 2.0) * greatest(0, abs(u - n1 * n0 / 2.0) - 0.5) / sqrt(v)) AS BIGINT) AS z FROM u""")
def rank_sum(t: Tables) -> DataFrame:
    """Lengths of good against bad documents, by language."""
    d = t.documents.join(t.labels, "doc_id")
    return E.rank_sum_test(d, "n_chars", "quality", ["lang"]).select("lang", "n1", "n0", F.round(2 * F.col("u")).cast("long").alias("u2"), F.round(F.col("z") * 1e6).cast("long").alias("z"))


@query(f"""WITH e AS ({PAIRED}), m AS (SELECT event_type, pair, avg(v) FILTER (WHERE arm = 1) - avg(v) FILTER (WHERE arm = 0) AS d FROM e GROUP BY ALL), k AS (SELECT event_type, round(d * 1000) AS d FROM m WHERE d IS NOT NULL AND round(d * 1000) <> 0),
r AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY abs(d)) + (count(*) OVER (PARTITION BY event_type, abs(d)) - 1) / 2.0 AS r FROM k), t AS (SELECT event_type, sum(n * n * n - n) AS t FROM (SELECT event_type, abs(d), CAST(count(*) AS DOUBLE) AS n FROM k GROUP BY ALL) GROUP BY 1),
s AS (SELECT event_type, count(*) AS n, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS w FROM r GROUP BY 1)
SELECT event_type, n, CAST(round(2 * w) AS BIGINT) AS w2, CAST(round(1e6 * (w - n * (n + 1) / 4.0) / sqrt(n * (n + 1.0) * (2 * n + 1) / 24.0 - t / 48)) AS BIGINT) AS z FROM s JOIN t USING (event_type)""")
def signed_rank(t: Tables) -> DataFrame:
    """Differences within pairs of users, in thousandths, by event type."""
    d = E.pair_differences(_paired(t), "v", pair="pair", arm="arm", by=["event_type"]).withColumn("d", F.round(F.col("difference") * 1000))
    return E.signed_rank_test(d, "d", ["event_type"]).select("event_type", "n", F.round(2 * F.col("w")).cast("long").alias("w2"), F.round(F.col("z") * 1e6).cast("long").alias("z"))


@query("""WITH d AS (SELECT CAST(quality AS DOUBLE) AS y, CAST(floor(ln(n_chars + 1)) AS DOUBLE) AS x FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL), m AS (SELECT count(*) AS n, avg(x) AS a, regr_slope(y, x) AS b, regr_intercept(y, x) AS c, regr_sxx(y, x) AS s FROM d),
e AS (SELECT (x - a) * (y - c - b * x) / (1 - 1.0 / n - (x - a) * (x - a) / s) AS g, s FROM d, m)
SELECT n, CAST(round(1e6 * b) AS BIGINT) AS coef, CAST(round(1e6 * (SELECT sqrt(sum(g * g)) / any_value(s) FROM e)) AS BIGINT) AS se FROM m""")
def ols_line(t: Tables) -> DataFrame:
    """Quality on the whole log of the length, with HC3 errors."""
    d = t.documents.join(t.labels, "doc_id").select("quality", F.floor(F.log(F.col("n_chars") + 1)).alias("size"))
    return E.ols(d, "quality", ["size"]).where("term = 'size'").select("n", F.round(F.col("coef") * 1e6).cast("long").alias("coef"), F.round(F.col("se") * 1e6).cast("long").alias("se"))


@query()
def ols_terms(t: Tables) -> DataFrame:
    d = t.documents.join(t.labels, "doc_id").select("quality", F.floor(F.log(F.col("n_chars") + 1)).alias("size"), "lang", "source")
    return E.ols(d, "quality", ["size"], ["lang"], cluster="source")


@query()
def mediation(t: Tables) -> DataFrame:
    """How much of the tie between toxicity and quality goes by way of length."""
    d = t.documents.join(t.labels, "doc_id").select("quality", "toxic", F.floor(F.log(F.col("n_chars") + 1)).alias("size"), "lang", "source")
    return E.mediation(d, "quality", "toxic", "size", categorical=["lang"], cluster="source")


# -- markup: documents with a template before them

BOX = [("{{Infobox school\n| name = ", "source"), ("\n| established = {{start date|1|{{x|y=z}}}} ", "n_chars"), ("\n|motto=[[", "lang"), ("|", "lang"), (" motto]]<ref>a|b=c</ref>\n| empty = \n}}\n== History ==\nFounded by ", "source"), (".\n== Sports ==\n", "lang"), ("\n", "text")]


@query("""SELECT doc_id, coalesce(source, '') AS name, CAST(n_chars AS VARCHAR) AS established, coalesce(lang, '') || ' motto' AS motto, 3 AS n_fields, 'Founded by ' || coalesce(source, '') || '.' AS history FROM documents""")
def infobox_fields(t: Tables) -> DataFrame:
    texts = [F.concat(F.lit(mark), F.coalesce(F.col(c).cast("string"), F.lit(""))) for mark, c in BOX]
    d = t.documents.select("doc_id", F.concat(*texts).alias("wikitext"))
    d = d.select("doc_id", K.template_fields(F.col("wikitext"), "Infobox school").alias("f"), K.section(F.col("wikitext"), ("History",)).alias("history"))
    return d.select("doc_id", *[F.coalesce(F.try_element_at("f", F.lit(n)), F.lit("")).alias(n) for n in ("name", "established", "motto")], F.size("f").alias("n_fields"), "history")


SQUEEZED = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, '') || ' k z', '\s+', ' ', 'g'), '\[\[(?:[^\]|]*\|)?([^\]]*)\]\]', '\1', 'g'), '\[\[|\]\]|\{\{|\}\}', ' ', 'g'), '\s+([,.;:])', '\1', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({SQUEEZED}) AS article FROM documents")
def article_text(t: Tables) -> DataFrame:
    """Whole documents with a template four deep, dropped sections and a link put round them, as articles."""
    wiki = F.concat(F.lit("{{a|{{b|{{c|{{d}}}}}}}} "), F.coalesce("text", F.lit("")), F.lit("\n== References ==\nx\n=== Deep ===\ny\n== History ==\n[[l|k]] z [1]"))
    return t.documents.select("doc_id", F.md5(K.article_text(wiki).cast("binary")).alias("article"))
