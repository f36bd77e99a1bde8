"""Sources, graph, estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import estimate as E
from tallyloom.operators import graph as G
from tallyloom.operators import measures as M
from tallyloom.operators import sampling as S2
from tallyloom.sources import readers as S
from tallyloom.sources import writers as W

from tallyloom.operators.shared import fresh_path

from .registry import Tables, query


@query()
def html_tables(t: Tables) -> DataFrame:
    """Each page with a table of its own address put in, read back as records."""
    page = F.concat(F.lit("<table><tr><th>Page*</th><th>Address</th></tr><tr><td>"), F.col("page_id").cast("string"), F.lit("</td><td>"), F.col("url"), F.lit("</td></tr><tr><td></td><td>footer</td></tr></table>"), F.col("html"))
    return S.html_tables(t.pages.select("page_id", page.alias("html")), "html", ["page_id"], "Page").select("page_id", "row", F.col("record")["Address"].alias("address"))


EDGES = """SELECT 'r' || r_regionkey AS a, 'n' || n_nationkey AS b FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer"""


@query(f"""WITH RECURSIVE e AS ({EDGES}), w(node, depth, via) AS (SELECT DISTINCT a, 0, CAST(NULL AS VARCHAR) FROM e WHERE a IN ('r0', 'r1') UNION SELECT e.b, w.depth + 1, e.a FROM w JOIN e ON e.a = w.node WHERE w.depth < 6)
SELECT node, CAST(min(depth) AS INTEGER) AS depth, min(via) AS via FROM w GROUP BY node""")
def bfs_levels(t: Tables) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = t.nation.select(name("r", "n_regionkey").alias("from"), name("n", "n_nationkey").alias("to"))
    edges = edges.union(t.supplier.select(name("n", "s_nationkey"), name("s", "s_suppkey"))).union(t.customer.select(name("n", "c_nationkey"), name("c", "c_custkey")))
    return G.bfs(edges, edges.where(F.col("from").isin("r0", "r1")).select(F.col("from").alias("node")))


@query("SELECT event_type, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type")
def bootstrap_sizes(t: Tables) -> DataFrame:
    return E.bootstrap_mean(t.events, "value", ["event_type"], key=["event_id"], draws=200).select("event_type", "n")


@query()
def bootstrap_gap(t: Tables) -> DataFrame:
    return E.bootstrap_mean(t.events, "value", ["event_type"], key=["event_id"], draws=500)


@query()
def matched_pairs(t: Tables) -> DataFrame:
    d = t.documents.join(t.labels, "doc_id").select("lang", "toxic", F.log("n_chars").alias("size"), "doc_id")
    return S2.matched_pairs(d, cell=["lang"], treated="toxic", value="size", id_col="doc_id", caliper=0.35).drop("order")


@query()
def glm_cluster(t: Tables) -> DataFrame:
    """Quality on length and language by logistic regression with errors by source."""
    d = t.documents.join(t.labels, "doc_id").select("quality", F.lit(1).alias("one"), F.floor(F.log("n_chars")).alias("size"), (F.col("lang") == "en").cast("int").alias("en"), "source")
    fit = E.clustered_logit(d, y="quality", x=["one", "size", "en"], cluster="source")
    return t.spark.createDataFrame([(n, float(b), float(s)) for n, b, s in zip(("one", "log_size", "english"), fit["coef"], fit["se"], strict=True)], "term string, coef double, se double")


@query("SELECT event_id, user_id, event_type FROM events")
def jsonl_scan(t: Tables) -> DataFrame:
    """Events written as JSON lines to the shared folder and read again."""
    spark = t.spark
    path = fresh_path(spark)
    W.write_jsonl(t.events.select("event_id", "user_id", "event_type"), path)
    return S.read_jsonl(spark, path, "event_id bigint, user_id bigint, event_type string")


@query("SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // CAST(ceil((SELECT count(*) FROM customer) / 7.0) AS BIGINT) AS chunk FROM customer")
def parquet_chunks(t: Tables) -> DataFrame:
    return W.chunked(t.customer.select("c_custkey"), "c_custkey", 7).select("c_custkey", F.col("chunk").cast("long").alias("chunk"))


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS VARCHAR) AS k, json_valid(props) AS valid FROM events""")
def json_extract(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.expr("try_parse_json(props) IS NOT NULL").alias("valid"))


@query("""WITH k AS (SELECT user_id, event_id, epoch_us(ts) AS us, CAST(floor(value) AS BIGINT) AS v FROM events), x AS (SELECT *, event_id % 3 = 0 OR v IS NULL AS asked FROM k),
b AS (SELECT *, max(CASE WHEN NOT asked THEN us END) OVER w AS u0, min(CASE WHEN NOT asked THEN us END) OVER f AS u1 FROM x WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
p AS (SELECT user_id, us, max(v) AS v FROM x WHERE NOT asked GROUP BY 1, 2)
SELECT event_id, CAST(floor(CASE WHEN u0 IS NULL THEN q.v WHEN u1 IS NULL OR u1 = u0 THEN p.v ELSE p.v + (q.v - p.v) * (CAST(b.us - u0 AS DOUBLE) / CAST(u1 - u0 AS DOUBLE)) END * 1000 + 0.5) AS BIGINT) AS millis
FROM b LEFT JOIN p ON p.user_id = b.user_id AND p.us = u0 LEFT JOIN p q ON q.user_id = b.user_id AND q.us = u1 WHERE asked""")
def interp_asof(t: Tables) -> DataFrame:
    """The value of events without one, and of every third, interpolated in time between its user's other events; constant beyond the ends."""
    v = F.floor("value")
    d = t.events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), v.alias("v"), ((F.col("event_id") % 3 == 0) | v.isNull()).alias("asked"))
    return E.interpolate(d, by=["user_id"], at="us", value="v", asked="asked").where("asked").select("event_id", F.floor(F.col("v") * 1000 + 0.5).alias("millis"))


@query("""SELECT o_orderpriority, count(*) AS n, CAST(count_if(o_totalprice > 150000) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS share FROM orders GROUP BY 1""")
def share_by_group(t: Tables) -> DataFrame:
    g = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 150000).alias("k"))
    return g.select("o_orderpriority", "n", M.ratio(F.col("k"), F.col("n")).alias("share"))
