"""Joins, duplicates, aggregates, windows and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators import measures as M
from tallyloom.operators import resolve as R
from tallyloom.sources import writers as W

from .registry import Tables, query


def _flagged(t: Tables) -> DataFrame:
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return R.flag(t.customer, urgent, "c_custkey", "has")


FLAGGED = "SELECT c.*, CASE WHEN u.o_custkey IS NULL THEN 0 ELSE 1 END AS has FROM customer c LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') u ON c_custkey = o_custkey"


@query(f"""SELECT n_name AS nation, count(*) AS total, CAST(sum(has) AS BIGINT) AS has, CAST(sum(has) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS share
FROM ({FLAGGED}) f JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def coverage_by_nation(t: Tables) -> DataFrame:
    d = _flagged(t).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    d = d.groupBy(F.col("n_name").alias("nation")).agg(F.count(F.lit(1)).alias("total"), F.sum("has").cast("long").alias("has"))
    return d.withColumn("share", M.ratio(F.col("has"), F.col("total")))


@query(f"""SELECT r_name AS region, c_mktsegment AS segment, count(*) AS total, CAST(sum(has) AS BIGINT) AS has
FROM ({FLAGGED}) f JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name), (r_name, c_mktsegment), ())""")
def coverage_by_region_level(t: Tables) -> DataFrame:
    d = _flagged(t).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    d = d.select(F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment"), "has")
    return d.groupingSets([[F.col("region")], [F.col("region"), F.col("segment")], []], "region", "segment").agg(F.count(F.lit(1)).alias("total"), F.sum("has").cast("long").alias("has"))


@query(f"""WITH c AS (SELECT c_nationkey AS k, count(*) AS total, CAST(sum(has) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS share FROM ({FLAGGED}) f GROUP BY 1 HAVING count(*) >= 20)
SELECT * FROM (SELECT 'low' AS side, * FROM c ORDER BY share, k LIMIT 3) UNION ALL SELECT * FROM (SELECT 'high' AS side, * FROM c ORDER BY share DESC, k DESC LIMIT 2)""")
def coverage_extremes(t: Tables) -> DataFrame:
    c = _flagged(t).groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("total"), F.sum("has").alias("has")).where("total >= 20")
    c = c.select("k", "total", M.ratio(F.col("has"), F.col("total")).alias("share"))
    low, high = c.orderBy("share", "k").limit(3), c.orderBy(F.desc("share"), F.desc("k")).limit(2)
    return low.withColumn("side", F.lit("low")).unionByName(high.withColumn("side", F.lit("high")))


@query("SELECT o_orderstatus AS status, o_orderstatus IN ('F', 'O') AS taken, count(*) AS n FROM orders GROUP BY 1, 2")
def status_filter_counts(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    return t.orders.groupBy(s.alias("status"), s.isin("F", "O").alias("taken")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, q.lines, q.qty, CASE WHEN q.lines > 0 AND q.qty > 0 THEN CAST(CAST(o_totalprice * 100 AS BIGINT) AS DOUBLE) / CAST(q.qty AS DOUBLE) END AS cents_each
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lineitem GROUP BY 1) q ON o_orderkey = l_orderkey""")
def left_lookup_chain(t: Tables) -> DataFrame:
    q = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.round("l_quantity").cast("long")).alias("qty"))
    each = F.when((F.col("lines") > 0) & (F.col("qty") > 0), F.round(F.col("o_totalprice") * 100).cast("long").cast("double") / F.col("qty").cast("double"))
    return t.orders.join(q, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "lines", "qty", each.alias("cents_each"))


@query("""SELECT l_orderkey, CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) END) AS BIGINT) AS a, CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) END) AS BIGINT) AS n,
CAST(sum(CAST(l_quantity AS BIGINT)) - coalesce(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) END), 0) AS BIGINT) AS not_returned FROM lineitem GROUP BY 1""")
def conditional_pick(t: Tables) -> DataFrame:
    qty = F.round("l_quantity").cast("long")
    of = lambda f: F.sum(F.when(F.col("l_returnflag") == f, qty))
    return t.lineitem.groupBy("l_orderkey").agg(of("A").alias("a"), of("N").alias("n"), (F.sum(qty) - F.coalesce(of("R"), F.lit(0))).alias("not_returned"))


@query("""SELECT 'customer' AS sector, c_custkey AS id, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer
UNION ALL BY NAME SELECT 'supplier' AS sector, s_suppkey AS id, s_name AS name, s_nationkey AS nation FROM supplier""")
def union_by_name_extras(t: Tables) -> DataFrame:
    c = t.customer.select(F.lit("customer").alias("sector"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    s = t.supplier.select(F.lit("supplier").alias("sector"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return c.unionByName(s, allowMissingColumns=True)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def first_wins(t: Tables) -> DataFrame:
    return R.pick_by_key(t.events, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def last_wins(t: Tables) -> DataFrame:
    return R.pick_by_key(t.events, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "event_type")


@query("""SELECT o_custkey, o_orderkey, n_losers FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS n,
count(*) OVER (PARTITION BY o_custkey) - 1 AS n_losers FROM orders) WHERE n = 1""")
def claim_resolution(t: Tables) -> DataFrame:
    won = R.claim_resolution(t.orders, "o_custkey", [F.col("o_orderpriority"), F.col("o_totalprice").desc(), F.col("o_orderkey")])
    return won.select("o_custkey", "o_orderkey", "n_losers")


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'closed' WHEN c_mktsegment = 'MACHINERY' THEN 'segment' WHEN c_nationkey IS NULL THEN 'no_location' ELSE 'open' END AS reason
FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def unmatched_reason(t: Tables) -> DataFrame:
    left = R.remaining(t.customer, t.orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])
    reason = F.when(F.col("c_acctbal") < 0, "closed").when(F.col("c_mktsegment") == "MACHINERY", "segment").when(F.col("c_nationkey").isNull(), "no_location").otherwise("open")
    return left.select("c_custkey", reason.alias("reason"))


@query("""SELECT u.user_id, k.event_type FROM (SELECT DISTINCT user_id FROM events) u, (SELECT DISTINCT event_type FROM events) k
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = k.event_type)""")
def resume_plan(t: Tables) -> DataFrame:
    kinds = t.events.groupBy().agg(F.collect_set("event_type").alias("kinds"))  # few values: one row
    work = t.events.select("user_id").distinct().crossJoin(F.broadcast(kinds)).select("user_id", F.explode("kinds").alias("event_type"))
    return R.remaining(work, t.events, ["user_id", "event_type"])


@query("SELECT count(*) AS n_missing FROM (SELECT DISTINCT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def referential_check(t: Tables) -> DataFrame:
    known = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return R.remaining(t.lineitem.select("l_orderkey").distinct(), known, ["l_orderkey"]).agg(F.count(F.lit(1)).alias("n_missing"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_restrict(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id", "left_semi")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE (p_name, p_brand) IN (SELECT (p_name, p_brand) FROM part GROUP BY p_name, p_brand HAVING count(*) = 1)")
def drop_all_duplicates(t: Tables) -> DataFrame:
    return R.drop_all_duplicates(t.part.select("p_partkey", "p_name", "p_brand"), ["p_name", "p_brand"])


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_name) AS n_same, count(*) OVER (PARTITION BY p_brand) AS n_brand FROM part")
def group_size_broadcast(t: Tables) -> DataFrame:
    n = lambda c, name: t.part.groupBy(F.col(c).alias(f"of_{c}")).agg(F.count(F.lit(1)).alias(name))
    d = t.part.select("p_partkey", "p_name", "p_brand")
    for c, name in (("p_name", "n_same"), ("p_brand", "n_brand")):
        d = d.join(n(c, name), F.col(c).eqNullSafe(F.col(f"of_{c}")))
    return d.select("p_partkey", "n_same", "n_brand")


@query("""WITH e AS (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.5) AS b, quantile_cont(p_retailprice, 0.75) AS c FROM part)
SELECT p_partkey, CAST(1 + CAST(p_retailprice > a AS INTEGER) + CAST(p_retailprice > b AS INTEGER) + CAST(p_retailprice > c AS INTEGER) AS INTEGER) AS bin FROM part, e""")
def quantile_bins(t: Tables) -> DataFrame:
    return M.quantile_bins(t.part.select("p_partkey", "p_retailprice"), "p_retailprice", 4).select("p_partkey", "bin")


@query("SELECT lang, median(CAST(n_chars AS DOUBLE)) AS middle, quantile_cont(CAST(n_chars AS DOUBLE), 0.9) AS high, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY lang")
def median_by_group(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.median("n_chars").alias("middle"), F.percentile("n_chars", F.lit(0.9)).alias("high"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query("""WITH c AS (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1)
SELECT *, CAST(n AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) AS share, n = max(n) OVER () AS is_mode FROM c""")
def value_distribution(t: Tables) -> DataFrame:
    c = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))
    total = c.agg(F.sum("n").alias("total"), F.max("n").alias("top"))
    return c.crossJoin(F.broadcast(total)).select("event_type", "n", "users", M.ratio(F.col("n"), F.col("total")).alias("share"), (F.col("n") == F.col("top")).alias("is_mode"))


MELTED = "(SELECT doc_id, 'quality' AS item, quality AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels)"


@query(f"SELECT lang, item, count(*) AS n, CAST(sum(value) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mean FROM {MELTED} m JOIN documents USING (doc_id) GROUP BY lang, item")
def melt_items(t: Tables) -> DataFrame:
    long = t.labels.unpivot("doc_id", ["quality", "toxic"], "item", "value").join(t.documents.select("doc_id", "lang"), "doc_id")
    return long.groupBy("lang", "item").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s")).select("lang", "item", "n", M.ratio(F.col("s"), F.col("n")).alias("mean"))


@query(f"""SELECT lang, CAST(sum(value) FILTER (WHERE item = 'quality') AS DOUBLE) / CAST(count(*) FILTER (WHERE item = 'quality') AS DOUBLE) AS quality,
CAST(sum(value) FILTER (WHERE item = 'toxic') AS DOUBLE) / CAST(count(*) FILTER (WHERE item = 'toxic') AS DOUBLE) AS toxic FROM {MELTED} m JOIN documents USING (doc_id) GROUP BY lang""")
def pivot_means(t: Tables) -> DataFrame:
    long = t.labels.unpivot("doc_id", ["quality", "toxic"], "item", "value").join(t.documents.select("doc_id", "lang"), "doc_id")
    return long.groupBy("lang").pivot("item", ["quality", "toxic"]).agg(M.ratio(F.sum("value"), F.count(F.lit(1))))


@query("""SELECT event_type, count(*) AS users, CAST(sum(cents) AS BIGINT) AS cents FROM
(SELECT event_type, user_id, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) // count(*) AS cents FROM events WHERE value IS NOT NULL GROUP BY 1, 2) GROUP BY event_type""")
def two_level_mean(t: Tables) -> DataFrame:
    per = t.events.where("value IS NOT NULL").groupBy("event_type", "user_id").agg(F.sum(F.floor(F.col("value") * 100)).alias("s"), F.count(F.lit(1)).alias("n"))
    per = per.withColumn("cents", F.floor(F.col("s").cast("decimal(38,0)") / F.col("n")))
    return per.groupBy("event_type").agg(F.count(F.lit(1)).alias("users"), F.sum("cents").cast("long").alias("cents"))


@query("SELECT conv_id, count(*) AS turns, count(DISTINCT role) = 1 AS one_role FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def constant_within_group(t: Tables) -> DataFrame:
    g = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), (F.countDistinct("role") == 1).alias("one_role"))
    return g.where("turns > 1")


@query("""WITH g AS (SELECT p_name, count(*) AS n FROM part WHERE contains(lower(p_name), 'a') AND contains(lower(p_name), 'e') GROUP BY p_name)
SELECT p_name, n, CAST(CASE WHEN starts_with(lower(p_name), 'a') THEN 0 WHEN contains(lower(p_name), ' a') THEN 1 ELSE 2 END AS INTEGER) AS class FROM g ORDER BY class, length(p_name), n DESC, p_name LIMIT 15""")
def search_ranked(t: Tables) -> DataFrame:
    name = F.lower("p_name")
    tokens = F.array(F.lit("a"), F.lit("e"))
    g = t.part.where(F.forall(tokens, lambda x: F.contains(name, x))).groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumn("class", F.when(name.startswith("a"), 0).when(F.contains(name, F.lit(" a")), 1).otherwise(2))
    return g.orderBy("class", F.length("p_name"), F.desc("n"), "p_name").limit(15)


NEAR = "abs(date_diff('day', CAST(o_orderdate AS DATE), DATE '1995-06-17'))"


@query(f"""SELECT * FROM (SELECT 'before' AS side, o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-17' ORDER BY {NEAR}, o_orderkey LIMIT 50)
UNION ALL SELECT * FROM (SELECT 'after' AS side, o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-17' ORDER BY {NEAR}, o_orderkey LIMIT 50)""")
def topk_nearest_value(t: Tables) -> DataFrame:
    near = F.abs(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-06-17").cast("date")))
    early = F.col("o_orderdate").cast("timestamp") < F.lit("1995-06-17 00:00:00").cast("timestamp")
    take = lambda c, side: t.orders.where(c).orderBy(near, "o_orderkey").limit(50).select(F.lit(side).alias("side"), "o_orderkey")
    return take(early, "before").union(take(~early, "after"))


@query("""SELECT c_custkey, n, least(n - 1, 12) AS shown FROM (SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer)""")
def nearby_counts(t: Tables) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy("c_nationkey", "c_mktsegment"))
    return t.customer.select("c_custkey", n.alias("n")).withColumn("shown", F.least(F.col("n") - 1, F.lit(12).cast("long")))


@query("""WITH r AS (SELECT c_custkey, c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_name, c_custkey) AS k FROM customer)
SELECT a.c_custkey, b.c_custkey AS other, CAST(b.k - CASE WHEN b.k > a.k THEN 1 ELSE 0 END AS INTEGER) AS place FROM r a JOIN r b USING (c_nationkey, c_mktsegment)
WHERE a.c_custkey <> b.c_custkey AND b.k <= 13 AND b.k - CASE WHEN b.k > a.k THEN 1 ELSE 0 END <= 12""")
def nearby_topk(t: Tables) -> DataFrame:
    w = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_name", "c_custkey")
    r = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment", F.row_number().over(w).alias("k"))
    first = r.where("k <= 13").select("c_nationkey", "c_mktsegment", F.col("c_custkey").alias("other"), F.col("k").alias("j"))
    place = F.col("j") - (F.col("j") > F.col("k")).cast("int")
    both = r.join(first, ["c_nationkey", "c_mktsegment"]).where(F.col("c_custkey") != F.col("other"))
    return both.select("c_custkey", "other", place.cast("int").alias("place")).where("place <= 12")


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 450 AS chunk FROM orders")
def chunk_index(t: Tables) -> DataFrame:
    return W.numbered(t.orders.select("o_orderkey"), "o_orderkey").select("o_orderkey", F.floor(F.col("index") / 450).cast("long").alias("chunk"))


@query("""WITH r AS (SELECT c_custkey, c_mktsegment, c_nationkey, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY md5(CAST(c_custkey AS VARCHAR))) AS k FROM customer),
c AS (SELECT *, count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) // 2 AS room FROM r)
SELECT c_custkey, k FROM c WHERE k <= room ORDER BY k, c_mktsegment, c_nationkey LIMIT 200""")
def round_robin_alloc(t: Tables) -> DataFrame:
    cell = Window.partitionBy("c_mktsegment", "c_nationkey")
    c = t.customer.withColumns({"k": F.row_number().over(cell.orderBy(F.md5(F.col("c_custkey").cast("string")))).cast("long"), "room": F.floor(F.count(F.lit(1)).over(cell) / 2)})
    return c.where("k <= room").orderBy("k", "c_mktsegment", "c_nationkey").limit(200).select("c_custkey", "k")


@query("""SELECT coalesce(a.n_nationkey, b.n_nationkey) AS nation, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM
(SELECT c_nationkey AS n_nationkey, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS n FROM supplier GROUP BY 1) b ON a.n_nationkey = b.n_nationkey""")
def key_union_counts(t: Tables) -> DataFrame:
    a = t.customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "nation", "full").na.fill(0, ["customers", "suppliers"])


@query("""SELECT user_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) INTERSECT SELECT user_id FROM events WHERE event_type = (SELECT max(event_type) FROM events)""")
def both_conditions(t: Tables) -> DataFrame:
    ends = t.events.agg(F.min("event_type").alias("low"), F.max("event_type").alias("high"))
    e = t.events.crossJoin(F.broadcast(ends))
    return e.where("event_type = low").select("user_id").intersect(e.where("event_type = high").select("user_id"))


@query("""SELECT p_partkey, CASE WHEN p_retailprice < 1000 THEN 'A' WHEN p_retailprice < 1200 THEN 'B' WHEN p_retailprice < 1500 THEN 'C' ELSE 'D' END AS band FROM part""")
def bands(t: Tables) -> DataFrame:
    p = F.col("p_retailprice")
    return t.part.select("p_partkey", F.when(p < 1000, "A").when(p < 1200, "B").when(p < 1500, "C").otherwise("D").alias("band"))


@query("""WITH b AS (SELECT greatest(max(ts), min(ts)) AS t FROM events), k AS (SELECT CAST(user_id AS BIGINT) AS user_id, min(event_id) AS lo, max(event_id) AS hi, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, lo, hi, n FROM k""")
def group_ranges(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"), F.count(F.lit(1)).alias("n"))
