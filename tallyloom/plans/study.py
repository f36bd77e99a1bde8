"""Queries of the page texts and of the exposure study over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import judge as J
from tallyloom.functions import pages as P
from tallyloom.operators import exposure as X

from .civic import pick, sql_pick
from .registry import Tables, query

CUTOFF = "2024-01-25"


@query(f"""WITH d AS (SELECT event_id, datediff('day', DATE '{CUTOFF}', CAST(ts AS DATE)) AS days, value AS views FROM events), u AS (SELECT * FROM d WHERE days > 0),
x AS (SELECT *, row_number() OVER (ORDER BY days DESC, event_id) AS r FROM d WHERE days <= 0),
p AS (SELECT event_id, days, 'exposed' AS "group" FROM x WHERE r <= (SELECT count(*) FROM u) UNION ALL SELECT event_id, days, 'unexposed' FROM u),
f AS (SELECT *, row_number() OVER (ORDER BY views DESC, event_id) AS r FROM d WHERE views IS NOT NULL AND event_id NOT IN (SELECT event_id FROM p))
SELECT event_id, CAST(days AS INTEGER) AS days, "group" FROM p UNION ALL SELECT event_id, CAST(days AS INTEGER), 'famous' FROM f WHERE r <= 15""")
def exposure_pool(t: Tables) -> DataFrame:
    return X.exposure_pool(t.events.select("event_id", F.to_date("ts").alias("day"), "value"), key="event_id", created="day", views="value", cutoff=CUTOFF)


@query("""WITH d AS (SELECT event_type AS g, CAST(1900 + user_id % 100 AS DOUBLE) AS t, CAST(abs(event_id % CASE WHEN event_type = 'signup' THEN 5 ELSE 61 END) AS DOUBLE) AS e FROM events),
m AS (SELECT median(t) AS guess FROM d WHERE g IN ('click', 'view'))
SELECT g AS "group", count(*) AS n, median(e) AS error, median(abs(guess - t)) AS guess_error, count_if(e <= 2) / CAST(count(*) AS DOUBLE) AS within_2, CASE WHEN g = 'signup' THEN median(e) <= median(abs(guess - t)) / 2 END AS ok FROM d, m GROUP BY g""")
def control_gate(t: Tables) -> DataFrame:
    truth = F.lit(1900) + F.col("user_id") % 100
    off = F.when(F.col("event_type") == "signup", F.col("event_id") % 5).otherwise(F.col("event_id") % 61)
    d = t.events.select("event_type", truth.alias("year"), (truth - off).alias("said"))
    return X.control_gate(d, group="event_type", truth="year", given="said", reference=["click", "view"], control="signup")


@query("""SELECT event_type, user_id, avg(CASE WHEN event_id % 2 = 0 THEN ok END) AS masked, avg(CASE WHEN event_id % 2 = 1 THEN ok END) AS "real", avg(CASE WHEN event_id % 2 = 1 THEN ok END) - avg(CASE WHEN event_id % 2 = 0 THEN ok END) AS gain
FROM (SELECT *, CAST(event_id % 3 = 0 AS INTEGER) AS ok FROM events) GROUP BY 1, 2""")
def identity_gains(t: Tables) -> DataFrame:
    d = t.events.select("event_type", "user_id", pick(F.col("event_id"), ["masked", "real"]).alias("tag"), (F.col("event_id") % 3 == 0).cast("int").alias("ok"))
    return X.gains(d, by=["event_type", "user_id"], condition="tag", value="ok", low="masked", high="real")


@query("""WITH n AS (SELECT x AS letter, (SELECT CAST(sum(length(text) - length(replace(text, x, ''))) AS BIGINT) FROM conversations) AS n FROM unnest(['A', 'B', 'C', 'D']) AS u(x))
SELECT letter, n, CAST(n AS DOUBLE) / (SELECT sum(n) FROM n) AS share FROM n""")
def letter_shares(t: Tables) -> DataFrame:
    return X.letter_shares(t.conversations, "text")


@query("""WITH c AS (SELECT n_regionkey, n_name, count(c_custkey) AS n, count_if(c_acctbal > 5000) AS w FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT n_regionkey, '{' || string_agg('"' || n_name || '":[' || n || ',' || w || ']', ',' ORDER BY n_name) || '}' AS json FROM c GROUP BY 1""")
def compact_maps(t: Tables) -> DataFrame:
    d = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_name").agg(F.count("c_custkey").alias("n"), F.count_if(F.col("c_acctbal") > 5000).alias("w"))
    return X.compact_map(d, by="n_regionkey", name="n_name", values=["n", "w"])


@query("""WITH s AS (SELECT c_nationkey, count_if(c_acctbal > 8000) / CAST(count(*) AS DOUBLE) AS share FROM customer GROUP BY 1)
SELECT c_nationkey, share, CASE WHEN share < 0.03 THEN '165,0,38' WHEN share < 0.06 THEN '215,48,39' WHEN share < 0.1 THEN '252,141,89' WHEN share < 0.16 THEN '254,224,139' WHEN share < 0.25 THEN '166,217,106' WHEN share < 0.4 THEN '102,189,99' ELSE '26,152,80' END AS rgb FROM s""")
def coverage_colours(t: Tables) -> DataFrame:
    d = t.customer.groupBy("c_nationkey").agg((F.count_if(F.col("c_acctbal") > 8000) / F.count(F.lit(1))).alias("share"))
    return d.withColumn("rgb", F.array_join(P.ramp(F.col("share")).cast("array<string>"), ","))


LEVELS, GRADES = ["high", "other", "elementary", "middle"], ["9", "", "K", None]


@query(f"""WITH d AS (SELECT p_partkey, p_name, {sql_pick('p_partkey', LEVELS)} AS lv, {sql_pick('p_size', GRADES)} AS lo, {sql_pick('p_partkey', ['12', '9', 'K'])} AS hi, p_size % 2 = 0 AS pv, p_partkey % 3 = 0 AS ch, CASE WHEN p_partkey % 5 > 0 THEN p_partkey * 7 END AS e FROM part),
g AS (SELECT *, CASE WHEN lo <> '' AND lo = hi THEN 'serves grade ' || lo WHEN lo <> '' THEN 'serves grades ' || lo || ' through ' || hi END AS gr, 'enrolls ' || format('{{:,}}', e) || ' students (2024)' AS en FROM d)
SELECT p_partkey, CASE lv WHEN 'high' THEN 'HighSchool' WHEN 'middle' THEN 'MiddleSchool' WHEN 'elementary' THEN 'ElementarySchool' ELSE 'School' END AS schema_type,
p_name || ' is a ' || CASE WHEN pv THEN 'private' WHEN ch THEN 'public charter' ELSE 'public' END || ' ' || CASE lv WHEN 'other' THEN '' ELSE lv || ' ' END || 'school in Troy, Ohio.' || CASE WHEN gr IS NOT NULL OR en IS NOT NULL THEN ' It ' || concat_ws(' and ', gr, en) || '.' ELSE '' END AS paragraph FROM g""")
def page_paragraphs(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    level = pick(k, LEVELS)
    d = {"name": F.col("p_name"), "sector": P.sector_label(size % 2 == 0, F.when(k % 3 == 0, "Yes")), "level": level, "city": F.lit("Troy"), "state": F.lit("Ohio"), "district": F.lit(None).cast("string"), "grades": P.grade_range(pick(size, GRADES), pick(k, ["12", "9", "K"])), "enrollment": F.when(k % 5 > 0, k * 7)}
    return t.part.select("p_partkey", P.schema_type(level).alias("schema_type"), P.describe(d, F.lit("2024")).alias("paragraph"))


URL_SQL = "regexp_matches(trim({c}), '(?i)^(https?://)?([0-9A-Za-z_-]+\\.)+[a-z]{{2,}}(/\\S*)?$')"
SOURCE_SQL = "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN ' ' || regexp_replace(url, '^[a-z]+://', '') || ' ' WHEN 2 THEN replace(url, '.', ' ') ELSE 'http://x' || page_id END"
MARKED = "'*See* [the ' || page_id || '](' || url || ') and Your website''s **' || page_id || '** '"


@query(rf"""WITH d AS (SELECT page_id, url, {SOURCE_SQL} AS a, CASE WHEN page_id % 3 = 0 THEN [url, 'none'] WHEN page_id % 3 = 1 THEN [url] ELSE [] END AS flags FROM pages)
SELECT page_id, {URL_SQL.format(c='a')} AS url, 'See the ' || page_id || ' and the school website''s ' || page_id AS plain, regexp_matches(replace(url, '://', '@'), '\S+@\S+\.\S+') AS mail,
(NOT (len(flags) = 0 AND page_id % 5 = 0)) AND (page_id % 5 = 0 OR {URL_SQL.format(c='a')}) AND len(list_filter(flags, lambda f: NOT {URL_SQL.format(c='f')})) = 0 AS submits,
concat_ws('; ', CASE WHEN page_id % 2 <> length(url) % 2 THEN 'charter: ' || page_id % 2 || ' vs ' || length(url) % 2 END, CASE WHEN page_id % 3 = 0 THEN 'status: None vs Active' END) AS differences FROM d""")
def page_checks(t: Tables) -> DataFrame:
    """Addresses of pages, whole, without their scheme, and broken; the SQL states the rules."""
    k, u = F.col("page_id"), F.col("url")
    a = F.when(k % 4 == 0, u).when(k % 4 == 1, F.concat(F.lit(" "), F.regexp_replace(u, "^[a-z]+://", ""), F.lit(" "))).when(k % 4 == 2, F.replace(u, F.lit("."), F.lit(" "))).otherwise(F.concat(F.lit("http://x"), k))
    flags = F.when(k % 3 == 0, F.array(u, F.lit("none"))).when(k % 3 == 1, F.array(u)).otherwise(F.array().cast("array<string>"))
    sources = F.array(F.when(k % 5 == 0, F.lit(None).cast("string")).otherwise(a))
    text = F.concat(F.lit("*See* [the "), k, F.lit("]("), u, F.lit(") and Your website's **"), k, F.lit("** "))
    checks = P.differences([("charter", k % 2, F.length(u) % 2), ("status", F.when(k % 3 > 0, "Active"), F.lit("Active"))])
    return t.pages.select("page_id", P.is_url(a).alias("url"), P.plain(text).alias("plain"), P.is_mail(F.replace(u, F.lit("://"), F.lit("@"))).alias("mail"), P.can_submit(sources, flags).alias("submits"), F.array_join(checks, "; ").alias("differences"))


SAID = r"CASE WHEN turn % 3 = 0 THEN coalesce(text, '') || ' It was founded in ' || (1800 + conv_id % 230) || ' and won ' || turn || ' titles.' WHEN turn % 5 = 1 THEN 'UNKNOWN' ELSE text END"
COUNTED = r"len(regexp_extract_all(lower(answer), '\b(1[89][0-9][0-9]|20[0-2][0-9]|program|titles?)\b'))"


@query(rf"""WITH s AS (SELECT conv_id, turn, role, {SAID} AS said FROM conversations), r AS (SELECT *, coalesce(regexp_replace(said, '^[\s*]+|[\s*]+$', '', 'g'), '') AS answer FROM s),
t AS (SELECT *, {COUNTED} AS n FROM r WHERE NOT (conv_id % 4 = 0 AND turn % 2 = 0))
SELECT conv_id, turn, md5('School: ' || role || ', Troy, Ohio' || chr(10) || 'Sector: ' || CASE WHEN turn % 2 = 0 THEN 'public' ELSE 'private' END || chr(10) || 'Level: high' || chr(10) || 'Enrollment: ' || conv_id || chr(10)
  || CASE WHEN turn % 2 = 0 THEN 'District: ' || turn || chr(10) || 'Charter: ' || CASE WHEN conv_id % 2 = 0 THEN 'yes' ELSE 'no' END ELSE 'Religious affiliation: none' END) AS facts,
  substr(md5(answer), 1, 12) AS answer_hash, CASE WHEN conv_id % 7 > 1 THEN CAST(CASE WHEN answer = '' OR lower(answer) LIKE '%unknown%' THEN 0 WHEN n > 0 THEN 2 ELSE 1 END AS INTEGER) END AS halluc,
  CASE WHEN conv_id % 7 > 1 THEN CAST(n AS INTEGER) END AS unverifiable_specific, CASE WHEN conv_id % 7 > 1 THEN CAST(lower(answer) LIKE '%well-regarded%' OR lower(answer) LIKE '%won%' AS INTEGER) END AS sentiment,
  CASE conv_id % 7 WHEN 0 THEN 'no object' WHEN 1 THEN 'not JSON' END AS judge_error FROM t""")
def judged_answers(t: Tables) -> DataFrame:
    """Answers that no judgement covers yet, judged by the mock: replies with text around the object, and some without a good one."""
    k, turn = F.col("conv_id"), F.col("turn")
    founded = F.concat(F.coalesce("text", F.lit("")), F.lit(" It was founded in "), 1800 + k % 230, F.lit(" and won "), turn, F.lit(" titles."))
    said = F.when(turn % 3 == 0, founded).when(turn % 5 == 1, "UNKNOWN").otherwise(F.col("text"))
    r = t.conversations.select("conv_id", "turn", "role", F.concat(F.lit("A1: PUBLIC\n**D1:** "), said).alias("text"))
    first = J.pending(r, None, ["conv_id", "turn"])
    stale = F.when(k % 4 == 1, F.lit("0" * 12)).otherwise(F.col("answer_hash"))
    judged = first.where((k % 4 < 2) & (turn % 2 == 0)).unionByName(first.where(k % 4 == 2)).select("conv_id", "turn", stale.alias("answer_hash"), F.when(k % 4 < 2, 1).alias("halluc"))
    todo = J.pending(r, judged, ["conv_id", "turn"])
    known = J.facts({"name": F.col("role"), "city": F.lit("Troy"), "state": F.lit("Ohio"), "sector": F.when(turn % 2 == 0, "public").otherwise("private"), "level": F.lit("high"), "enrollment": k, "district": turn, "charter": k % 2 == 0, "religion": F.lit("none")})
    mock = J.mock_reply(F.col("answer"))
    reply = F.when(k % 7 == 0, "I can't say.").when(k % 7 == 1, F.concat(mock, F.lit(" or {"), mock, F.lit("}"))).otherwise(F.concat(F.lit("Here it is:\n"), mock, F.lit("\nDone.")))
    out = J.with_marks(todo.select("conv_id", "turn", F.md5(known.cast("binary")).alias("facts"), "answer_hash", reply.alias("reply")), "reply")
    return out.select("conv_id", "turn", "facts", "answer_hash", "halluc", "unverifiable_specific", "sentiment", "judge_error")
