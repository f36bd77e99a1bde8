"""Queries of article texts, fact sheets, prompts, cards, plans of calls and joins for pages, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import articles as A
from tallyloom.functions import prompts as P
from tallyloom.functions import schools as H
from tallyloom.functions import text as X
from tallyloom.operators import card as C
from tallyloom.operators import matching as M

from .civic import match_sides, pick, sql_pick
from .registry import Tables, query


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# -- articles: parts are schools

LOWS, HIGHS = ["PK", "09", "06", "KG", ""], ["05", "12", "08", "12", "12"]
SPANS = ["PK–5", "9–12", "6–8", "K–12", None]
WORDS = ["elementary ", "high ", "middle ", "", ""]
DISTRICTS = ["", "Troy", "TROY ISD in the county of Cook", "School"]
PARTS_OF = [None, "the Troy school district", "the Troy ISD", None]


@query(f"""WITH d AS (SELECT p_partkey AS k, p_size AS s, CASE WHEN p_partkey % 2 = 0 THEN array_to_string(list_transform(string_split(upper(p_name), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' HS' ELSE p_name || ' School' END AS name,
  CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand END AS city, {sql_pick('p_partkey', SPANS)} AS span, {sql_pick('p_partkey', WORDS)} AS word, {sql_pick('p_partkey', PARTS_OF)} AS part FROM part)
SELECT k AS p_partkey, concat_ws(' ', name || ' is a public ' || CASE WHEN k % 3 = 0 THEN 'charter ' ELSE '' END || CASE WHEN k % 7 = 0 THEN 'vocational ' ELSE '' END || word || 'school in ' || CASE WHEN city <> '' THEN city || ', ' ELSE '' END || 'Ohio' || coalesce(', serving grades ' || span, '') || '.',
  'It is part of ' || part || '.', CASE WHEN k % 2 = 1 THEN 'It is located in a remote town.' END, CASE WHEN k % 6 = 0 THEN 'It opened in the 2024-25 school year.' END,
  'As of the 2024-25 school year, it enrolled ' || format('{{:,}}', CAST(s * 37 AS BIGINT)) || ' students' || CASE WHEN s % 3 <> 0 THEN ' and employed about ' || s || ' teachers, a student–teacher ratio of roughly 37.0:1' ELSE '' END || '.',
  CASE WHEN k % 2 = 0 THEN 'About 3% of students were eligible for free or reduced-price lunch.' END,
  CASE WHEN k % 2 = 0 AND city <> '' THEN 'Its street address is 12 Main St, ' || city || ', OH 4' || k || CASE WHEN k % 4 = 0 THEN ', and its phone number is (1)2.' ELSE '.' END END) AS article FROM d""")
def public_articles(t: Tables) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    even = lambda c: F.when(k % 2 == 0, c)
    r = {
        "sector": F.lit("public"), "school_name": F.when(k % 2 == 0, F.concat(F.upper("p_name"), F.lit(" HS"))).otherwise(F.concat("p_name", F.lit(" School"))), "city": F.when(s % 4 != 0, F.col("p_brand")), "state": F.lit("OH"),
        "low_grade": pick(k, LOWS), "high_grade": pick(k, HIGHS), "Charter": F.when(k % 3 == 0, "Yes"), "type": F.when(k % 7 == 0, "Vocational").otherwise("Regular"), "District": pick(k, DISTRICTS), "Locale": F.when(k % 2 == 1, "Town, Remote"),
        "Status": F.when(k % 6 == 0, "New").otherwise("Open"), "total_students": (s * 37).cast("string"), "teachers": F.when(s % 3 != 0, s.cast("string")), "student_teacher_ratio": F.lit("0"), "Free Lunch": even(s.cast("string")),
        "address": even(F.lit("12 MAIN ST")), "zip": F.concat(F.lit("4"), k), "phone": F.when(k % 4 == 0, "(1)2"),
    }
    return t.part.select("p_partkey", A.article(r).alias("article"))


SHARES = ["PSS_WHITE_PCT", "PSS_BLACK_PCT", "PSS_HISP_PCT"]


@query("""WITH d AS (SELECT s_suppkey AS k, s_name, CAST(floor(s_acctbal) AS BIGINT) % 100 / 2.0 AS a, CAST(s_suppkey % 30 AS DOUBLE) AS b FROM supplier), r AS (SELECT *, list_sort(list_filter([{'p': -a, 'i': 0, 'n': 'White'}, {'p': -b, 'i': 1, 'n': 'Black'}, {'p': -b, 'i': 2, 'n': 'Hispanic'}], lambda x: x.p < 0)) AS l FROM d),
t AS (SELECT *, list_transform(l, lambda x: regexp_replace(printf('%.1f', -x.p), '\\.0$', '') || '% ' || x.n) AS w FROM r)
SELECT k AS s_suppkey, concat_ws(' ', s_name || ' is a ' || CASE k % 3 WHEN 1 THEN 'coeducational Catholic ' WHEN 2 THEN 'all-boys religiously affiliated ' ELSE '' END || 'private ' || CASE WHEN k % 2 = 1 THEN 'elementary ' ELSE 'secondary ' END || 'school in Cook County, Ohio, serving grades PK–' || CASE WHEN k % 2 = 1 THEN '5' ELSE '12' END || '.',
  CASE WHEN len(w) = 1 THEN 'Its student body was ' || w[1] || '.' WHEN len(w) > 1 THEN 'Its student body was ' || array_to_string(w[1:len(w) - 1], ', ') || ', and ' || w[len(w)] || '.' END,
  CASE k % 4 WHEN 0 THEN 'The school has a library and is in session about ' || (170 + k % 20) || ' days a year, 6.5 hours a day.' WHEN 1 THEN 'The school does not have a library and is in session about ' || (170 + k % 20) || ' days a year.' ELSE 'The school is in session about ' || (170 + k % 20) || ' days a year.' END,
  CASE k % 3 WHEN 0 THEN 'It reports affiliation with NCEA.' WHEN 1 THEN 'It reports affiliation with AMS, and NCEA.' END) AS article FROM t""")
def private_articles(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    a = (F.floor("s_acctbal") % 100 / 2.0).cast("string")
    r = {
        "sector": F.lit("private"), "school_name": F.col("s_name"), "county": F.lit("COOK"), "state": F.lit("OH"), "PSS_COED": (k % 3).cast("string"), "PSS_RELIG": (k % 3).cast("string"), "PSS_LEVEL": F.when(k % 2 == 1, "1").otherwise("2"),
        "PSS_ENROLL_PK": F.lit("3"), "PSS_ENROLL_5": F.lit("8"), "PSS_ENROLL_12": F.when(k % 2 == 0, "9").otherwise("0"), "PSS_WHITE_PCT": a, "PSS_BLACK_PCT": (k % 30).cast("string"), "PSS_HISP_PCT": (k % 30).cast("string"),
        "PSS_LIBRARY": pick(k, ["Yes", "No", "", None]), "PSS_SCH_DAYS": (k % 20 + 170).cast("string"), "PSS_STU_DAY_HRS": F.when(k % 4 == 0, "6.5"), "PSS_ASSOC_2": F.when(k % 3 != 2, "NCEA"), "PSS_ASSOC_7": F.when(k % 3 == 1, "AMS"), "PSS_ASSOC_9": F.when(k % 3 == 0, "NCEA"),
    }
    return t.supplier.select("s_suppkey", A.article(r).alias("article"))


@query("""SELECT p_partkey, regexp_replace(array_to_string(list_transform(string_split(upper(p_name), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || CASE p_partkey % 4 WHEN 0 THEN ' High School' WHEN 1 THEN ' Elementary School' WHEN 2 THEN ' Junior High School' ELSE ' Academy' END, ' +', ' ', 'g') AS name FROM part""")
def display_names(t: Tables) -> DataFrame:
    """Names in capitals with abbreviations after them."""
    end = pick(F.col("p_partkey"), [" H S", " ELEM.", " JR. HIGH", "  ACAD"])
    return t.part.select("p_partkey", A.display_name(F.concat(F.upper("p_name"), end)).alias("name"))


# -- fact sheets: suppliers are schools, what research says comes from their balance

FACT_SQL = """WITH d AS (SELECT s_suppkey AS k, s_name, s_acctbal > 5000 AS rich, CASE WHEN s_suppkey % 3 = 0 THEN '*Not found* in public sources' WHEN s_suppkey % 3 = 1 THEN '19' || (10 + s_suppkey % 80) ELSE 'Not found; state directory silent' END AS year FROM supplier)"""


@query(FACT_SQL + """ SELECT k AS s_suppkey, CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN year || ' (state directory open date: March ' || (1 + k % 28) || ', 1990)' ELSE year END AS opened, CASE WHEN rich THEN 'Told ' || s_name ELSE s_name END AS name,
CASE WHEN rich THEN '[paper](https://p.org/' || k || '); letter' ELSE '[records](https://r.org/' || k || ')' END AS name_source, CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN '[directory](https://d.org)' ELSE '—' END AS year_source,
CAST(CASE WHEN k % 3 <> 1 THEN 8 ELSE 7 END AS INTEGER) AS n_missing, 'Teachers' AS first_missing, 'See the school website page' AS site FROM d""")
def fact_sheets(t: Tables) -> DataFrame:
    """Fifteen rows each, written as a table, read back, and split into what is known and what isn't."""
    k, rich = F.col("s_suppkey"), F.col("s_acctbal") > 5000
    year = F.when(k % 3 == 0, "*Not found* in public sources").when(k % 3 == 1, F.concat(F.lit("19"), k % 80 + 10)).otherwise("Not found; state directory silent")
    told = {0: F.when(rich, F.concat(F.lit("Told "), "s_name")), 7: F.lit("See [your website](https://x.org/y) *page*"), 8: year}
    sources = F.array(A.link("paper", F.concat(F.lit("https://p.org/"), k)), A.link("letter", F.lit(None).cast("string")))
    none = F.array().cast(A.SOURCES)
    facts = F.array(*[F.struct(F.lit(f).alias("fact"), (told[i] if i in told else F.lit(None if i < 7 else "None found")).cast("string").alias("value"), (F.when(rich, sources).otherwise(none) if i == 0 else none).alias("sources")) for i, f in enumerate(A.FACTS)])
    listed = k % 2 == 0
    r = {"school_name": F.col("s_name"), "low_grade": F.lit("09"), "high_grade": F.lit("12"), "District": F.lit("Troy"), "address": F.lit("1 A ST"), "city": F.lit("TROY"), "state": F.lit("OH"), "zip": F.lit("4"), "total_students": F.lit("1200"), "teachers": F.lit("")}
    directory = F.when(listed, A.link("directory", F.lit("https://d.org")))
    record = A.record_rows(r, A.link("records", F.concat(F.lit("https://r.org/"), k)), directory, F.when(listed, "N"))
    rows = A.sheet_rows(facts, record, F.when(listed, F.concat(F.lit("1990-03-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))), directory)
    d = t.supplier.select("s_suppkey", rows.alias("rows"))
    d = d.withColumns({"back": A.read_table(A.sheet_table(F.col("rows"))), "facts": A.page_facts(F.col("rows"))[0], "missing": A.page_facts(F.col("rows"))[1]})
    at = lambda i: F.get("back", i)
    site = F.get(F.filter("facts", lambda f: f["f"] == "Official website"), 0)["v"]
    return d.select("s_suppkey", at(8)["value"].alias("opened"), at(0)["value"].alias("name"), at(0)["source"].alias("name_source"), at(8)["source"].alias("year_source"), F.size("missing").alias("n_missing"), F.get("missing", 0).alias("first_missing"), site.alias("site"))


@query("""SELECT doc_id, 'see ' || source AS before, 'https://x.org/' || doc_id AS url, lang AS slanted, CAST(5 AS INTEGER) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""")
def cell_segments(t: Tables) -> DataFrame:
    cell = F.concat(F.lit("see "), "source", F.lit("[the *page]*](https://x.org/"), F.col("doc_id").cast("string"), F.lit(")"), F.lit("*"), "lang", F.lit("* and "), F.lit("*x*"))
    d = t.documents.where("source is not null and lang is not null").select("doc_id", A.segments(F.replace(cell, F.lit("*page]*"), F.lit("page"))).alias("s"))
    return d.select("doc_id", F.get("s", 0)["text"].alias("before"), F.get("s", 1)["url"].alias("url"), F.get("s", 2)["text"].alias("slanted"), F.size("s").alias("n"))


# -- prompts

FACTS_SQL, BIAS_SQL = (quoted(x).replace("{school}", "' || s || '").replace("{context}", quoted(P.ARMS["frl85"]).join(["' || ", " || '"])) for x in (P.FACTS, P.BIAS))
MASKED_SQL = quoted(P.FORCED.replace(P.FORCED_HEAD, P.MASKED_HEAD)).replace("{mask}", "' || m || '").replace("{state}", "Ohio")


@query(f"""WITH d AS (SELECT p_partkey, p_name || ' High School (in ' || CASE WHEN p_size % 2 = 0 THEN p_brand || ', ' ELSE '' END || 'Ohio)' AS s, '[X] High School' AS m FROM part)
SELECT p_partkey, md5({FACTS_SQL}) AS facts, md5({BIAS_SQL}) AS bias, md5({MASKED_SQL}) AS masked FROM d""")
def prompt_forms(t: Tables) -> DataFrame:
    name = F.concat("p_name", F.lit(" High School"))
    s = P.school(name, F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.lit("Ohio"))
    of = lambda c: F.md5(c.cast("binary"))
    return t.part.select("p_partkey", of(P.facts_prompt(s)).alias("facts"), of(P.bias_prompt(s, "frl85")).alias("bias"), of(P.masked_prompt(name, F.lit("Ohio"))).alias("masked"))


RUNS = "list_transform(range(1, greatest(len({w}) - {n} + 2, 1)), lambda i: array_to_string({w}[i:i + {n} - 1], ' '))"
RECALL = "CASE WHEN len(t) >= {n} THEN len(list_filter(" + RUNS.replace("{w}", "t") + ", lambda x: list_contains(" + RUNS.replace("{w}", "g") + ", x))) / CAST(len(t) - {n} + 1 AS DOUBLE) END"


@query(rf"""WITH d AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '\S+') AS w FROM documents), s AS (SELECT doc_id, CASE WHEN len(w) >= 45 THEN array_to_string(w[21:45], ' ') END AS target FROM d),
p AS (SELECT b.item_id, d.doc_id, d.target, b.text AS said FROM benchmark b JOIN s d ON d.doc_id = b.item_id), k AS (SELECT *, regexp_extract_all(lower(target), '[a-z0-9'']+') AS t FROM p), j AS (SELECT *, regexp_extract_all(lower(said), '[a-z0-9'']+')[1:len(t) + 10] AS g FROM k)
SELECT item_id, {RECALL.format(n=4)} AS recall4, {RECALL.format(n=2)} AS recall2 FROM j WHERE target IS NOT NULL""")
def continuation_scores(t: Tables) -> DataFrame:
    """Each benchmark item as the continuation of the document of its number."""
    d = t.documents.select("doc_id", P.split_text(F.col("text"))[1].alias("target")).where("target is not null")
    d = t.benchmark.join(d, F.col("item_id") == F.col("doc_id"))
    four, two = X.continuation(*X.continued(F.col("text"), F.col("target")))
    return d.select("item_id", four.alias("recall4"), two.alias("recall2"))


# -- card, plans of calls, joins for pages

METHODS = ("id", "name_state", "geo")
CARD_ROWS = f"""SELECT d.doc_id AS id, {sql_pick('d.doc_id', ['OH', 'TX', 'NY'])} AS state, CASE WHEN d.doc_id % 5 = 0 THEN 'private' ELSE 'public' END AS sector, text, CAST(quality = 1 AS INTEGER) AS k, source AS title, CASE WHEN quality = 1 THEN {sql_pick('d.doc_id', [*METHODS])} END AS method,
CASE WHEN quality = 0 THEN CASE WHEN d.doc_id % 2 = 0 THEN 'closed_school' ELSE 'no_text' END ELSE '' END AS reason FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id"""


@query(f"""WITH r AS ({CARD_ROWS}), s AS (SELECT state, sum(coalesce(k, 0)) / count(*) AS share FROM r GROUP BY 1 HAVING count(*) >= 100), o AS (SELECT *, row_number() OVER (ORDER BY share, state) AS i, count(*) OVER () AS n FROM s),
u AS (SELECT min(CAST(CAST(ts AS DATE) AS VARCHAR)) AS a, max(CAST(CAST(ts AS DATE) AS VARCHAR)) AS b FROM events WHERE 'src' || (user_id % 20) IN (SELECT title FROM r WHERE k = 1))
SELECT format('{{:,}}', count(*)) AS rows, format('{{:,}}', count_if(k = 1)) AS articles, printf('%.1f', 100.0 * count_if(k = 1) / count(*)) AS articles_percent, format('{{:,}}', count(*) - count_if(k = 1)) AS records, printf('%.1f', 100.0 * count(method) / count(*)) AS matched_percent,
format('{{:,}}', count_if(sector = 'public')) AS public, format('{{:,}}', count_if(sector = 'private')) AS private, CAST(count(DISTINCT state) AS VARCHAR) AS states, printf('%.1f', sum(length(text)) / 1e6) AS text_m, format('{{:,}}', count_if(reason = 'closed_school')) AS closed, format('{{:,}}', count_if(reason = 'no_text')) AS without,
{', '.join(f"format('{{:,}}', count_if(method = '{m}')) AS m_{m}" for m in METHODS)},
(SELECT string_agg(printf('%.1f', 100 * share) || '% (' || CASE state WHEN 'OH' THEN 'Ohio' WHEN 'TX' THEN 'Texas' ELSE 'New York' END || ')', CASE WHEN i = 3 THEN ' and ' ELSE ', ' END ORDER BY i) FROM o) AS coverage, (SELECT a || ' to ' || b FROM u) AS fetched FROM r""".replace("string_agg(printf('%.1f', 100 * share) || '% (' || CASE state WHEN 'OH' THEN 'Ohio' WHEN 'TX' THEN 'Texas' ELSE 'New York' END || ')', CASE WHEN i = 3 THEN ' and ' ELSE ', ' END ORDER BY i)", "regexp_replace(string_agg(printf('%.1f', 100 * share) || '% (' || CASE state WHEN 'OH' THEN 'Ohio' WHEN 'TX' THEN 'Texas' ELSE 'New York' END || ')', ', ' ORDER BY i), ', ([^,]*)$', ' and \\1')"))
def card_numbers(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    labels = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    good = F.col("quality") == 1
    d = t.documents.join(labels, "doc_id", "left").select(
        k.alias("id"), pick(k, ["OH", "TX", "NY"]).alias("state"), F.when(k % 5 == 0, "private").otherwise("public").alias("sector"), "text", good.cast("int").alias("from_article"), F.col("source").alias("title"), F.when(good, pick(k, [*METHODS])).alias("method"),
        F.when(F.col("quality") == 0, F.when(k % 2 == 0, "closed_school").otherwise("no_text")).otherwise("").alias("reason"),
    )
    texts = t.events.select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("title"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("fetched_at"))
    return C.card_values(d, texts, METHODS).drop("coverage_high", "median_articles", "median_records").withColumnRenamed("coverage_low", "coverage")


@query("""WITH m AS (SELECT unnest(['a', 'b']) AS model), k AS (SELECT unnest(['facts', 'bias']) AS task), r AS (SELECT unnest([0, 1]) AS rep), e AS (SELECT DISTINCT user_id FROM events), j AS (SELECT user_id, model, task, rep FROM e, m, k, r),
d AS (SELECT DISTINCT user_id, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS model, CASE WHEN event_type = 'click' THEN 'bias' ELSE 'facts' END AS task, CAST(event_id % 3 AS INTEGER) AS rep FROM events WHERE event_type <> 'error')
SELECT model, task, count(*) AS calls, count(*) * 350 AS tokens_in, count(*) * 250 AS tokens_out FROM j ANTI JOIN d USING (user_id, model, task, rep) GROUP BY 1, 2""")
def call_plan(t: Tables) -> DataFrame:
    """Calls that events don't show as done, by model and task; errors count as not done, and an old row without a task was of facts."""
    e = F.col("event_id")
    done = t.events.select("user_id", F.when(e % 2 == 0, "a").otherwise("b").alias("model"), F.when(F.col("event_type") == "click", "bias").alias("task"), (e % 3).cast("int").alias("rep"), F.when(F.col("event_type") == "error", "x").alias("error"))
    return C.estimate(C.jobs(t.events, "user_id", ["a", "b"], ["facts", "bias"], 2, done))


@query("""WITH m AS (SELECT o_custkey AS id, arg_min(o_orderkey, o_orderkey) AS page FROM orders GROUP BY 1) SELECT id, CAST(o_totalprice AS DOUBLE) AS views, CAST(round(1e6 * ln(1 + o_totalprice)) AS BIGINT) AS log_views, CAST(round(1e6 * CASE WHEN c.n > 0 THEN ln(c.n) END) AS BIGINT) AS log_chars,
CASE WHEN 1400 + page % 700 > 1600 AND 1400 + page % 700 <= 2026 THEN CAST(2026 - (1400 + page % 700) AS INTEGER) END AS age, page % 2 = 0 AS has_website FROM m JOIN orders ON o_orderkey = page LEFT JOIN (SELECT l_orderkey, max(CAST(floor(l_extendedprice) AS BIGINT) - 20000) AS n FROM lineitem GROUP BY 1) c ON l_orderkey = page""")
def page_prominence(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    matches = t.orders.select(F.col("o_custkey").alias("id"), k.alias("page"), k.alias("ordinal"))
    enriched = t.orders.select(k.alias("page"), F.col("o_totalprice").cast("string").alias("views"), F.concat(F.lit("in "), (k % 700 + 1400).cast("string")).alias("founded"), F.when(k % 2 == 0, "http://x").otherwise("no").alias("website"))
    chars = t.lineitem.select(F.col("l_orderkey").alias("page"), (F.floor("l_extendedprice") - 20000).alias("chars"))
    p = C.prominence(matches, enriched, chars)
    return p.select("id", "views", *[F.round(F.col(c) * 1e6).cast("long").alias(c) for c in ("log_views", "log_chars")], "age", "has_website")


@query("""WITH i AS (SELECT 'Q' || (p_partkey % 500) AS qid, arg_max({'f': CASE WHEN p_size % 2 = 0 THEN CAST(1900 + p_size AS VARCHAR) ELSE 'x' END, 'u': CASE WHEN p_size % 3 = 0 THEN 'http://p' || p_partkey ELSE 'p' END}, p_partkey) AS x FROM part WHERE p_type <> 'ECONOMY' GROUP BY 1),
m AS (SELECT o_custkey AS id, 'Q' || (o_orderkey % 600) AS qid, o_orderkey FROM orders WHERE o_orderkey % 4 <> 3)
SELECT id, arg_max('{"q":"' || qid || '"' || CASE WHEN x.f <> 'x' THEN ',"f":"' || x.f || '"' ELSE '' END || CASE WHEN x.u <> 'p' THEN ',"u":"' || x.u || '"' ELSE '' END || '}', o_orderkey) AS json FROM m JOIN i USING (qid) GROUP BY id""")
def entity_json(t: Tables) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    items = t.part.select(F.concat(F.lit("Q"), k % 500).alias("qid"), F.when(F.col("p_type") != "ECONOMY", "school").otherwise("defunct").alias("tag"), F.when(s % 2 == 0, (s + 1900).cast("string")).otherwise("x").alias("founded"), F.when(s % 3 == 0, F.concat(F.lit("http://p"), k)).otherwise("p").alias("website"), k.alias("ordinal"))
    o = F.col("o_orderkey")
    matches = t.orders.select(F.col("o_custkey").alias("id"), F.concat(F.lit("Q"), o % 600).alias("qid"), pick(o, ["id", "id_stale", "name_state", "geo"]).alias("method"), o.alias("ordinal"))
    return C.entity_facts(matches, items)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')")
def status_asked(t: Tables) -> DataFrame:
    return C.with_status(C.with_status(t.orders, "o_orderstatus", " P, F,"), "o_orderstatus", "all").select("o_orderkey", "o_orderstatus")


# -- the waterfall's tiers without similarity, and who wins a record

@query(rf"""WITH p AS (SELECT p_partkey AS k, p_name, p_size % 50 AS s FROM part), n AS (SELECT p_name, s, count(*) AS n FROM p GROUP BY 1, 2),
m AS (SELECT k, CAST(k AS VARCHAR) AS record_id, 'id' AS method FROM p WHERE k % 5 = 0 AND k % 2 = 0 UNION ALL SELECT k, CAST(k AS VARCHAR), 'name_state' FROM p JOIN n USING (p_name, s) WHERE k % 5 = 1 AND n = 1)
SELECT record_id, CAST(k AS INTEGER) AS article_id, method, CAST(0 AS BIGINT) AS n_losers FROM m""")
def waterfall_exact(t: Tables) -> DataFrame:
    """What the tiers of ids and of equal names link, one article for each record."""
    return M.resolve_claims(M.match(*match_sides(t), last="name_state"), F.lit(0)).select("record_id", "article_id", "method", "n_losers")


@query(f"""WITH d AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'no' ELSE 'yes' END AS o, c_nationkey % 3 = 0 AS known FROM customer) SELECT c_custkey, CASE WHEN o = 'no' THEN 'not_operating' WHEN NOT known THEN 'no_state' ELSE 'no_record_or_variant_name' END AS reason FROM d""")
def match_reasons(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", M.unmatched_reason(F.when(F.col("c_acctbal") < 0, "no").otherwise("yes"), F.when(F.col("c_nationkey") % 3 == 0, "ohio").otherwise("Narnia")).alias("reason"))


ELIGIBLE = ["a", "b", None]


@query(f"""WITH d AS (SELECT o_orderkey AS k, {sql_pick('o_orderkey', ['public', 'private', None])} AS sector, nullif(o_orderpriority, '5-LOW') AS type, o_orderstatus AS status, {sql_pick('o_custkey', ['OH', 'PR', None])} AS state, {sql_pick('o_custkey', ELIGIBLE)} AS method, o_custkey % 4 AS c, o_totalprice FROM orders)
SELECT k AS o_orderkey, coalesce(state NOT IN ('PR'), FALSE) AND o_totalprice > 50000 AND c <> 1 AND NOT (coalesce(sector = 'public', FALSE) AND NOT coalesce(type IN ('1-URGENT', '2-HIGH'), FALSE)) AND NOT (coalesce(sector = 'public', FALSE) AND NOT coalesce(status IN ('F', 'O'), FALSE))
AND NOT (coalesce(sector = 'public', FALSE) AND c = 2) AND NOT (c = 3 AND NOT coalesce(method IN ('a'), FALSE)) AS ok FROM d""")
def eligible_rows(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    d = {
        "sector": pick(k, ["public", "private", None]), "level": F.lit("high"), "locale": F.lit("city"), "enrollment": F.when(F.col("o_totalprice") > 50000, 1), "city": F.when(c % 4 != 1, "troy").otherwise(""), "state": pick(c, ["OH", "PR", None]),
        "type": F.nullif("o_orderpriority", F.lit("5-LOW")), "status": F.col("o_orderstatus"), "hi": F.lit(12), "lunch": F.when(c % 4 != 2, 0.5), "listed": F.when(c % 4 == 3, 1), "method": pick(c, ELIGIBLE),
    }
    return t.orders.select("o_orderkey", H.eligible(d, types=("1-URGENT", "2-HIGH"), statuses=("F", "O"), methods=("a",)).alias("ok"))


@query("""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) || ' ' || lower(coalesce(source, '')) || CASE doc_id % 5 WHEN 0 THEN ' Senior High' WHEN 1 THEN ' k-8' WHEN 2 THEN ' grammar school' ELSE '' END AS t FROM documents), l AS (SELECT doc_id, lower(t) AS t FROM d)
SELECT doc_id, CASE WHEN regexp_matches(t, 'high school|secondary|senior high') THEN 'high' WHEN regexp_matches(t, 'middle school|junior high|intermediate school') THEN 'middle' WHEN regexp_matches(t, 'elementary|primary school|grade school|grammar school') THEN 'elementary' WHEN regexp_matches(t, 'k[–-](12|8)') THEN 'combined' ELSE '' END AS level FROM l""")
def text_levels(t: Tables) -> DataFrame:
    more = F.coalesce(pick(F.col("doc_id"), [" Senior High", " k-8", " grammar school", None, None]), F.lit(""))
    return t.documents.select("doc_id", H.text_level(F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.coalesce("source", F.lit("")), more)).alias("level"))
