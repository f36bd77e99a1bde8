"""Queries of the civic-data operators over the driver's tables, whose columns stand in for those of schools and articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import answers as A
from tallyloom.functions import schools as H
from tallyloom.operators import build as B
from tallyloom.operators import matching as M
from tallyloom.operators import rules as R

from .registry import Tables, query


def pick(key: Column, values: list[str | None]) -> Column:
    """values[key mod n]."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(key, F.lit(len(values))).cast("int"))


def sql_pick(key: str, values: list[str | None]) -> str:
    quoted = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"(CAST([{quoted}] AS VARCHAR[]))[CAST({key} % {len(values)} AS INTEGER) + 1]"


# -- public build: orders are schools, their lines the counts

STATUSES = ["Open", "Closed", "New", "Future", "Reopened"]
LOWS, HIGHS = ["PK", "N", "06", "M", "09"], ["05", "08", "12", "N"]
CHARTERS, KINDS = ["Yes", "No", "Not applicable", None], ["Regular School", "Alternative School", "Other", None]
PLACES = ["AL", None, "", "TX"]
INDICATORS = ["Education Unit Total", "Subtotal 4 - By Grade", "Derived"]
PROGRAMS = ["Free lunch qualified", "Reduced-price lunch qualified", "No Category Codes"]


@query(rf"""
WITH dir AS (SELECT o_orderkey AS school, {sql_pick('o_orderkey', STATUSES)} AS status, {sql_pick('o_custkey', LOWS)} AS low, {sql_pick('o_orderkey', HIGHS)} AS high, {sql_pick('o_custkey', CHARTERS)} AS charter,
  {sql_pick('o_orderkey', KINDS)} AS type, {sql_pick('o_custkey', PLACES)} AS loc FROM orders),
l AS (SELECT l_orderkey AS school, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS ordinal, CAST(l_quantity AS BIGINT) - 2 AS n, {sql_pick('l_partkey', INDICATORS)} AS indicator, {sql_pick('l_suppkey', PROGRAMS)} AS program,
  l_partkey % 4 = 0 AS direct, l_suppkey % 2 = 0 AS adult FROM lineitem),
m AS (SELECT school, max_by(n, ordinal) FILTER (WHERE indicator = 'Education Unit Total') AS total, max_by(n, ordinal) FILTER (WHERE indicator LIKE 'Subtotal 4%' AND adult) AS adult,
  max_by(n, ordinal) FILTER (WHERE indicator = 'Education Unit Total') AS teachers, max_by(n, ordinal) FILTER (WHERE NOT direct AND program = 'Free lunch qualified') AS free,
  max_by(n, ordinal) FILTER (WHERE NOT direct AND program = 'Reduced-price lunch qualified') AS reduced, max_by(n, ordinal) FILTER (WHERE direct) AS direct FROM l GROUP BY school),
s AS (SELECT dir.*, m.*, CASE WHEN total >= 0 AND adult >= 0 THEN CASE WHEN total - adult >= 0 THEN total - adult END WHEN total >= 0 THEN total END AS students, CASE WHEN teachers >= 0 THEN teachers END AS fte FROM dir LEFT JOIN m ON dir.school = m.school
  WHERE status IN ('Open', 'New', 'Added', 'Changed Boundary/Agency', 'Reopened'))
SELECT school, CASE WHEN low IN ('N', 'M') THEN '' ELSE low END AS low_grade, CASE WHEN high IN ('N', 'M') THEN '' ELSE high END AS high_grade, CASE WHEN coalesce(loc, '') <> '' THEN loc ELSE 'BI' END AS state,
  CASE WHEN school % 4 = 0 THEN 'County ' || CAST(school % 97 AS VARCHAR) ELSE '' END AS county, CASE WHEN school % 4 = 0 THEN '2' || CAST(school % 5 AS VARCHAR) ELSE '' END AS locale_code,
  CASE WHEN school % 4 = 0 THEN CASE school % 5 WHEN 1 THEN 'Suburban, Large' WHEN 2 THEN 'Suburban, Midsize' WHEN 3 THEN 'Suburban, Small' ELSE '' END ELSE '' END AS locale,
  CASE WHEN charter IN ('Yes', 'No') THEN charter ELSE '' END AS charter, coalesce(CAST(students AS VARCHAR), '') AS students, coalesce(CAST(fte AS VARCHAR), '') AS teachers,
  students > 0 AND fte > 0 AS has_ratio, coalesce(CAST(CASE WHEN free >= 0 THEN free END AS VARCHAR), '') AS free, coalesce(CAST(CASE WHEN reduced >= 0 THEN reduced END AS VARCHAR), '') AS reduced,
  coalesce(CAST(CASE WHEN direct >= 0 THEN direct END AS VARCHAR), '') AS direct, CASE type WHEN 'Regular School' THEN 'Regular' WHEN 'Alternative School' THEN 'Other/Alternative' ELSE coalesce(type, '') END AS type, status FROM s""".replace("students > 0 AND fte > 0 AS has_ratio", "coalesce(students > 0 AND fte > 0, FALSE) AS has_ratio"))
def public_build(t: Tables) -> DataFrame:
    o, k = t.orders, F.col("o_orderkey")
    directory = o.select(k.alias("school"), F.lit(1).alias("ordinal"), pick(k, STATUSES).alias("status"), pick(F.col("o_custkey"), LOWS).alias("low"), pick(k, HIGHS).alias("high"), pick(F.col("o_custkey"), CHARTERS).alias("charter"), pick(k, KINDS).alias("type"), F.lit("BI").alias("state"), pick(F.col("o_custkey"), PLACES).alias("location_state"))
    indicator, program = pick(F.col("l_partkey"), INDICATORS), pick(F.col("l_suppkey"), PROGRAMS)
    lines = t.lineitem.select(F.col("l_orderkey").alias("school"), (F.col("l_linenumber").cast("long") * 10000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("ordinal"), (F.round("l_quantity").cast("long") - 2).cast("string").alias("count"), indicator.alias("indicator"), program.alias("program"), F.when(F.col("l_partkey") % 4 == 0, B.DIRECT).otherwise("x").alias("data_group"), F.when(F.col("l_suppkey") % 2 == 0, B.ADULT).otherwise("x").alias("grade"))
    places = o.where(k % 4 == 0).select(k.alias("school"), F.lit(1).alias("ordinal"), F.concat(F.lit("2"), k % 5).alias("locale"), F.concat(F.lit("County "), k % 97).alias("county"), F.lit("1").alias("lat"), F.lit("1").alias("lon"))
    out = B.public_build(directory, lines, lines.withColumnRenamed("count", "teachers"), lines, places)
    return out.withColumn("has_ratio", F.col("ratio") != "").drop("ratio")


# -- release rows and gate: documents are articles, labels the matches

# DuckDB's \b and \s know ASCII alone, so words and spaces are spelled out
OPENING = r"substr(array_to_string(list_transform(regexp_extract_all(substr(page_text, 1, 600), '[\pL\pN\pM_]+\.?|[^\pL\pN\pM_]'), lambda w: CASE WHEN regexp_full_match(w, '[A-Z][a-z]{0,2}\.') THEN rtrim(w, '.') ELSE w END), ''), 1, 300)"
CLOSED = " AND NOT ".join(rf"regexp_matches(o, '(?i)^(?:[^.]{{0,199}}[^.\pL\pN\pM_])?(?:{verb})[\s\pZ\x0B\x1C-\x1F\x85]+(?:a|an|the)(?:[^\pL\pN\pM_]|$)')" for verb in ("was|were", "is|are"))
CODES = ["AL", "TX", "ny", "CA"]


def _release(t: Tables) -> DataFrame:
    d = t.documents
    generated = d.select(F.col("doc_id").alias("id"), F.concat(F.lit("School "), "doc_id").alias("name"), pick(F.col("doc_id"), CODES).alias("state"), pick(F.col("doc_id"), ["public", "private"]).alias("sector"), F.lit("A school.").alias("text"))
    matches = t.labels.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("page"), F.concat(F.lit("Title "), F.col("doc_id") % 50).alias("title"), F.lit("Q1").alias("qid"))
    texts = d.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("page"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Page "), "doc_id")).alias("title"), F.concat(pick(F.col("doc_id"), ["It was a school. ", "It is a school. ", "", "x [[y]] "]), F.col("text")).alias("text"), F.lit(12).alias("revision"))
    return B.release_rows(generated, matches, texts, 400)


RELEASE = rf"""
WITH a AS (SELECT d.doc_id AS id, l.doc_id IS NOT NULL AS hit, CASE WHEN d.doc_id % 7 <> 0 THEN {sql_pick('d.doc_id', ['It was a school. ', 'It is a school. ', '', 'x [[y]] '])} || d.text END AS page_text,
  CASE WHEN d.doc_id % 7 <> 0 AND d.doc_id % 2 = 0 THEN 'Page ' || CAST(d.doc_id AS VARCHAR) ELSE 'Title ' || CAST(d.doc_id % 50 AS VARCHAR) END AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
b AS (SELECT *, {OPENING} AS o FROM a),
c AS (SELECT *, CASE WHEN NOT hit THEN '' WHEN coalesce(page_text, '') = '' THEN 'no_text' WHEN length(page_text) < 400 THEN 'short_text' WHEN {CLOSED} THEN 'closed_school' ELSE '' END AS reason FROM b),
r AS (SELECT id, 'School ' || CAST(id AS VARCHAR) AS name, {sql_pick('id', CODES)} AS state, {sql_pick('id', ['public', 'private'])} AS sector, hit AND reason = '' AS taken, page_text, t, reason FROM c),
rows AS (SELECT id, name, state, sector, CASE WHEN taken THEN page_text ELSE 'A school.' END AS text, CAST(taken AS TINYINT) AS from_article, CASE WHEN taken THEN t ELSE '' END AS title, CASE WHEN taken THEN 'Q1' ELSE '' END AS qid,
  CASE WHEN taken THEN '12' ELSE '' END AS revision, CASE WHEN taken THEN 'https://en.wikipedia.org/wiki/' || replace(t, ' ', '_') ELSE 'NCES' END AS source, CASE WHEN taken THEN 'CC-BY-SA-4.0' ELSE 'CC0-1.0' END AS license, reason FROM r)
"""


@query(f"{RELEASE} SELECT * FROM rows")
def release_rows(t: Tables) -> DataFrame:
    return _release(t)


@query(rf"""{RELEASE}, n AS (SELECT 'key_present' AS "check", count_if(id IS NULL) AS n_bad FROM rows
UNION ALL SELECT 'sector_and_state', count_if(NOT (sector IN ('public', 'private') AND regexp_matches(state, '^[A-Z]{{2}}$'))) FROM rows
UNION ALL SELECT 'text_present', count_if(trim(text) = '') FROM rows UNION ALL SELECT 'no_markup', count_if(from_article = 1 AND regexp_matches(text, '\{{\{{|\}}\}}|\[\[|\]\]|\[[0-9]+\]')) FROM rows
UNION ALL SELECT 'provenance', 0 UNION ALL SELECT 'level_fits', 0 UNION ALL SELECT 'schema', 0 UNION ALL SELECT 'rows', greatest(500 - count(*), 0) FROM rows UNION ALL SELECT 'key_unique', count(*) FROM (SELECT id FROM rows GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'one_article_per_school', count(*) FROM (SELECT title FROM rows WHERE from_article = 1 GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'state_counts', count(*) FROM (SELECT state, CAST(count_if(id % 3 <> 0) AS DOUBLE) AS o, CAST(count(*) AS DOUBLE) AS w FROM rows GROUP BY 1) WHERE abs((w - o) / greatest(o, 1)) > 0.05 AND greatest(o, w) >= 20)
SELECT "check", n_bad = 0 AS ok, CAST(n_bad AS BIGINT) AS n_bad, CAST(least(n_bad, 5) AS BIGINT) AS n_examples FROM n WHERE "check" <> 'rows' UNION ALL SELECT "check", n_bad = 0, CAST(n_bad AS BIGINT), 1 FROM n WHERE "check" = 'rows'""")
def release_gate(t: Tables) -> DataFrame:
    rows = _release(t)
    spans = t.documents.select(F.col("doc_id").alias("id"), F.array(F.lit("high")).alias("span_levels"))
    out = B.release_gate(rows, spans, expect=500, baseline=rows.where("id % 3 <> 0"))
    return out.select("check", "ok", "n_bad", F.size("examples").cast("long").alias("n_examples"))


# -- rules

KIND_SQL = "regexp_matches(x, '(?i)school|academ|gymnasium|yeshiv|lyceum|montessori|seminar|kindergarten|preparat|educational institution')"
HIGHER_SQL = r"(NOT regexp_matches(x, '(?i)preparat') AND regexp_matches(x, '(?i)\bcollege\b|\buniversity\b|law school|medical school|graduate school|business school|nursing school|art school|dental school|veterinary school|divinity school|community college|junior college'))"
EVENT_SQL = "regexp_matches(x, '(?i)shooting|massacre|bombing|attack|murder|killing|stabbing|disaster|riot|hostage|kidnap|hoax')"
DISTRICT_SQL = "regexp_matches(x, '(?i)school district')"
ENDS, MORE = [" High School", " bridge", " School District", " University", " law School", " preparatory college", ""], [" massacre", " art school", " house", " Seminar", " Collegeview"]


@query(rf"""WITH d AS (SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN [] ELSE [p_name || {sql_pick('p_partkey', ENDS)}, p_type || {sql_pick('p_size', MORE)}] END AS labels, p_size % 3 AS q FROM part),
t AS (SELECT *, len(list_filter(labels, lambda x: {KIND_SQL} AND NOT {DISTRICT_SQL} AND NOT {HIGHER_SQL} AND NOT {EVENT_SQL})) > 0 AS genuine, len(list_filter(labels, lambda x: {DISTRICT_SQL} OR {HIGHER_SQL})) > 0 AS out FROM d)
SELECT p_partkey, CASE WHEN q = 0 OR len(labels) = 0 THEN 'unverified' WHEN genuine AND q = 1 THEN 'defunct' WHEN genuine THEN 'school' WHEN out THEN 'out_of_scope' ELSE 'non_school' END AS tag FROM t""")
def classify_labels(t: Tables) -> DataFrame:
    """Labels made of names, types and words; the SQL states the rule."""
    k, s = F.col("p_partkey"), F.col("p_size")
    labels = F.when(s % 9 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat("p_name", pick(k, ENDS)), F.concat("p_type", pick(s, MORE))))
    qid, gone = F.when(s % 3 > 0, "Q1").otherwise(""), F.when(s % 3 == 1, "1999")
    return t.part.select("p_partkey", R.classify(qid, labels, gone).alias("tag"))


PLAIN_SQL = r"""regexp_replace(regexp_replace(regexp_replace(lead, '(?i)\b(St|Sts|Ste|Mt|Dr|Jr|Sr|No|Ft|Rev|Msgr|Sen|Gen|Pres|Ave|Blvd|Rd|Hwy|Co|Inc|Corp|Bros)\.', '\1', 'g'), '\b([A-Z])\.', '\1', 'g'), '\s*\([^)]*\)', '', 'g')"""
VERBS = [" is a ", " was a ", " is the former ", " was built as a ", ", St. X (once), is a ", " is a historic ", " and a ", " were the "]
AFTER = [" that was a mill. It is large.", " in Ohio", " building. It was closed! It is on the National Register.", "? He is a dean."]


@query(rf"""WITH d AS (SELECT doc_id, coalesce(regexp_extract(text, '^[^\n.!?]*', 0), '') || {sql_pick('doc_id', VERBS)} || coalesce(source, 'x') || {sql_pick('doc_id', AFTER)} AS lead FROM documents), p AS (SELECT doc_id, {PLAIN_SQL} AS whole FROM d),
f AS (SELECT doc_id, whole, CASE WHEN regexp_matches(whole, '(?s)^.*?[.!?]\s') THEN rtrim(regexp_extract(whole, '(?s)^(.*?[.!?])\s', 1)) ELSE whole END AS first FROM p),
v AS (SELECT *, CASE WHEN regexp_matches(first, '(?i)^([^.]{{0,200}}?)\b(is|are)\s+(an?|the)\b') THEN length(regexp_extract(first, '(?i)^([^.]{{0,200}}?)\b(is|are)\s+(an?|the)\b', 1)) END AS now, CASE WHEN regexp_matches(first, '(?i)^([^.]{{0,200}}?)\b(was|were)\s+(an?|the)\b') THEN length(regexp_extract(first, '(?i)^([^.]{{0,200}}?)\b(was|were)\s+(an?|the)\b', 1)) END AS was FROM f)
SELECT doc_id, CASE WHEN regexp_matches(first, '(?i)\b(is|are)\s+(an?|the)\s+(former|defunct|closed|historic\b[^.]{{0,60}}?\b(building|schoolhouse|site|structure|district))\b') THEN 'past' WHEN regexp_matches(first, '(?i)\b(was|were)\s+(built|constructed|erected|designed)\b') AND regexp_matches(whole, '(?i)National Register|historic') THEN 'past'
WHEN was IS NOT NULL AND (now IS NULL OR was < now) THEN 'past' WHEN regexp_matches(first, '(?i)\b(is|are)\s+(an?|the)\s+historic\b') THEN '' WHEN now IS NOT NULL THEN 'present' ELSE '' END AS tense FROM v""")
def lead_tenses(t: Tables) -> DataFrame:
    """Opening sentences that start as the documents do; the SQL states the rule."""
    k = F.col("doc_id")
    lead = F.concat(F.regexp_extract(F.coalesce("text", F.lit("")), r"^[^\n.!?]*", 0), pick(k, VERBS), F.coalesce("source", F.lit("x")), pick(k, AFTER))
    return t.documents.select("doc_id", R.tense(lead).alias("tense"))


#: lead, description, type, tag before -> tense, head noun, tag after, operating; each stated by hand.
LEADS = [
    ("Troy School is a public high school in Ohio.", "", "high school", "school", "present", "school", "school", "yes"),
    ("Troy School, which was founded in 1950, is a charter school network in Ohio.", "", "", "school", "present", "school network", "out_of_scope", "yes"),
    ("A ranch school is a type of school used in the west.", "", "", "unverified", "present", "", "non_school", "yes"),
    ("Troy School was a school in Ohio.", "", "high school", "school", "past", "", "school", "no"),
    ("Troy School is a defunct high school.", "", "high school", "non_school", "past", "school", "non_school", "no"),
    ("Troy School is a historic school.", "", "school building", "school", "", "school", "school", "no"),
    ("", "seminary in Ohio", "", "school", "", "", "out_of_scope", "yes"),
    ("", "public school in Ohio", "", "unverified", "", "", "school", "yes"),
    ("Troy School is an academy in Ohio.", "", "private school", "out_of_scope", "present", "academy", "school", "yes"),
]


@query(f"""SELECT o_orderkey, {sql_pick('o_orderkey', [x[4] for x in LEADS])} AS tense, {sql_pick('o_orderkey', [x[5] for x in LEADS])} AS head, {sql_pick('o_orderkey', [x[6] for x in LEADS])} AS validation, {sql_pick('o_orderkey', [x[7] for x in LEADS])} AS operating FROM orders""")
def revalidate_leads(t: Tables) -> DataFrame:
    of = lambda i: pick(F.col("o_orderkey"), [x[i] for x in LEADS])
    empty = {c: F.lit("") for c in ("country", "dissolved", "defunct_category", "crawl_validation")}
    d = t.orders.select("o_orderkey").withColumns({"lead": of(0), "description": of(1), "instance_of": F.array(of(2)), "validation": of(3), "title": F.lit("Troy School"), "state": F.lit("Ohio"), "wikidata_qid": F.lit("Q1"), **empty})
    return R.revalidate(d).select("o_orderkey", R.tense(F.col("lead")).alias("tense"), R.head_noun(F.col("lead")).alias("head"), "validation", "operating")


STARTS, TAILS = ["Template:", "", "", "List of ", "Category:", "", "Portal: "], [" Church", " (1999 film)", " School", " Cemetery Academy", "", " (disambiguation)", " chapel", " (band)"]
TITLE_SQL = f"{sql_pick('doc_id', STARTS)} || coalesce(substr(regexp_extract(text, '^[^\\n]*', 0), 1, 40), '') || {sql_pick('doc_id', TAILS)}"
BRANCH = ["Category:High schools ", "Category:Academies: ", "Category:Yeshivas ", "Category:College schools ", "Category:College preparatory schools ", "Category:Defunct schools ", "Category:Bridges "]
BRANCH_TAILS = ["in Ohio", "alumni", "with songs", "of art school", "(heads office)", "by stadium", "resort", "filmed in Ohio", "lost"]
STOPS_SQL = "|".join(H.BRANCH_STOPS)


@query(rf"""WITH d AS (SELECT doc_id, {TITLE_SQL} AS title, coalesce(source, '') || CASE WHEN doc_id % 11 = 0 THEN ' Accredited schools' ELSE '' END AS category, {sql_pick('doc_id', BRANCH)} || coalesce(lang, '') || ' ' || {sql_pick('doc_id', BRANCH_TAILS)} AS branch FROM documents),
b AS (SELECT *, lower(regexp_replace(branch, '^Category:', '')) AS n FROM d)
SELECT doc_id, regexp_matches(title, '^(Template|Portal|Wikipedia|Draft|Module|Help|Category|File|User|MediaWiki|Talk):') OR regexp_matches(title, '(?i)\(([0-9]{{4}} )?film\)|\(TV series\)|\(song\)|\(album\)|\(band\)|\(novel\)|\(disambiguation\)') OR (regexp_matches(title, '(?i)\b(church|cemetery|chapel|congregation)\b') AND NOT regexp_matches(title, '(?i)school|academ|yeshiv|institute|seminary|montessori'))
OR regexp_matches(category, '(?i)accredit|commission on|association of') AS dropped, regexp_matches(title, '^(List of |Lists of |Index of |Outline of |Timeline of )') AS listed,
regexp_matches(n, 'school|academ|yeshiv') AND NOT (contains(n, 'college') AND NOT contains(n, 'prep')) AND NOT regexp_matches(n, '\b({STOPS_SQL})') AND NOT regexp_matches(n, '\bdefunct') AS followed FROM b""")
def title_rules(t: Tables) -> DataFrame:
    """Titles that start as the documents do, categories of their sources and languages; the SQL states the rules."""
    k = F.col("doc_id")
    title = F.concat(pick(k, STARTS), F.substring(F.regexp_extract(F.coalesce("text", F.lit("")), r"^[^\n]*", 0), 1, 40), pick(k, TAILS))
    category = F.concat(F.coalesce("source", F.lit("")), F.when(k % 11 == 0, " Accredited schools").otherwise(""))
    branch = F.concat(pick(k, BRANCH), F.coalesce("lang", F.lit("")), F.lit(" "), pick(k, BRANCH_TAILS))
    return t.documents.select("doc_id", H.title_dropped(title, category).alias("dropped"), H.is_list(title).alias("listed"), H.descends(branch).alias("followed"))


GRADES = ["PK", "KG", "01", "05", "06", "08", "09", "12", "UG", None]
LEVEL_SQL = "list_filter([CASE WHEN ok AND lo <= 5 THEN 'elementary' END, CASE WHEN ok AND lo <= 8 AND hi >= 6 THEN 'middle' END, CASE WHEN ok AND hi >= 9 THEN 'high' END], lambda x: x IS NOT NULL)"


@query(f"""WITH g AS (SELECT p_partkey, {sql_pick('p_partkey', GRADES)} AS a, {sql_pick('p_size', GRADES)} AS b FROM part),
n AS (SELECT p_partkey, CASE a WHEN 'PK' THEN -1 WHEN 'KG' THEN 0 ELSE try_cast(a AS INTEGER) END AS lo, CASE b WHEN 'PK' THEN -1 WHEN 'KG' THEN 0 ELSE try_cast(b AS INTEGER) END AS hi FROM g),
k AS (SELECT *, coalesce(lo <= hi, FALSE) AS ok FROM n)
SELECT p_partkey, array_to_string({LEVEL_SQL}, '|') AS levels, CASE WHEN hi <= 6 AND lo IS NOT NULL THEN 'elementary' WHEN lo >= 9 AND hi IS NOT NULL THEN 'high' WHEN lo >= 5 AND hi <= 8 THEN 'middle' WHEN lo IS NOT NULL AND hi IS NOT NULL THEN 'combined' END AS level FROM k""")
def grade_levels(t: Tables) -> DataFrame:
    lo, hi = H.public_grade(pick(F.col("p_partkey"), GRADES)), H.public_grade(pick(F.col("p_size"), GRADES))
    return t.part.select("p_partkey", F.array_join(H.span_levels(lo, hi), "|").alias("levels"), H.evaluation_level(lo, hi)[0].alias("level"))


NAMED = {n: k for k, n in H.NAMES.items()} | H.OTHER_TEXT_NAMES
LONGEST = ", ".join("'" + n.replace("'", "''") + "'" for n in sorted(NAMED, key=lambda n: (-len(n), n)))
CODES_OF = "MAP {" + ", ".join(f"'{n.lower()}': '{k}'" for n, k in ({n: k for k, n in H.NAMES.items()} | H.OTHER_NAMES | {k: k for k in H.NAMES}).items()) + "}"
FULL = "MAP {" + ", ".join(f"'{n}': '{H.NAMES[k]}'" for n, k in NAMED.items()) + "}"
SPELT = sorted(NAMED)


@query(f"""WITH d AS (SELECT doc_id, 'In ' || {sql_pick('doc_id', SPELT)} || coalesce(source, '') || ' and ' || {sql_pick('n_chars', SPELT)} || coalesce(lang, '') AS told, CASE doc_id % 3 WHEN 0 THEN ' ' || upper({sql_pick('n_chars', SPELT)}) ELSE {sql_pick('n_chars', [*H.NAMES, 'XX'])} END AS code FROM documents),
c AS (SELECT doc_id, trim(code) AS code, list_filter([{LONGEST}], lambda n: contains(told, n))[1] AS found FROM d)
SELECT doc_id, coalesce({CODES_OF}[lower(code)], '') AS code, coalesce({FULL}[found], '') AS name FROM c""")
def state_names(t: Tables) -> DataFrame:
    """Two names in prose, the longest counts; names and codes by themselves. The SQL looks them up in a table."""
    k, n = F.col("doc_id"), F.col("n_chars")
    told = F.concat(F.lit("In "), pick(k, SPELT), F.coalesce("source", F.lit("")), F.lit(" and "), pick(n, SPELT), F.coalesce("lang", F.lit("")))
    code = F.when(k % 3 == 0, F.concat(F.lit(" "), F.upper(pick(n, SPELT)))).otherwise(pick(n, [*H.NAMES, "XX"]))
    return t.documents.select("doc_id", H.state_code(code).alias("code"), H.state_in_text(told).alias("name"))


CITY_WORDS, TYPE_WORDS = ["", "new ", "st. ", "port ", "lake "], [" academy", " virtual program", " prep", " career center", "", " magnet", " charter academy"]
FILLER_SQL = ", ".join(f"'{w}'" for w in H.CITY_FILLER)
FAMILY_SQL = "MAP {" + ", ".join(f"'{w}': '{k}'" for w, k in H.by_word(H.TYPE_FAMILIES).items()) + "}"
FAMILIES_X, FAMILIES_Y = (f"list_distinct(list_filter(list_transform(string_split({c}, ' '), lambda w: {FAMILY_SQL}[w]), lambda f: f IS NOT NULL))" for c in "xy")


@query(f"""WITH d AS (SELECT p_partkey, {sql_pick('p_partkey', CITY_WORDS)} || CASE WHEN p_size % 10 = 0 THEN '' ELSE string_split(p_name, ' ')[1] END || ' city' AS a, {sql_pick('p_size', CITY_WORDS)} || CASE WHEN p_size % 7 = 0 THEN 'bronx' ELSE string_split(p_name, ' ')[1 + p_partkey % 2] END AS b, p_name || {sql_pick('p_partkey', TYPE_WORDS)} AS x, p_name || {sql_pick('p_size', TYPE_WORDS)} AS y FROM part),
n AS (SELECT *, list_filter(string_split(replace(a, 'st. ', 'saint '), ' '), lambda w: w <> '') AS wa, list_filter(string_split(replace(b, 'st. ', 'saint '), ' '), lambda w: w <> '') AS wb FROM d)
SELECT p_partkey, wa = wb OR list_has_any(list_filter(wa, lambda w: w NOT IN ({FILLER_SQL})), list_filter(wb, lambda w: w NOT IN ({FILLER_SQL}))) AS city, len({FAMILIES_X}) = 0 OR len({FAMILIES_Y}) = 0 OR list_has_any({FAMILIES_X}, {FAMILIES_Y}) AS types FROM n""")
def compatible_names(t: Tables) -> DataFrame:
    """Cities and names made of the parts' words; the SQL states the rules."""
    k, s, w = F.col("p_partkey"), F.col("p_size"), F.split("p_name", " ")
    a = F.concat(pick(k, CITY_WORDS), F.when(s % 10 == 0, "").otherwise(w[0]), F.lit(" city"))
    b = F.concat(pick(s, CITY_WORDS), F.when(s % 7 == 0, "bronx").otherwise(F.get(w, (k % 2).cast("int"))))
    return t.part.select("p_partkey", H.city_compatible(a, b).alias("city"), H.types_compatible(F.concat("p_name", pick(k, TYPE_WORDS)), F.concat("p_name", pick(s, TYPE_WORDS))).alias("types"))


# -- answers

SECTORS, SAID, BANDS, SPANS = ["public", "private"], ["Public", "private school", "unknown", "who knows", None], ["(A) under 200", "B", "D: many", "not sure"], ["9-12", "K to 5", "12-9", "5"]


@query(rf"""WITH r AS (SELECT o_orderkey, {sql_pick('o_custkey', SECTORS)} AS sector, {sql_pick('o_orderkey', SAID)} AS said, {sql_pick('o_custkey', BANDS)} AS size, {sql_pick('o_orderkey', SPANS)} AS span, CAST(floor(o_totalprice / 200) AS BIGINT) AS n FROM orders)
SELECT o_orderkey, CASE WHEN said IS NULL THEN 'unparsed' WHEN said = 'unknown' THEN 'abstain' WHEN said = 'who knows' THEN 'unparsed' WHEN starts_with(lower(said), sector) THEN 'correct' ELSE 'wrong' END AS o_sector,
CASE WHEN size = 'not sure' THEN 'abstain' WHEN regexp_extract(size, '([ABCD])', 1) = CASE WHEN n < 200 THEN 'A' WHEN n < 500 THEN 'B' WHEN n < 1000 THEN 'C' ELSE 'D' END THEN 'correct' ELSE 'wrong' END AS o_enroll,
CASE span WHEN '9-12' THEN 'correct' WHEN 'K to 5' THEN 'wrong' ELSE 'unparsed' END AS o_grades FROM r""")
def score_answers(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    frame = t.orders.select(k.alias("id"), pick(c, SECTORS).alias("sector"), F.lit(False).alias("charter"), F.lit("high").alias("level"), F.lit(None).cast("string").alias("level_alt"), F.lit("none").alias("religion"), F.lit("Troy").alias("district"), F.lit(9).alias("lo"), F.lit(12).alias("hi"), F.floor(F.col("o_totalprice") / 200).cast("double").alias("enrollment"))
    line = lambda a, v: F.coalesce(F.concat(F.lit(f"{a}: "), v, F.lit("\n")), F.lit(""))
    text = F.concat(line("A1", pick(k, SAID)), line("A5", pick(k, SPANS)), line("**A6**", pick(c, BANDS)), F.lit("D1: a school"))
    d = t.orders.select(k.alias("id"), F.lit("m").alias("model"), F.lit(0).alias("rep"), text.alias("text"), F.lit("").alias("error"))
    return A.score_all(d, frame).select(F.col("id").alias("o_orderkey"), "o_sector", "o_enroll", "o_grades")


# -- the waterfall: parts are records, and the articles are parts whose names were changed

def match_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Articles and records, prepared."""
    state = pick(F.col("p_size"), [*H.NAMES][:50])
    k, name = F.col("p_partkey"), F.col("p_name")
    point = [(k * 7919 % 6000) / 100.0 - 30, (k * 104729 % 30000) / 100.0 - 150]
    span = F.array(pick(k, ["high", "elementary"]))
    records = t.part.select(k.cast("string").alias("record_id"), F.concat(name, F.lit(" School")).alias("name"), state.alias("state"), F.lit("").alias("city"), F.lit("").alias("county"), span.alias("span_levels"), point[0].alias("lat"), point[1].alias("lon"), k.alias("ordinal"))
    first, rest = F.split(name, " ")[0], F.regexp_replace(name, "^[^ ]+ ", "")
    title = F.when(k % 5 == 1, F.concat(name, F.lit(" School"))).when(k % 5 == 2, F.concat(rest, F.lit(" "), first, F.lit(" Academy"))).when(k % 5 == 3, F.concat(rest, F.lit(" Hall School"))).otherwise(F.concat(name, F.lit(" High School")))
    articles = t.part.select(k.cast("int").alias("article_id"), title.alias("title"), state.alias("state"), F.lit("").alias("level"), F.when(k % 5 == 0, k.cast("string")).alias("given_id"), F.when(k % 5 == 3, point[0] + 0.002).alias("lat"), F.when(k % 5 == 3, point[1]).alias("lon"))
    return M.prepare_articles(articles), M.prepare_records(records)


@query()
def match_waterfall(t: Tables) -> DataFrame:
    return M.match(*match_sides(t))
