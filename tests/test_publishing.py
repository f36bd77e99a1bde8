"""Articles, sheets, prompts, cards, plans and phrases by hand."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import articles as A
from tallyloom.functions import prompts as P
from tallyloom.functions import text as X
from tallyloom.operators import card as C
from tallyloom.operators import phrases
from tallyloom.sources import writers


def articles(spark, rows):
    names = sorted({k for r in rows for k in r})
    d = spark.createDataFrame([(i, *[r.get(n) for n in names]) for i, r in enumerate(rows)], "i int, " + ", ".join(f"`{n}` string" for n in names))
    return [r.a for r in d.select("i", A.article({n: F.col(f"`{n}`") for n in names}).alias("a")).orderBy("i").collect()]


def test_public_and_private_articles(spark):
    rows = [
        {"sector": "public", "school_name": "A C MOORE PRIMARY SCHOOL", "city": "ATMORE", "county": "Escambia", "state": "AL", "low_grade": "PK", "high_grade": "05", "type": "Regular", "Charter": "No", "District": "School District No. 3 in the county of El Paso and State of", "Locale": "Rural, Fringe", "Status": "New", "total_students": "1234", "teachers": "61.5", "student_teacher_ratio": "20.1", "Free Lunch": "600", "Reduced Lunch": "17", "address": "1 MLK ST", "zip": "36502", "phone": "(251)1"},
        {"sector": "public", "school_name": None, "state": None, "total_students": "-1"},
        {"sector": "public", "school_name": "Troy Unified", "District": "troy unified", "state": "DC", "total_students": "0", "Free Lunch": "3", "teachers": "2"},
        {"sector": "private", "school_name": "St Mary's", "city": "Troy", "county": "Rock County", "state": "OH", "type": "2", "PSS_COED": "3", "PSS_RELIG": "1", "PSS_LEVEL": "3", "PSS_ENROLL_K": "4", "PSS_ENROLL_8": "7", "PSS_ENROLL_9": "0", "PSS_WHITE_PCT": "60", "PSS_BLACK_PCT": "30.25", "PSS_ASIAN_PCT": "-1", "PSS_HISP_PCT": "9.75", "PSS_LIBRARY": "No", "PSS_SCH_DAYS": "180", "PSS_STU_DAY_HRS": "7.0", "PSS_ASSOC_1": "NCEA", "PSS_ASSOC_9": "AMS", "PSS_ASSOC_2": "NCEA", "address": "2 Elm", "phone": "(1)2", "PSS_LOCALE": "42", "total_students": "50"},
        {"sector": "private", "PSS_WHITE_PCT": "100", "PSS_ASSOC_3": "X"},
    ]
    a = articles(spark, rows)
    assert a[0] == "A C Moore Primary School is a public elementary school in Atmore, Escambia, Alabama, serving grades PK–5. It is part of the School District No. 3. It is located in a rural area near a city. It opened in the 2024-25 school year. As of the 2024-25 school year, it enrolled 1,234 students and employed about 62 teachers, a student–teacher ratio of roughly 20.1:1. About 50% of students were eligible for free or reduced-price lunch. Its street address is 1 MLK St, Atmore, AL 36502, and its phone number is (251)1."
    assert a[1] == "This school is a public school. As of the 2024-25 school year, it enrolled -1 students."
    assert a[2] == "Troy Unified is a public school in the District of Columbia."
    assert a[3] == "St Mary's is a all-girls Catholic private Montessori school in Troy, Rock County, Ohio, serving grades K–8. It is located in a distant rural area. As of the 2023-24 school year, it enrolled 50 students. Its student body was 60% White, 30.2% Black, and 9.8% Hispanic. The school does not have a library and is in session about 180 days a year, 7 hours a day. It reports affiliation with AMS, and NCEA. Its street address is 2 Elm, Troy, OH."
    assert a[4] == "This school is a private school. Its student body was 100% White. It reports affiliation with X."


def test_names_and_districts(spark):
    names = [("TROY H S", "Troy High School"), ("O'BRIEN'S ELEM.", "O'brien's Elementary School"), ("Troy Jr. High", "Troy Junior High School"), ("Troy  Acad", "Troy Academy"), ("Mid-City Sch", "Mid-City School"), ("Troy Middle", "Troy Middle School"), (None, "")]
    d = spark.createDataFrame(names, "n string, want string")
    assert d.where(A.display_name(F.col("n")) != F.col("want")).collect() == []
    districts = [("Troy", "the Troy school district"), ("The Troy ISD", "The Troy ISD"), ("Troy Schools, in the County of Rock", "the Troy Schools"), ("", ""), (None, "")]
    d = spark.createDataFrame(districts, "n string, want string")
    assert d.where(A.district_phrase(A.district_name(F.col("n"))) != F.col("want")).collect() == []


def test_cells(spark):
    cells = [("see [a b](https://x.org/y) and *slant* end", [("see ", None, False), ("a b", "https://x.org/y", False), (" and ", None, False), ("slant", None, True), (" end", None, False)]), ("https://bare.org ", [("https://bare.org ", "https://bare.org", False)]), ("a * b [c] (d)\nnext", [("a * b [c] (d)\nnext", None, False)]), ("", [])]
    d = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cells)], "i int, c string")
    got = {r.i: [tuple(x) for x in r.s] for r in d.select("i", A.segments(F.col("c")).alias("s")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cells)}
    d = spark.createDataFrame([("2026-10-01", "October 1, 2026"), ("x", None), (None, None)], "d string, want string")
    assert all(r.got == r.want for r in d.select("want", A.long_date(F.col("d")).alias("got")).collect())
    table = spark.createDataFrame([("title\n| # | Fact |\n| --- | --- | --- | --- |\n| 1 | Name | Troy | [a](b) |  |  |\n| x | y | z | q |\n|12|Year|*Not found*|—||",), (None,)], "t string")
    assert [[tuple(x) for x in r.r] for r in table.select(A.read_table(F.col("t")).alias("r")).collect()] == [[("Name", "Troy", "[a](b)"), ("Year", "*Not found*", "—")], []]


def test_prompts(spark):
    d = spark.createDataFrame([("St. Mary Troy K-8 School 12 & Co", "Troy", "OH"), ("Blue Oak Hill High", None, "TX"), ("the Academy", "", "NY"), (None, None, None)], "n string, c string, s string")
    assert [r[0] for r in d.select(P.masked(F.col("n"))).collect()] == ["St. [X] K-8 School 12 & [X]", "[X] High", "the Academy", ""]
    s = P.school(F.col("n"), F.col("c"), F.col("s"))
    arms = d.select(*[P.bias_prompt(s, a).alias(a) for a in P.ARMS], P.facts_prompt(s).alias("facts"), P.masked_prompt(F.col("n"), F.col("s")).alias("masked")).collect()
    assert all(r[a].replace(P.ARMS[a], "", 1) == r["none"] for r in arms for a in P.ARMS if a != "none")
    assert "about Blue Oak Hill High (in TX), using" in arms[1].facts and "St. Mary Troy K-8 School 12 & Co (in Troy, OH)" in arms[0].none
    assert 'named "[X] High" in TX. In the name' in arms[1].masked and "{" not in arms[1].masked and "Blue" not in arms[1].masked
    items = F.array(F.struct(F.lit("When?").alias("q"), F.array(F.lit("1"), F.lit("2")).alias("options")))
    r = d.limit(1).select(P.choice_prompt(None, items).alias("blind"), P.choice_prompt(s, items).alias("choice"), P.open_prompt(s, F.array(F.lit("Who?"))).alias("open")).first()
    assert "1. When?\n   A. 1\n   B. 2\n" in r.blind and "St. Mary" not in r.blind and "St. Mary" in r.choice and "\n1: <your answer to: Who?>\n" in r.open
    with pytest.raises(ValueError, match="no column for b"):
        P.filled("{a} {b}", a=F.lit(1))
    t = spark.createDataFrame([(" ".join(f"w{i}" for i in range(50)),), ("few words",), (None,)], "t string")
    got = t.select(*P.split_text(F.col("t"))).collect()
    assert got[0][0].split() == [f"w{i}" for i in range(20)] and got[0][1].split() == [f"w{i}" for i in range(20, 45)] and got[1][0] is got[2][1] is None
    c = spark.createDataFrame([("a b c d e x", "a b c d a b c d"), ("", "a"), (None, "a b")], "g string, t string")
    out = c.select(*X.continuation(*X.continued(F.col("g"), F.col("t")))).collect()
    assert out[0][0] == 2 / 5 and out[0][1] == pytest.approx(6 / 7) and out[1][0] is None and out[1][1] is None and out[2][1] == 0


def test_cards_and_tables(spark, tmp_path):
    rows = [(str(i), "OH" if i < 5 else "XX", "public", "x" * (i + 1), int(i % 2), f"T{i}", "id" if i % 2 else None, "closed_school" if i == 2 else "") for i in range(10)]
    d = spark.createDataFrame(rows, "id string, state string, sector string, text string, from_article int, title string, method string, reason string")
    texts = spark.createDataFrame([("T1", "2026-03-02T01:00:00Z"), ("T3", "2026-01-05"), ("T2", "2020-01-01"), ("T5", None), ("T7", "")], "title string, fetched_at string")
    v = C.card_values(d, texts, ("id", "geo"), least=5).first().asDict()
    assert v["rows"] == "10" and v["articles"] == "5" and v["articles_percent"] == "50.0" and v["m_id"] == "5" and v["m_geo"] == "0" and v["closed"] == "1" and v["private"] == "0" and v["states"] == "2"
    assert v["coverage_low"] == "40.0% (Ohio) and 60.0% (XX)" == v["coverage_high"] and v["fetched"] == "2026-01-05 to 2026-03-02" and (v["median_articles"], v["median_records"]) == ("6", "5")
    empty = C.card_values(d.where("false"), texts, ("id",)).first()
    assert empty.rows == "0" and empty.coverage_low == "n/a" and empty.fetched == "n/a" and empty.median_articles == "n/a"
    assert C.render_card("---\n<!-- Template: x\ny -->\n@@rows@@ of @@rows@@ @@states@@", v) == "---\n10 of 10 2"
    with pytest.raises(ValueError, match="unfilled: other"):
        C.render_card("@@rows@@ @@other@@", v)
    t = spark.createDataFrame([("a", 0.12345, None), ("b", None, 3)], "n string, v double, k int")
    assert C.markdown_table(t) == "| n | v | k |\n|---|---|---|\n| a | 0.123 |  |\n| b |  | 3 |"
    with pytest.raises(ValueError, match="over 1 rows"):
        C.markdown_table(t, 1)
    path = str(tmp_path / "table")
    for n in (3, 7):
        writers.replace_table(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    with pytest.raises(Exception, match="stop"):
        writers.replace_table(spark.range(5).select(F.raise_error(F.lit("stop"))), path)
    assert spark.read.parquet(path).count() == 7


def test_plans_of_calls(spark):
    rows = spark.createDataFrame([(1,), (2,), (2,)], "i int")
    done = spark.createDataFrame([(1, "a", "facts", 0, None), (1, "a", None, 1, ""), (2, "b", "facts", 0, "timeout"), (9, "a", "facts", 0, None)], "i int, model string, task string, rep int, error string")
    todo = C.jobs(rows, "i", ["a", "b"], ["facts"], 2, done)
    assert {tuple(r) for r in todo.collect()} == {(2, "a", "facts", 0), (2, "a", "facts", 1), (1, "b", "facts", 0), (1, "b", "facts", 1), (2, "b", "facts", 0), (2, "b", "facts", 1)}
    assert {(r.model, r.calls, r.tokens_in) for r in C.estimate(todo).collect()} == {("a", 2, 700), ("b", 4, 1400)} and C.jobs(rows, "i", ["a"], ["t"], 3).count() == 6
    assert C.statuses("all") is C.statuses("") is C.statuses(None) is C.statuses("x, all") is None and C.statuses(" b ,a,") == ("a", "b")


def test_page_joins(spark):
    matches = spark.createDataFrame([("1", 11, 2), ("1", 10, 1), ("2", 12, 3), ("3", 99, 4)], "id string, page int, ordinal int")
    enriched = spark.createDataFrame([(10, "5", "c. 1950", "http://x"), (12, "x", "1600", "no"), (11, "9", "2000", None)], "page int, views string, founded string, website string")
    p = {r.id: r for r in C.prominence(matches, enriched, spark.createDataFrame([(10, 7), (10, 3), (12, 0)], "page int, chars int")).collect()}
    assert (p["1"].views, p["1"].age, p["1"].has_website) == (5.0, 76, True) and p["1"].log_chars == pytest.approx(1.9459, abs=1e-4)
    assert (p["2"].views, p["2"].age, p["2"].log_chars, p["2"].has_website) == (None, None, None, False) and p["3"].views is None and p["3"].has_website is False
    items = spark.createDataFrame([("Q1", "school", "1950", "ftp://x", 1), ("Q1", "school", "x1", "https://y", 2), ("Q1", "defunct", "1", "", 3), ("Q2", "defunct", "1", "", 4), ("", "school", "1", "", 5)], "qid string, tag string, founded string, website string, ordinal int")
    m = spark.createDataFrame([("a", "Q1", "id", 1), ("a", "Q2", "id", 2), ("b", "Q1", "geo", 3), ("c", "", "id", 4)], "id string, qid string, method string, ordinal int")
    assert [tuple(r) for r in C.entity_facts(m, items).collect()] == [("a", '{"q":"Q1","u":"https://y"}')]


def test_phrases_in_one_pass(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab c") for _ in range(60)) for _ in range(50)] + [None, ""]
    asked = ["a", "aa", "aba", "b c", "zz", "", None, "aa"]
    d = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    p = spark.createDataFrame([(x,) for x in asked], "phrase string")
    want = {x: n for x in asked if x and (n := sum(t.count(x) for t in texts if t))}
    for group in (100, 2):
        assert {r.phrase: r.n for r in phrases.count_phrases(d, p, group=group).collect()} == want


def test_phrases_in_parts_without_any(spark):
    """Parts whose texts hold no phrase, or that have no text, send nothing."""
    d = spark.createDataFrame([("red sun",), ("blue moon",), (None,)], "text string")
    d = d.where("text = 'red sun'").coalesce(1).union(d.where("text is null or text = 'blue moon'").coalesce(1)).union(d.where("text = 'none'").coalesce(1))
    p = spark.createDataFrame([("red",)], "phrase string")
    assert [tuple(r) for r in phrases.count_phrases(d, p).collect()] == [("red", 1)]
    assert phrases.count_phrases(d, p.where("phrase = ''")).collect() == []
