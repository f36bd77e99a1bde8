import duckdb
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import build as B
from tallyloom.plans.civic import CLOSED, OPENING
from tallyloom.plans.registry import ORACLES


def test_count_text(spark):
    d = spark.createDataFrame([("348",), ("16.5",), ("-1",), ("x",), (None,), ("0",)], "c string")
    assert [r[0] for r in d.select(B.count_text(F.col("c"))).collect()] == ["348", "16.50", "", "", "", "0"]


def test_public_build(spark):
    directory = spark.createDataFrame([("a", 1, "Open", "PK", "N", "Yes", "Regular School", "BI", "SD"), ("b", 2, "Closed", "01", "05", "No", "x", "AL", ""), ("c", 3, "New", "M", "12", "Not applicable", None, "AL", None)], "school string, ordinal int, status string, low string, high string, charter string, type string, state string, location_state string")
    members = spark.createDataFrame([("a", 1, "x", "1", B.TOTAL), ("a", 2, "x", "348", B.TOTAL), ("a", 3, B.ADULT, "347", "Subtotal 4 - By Grade"), ("c", 4, "x", "0", B.TOTAL)], "school string, ordinal int, grade string, count string, indicator string")
    staff = spark.createDataFrame([("a", 1, "4", B.TOTAL), ("c", 2, "13", B.TOTAL)], "school string, ordinal int, teachers string, indicator string")
    lunch = spark.createDataFrame([("a", 1, "x", B.FREE, "5"), ("a", 2, B.DIRECT, B.FREE, "7"), ("a", 3, "x", B.REDUCED, "-9")], "school string, ordinal int, data_group string, program string, count string")
    places = spark.createDataFrame([("a", 1, " 41 ", "Doña Ana", "1", "2")], "school string, ordinal int, locale string, county string, lat string, lon string")
    out = {r.school: r for r in B.public_build(directory, members, staff, lunch, places).collect()}
    assert set(out) == {"a", "c"}
    a, c = out["a"], out["c"]
    assert (a.students, a.teachers, a.ratio, a.free, a.reduced, a.direct) == ("1", "4", "0.25", "5", "", "7")
    assert (a.state, a.county, a.locale_code, a.locale, a.low_grade, a.high_grade, a.charter, a.type) == ("SD", "Doña Ana", "41", "Rural, Fringe", "PK", "", "Yes", "Regular")
    assert (c.students, c.ratio, c.state, c.charter, c.low_grade, c.county, c.type) == ("0", "", "AL", "", "", "", "")
    assert B.skipped_by_status(directory).collect()[0]["status"] == "Closed"


def test_gate(spark):
    generated = spark.createDataFrame([(i, f"School {i}", "AL", "public", "A school.") for i in range(8)], "id int, name string, state string, sector string, text string")
    matches = spark.createDataFrame([(1, 11, "Troy High School", "Q1"), (2, 12, "T2", "Q2"), (3, 13, "T3", "Q3"), (4, 14, "T4", "Q4"), (5, 15, "T5", "Q5")], "id int, page int, title string, qid string")
    texts = spark.createDataFrame([(11, None, "Troy is a school. " * 5, 7), (12, "T2", "short", 7), (13, "T3", "It was a school. " * 5, 7), (15, "T5", "It is a school with [[links]]. " * 4, 7)], "page int, title string, text string, revision int")
    rows = B.release_rows(generated, matches, texts, 20)
    got = {r.id: (r.from_article, r.reason, r.title, r.source) for r in rows.collect()}
    assert got[1] == (1, "", "Troy High School", B.PAGE + "Troy_High_School") and [got[i][1] for i in (0, 2, 3, 4)] == ["", "short_text", "closed_school", "no_text"]
    spans = spark.createDataFrame([(1, ["elementary"]), (5, ["high"])], "id int, span_levels array<string>")
    report = {r.check: r for r in B.release_gate(rows, spans, expect=8, baseline=rows, card="---\n8 rows").collect()}
    assert {k for k, r in report.items() if not r.ok} == {"no_markup", "level_fits"}
    assert report["level_fits"].examples == ["1"] and report["no_markup"].n_bad == 1


def test_gate_counts_null_states_and_rows_once(spark):
    rows = B.release_rows(spark.createDataFrame([(i, "n", None if i < 30 else "AL", "public", "") for i in range(60)], "id int, name string, state string, sector string, text string"), spark.createDataFrame([], "id int, page int, title string, qid string"), spark.createDataFrame([], "page int, title string, text string, revision int"), 20)
    spans = spark.createDataFrame([(1, ["high"]), (1, ["middle"]), (1, None)], "id int, span_levels array<string>")
    report = {r.check: r for r in B.release_gate(rows, spans, baseline=rows).collect()}
    assert report["state_counts"].ok and report["text_present"].n_bad == 60
    report = {r.check: r for r in B.release_gate(rows, spans, baseline=rows.where("id % 2 = 0 or state is not null")).collect()}
    assert report["state_counts"].examples == ["none 15 -> 30"]


OPENINGS = ["Was the school of Troy, and that for long.", "It WERE a mill, then it was THE school.", "Was a school; it Is a school.", "It is the school of Troy, no more."]


def _opened(spark):
    generated = spark.createDataFrame([(i, f"School {i}", "AL", "public", "A school.") for i in range(4)], "id int, name string, state string, sector string, text string")
    matches = spark.createDataFrame([(i, i, f"T{i}", "Q1") for i in range(4)], "id int, page int, title string, qid string")
    texts = spark.createDataFrame([(i, None, x + " [[x]]", 7) for i, x in enumerate(OPENINGS)], "page int, title string, text string, revision int")
    return B.release_rows(generated, matches, texts, 20)


def test_closed_opening_in_capitals_supplies_no_text(spark):
    assert [r.reason for r in _opened(spark).orderBy("id").collect()] == ["closed_school", "closed_school", "", ""]


def test_gate_sees_no_text_of_closed_schools(spark):
    spans = spark.createDataFrame([(i, ["high"]) for i in range(4)], "id int, span_levels array<string>")
    report = {r.check: r for r in B.release_gate(_opened(spark), spans).collect()}
    assert (report["no_markup"].n_bad, report["no_markup"].examples) == (2, ["2", "3"])


def test_openings_of_any_language_in_spark_and_sql(spark):
    """Accented letters belong to words, and any space parts them, for the operator and for the SQL of release_rows and release_gate."""
    said = {
        "It was a school": True, "It WAS\u00a0a school": True, "It was\x0ba school": True, "It waſ a school": True, "Oak Jr. Hall was the school": True, "A.B.C. was a school": True, "It was a": True, "école. It was a school": False,
        "It was añejo": False, "It était was aérien": False, "Éwas a school": False, "PROGRÈS. It was a school": False, "It was a school and ís a ruin": True, "It was a school and is\u2003a ruin": False, ("x" * 199) + " was a school": True, ("x" * 200) + " was a school": False,
    }
    d = spark.createDataFrame([(x,) for x in said], "page_text string")
    assert {r[0]: r[1] for r in d.select("page_text", X.closed_opening(F.col("page_text"), any_case=True)).collect()} == said
    values = ", ".join("(?)" for _ in said)
    rows = duckdb.execute(f"SELECT page_text, {CLOSED} FROM (SELECT *, {OPENING} AS o FROM (VALUES {values}) t(page_text))", [*said]).fetchall()
    assert dict(rows) == said


def test_gate_counts_are_longs_in_sql_too():
    """A HUGEINT would be written as a double."""
    db = duckdb.connect()
    db.execute("CREATE TABLE documents AS SELECT 1::BIGINT AS doc_id, 'It was a school.' AS text; CREATE TABLE labels AS SELECT 1::BIGINT AS doc_id")
    assert [(r[0], r[1]) for r in db.execute(f"DESCRIBE {ORACLES['release_gate']}").fetchall()] == [("check", "VARCHAR"), ("ok", "BOOLEAN"), ("n_bad", "BIGINT"), ("n_examples", "BIGINT")]
