import pytest
from pyspark.sql import functions as F

from tallyloom.functions import answers as A

FRAME = "id int, sector string, charter boolean, level string, level_alt string, religion string, district string, lo int, hi int, enrollment double"
TEXT = "A1: Public\n**A2**: Troy Unified School District\nA3: high school\nA4: none\nA5: 9-12\nA6: (B) 200-499\nA7: No\nD1: A school.\nIt is old."


def test_labelled_lines(spark):
    d = spark.createDataFrame([(TEXT,), ("Q1) x\nno label\nA2 - y\nA2: z",), (None,)], "t string").select(A.labelled_lines(F.col("t")).alias("e"))
    rows = [dict((x.k, x.v) for x in r.e) for r in d.collect()]
    assert rows[0]["a1"] == "Public" and rows[0]["a2"] == "Troy Unified School District" and rows[0]["d1"] == "A school.\nIt is old."
    assert rows[1] == {"q1": "x\nno label", "a2": "z"} and rows[2] == {}


def test_outcomes(spark):
    frame = spark.createDataFrame([(1, "public", False, "high", None, "none", "Troy Unif Sch Dist", 9, 12, 300.0), (2, "private", None, "combined", "high", "catholic", None, -1, 8, 50.0), (3, "public", True, "elementary", None, None, "X", 0, 5, 999.0)], FRAME)
    two = "A1: I don't know\nA2: x\nA3: HIGH\nA4: Catholic\nA5: K to 8\nA6: D\nA7: yes"
    three = "A1: private\nA2: x\nA3: huh\nA4: NONE\nA5: 5\nA6: unknown\nA7: YES"
    d = spark.createDataFrame([(1, "m", 0, TEXT, None), (2, "m", None, two, None), (3, "m", 0, three, ""), (3, "m", 1, None, None), (3, "m", 2, TEXT, "timeout"), (9, "m", 0, TEXT, None)], "id int, model string, rep int, text string, error string")
    got = {(r.id, r.rep): [r[f"o_{i}"] for i in A.ITEMS] + [r.d1_words] for r in A.score_all(d, frame).collect()}
    assert got == {
        (1, 0): ["correct", "correct", "correct", "NA", "correct", "correct", "correct", 5],
        (2, 0): ["abstain", "NA", "correct", "correct", "correct", "wrong", "NA", 0],
        (3, 0): ["wrong", "NA", "unparsed", "NA", "unparsed", "abstain", "correct", 0],
        (3, 1): ["unparsed", "NA", "unparsed", "NA", "unparsed", "unparsed", "unparsed", 0],
    }


@pytest.mark.parametrize("rows", [[("Troy ISD", "Troy Independent School District", True), ("NYC Dept of Education", "New York City Geographic District # 2", True), ("Springfeld Heights", "Springfield Heights School District", True), ("Albany", "Troy", False), ("School District", "Troy", False), ("Troy", None, False)]])
def test_districts(spark, rows):
    d = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert d.select("a", "want", A.district_match(F.col("a"), F.col("b")).alias("got")).where("got <> want").count() == 0


def test_small_parsers(spark):
    d = spark.createDataFrame([("B0: 4\nB1: 7.5 of 10\nB2: 11\nB6: fine", "Y: founded 1921 | confidence: 120 | basis: (b)\nM: Lions | conf=7", "1: A\n2) (c)\n3 - d\n3: B")], "b string, y string, m string")
    r = d.select(*[c.alias(n) for n, c in A.bias_scores(F.col("b")).items()], A.direct_answer(F.col("y"), "Y", year=True).alias("y"), A.direct_answer(F.col("y"), "M").alias("m"), A.direct_answer(F.col("y"), "C").alias("c"), A.letter_picks(F.col("m")).alias("p")).first()
    assert (r.familiarity, r.academic, r.safety, r.resources, r.text) == (4.0, 7.5, None, None, "fine")
    assert tuple(r.y) == ("1921", 100, "B") and tuple(r.m) == ("Lions", 7, None) and r.c is None
    assert [tuple(p) for p in r.p] == [(1, "A"), (2, "C"), (3, "D"), (3, "B")]
    assert d.select(A.choice_accuracy(A.letter_picks(F.col("m")), F.array(*[F.lit(x) for x in "ABBD"]))).first()[0] == 0.5
