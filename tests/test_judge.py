import json

from pyspark.sql import functions as F

from tallyloom.functions import judge as J


def test_mock_replies_and_marks(spark):
    said = ["", None, "I do not know: UNKNOWN", "A fine school.", "Founded 1897, it won two titles in 2029 and a program", "year 2031, programs, 18990", "well-regarded"]
    d = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select("i", J.mock_reply(F.col("s")).alias("reply"))
    got = {r.i: json.loads(r.reply) for r in d.collect()}
    assert [(got[i]["halluc"], got[i]["unverifiable_specific"], got[i]["sentiment"]) for i in range(7)] == [(0, 0, 0), (0, 0, 0), (0, 0, 0), (1, 0, 0), (2, 4, 1), (1, 0, 0), (1, 0, 1)]
    assert list(got[0]) == list(J.MARKS)


def test_replies_in_free_text(spark):
    rows = [("so:\n{\"halluc\": 2,\n\"sentiment\": -1} ok", "old"), ("none", "old"), ("{a} and {b}", "old"), ("{\"sentiment\": 1}", "old"), (None, None), ("{\"halluc\": \"many\"}", "old"), ("{\"halluc\": 1} or {\"halluc\": 2}", "old"), ("{\"halluc\": 1}, {\"halluc\": 2}", "old")]
    d = J.with_marks(spark.createDataFrame(rows, "reply string, Halluc string"), "reply")
    got = d.collect()
    assert [(r[d.columns.index("halluc")], r.sentiment, r.judge_error) for r in got] == [(2, -1, None), (None, None, "no object"), (None, None, "not JSON"), (None, 1, "no mark"), (None, None, "no object"), (None, None, "no mark"), (None, None, "not JSON"), (None, None, "not JSON")]
    assert "_Halluc" in d.columns and got[0]["_Halluc"] == "old"
    assert J.with_marks(spark.createDataFrame([], "reply string"), "reply").count() == 0


def test_only_that_very_answer_is_judged(spark):
    r = spark.createDataFrame([("m", "1", "D1: a school"), ("m", "2", "D1: new words"), ("m", "3", "no label"), ("m", "4", None), (None, "1", "D1: a school"), ("m", "1", "D1: a school")], "model string, id string, text string")
    first = J.pending(r, None, ["model", "id"])
    assert [x.answer for x in first.collect()] == ["a school", "new words", "", "", "a school", "a school"]
    of = {x.id: x.answer_hash for x in first.where("model = 'm'").collect()}
    judged = spark.createDataFrame([("m", "1", of["1"], 1), ("m", "2", of["1"], 1), ("m", "3", of["3"], None), ("m", "4", of["4"], 0)], "model string, id string, answer_hash string, halluc int")
    assert sorted((str(x.model), x.id) for x in J.pending(r, judged, ["model", "id"]).collect()) == [("None", "1"), ("m", "2"), ("m", "3")]


def test_prompt(spark):
    t = {"name": "Hope High", "city": "Troy", "state": "Ohio", "sector": "public", "level": "high", "enrollment": 12.7, "district": "Troy City", "charter": False, "religion": None}
    d = spark.createDataFrame([tuple(t.values())], "name string, city string, state string, sector string, level string, enrollment double, district string, charter boolean, religion string")
    c = {k: F.col(k) for k in t}
    known = J.facts(c)
    got = d.select(known.alias("f"), J.prompt(known, F.lit("")).alias("p"), J.facts({**c, "sector": F.lit("private"), "religion": F.lit("Catholic")}).alias("q")).first()
    assert got.f == "School: Hope High, Troy, Ohio\nSector: public\nLevel: high\nEnrollment: 12\nDistrict: Troy City\nCharter: no"
    assert got.q.split("\n")[-1] == "Religious affiliation: Catholic" and got.f in got.p and '"""(empty)"""' in got.p and "{" not in got.p
