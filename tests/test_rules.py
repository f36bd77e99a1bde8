from pyspark.sql import functions as F

from tallyloom.operators import rules as R

FIELDS = "i int, title string, state string, description string, lead string, instance_of array<string>, wikidata_qid string, country string, dissolved string, defunct_category string, crawl_validation string, validation string"


def rec(i, **k):
    base = {"title": "Troy School", "state": "Ohio", "description": "", "lead": "Troy School is a school in Ohio.", "instance_of": ["high school"], "wikidata_qid": "Q1", "country": "", "dissolved": "", "defunct_category": "", "crawl_validation": "school", "validation": "x"}
    base.update(k)
    return (i, *base.values())


def test_classify(spark):
    rows = [("", ["high school"], None), ("Q1", [], None), ("Q1", ["high school", "university"], None), ("Q1", ["high school"], "1999"), ("Q1", ["school district"], None), ("Q1", ["bridge"], None), ("Q1", ["school shooting"], None)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q string, l array<string>, d string")
    got = [r.t for r in d.select("i", R.classify(F.col("q"), F.col("l"), F.col("d")).alias("t")).orderBy("i").collect()]
    assert got == ["unverified", "unverified", "school", "defunct", "out_of_scope", "non_school", "non_school"]


def test_tense(spark):
    more = [("X, which was founded in 1950, is a public school.", "present"), ("X is a defunct school.", "past"), ("X is a historic school.", ""), ("X is a historic school building in Ohio.", "past"), ("The X, at 7th and Elm, was built in 1929. It is on the National Register.", "past"), ("R. J. Neutra School is a school", "present"), ("Mt. Troy was the school of Mr. Y. It is a park now.", "past")]
    d = spark.createDataFrame(more, "t string, want string")
    assert d.where(R.tense(F.col("t")) != F.col("want")).count() == 0
    rows = ["X is a school.", "X was a school that is now a park.", "X is a school that was a mill.", "X is a former school.", "X is a historic place.", "St. X (was y) is a school.", "Nothing here.", None]
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    assert [r.t for r in d.select("i", R.tense(F.col("t")).alias("t")).orderBy("i").collect()] == ["present", "past", "present", "past", "", "present", "", ""]


def test_head_nouns(spark):
    rows = [("X is a public charter school network in Ohio.", "school network"), ("X is a public high school in the Troy school district.", "school"), ("X is a Dallas ISD (DISD) magnet high school located in Troy.", "school"), ("X is a network of charter schools.", "network"), ("X is a part of the Troy School District.", ""), ("X was a school.", ""), (None, "")]
    d = spark.createDataFrame(rows, "t string, want string")
    assert d.where(R.head_noun(F.col("t")) != F.col("want")).count() == 0
    assert [r[0] for r in d.select(R.names_network(F.col("t"))).collect()] == [True, False, False, True, False, False, False]
    d = spark.createDataFrame([(["Schools in Ohio", "Defunct high schools in Ohio"],), (["Former girls' schools"],), (["Schools disestablished in 1971"],)], "c array<string>")
    assert [r[0] for r in d.select(R.defunct_category(F.col("c"))).collect()] == ["Defunct high schools in Ohio", "", "Schools disestablished in 1971"]


def test_revalidate_first_rule_and_twice_the_same(spark):
    rows = [
        rec(0),
        rec(1, lead="A magnet is a type of school."),
        rec(2, crawl_validation="unverified", country="Canada", state="", lead=""),
        rec(3, instance_of=["university"], description="university in Ohio", lead=""),
        rec(4, defunct_category="Defunct schools in Ohio", lead="Troy School was a school."),
        rec(5, crawl_validation="non_school"),
        rec(6, crawl_validation="unverified", description="public school in Ohio", lead="", instance_of=None),
        rec(7, title="Troy Schools", lead="Troy Schools is a system of campuses."),
        rec(8, crawl_validation=None, validation=None, lead=None, description=None, instance_of=None),
    ]
    once = R.revalidate(spark.createDataFrame(rows, FIELDS))
    got = {r.i: (r.validation, r.validation_note, r.operating) for r in once.collect()}
    assert got[0] == ("school", "", "yes") and got[1][:2] == ("non_school", "kind_of") and got[2][:2] == ("out_of_scope", "abroad")
    assert got[3][:2] == ("out_of_scope", "higher") and got[4] == ("defunct", "closed", "no") and got[5][:2] == ("school", "rescued")
    assert got[6] == ("school", "described", "yes") and got[7][:2] == ("out_of_scope", "plural") and got[8][:2] == (None, "")
    again = {r.i: (r.validation, r.validation_note, r.operating) for r in R.revalidate(once).collect()}
    assert again == got
    assert sum(r["count"] for r in R.changes(once, once, "i", "validation").collect()) == len(rows)
    more = [rec(0, state="", description="public school in Talladega, Alabama"), rec(1, title="Lenape High School", lead="Lenape High School is a public high school and school district.", description="school district in Sussex"), rec(2, lead="X was a school.")]
    out = {r.i: r for r in R.revalidate(spark.createDataFrame(more, FIELDS)).collect()}
    assert (out[0].state, out[0].validation_note) == ("Alabama", "state from description")
    assert out[1].validation == "school" and out[2].operating == "no" and out[2].validation == "school"


def test_higher_education_is_judged_at_the_word(spark):
    """What stands before a word of higher education doesn't count, what follows it does; the types are one text."""
    rows = [
        rec(0, description="preparatory college in Ohio", lead="", instance_of=["place"]),
        rec(1, crawl_validation="unverified", description="K-12 school and college", lead="", instance_of=["place"]),
        rec(2, description="", lead="", instance_of=["university", "prep institution"]),
        rec(3, description="college of a high school", lead="", instance_of=["place"]),
        rec(4, description="", lead="", instance_of=["prep institution", "university"]),
        rec(5, description="college prep school", lead="", instance_of=["place"]),
    ]
    got = {r.i: (r.validation, r.validation_note) for r in R.revalidate(spark.createDataFrame(rows, FIELDS)).collect()}
    assert got[0] == ("out_of_scope", "higher") and got[1] == ("unverified", "") and got[2][0] == "school"
    assert got[3][0] == "school" and got[4] == ("out_of_scope", "higher") and got[5][0] == "school"
