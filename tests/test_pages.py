"""Page texts and checks, and the pools and gains of the exposure study, on small rows."""

from pyspark.sql import functions as F

from tallyloom.functions import pages as P
from tallyloom.operators import exposure as X


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_colours_and_checks(spark):
    share = F.lit(0.05)
    assert one(spark, P.ramp(share), P.ramp(share, "middle"), P.ramp(F.lit(0.9)), P.ramp(F.lit(None).cast("double"))) == ([215, 48, 39], [102, 189, 99], [26, 152, 80], None)
    none = F.lit(None).cast("string")
    assert one(spark, P.is_url(none), P.is_url(F.lit("a.org")), P.is_mail(F.lit("a@b.c")), P.is_mail(none), P.with_scheme(F.lit(" a.org "))) == (False, True, True, False, "https://a.org")
    texts = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    cases = [(texts(), texts(), False), (texts(" ", None), texts("a.org"), True), (texts("a.org"), texts("x"), False), (texts("x"), texts(), False), (texts("a.org"), texts(None), False)]
    assert one(spark, *[P.can_submit(s, f) for s, f, _ in cases]) == tuple(x for *_, x in cases)


def test_description(spark):
    null = F.lit(None)
    d = {"name": F.lit("Troy"), "sector": P.sector_label(F.lit(False), F.lit("Yes")), "level": F.lit("high"), "city": F.lit("Troy"), "state": F.lit("Ohio"), "district": F.lit("Troy City"), "grades": P.grade_range(F.lit("9"), F.lit("12")), "enrollment": F.lit(1200)}
    bare = d | {"level": F.lit("other"), "district": null.cast("string"), "grades": P.grade_range(null.cast("string"), F.lit("12")), "enrollment": null.cast("int")}
    assert one(spark, P.describe(d, F.lit("2024")), P.describe(bare, F.lit("2024"))) == (
        "Troy is a public charter high school in Troy, Ohio, in the Troy City district. It serves grades 9 through 12 and enrolls 1,200 students (2024).",
        "Troy is a public charter school in Troy, Ohio.",
    )


def test_pool_has_equal_sides_and_breaks_ties_by_key(spark):
    rows = [(1, "2024-01-09", 1), (2, "2024-01-08", 5), (3, "2024-01-08", 9), (4, "2024-01-08", 7), (5, "2024-02-01", 2), (6, "2024-02-02", 3), (7, None, 8), (8, "2020-01-01", None)]
    d = spark.createDataFrame(rows, "id int, day string, seen int").withColumn("day", F.to_date("day"))
    got = {(r.id, r.group) for r in X.exposure_pool(d, key="id", created="day", views="seen", cutoff="2024-01-10", famous=2).collect()}
    assert got == {(5, "unexposed"), (6, "unexposed"), (1, "exposed"), (2, "exposed"), (3, "famous"), (7, "famous")}
    assert X.exposure_pool(d.limit(0), key="id", created="day", views="seen", cutoff="2024-01-10").count() == 0


def test_gate_gains_letters_and_maps(spark):
    d = spark.createDataFrame([("f", 1900, 1901), ("f", 1950, 1950), ("e", 1990, 1900), ("e", 2000, None)], "g string, t int, s int")
    got = {r.group: (r.n, r.error, r.guess_error, r.ok) for r in X.control_gate(d, group="g", truth="t", given="s", reference=["e"], control="f").collect()}
    assert got == {"f": (2, 0.5, 65.0, True), "e": (1, 90.0, 0.0, None)}
    d = spark.createDataFrame([("m", "real", 1), ("m", "masked", 0), ("n", "real", 1)], "model string, tag string, ok int")
    got = {tuple(r) for r in X.gains(d, by=["model"], condition="tag", value="ok", low="masked", high="real").collect()}
    assert got == {("m", 0.0, 1.0, 1.0), ("n", None, 1.0, None)}
    letters = X.letter_shares(spark.createDataFrame([("AAB-",), (None,)], "x string"), "x").collect()
    assert [(r.letter, r.n) for r in letters] == [("A", 2), ("B", 1), ("C", 0), ("D", 0)]
    assert all(r.share == 0 for r in X.letter_shares(spark.createDataFrame([], "x string"), "x").collect())
    d = spark.createDataFrame([("r", "b", 1), ("r", "a", 2)], "by string, name string, n int")
    assert X.compact_map(d, by="by", name="name", values=["n"]).first().json == '{"a":[2],"b":[1]}'
