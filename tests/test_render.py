from pyspark.sql import functions as F

from tallyloom.functions import text as X


def test_sections_and_sentences(spark):
    t = "Lead.\n== History ==\nOld.\n== References ==\nr1\n=== Sub ===\nr2\n== Life ==\nNew.\nx = y"
    d = spark.createDataFrame([(1, t, 60.0, 30.5, None), (2, None, 0.0, 100.0, 0.0), (3, "", 0.0, 0.0, 0.0)], "i int, t string, a double, b double, c double")
    shares = X.shares_text(["a", "b", "c"], [F.col("b"), F.col("a"), F.col("c")])
    out = d.select(X.strip_sections(F.col("t"), ["references"]).alias("s"), shares.alias("p"), X.clauses(F.lit("One ,"), F.concat(F.lit("two "), shares), F.lit("three.")).alias("c"), X.thousands(F.col("i") * 1234567).alias("k")).collect()
    assert out[0].s == "Lead.\nOld.\nNew.\nx = y" and out[1].s == ""
    assert [r.p for r in out] == ["60% b and 30.5% a", "100% a", None]
    assert out[0].c == "One, two 60% b and 30.5% a three." and out[2].c == "One, three."
    assert out[0].k == "1,234,567"
    assert spark.range(1).select(X.oxford(F.array(*map(F.lit, "abc"))).alias("x")).first().x == "a, b, and c"
