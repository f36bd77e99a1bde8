from pyspark.sql import functions as F

from tallyloom.functions import schools as H
from tallyloom.operators import matching as M

R = "record_id string, name string, state string, city string, county string, lo string, hi string, lat double, lon double, ordinal int"
A = "article_id int, title string, state string, level string, given_id string, lat string, lon string"

#: (records: id, name, state, city, low, high, lat, lon), article (title, state, more), expected (id, method)
CASES = [
    ([("1", "Troy Elementary School", "AL", "troy", "KG", "05")], ("Troy High School (Alabama)", "Alabama"), None),
    ([("1", "Troy Elementary School", "AL", "troy", "KG", "05"), ("2", "Troy High School", "AL", "troy", "09", "12")], ("Troy High School (Alabama)", "Alabama"), ("2", "name_state")),
    ([("1", "Hope Academy", "TX", "la joya", "09", "12")], ("Hope High School (Port Lavaca, Texas)", "Texas"), None),
    ([("1", "Lincoln High School", "AL", "mobile", "09", "12"), ("2", "Lincoln High School", "AL", "talladega", "09", "12")], ("Lincoln High School (Talladega, Alabama)", "Alabama"), ("2", "name_state")),
    ([("1", "Notre Dame School", "NY", "new hyde park", "KG", "08")], ("Notre Dame School (Albany, New York)", "New York"), None),
    ([("1", "Albertville Middle", "AL", "albertville", "07", "08")], ("Whatever Title", "Alabama", {"given_id": "1"}), ("1", "id")),
    ([("1", "Oak Hill Academy", "MS", "west point", "PK", "08")], ("Oak Hill Academy", "Mississippi", {"level": "high"}), ("1", "name_state")),
    ([("1", "Bridges Academy", "CA", "san jose", "KG", "12"), ("2", "Bridges Academy", "CA", "studio city", "KG", "12")], ("Bridges Academy", "California"), None),
    ([("1", "Bridges Academy", "CA", "san jose", "KG", "12", 37.33, -121.89), ("2", "Bridges Academy", "CA", "studio city", "KG", "12", 34.14, -118.39)], ("Bridges Academy", "California", {"lat": "34.15", "lon": "-118.40"}), ("2", "name_state")),
    ([("1", "Bridges Academy", "CA", "san jose", "KG", "12", 37.33, -121.89), ("2", "Bridges Academy", "CA", "studio city", "KG", "12", 34.14, -118.39)], ("Bridges Academy", "California", {"lat": "40.0", "lon": "-100.0"}), None),
    ([("1", "Bailey Apac Middle School", "MS", "jackson", "06", "08"), ("2", "Bailey Magnet High School", "MS", "jackson", "09", "12")], ("Bailey Magnet High School", "Mississippi", {"given_id": "1"}), ("2", "name_state")),
    ([("1", "Blue Valley Virtual Program", "KS", "overland park", "09", "12")], ("Blue Valley Academy", "Kansas"), None),
    ([("1", "Chandler Park Academy High School", "MI", "harper woods", "09", "12")], ("Chandler Park Academy", "Michigan"), ("1", "fuzzy")),
    ([("1", "Career Academy at Truman High School", "MO", "independence", "09", "12")], ("Harry S. Truman High School (Independence, Missouri)", "Missouri"), None),
    ([("1", "St. Paul City High School", "MN", "saint paul", "09", "12")], ("Saint Paul Preparatory School", "Minnesota"), None),
    ([("1", "Yreka High", "CA", "yreka", "09", "12")], ("Yreka High School", "California"), ("1", "fuzzy")),
    ([("120000300123", "Salem Grove High", "FL", "ocala", "09", "12")], ("Salem Grove High School (Ocala)", "Florida", {"given_id": "129999900123"}), ("120000300123", "id_stale")),
    ([("1", "Premier High School Wichita Falls", "TX", "wichita falls", "09", "12", 33.90, -98.50)], ("Wichita Falls Senior Center", "Texas", {"lat": "33.901", "lon": "-98.501"}), None),
    ([("1", "Carver Lane Elementary", "GA", "macon", "KG", "05", 32.80, -83.60)], ("Carver Lane Hill Elementary School", "Georgia", {"lat": "32.801", "lon": "-83.601"}), ("1", "geo")),
]


def tag(i, record):
    return record if len(record) == 12 else f"{i}:{record}"


def test_cases(spark):
    """Each case is a state of its own."""
    records, articles = [], []
    for i, (recs, art, _) in enumerate(CASES):
        for j, r in enumerate(recs):
            r = (*r, None, None)[:8]
            records.append((tag(i, r[0]), r[1], str(i), r[3], "", *r[4:], j))
        more = art[2] if len(art) > 2 else {}
        articles.append((i, art[0], str(i), more.get("level", ""), tag(i, more["given_id"]) if "given_id" in more else "", more.get("lat"), more.get("lon")))
    r = spark.createDataFrame(records, R).withColumn("span_levels", H.span_levels(H.public_grade(F.col("lo")), H.public_grade(F.col("hi"))))
    a = spark.createDataFrame(articles, A)
    states = a.select("article_id", F.col("state").alias("w_state"))
    r = M.prepare_records(r).drop("state").join(r.select("record_id", "state"), "record_id")
    out = {x.article_id: (x.record_id, x.method) for x in M.match(M.prepare_articles(a).drop("w_state").join(states, "article_id"), r).collect()}
    assert out == {i: (tag(i, c[2][0]), c[2][1]) for i, c in enumerate(CASES) if c[2]}


def test_cities(spark):
    rows = [("st. george", "st george", True), ("new york city", "new york", True), ("queens", "astoria", True), ("bloomfield township", "bloomfield hills", True), ("port lavaca", "la joya", False), ("encino", "el cajon", False), ("north bend", "north hills", False), ("", "anywhere", True), (None, "x", True)]
    d = spark.createDataFrame(rows, "a string, b string, ok boolean")
    assert d.where(H.city_compatible(F.col("a"), F.col("b")) != F.col("ok")).count() == 0


def test_states_levels_and_titles(spark):
    d = spark.createDataFrame([("ca",), ("West Virginia",), ("Washington, D.C.",), ("Narnia",), (None,)], "s string")
    assert [r[0] for r in d.select(H.state_code(F.col("s"))).collect()] == ["CA", "WV", "DC", "", ""]
    t = spark.createDataFrame([("a school in Charleston, West Virginia",), ("in Arkansas",), ("Washington D.C. school",), ("nowhere",), (None,)], "s string")
    assert [r[0] for r in t.select(H.state_in_text(F.col("s"))).collect()] == ["West Virginia", "Arkansas", "District of Columbia", "", ""]
    n = spark.createDataFrame([("north middle high school",), ("gateway middle college",), ("pine crest school",), (None,)], "s string")
    assert [sorted(r[0]) for r in n.select(H.name_levels(F.col("s"))).collect()] == [["high", "middle"], [], [], []]
    c = spark.createDataFrame([("X (Georgia)",), ("X (Macon, Georgia)",), ("X (Macon)",), ("X (high school)",), ("X (1990)",), ("X",), (None,)], "s string")
    assert [r[0] for r in c.select(H.explicit_city(F.col("s"))).collect()] == ["", "macon", "macon", "", "", "", ""]
    g = spark.createDataFrame([("PK", "05"), ("06", "12"), ("UG", "UG"), ("09", "08"), (None, "12")], "lo string, hi string")
    assert [r[0] for r in g.select(H.span_levels(H.public_grade(F.col("lo")), H.public_grade(F.col("hi")))).collect()] == [["elementary"], ["middle", "high"], [], [], []]
    rows = [("Template:X", "", True), ("Troy (film)", "", True), ("Grace Church", "", True), ("Grace Church School", "", False), ("Troy School", "Schools accredited by Y", True), (None, None, False)]
    d = spark.createDataFrame(rows, "t string, c string, want boolean")
    assert d.where(H.title_dropped(F.col("t"), F.col("c")) != F.col("want")).count() == 0
    rows = [("Category:High schools in Ohio", True), ("Category:Art schools in Ohio", False), ("Category:Heart schools", True), ("Category:College preparatory schools", True), ("Category:Collegiate colleges school", False), ("Category:Defunct schools", False), ("Category:Films about school", False), ("Category:Bridges", False)]
    d = spark.createDataFrame(rows, "t string, want boolean")
    assert d.where(H.descends(F.col("t")) != F.col("want")).count() == 0


def test_articles_of_no_known_state_are_not_linked_by_name(spark):
    r = spark.createDataFrame([("1", "Chandler Park Academy", "", "", "", "09", "12", None, None, 0)], R).withColumn("span_levels", H.span_levels(H.public_grade(F.col("lo")), H.public_grade(F.col("hi"))))
    a = spark.createDataFrame([(0, "Chandler Park Academy", "Narnia", "", "", None, None), (1, "Chandler Park Academy", None, "", "1", None, None)], A)
    assert [(x.article_id, x.method) for x in M.match(M.prepare_articles(a), M.prepare_records(r)).collect()] == [(1, "id")]


def test_claims_and_reasons(spark):
    d = spark.createDataFrame([(1, "r", "geo", 99.0, 5), (2, "r", "fuzzy", 97.0, 1), (3, "r", "fuzzy", 97.0, 9), (4, "s", "id", 100.0, None), (5, "s", "id", 100.0, 3), (6, "s", "id", 100.0, 3)], "article_id int, record_id string, method string, score double, views int")
    assert {(x.record_id, x.article_id, x.n_losers) for x in M.resolve_claims(d, F.col("views")).collect()} == {("r", 3, 2), ("s", 5, 2)}
    why = spark.createDataFrame([("no", "Ohio"), ("yes", "Narnia"), ("yes", "OH"), (None, None)], "o string, s string")
    assert [x[0] for x in why.select(M.unmatched_reason(F.col("o"), F.col("s"))).collect()] == ["not_operating", "no_state", "no_record_or_variant_name", "no_state"]


def test_eligible_rows_and_levels_of_texts(spark):
    fields = "sector string, level string, locale string, enrollment int, city string, state string, type string, status string, hi int, lunch double, listed int, method string"
    good = ("public", "high", "city", 5, "troy", "OH", "Regular", "Open", 12, 0.5, 1, "id")
    put = lambda **k: tuple(k.get(n, v) for n, v in zip([f.split()[0] for f in fields.split(", ")], good))
    rows = [(good, True), (put(level=None), False), (put(city=""), False), (put(city=None), False), (put(state="PR"), False), (put(state=None), False), (put(type=None), False), (put(status="New"), False), (put(sector="private", type=None, status=None, lunch=None), True), (put(lunch=None), False), (put(method="geo"), False), (put(method=None), False), (put(listed=None, method=None), True), (put(sector=None, type="x"), True), (put(hi=None), False), (put(hi=11), False)]
    d = spark.createDataFrame([(*r, w) for r, w in rows], fields + ", want boolean")
    ok = H.eligible({c: F.col(c) for c in d.columns}, types=("Regular",), statuses=("Open",), methods=("id",), need_high=True)
    assert d.where(~(ok == F.col("want"))).count() == 0 and d.where(ok.isNull()).count() == 0
    t = spark.createDataFrame([("A Senior High in Ohio", "high"), ("junior high", "middle"), ("grammar school", "elementary"), ("a K–12 school", "combined"), ("a school", ""), (None, ""), ("middle school and high school", "high")], "t string, want string")
    assert t.where(H.text_level(F.col("t")) != F.col("want")).count() == 0


def alike(spark, name, title):
    """600 records of one name at two points and one near the pole, and 600 articles of one title at three points and none."""
    at = {0: (33.0, -86.0), 1: (34.0, -86.0)}
    r = spark.createDataFrame([(f"{i:04}", name, "AL", "", "", "", "", *(at[i % 2] if i else (89.9, 170.0)), i) for i in range(600)], R).withColumn("span_levels", F.array().cast("array<string>"))
    points = [("33.1", "-86.0"), ("33.9", "-86.1"), ("89.8", "-10.0"), (None, None)]
    a = spark.createDataFrame([(i, title, "AL", "", "", *points[i % 4]) for i in range(600)], A)
    return M.prepare_articles(a), M.prepare_records(r)


def seen_pairs(monkeypatch):
    seen, real = [], M.pick_one
    monkeypatch.setattr(M, "pick_one", lambda pairs, *more: (seen.append(pairs.count()), real(pairs, *more))[1])
    return seen


def test_equal_names_meet_by_kinds(spark, monkeypatch):
    seen = seen_pairs(monkeypatch)
    out = {x.article_id: (x.record_id, x.method) for x in M.match(*alike(spark, "Oak Hill School", "Oak Hill School")).collect()}
    want = {0: "0002", 1: "0001"}
    assert out == {i: (want[i % 4], "name_state") for i in range(600) if i % 4 in want}
    assert seen[0] == 1


def test_similar_names_meet_by_kinds(spark, monkeypatch):
    seen = seen_pairs(monkeypatch)
    out = {x.article_id: (x.record_id, x.method) for x in M.match(*alike(spark, "Oak Hill School", "Oak Hill Academy")).collect()}
    assert out == {i: ({0: "0002", 1: "0001"}[i % 4], "fuzzy") for i in range(600) if i % 4 < 2}
    assert seen == [0, 1]


def test_no_tier_runs_after_the_last(spark, monkeypatch):
    """Earlier tiers link what they link in a whole run, and the tiers of similar names and places, by far the longest, aren't begun."""
    a, r = alike(spark, "Oak Hill School", "Oak Hill School")
    want = sorted(tuple(x) for x in M.match(a, r).where("method = 'name_state'").collect())
    later = []
    for tier in ("by_similar_name", "by_place"):
        monkeypatch.setattr(M, tier, lambda *_: later.append(1))
    assert sorted(tuple(x) for x in M.match(a, r, last="name_state").collect()) == want and len(want) == 300
    assert later == []
