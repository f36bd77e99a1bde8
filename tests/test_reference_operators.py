import hashlib
import io
import zipfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import similarity as S
from tallyloom.functions import text as X
from tallyloom.operators import estimate as E
from tallyloom.operators import graph as G
from tallyloom.operators import linkage as L
from tallyloom.operators import measures as M
from tallyloom.operators import resolve as R
from tallyloom.sources import readers, writers
from tallyloom.streaming import log


@pytest.mark.parametrize(("a", "b", "want"), [("blue valley", "valley blue", 100), ("albertville", "albertvile", 95.2381), ("lincoln", "lincoln park", 73.6842), ("pace", "price", 66.6667), ("washington", "wellington", 70), ("salem", "lames", 40)])
def test_token_sort(a, b, want):
    assert S.token_sort(a, b) == pytest.approx(want, abs=1e-3)


def test_token_set_and_runs():
    assert S.token_set("lincoln high", "lincoln") == 100 and S.token_set("a", "") == 0
    assert S.longest_run("a b c d", "x b c d y") == 3 and S.longest_run("", "a") == 0


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_text(spark):
    c = F.col("c")
    assert one(spark, X.norm_name(c), c="St. Mary's & Co (Old)") == "saint mary s and co"
    assert one(spark, X.title_case(c), c="O'BRIEN HS") == "O'brien HS"
    assert one(spark, X.clean_markup(c), c="A {{x|{{y}}}}[[b|c]] is [[d]] [3] , e.") == "A c is d, e."
    cleaned = one(spark, X.clean_markup(c), c="in [[a|b]] [[c ]] .")
    assert one(spark, X.clean_markup(c), c=cleaned) == cleaned
    assert one(spark, X.closed_opening(c), c="X was a school in Town. It is a ruin.") and not one(spark, X.closed_opening(c), c="X is a school that was a mill.")
    assert one(spark, X.mask_words(c, ["high", "school"]), c="Old Troy High School - East Side") == "[X] High School - [X]"
    assert one(spark, X.utf16_length(c), c="a\U0001f389") == 3
    assert one(spark, X.zero_pad(c), c="1234567890123") == "1234567890123" and one(spark, X.zero_pad(c), c="12") == "000000000012"
    assert one(spark, X.phone(c), c="205-555 0101") == "(205)555-0101"
    assert one(spark, X.host(c), c="HTTPS://www.Example.org/a?b") == "example.org"
    assert one(spark, X.ngram_recall(X.word_list(c), X.word_list(F.col("d")), 2), c="a b c", d="b c d") == 0.5
    assert one(spark, X.labelled(c, "A2"), c="A1: x\nA2: y z\n") == "y z" and one(spark, X.first_object(c), c="so {a {b}} end") == "{a {b}}"


def test_resolve(spark):
    d = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (2, "c", 2)], "k int, v string, o int")
    assert {r.v for r in R.pick_by_key(d, ["k"], [F.col("o")]).collect()} == {"b", "c"}
    assert {(r.v, r.n_losers) for r in R.claim_resolution(d, "k", [F.col("o").desc()]).collect()} == {("a", 1), ("c", 0)}
    assert [r.v for r in R.drop_all_duplicates(d, ["k"]).collect()] == ["c"]
    assert [r.v for r in R.remaining(d, d.where("k = 1"), ["k"]).collect()] == ["c"]
    tiers = [("first", lambda x: x.where("o = 3")), ("second", lambda x: x.where("o < 3"))]
    assert {(r.v, r.tier) for r in R.waterfall(d, tiers, "v").collect()} == {("a", "first"), ("b", "second"), ("c", "second")}


def test_linkage(spark):
    a = spark.createDataFrame([(1, "tx", "chandler park academy"), (2, "tx", "hope")], "a int, s string, ca string").withColumn("ta", F.split("ca", " "))
    b = spark.createDataFrame([(7, "tx", "chandler park academy high"), (8, "al", "chandler park academy"), (9, "tx", "other park")], "b int, s string, cb string").withColumn("tb", F.split("cb", " "))
    out = L.fuzzy_link(a, b, left_id="a", right_id="b", core_left="ca", core_right="cb", left_tokens="ta", right_tokens="tb", block=["s"], threshold=80).collect()
    assert [(r.a, r.b) for r in out] == [(1, 7)]
    p = spark.createDataFrame([(1, 34.15, -118.4), (2, 60.0, 10.0)], "i int, lat double, lon double")
    q = spark.createDataFrame([(5, 34.14, -118.39), (6, 37.33, -121.89), (7, 34.1, -118.4)], "j int, lat double, lon double")
    assert [(r.i, r.j) for r in L.geo_nearest(p, q, left_id="i", right_id="j", radius=50).collect()] == [(1, 5)]
    plan = L.geo_nearest(p, q, left_id="i", right_id="j", radius=50)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    moved = L.follow_redirects(spark.createDataFrame([("x",), ("z",)], "t string"), spark.createDataFrame([("x", "y"), ("y", "w")], "from string, to string"), key="t")
    assert {(r.t, r.target) for r in moved.collect()} == {("x", "w"), ("z", "z")}


def test_measures(spark):
    d = spark.createDataFrame([(float(v),) for v in (1, 2, 2, 2, 3, 9, 9, 10)], "v double")
    bins = {r.v: r.bin for r in M.quantile_bins(d, "v", 4).collect()}
    assert bins[1.0] == bins[2.0] == 1 and bins[10.0] == 4
    assert sorted(r.r for r in d.select(M.average_rank("v").alias("r")).collect()) == [1, 3, 3, 3, 5, 6.5, 6.5, 8]
    k = M.kappa(spark.createDataFrame([(1, 1), (2, 2), (3, 2), (1, 3)], "a int, b int"), "a", "b").first()
    assert (k.n, k.exact, k.within_one) == (4, 0.5, 0.75)


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "from string, to string")
    out = G.bfs(e, spark.createDataFrame([("a",)], "node string")).collect()
    assert {(r.node, r.depth, r.via) for r in out} == {("a", 0, None), ("b", 1, "a"), ("c", 1, "a"), ("d", 2, "c")}


def test_estimates(spark):
    rng = np.random.default_rng(1)
    d = spark.createDataFrame([("g", float(v)) for v in rng.normal(5, 2, 400)], "g string, v double")
    r = E.bootstrap_mean(d, "v", ["g"], draws=400).first()
    assert r.low < r["mean"] < r.high and r.high - r.low == pytest.approx(4 * 2 / 20, rel=0.4)
    x = np.column_stack([np.ones(2000), rng.normal(size=2000)])
    y = (rng.random(2000) < 1 / (1 + np.exp(-(0.5 + x[:, 1])))).astype(float)
    fit = E.clustered_fit(x, y, np.arange(2000) % 50)
    assert np.abs(fit["coef"] - [0.5, 1]).max() < 0.2 and (fit["se"] < 0.1).all()
    assert E.chi2_tail(3.841, 1) == pytest.approx(0.05, abs=1e-3)
    assert 0.1 < E.detectable_effect(200, 0.5) < 0.2


def test_sources_and_sinks(spark, tmp_path):
    html = "<table><tr><td>banner</td></tr><tr><th>ID</th><th>Name*</th></tr><tr><td>7</td><td>A &amp; B</td></tr><tr><td></td><td>footer</td></tr></table>"
    assert readers.table_records(html, "ID") == [{"ID": "7", "Name": "A & B"}] and readers.table_records(None, "ID") == []
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr("data.csv", 'a,b\n1,"x, y"\n2,\n')
    (tmp_path / "f.zip").write_bytes(buf.getvalue())
    rows = readers.read_zip_members(spark, str(tmp_path / "f.zip"), ".csv", ["a", "b"]).collect()
    assert [(r.a, r.b) for r in rows] == [("1", "x, y"), ("2", "")]
    d = spark.createDataFrame([(i, None if i % 2 else f'q"{i}') for i in range(10)], "id int, t string")
    writers.write_csv(d, str(tmp_path / "c"), ["id", "t", "none"], ["id"])
    back = readers.read_csv(spark, str(tmp_path / "c"), ids=["2", "3"], id_col="id").collect()
    assert {(r.id, r.t or "", r.none or "") for r in back} == {("2", 'q"2', ""), ("3", "", "")}
    sizes = writers.chunked(d, "id", 4).groupBy("chunk").agg(F.min("id").alias("lo"), F.count("*").alias("n")).orderBy("chunk").collect()
    assert [(r.lo, r.n) for r in sizes] == [(0, 3), (3, 3), (6, 3), (9, 1)]
    replies = iter([{"retry_after": 1}, {"records": {"1": {"v": 1}}}])
    assert readers.with_retries(lambda: next(replies), sleep=lambda s: None)["records"] == {"1": {"v": 1}}
    paged = readers.paged_lookup(d.where("id < 3"), "id", lambda ids, token: {"records": {i: {"p": token} for i in ids}, "continue": None if token else "t"}, batch=2)
    assert paged.count() == 6


def test_ratings_agree_as_counted_by_hand(spark):
    rows = [("x", 1, 1), ("x", 1, 2), ("x", 2, 5), ("x", 5, 5), ("x", None, 3), ("y", 3, 3), ("y", 3, 3), (None, 2, 1), ("x", 9, 1)]
    d = spark.createDataFrame(rows, "g string, a int, b int")
    grid = {(r.g, r.a): [r.r_1, r.r_2, r.r_3, r.r_4, r.r_5] for r in M.confusion(d, "a", "b", [1, 2, 3, 4, 5], ["g"]).collect()}
    assert len(grid) == 15 and grid["x", 1] == [1, 1, 0, 0, 0] and grid["x", 2] == [0, 0, 0, 0, 1] and grid["x", 4] == [0] * 5
    assert grid["y", 3] == [0, 0, 2, 0, 0] and grid[None, 2] == [1, 0, 0, 0, 0] and sum(map(sum, grid.values())) == 7
    whole = M.confusion(d, "a", "b", [1, 2, 3, 4, 5]).collect()
    assert len(whole) == 5 and M.confusion(d.limit(0), "a", "b", [1, 2]).count() == 0
    got = {r.g: r for r in M.kappa(d.where("a < 9 or a is null"), "a", "b", ["g"]).collect()}
    a, b = np.array([1, 1, 2, 5]), np.array([1, 2, 5, 5])
    want = 1 - ((a - b) ** 2).mean() / ((a[:, None] - b) ** 2).mean()
    assert got["x"].n == 4 and got["x"].exact == 0.5 and got["x"].within_one == 0.75 and abs(got["x"].kappa - want) < 1e-12
    assert got["y"].exact == 1 and got["y"].kappa is None and M.kappa(d.limit(0), "a", "b", ["g"]).count() == 0


def test_releases_are_read_as_they_are_written(spark, tmp_path):
    d = spark.createDataFrame([(i, None if i == 3 else f"t{i}\n", 7, 7, 7, 7) for i in range(23)], "id int, t string, p int, i int, n int, before int")
    kind = "id int, t string, p int, i int, n int, before int"
    writers.write_jsonl(d, str(tmp_path / "a.jsonl"))
    whole = sorted(tuple(r) for r in d.collect())
    assert sorted(tuple(r) for r in readers.read_release(spark, str(tmp_path / "a.jsonl"), kind).collect()) == whole
    assert '"t"' not in next(x for f in (tmp_path / "a.jsonl").glob("part-*") for x in f.read_text().splitlines() if '"id":3,' in x)
    (tmp_path / "b.jsonl").write_text('{"id": 1, "t": "x"}\n\n{broken\n{"id": 2}\n')
    assert sorted((r.id, r.t) for r in readers.read_jsonl(spark, str(tmp_path / "b.jsonl"), "id int, t string").collect()) == [(1, "x"), (2, None)]
    (tmp_path / "c.json").write_text('[{"id": 1,\n "t": "x"}, {"id": 2}]')
    assert sorted((r.id, r.t) for r in readers.read_json_documents(spark, str(tmp_path / "c.json"), "id int, t string").collect()) == [(1, "x"), (2, None)]
    writers.write_chunks(d, str(tmp_path / "d"), "id", 4)
    back = readers.read_release(spark, str(tmp_path / "d"), kind)
    assert sorted(tuple(r)[:6] for r in back.collect()) == whole
    assert [(r.chunk, r.lo, r.size) for r in back.groupBy("chunk").agg(F.min("id").alias("lo"), F.count("*").alias("size")).orderBy("chunk").collect()] == [(0, 0, 6), (1, 6, 6), (2, 12, 6), (3, 18, 5)]
    files = sorted((tmp_path / "d").glob("chunk=*/*.parquet"))
    told = {r.path.split("/")[-1]: (r.bytes, r.sha256) for r in writers.manifest(spark, [str(tmp_path / "d" / "chunk=*")]).collect()}
    assert told == {f.name: (f.stat().st_size, hashlib.sha256(f.read_bytes()).hexdigest()) for f in files}
    writers.write_csv(d, str(tmp_path / "e"), ["id", "t"])
    wanted = spark.createDataFrame([("4",), ("4",), ("22",), ("99",), (None,)], "id string")
    assert sorted(r.id for r in readers.read_csv(spark, str(tmp_path / "e"), ids=wanted, id_col="id").collect()) == ["22", "4"]
    numbers = writers.numbered(d, "id")
    assert numbers.columns[:6] == d.columns and sorted((r.id, r["index"], r.total) for r in numbers.collect()) == [(i, i, 23) for i in range(23)]


def test_log_stream(spark, tmp_path):
    at = datetime(2024, 1, 1, 10)
    d = spark.createDataFrame([(1, "a", at), (1, "a", at), (2, "b", at)], "id int, kind string, ts timestamp")
    for _ in range(2):
        writers.append_log(d.coalesce(1), str(tmp_path / "log"))
    stream = log.once(log.read_log(spark, str(tmp_path / "log"), "id int, kind string, ts timestamp"), ["id"], "ts")
    q = stream.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.id for r in spark.table("once").collect()) == [1, 2]
