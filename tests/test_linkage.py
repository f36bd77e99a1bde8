import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.similarity import token_sort
from tallyloom.operators import linkage as L
from tallyloom.operators.shared import meet

WORDS = ["academy", "lincoln", "park", "north", "valley", "charter", "st", "jose"]


def sides(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        core = "  ".join(["academy"] + r.sample(WORDS[1:], r.randint(0, 3))) if i % 9 else ["", None, "park"][i // 9 % 3]
        out.append((i if i % 17 else None, r.choice(["tx", "tx", "al", None]), core, i))
    return out + out[3:6]


def frames(spark, n, m):
    a, b = sides(n, 1), sides(m, 2)
    left = spark.createDataFrame(a, "a long, s string, ca string, token long").withColumn("ta", F.split("ca", r"\s+"))
    right = spark.createDataFrame(b, "b long, s string, cb string, token long").withColumn("tb", F.split("cb", r"\s+"))
    return a, b, left, right


def shared(a, b):
    return {(x[0], y[0]): (x[2], y[2]) for x in a for y in b if x[0] is not None and y[0] is not None and x[1] and x[1] == y[1] and x[2] is not None and y[2] is not None and set(x[2].split() or [""]) & set(y[2].split() or [""])}


@pytest.mark.parametrize("side", [3, 2048])
def test_candidates_are_all_pairs_that_share_a_token(spark, side):
    a, b, left, right = frames(spark, 60, 40)
    got = L.token_candidates(left, right, left_id="a", right_id="b", left_tokens="ta", right_tokens="tb", block=["s"], side=side).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == set(shared(a, b))


@pytest.mark.parametrize(("side", "other"), [(3, True), (2048, False)])
def test_links_are_those_of_all_pairs(spark, side, other):
    a, b, left, right = frames(spark, 60, 40)
    want = {}
    for x in {p[0] for p in shared(a, b)}:
        scores = {y: min(100.0, token_sort(*c) + (3.0 if "park" in c[1] else 0.0)) for (w, y), c in shared(a, b).items() if w == x and (w != y or not other)}
        top = max(scores.values(), default=0)
        if top >= 75 and list(scores.values()).count(top) == 1:
            want[x] = (max(scores, key=scores.get), top)
    boost = F.when(F.col("cb").contains("park"), 3.0).otherwise(0.0)
    got = L.fuzzy_link(left, right, left_id="a", right_id="b", core_left="ca", core_right="cb", left_tokens="ta", right_tokens="tb", block=["s"], threshold=75, boost=boost, other=other, side=side).collect()
    assert want and {r.a: (r.b, r.score) for r in got} == want and len(got) == len(want)


def test_frequent_keys_meet_in_parts(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 4}", "x") for i in range(60)] + [(None, "hot", "x"), (99, None, "x")], "i long, k string, own string")
    right = spark.createDataFrame([(j, "hot" if j % 2 else f"k{j % 5}", 1) for j in range(30)], "j long, k string, high int")
    want = [tuple(r) for r in left.join(right, "k").select("k", "i", "own", "j", "high").collect()]
    got = meet(left, right, ["k"], "i", "j", side=8)
    assert got.columns == ["k", "i", "own", "j", "high"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert meet(left.where("false"), right, ["k"], "i", "j", side=8).count() == 0


def test_lengths_bound_the_score():
    r = random.Random(3)
    for _ in range(300):
        x, y = ("  ".join(r.choices(WORDS, k=r.randint(0, 4))) for _ in range(2))
        n, m = len(" ".join(x.split())), len(" ".join(y.split()))
        assert token_sort(x, y) <= (min(n, m) * 200.0 / (n + m) if n + m else 100.0) + 1e-9


def test_an_id_takes_only_itself_away(spark):
    rows = [(1, "park one"), (2, "park one"), (3, "park two"), (4, "park twos"), (5, "park six"), (6, "park six"), (7, "park six"), (8, "lone")]
    left = spark.createDataFrame(rows, "a long, ca string").select(F.lit("tx").alias("s"), "a", "ca", F.split("ca", " ").alias("ta"))
    right = left.select("s", F.col("a").alias("b"), F.col("ca").alias("cb"), F.col("ta").alias("tb"))
    got = L.fuzzy_link(left, right, left_id="a", right_id="b", core_left="ca", core_right="cb", left_tokens="ta", right_tokens="tb", block=["s"], threshold=80, other=True).collect()
    assert {r.a: (r.b, round(r.score, 1)) for r in got} == {1: (2, 100.0), 2: (1, 100.0), 3: (4, 94.1), 4: (3, 94.1)}


def test_count_token_pairs(spark):
    """Against all pairs, with lists that are short, long and both, copies, repeated tokens, nulls and blocks without pairs."""
    words = [f"w{i}" for i in range(14)]
    rows = [(i, "xyz"[i % 3], [words[(i * 5 + j * (i % 4 + 1)) % 14] for j in range(i % 13)] + ["dup", "dup"] * (i % 7 == 0)) for i in range(120)]
    rows += [(i + 500, *r[1:]) for i, r in enumerate(rows[:40])] + [(900, "lone", ["w1"]), (901, "x", None), (902, None, ["w1"]), (903, "x", [None, "w1"]), (904, "x", [])]
    d = spark.createDataFrame(rows, "id int, b string, t array<string>")
    want = {}
    sets = [(b, {x for x in t if x}) for _, b, t in rows if b and t]
    for i, (b, t) in enumerate(sets):
        for c, u in sets[:i]:
            if b == c and t & u:
                want[b] = want.get(b, 0) + 1
    for most in (0, 4, 30):
        assert {r.b: r.pairs for r in L.count_token_pairs(d, tokens="t", block=["b"], most=most).collect()} == want
