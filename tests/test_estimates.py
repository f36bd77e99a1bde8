"""Estimates over Spark against plain ones, and under another dealing of rows."""

import numpy as np

from tallyloom.operators import estimate as E


def test_logit_over_cells_is_that_over_rows(spark):
    rng = np.random.default_rng(3)
    n = 400
    x, c = rng.integers(0, 4, n), rng.integers(0, 12, n)
    y = (rng.random(n) < 1 / (1 + np.exp(0.8 - 0.5 * x - 0.1 * (c % 3)))).astype(int)
    rows = [(int(a), 1, int(b), int(k)) for a, b, k in zip(y, x, c, strict=True)] + [(None, 1, 1, 1), (1, 1, None, 1)]
    got = E.clustered_logit(spark.createDataFrame(rows, "y int, one int, x int, c int"), y="y", x=["one", "x"], cluster="c")
    want = E.clustered_fit(np.column_stack([np.ones(n), x.astype(float)]), y.astype(float), c)
    assert all(np.allclose(got[k], want[k], rtol=1e-6) for k in want)


def test_intervals_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(4)
    values = rng.normal(5, 2, 300)
    d = spark.createDataFrame([(i, "ab"[i % 2], float(v)) for i, v in enumerate(values)], "id int, g string, v double")
    of = lambda d: {r.g: (r.n, r["mean"], r.low, r.high) for r in E.bootstrap_mean(d, "v", ["g"], key=["id"], draws=400).collect()}
    one, many = of(d.coalesce(1)), of(d.repartition(7))
    assert all(np.allclose(one[k], many[k]) for k in "ab")
    error = values[::2].std() / np.sqrt(150)
    assert abs((one["a"][3] - one["a"][2]) / (2 * 1.96 * error) - 1) < 0.2


def test_weights_are_poisson():
    w = E.poisson_weights(np.arange(100_000, dtype=np.int64).view(np.uint64), 7, 1)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
