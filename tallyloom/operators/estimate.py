"""Estimates that need more than an aggregate: bootstrap intervals, regression with clustered or HC3 errors, mediation, rank tests."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, free_names, running_totals


#: Of a Poisson(1) number: the chance of 0, of at most 1, ...
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


def poisson_weights(keys: np.ndarray, draw: int, seed: int) -> np.ndarray:
    """A Poisson(1) number for each 64-bit key, by a mixing function of key, draw and seed: however rows are dealt, a row's is the same."""
    z = keys + np.uint64((draw + 1) * 0x9E3779B97F4A7C15 + seed * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
    return np.searchsorted(POISSON, u, side="right").astype(float)


def bootstrap_draws(df: DataFrame, value: str, by: list[str], *, key: list[str] | None = None, draws: int = 2000, seed: int = 1) -> DataFrame:
    """by, draw, draw_n, draw_sum, draw_mean: rows and sum of each group, and the mean of each draw, in which a value counts a Poisson(1) number of times.

    The numbers come from a hash of the row's key (all columns if none is named) and the draw, so that a key counts alike in
    every group and however rows are dealt. A group's draws are sums, which combine before the shuffle; no group is gathered.
    """
    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            out = []
            for name, g in b.groupby(by, dropna=False) if by else [((), b)]:
                v, keys = g["_v"].to_numpy(float), g["_h"].to_numpy(np.int64).view(np.uint64)
                w, ws = np.empty(draws), np.empty(draws)
                for d in range(draws):
                    n = poisson_weights(keys, d, seed)
                    w[d], ws[d] = n.sum(), n @ v
                out.append((*name, len(v), float(v.sum()), w.tolist(), ws.tolist()))
            yield pd.DataFrame(out, columns=[*by, "draw_n", "draw_sum", "draw_w", "draw_ws"])

    parts = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"), F.xxhash64(*(key or df.columns)).alias("_h")).mapInPandas(run, f"{kinds}draw_n bigint, draw_sum double, draw_w array<double>, draw_ws array<double>")
    long = parts.select(*by, "draw_n", "draw_sum", F.posexplode(F.arrays_zip("draw_w", "draw_ws")).alias("draw", "draw_x"))
    mean = F.sum("draw_x.draw_ws") / F.nullif(F.sum("draw_x.draw_w"), F.lit(0.0))
    return long.groupBy(*by, "draw").agg(F.sum("draw_n").alias("draw_n"), F.sum("draw_sum").alias("draw_sum"), mean.alias("draw_mean"))


def bootstrap_mean(df: DataFrame, value: str, by: list[str], *, key: list[str] | None = None, draws: int = 2000, seed: int = 1) -> DataFrame:
    """by, n, mean, low and high (95 %) of each group; rows with one key are drawn together."""
    per = bootstrap_draws(df, value, by, key=key, draws=draws, seed=seed)
    return per.groupBy(*by).agg(F.max("draw_n").alias("n"), (F.max("draw_sum") / F.max("draw_n")).alias("mean"), F.percentile("draw_mean", F.lit(0.025)).alias("low"), F.percentile("draw_mean", F.lit(0.975)).alias("high"))


def pair_differences(df: DataFrame, value: str, *, pair: str, arm: str, by: list[str]) -> DataFrame:
    """by, pair, difference: the mean of arm 1 less the mean of arm 0, for the pairs that have values of both."""
    mean = lambda a: F.avg(F.when(F.col(arm) == a, F.col(value).cast("double")))
    return df.where(F.col(pair).isNotNull()).groupBy(*by, pair).agg((mean(1) - mean(0)).alias("difference")).where("difference is not null")


def paired_bootstrap(df: DataFrame, value: str, *, pair: str, arm: str, by: list[str], draws: int = 2000, seed: int = 1, least: int = 5) -> DataFrame:
    """by, n (pairs), mean, low and high of the difference within pairs; only groups of at least that many pairs.

    Both members of a pair, and the pair in every group, count as often in a draw.
    """
    d = pair_differences(df, value, pair=pair, arm=arm, by=by)
    return bootstrap_mean(d, "difference", by, key=[pair], draws=draws, seed=seed).where(F.col("n") >= least)


def paired_contrasts(df: DataFrame, value: str, *, pair: str, arm: str, model: str, draws: int = 2000, seed: int = 1, least: int = 5) -> DataFrame:
    """a, b, gap, low, high: for each two models how much larger a's difference within pairs is than b's, draw by draw.

    The draws are the same for both models, so what pairs have in common goes out of the interval.
    """
    d = pair_differences(df, value, pair=pair, arm=arm, by=[model])
    per = cut(bootstrap_draws(d, "difference", [model], key=[pair], draws=draws, seed=seed).where(F.col("draw_n") >= least))
    a, b = (per.select(F.col(model).alias(x), "draw", F.col("draw_mean").alias(f"m_{x}"), (F.col("draw_sum") / F.col("draw_n")).alias(f"mean_{x}")) for x in "ab")
    both = a.join(b, "draw").where("a < b")
    ends = [F.percentile(F.col("m_a") - F.col("m_b"), F.lit(p)).alias(n) for n, p in (("low", 0.025), ("high", 0.975))]
    return both.groupBy("a", "b").agg((F.max("mean_a") - F.max("mean_b")).alias("gap"), *ends)


def interpolate(df: DataFrame, *, by: list[str], at: str, value: str, asked: str) -> DataFrame:
    """df, the value of asked rows put between the nearest known ones before and after in at, in proportion; beyond the ends that of the end.

    Known rows of a group with one at count as their largest value. Two window functions over each group, no join.
    """
    w = Window.partitionBy(*by).orderBy(at)
    past, ahead = w.rangeBetween(Window.unboundedPreceding, Window.currentRow), w.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    known = F.when(~F.col(asked), F.struct(F.col(at).alias("at"), F.col(value).cast("double").alias("v")))
    later = F.when(~F.col(asked), F.struct(F.col(at).alias("at"), (-F.col(value).cast("double")).alias("v")))
    d = df.withColumns({"_a": F.max(known).over(past), "_b": F.min(later).over(ahead)})
    x0, y0, x1, y1 = F.col("_a.at"), F.col("_a.v"), F.col("_b.at"), -F.col("_b.v")
    between = y0 + (y1 - y0) * ((F.col(at) - x0) / F.nullif(x1 - x0, F.lit(0).cast(df.schema[at].dataType)))
    put = F.when(F.col("_a").isNull(), y1).when(F.col("_b").isNull() | (x0 == x1), y0).otherwise(between)
    return d.withColumn(value, F.when(F.col(asked), put).otherwise(F.col(value).cast("double"))).drop("_a", "_b")


def clustered_fit(x: np.ndarray, y: np.ndarray, cluster: np.ndarray | None = None, *, logit: bool = True, turns: int = 50, ridge: float = 1e-6) -> dict[str, np.ndarray | float]:
    """Coefficients, errors and log likelihood; errors by cluster if given, else HC3 (linear) or by row."""
    n, k = x.shape
    b = np.zeros(k)
    for _ in range(turns if logit else 1):
        if logit:
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            w, r = p * (1 - p), y - p
        else:
            w, r = np.ones(n), y - x @ b
        step = np.linalg.solve(x.T @ (x * w[:, None]) + ridge * np.eye(k), x.T @ r)
        b = b + step
        if np.abs(step).max() < 1e-10:
            break
    fit = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30))) if logit else x @ b
    w, r = (fit * (1 - fit) if logit else np.ones(n)), y - fit
    bread = np.linalg.inv(x.T @ (x * w[:, None]) + ridge * np.eye(k))
    if cluster is None:
        lever = (x @ bread * x).sum(1) * w if not logit else np.zeros(n)
        s = x * (r / (1 - lever))[:, None]
        scale = 1.0
    else:
        groups, back = np.unique(cluster, return_inverse=True)
        s = np.stack([np.bincount(back, x[:, j] * r, len(groups)) for j in range(k)], 1)
        scale = len(groups) / max(1, len(groups) - 1)
    cov = scale * bread @ (s.T @ s) @ bread
    like = float((y * np.log(np.clip(fit, 1e-300, 1)) + (1 - y) * np.log(np.clip(1 - fit, 1e-300, 1))).sum()) if logit else float(-n / 2 * (math.log(2 * math.pi * (r @ r) / n) + 1))
    return {"coef": b, "se": np.sqrt(np.diag(cov)), "log_likelihood": like}


def clustered_logit(df: DataFrame, *, y: str, x: list[str], cluster: str, turns: int = 50, ridge: float = 1e-6) -> dict[str, np.ndarray | float]:
    """clustered_fit of y (0 or 1) on the columns x, over counts of equal rows; only sums over rows and over clusters reach the driver.

    Rows with a null among these columns are left out.
    """
    k = len(x)
    used = df.select(F.col(y).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(x)], F.col(cluster).alias("cluster")).na.drop()
    cells = cut(used.groupBy(*used.columns).agg(F.count(F.lit(1)).alias("n")))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    b = np.zeros(k)

    def fitted():  # noqa: ANN202
        e = sum((F.col(f"x{j}") * float(b[j]) for j in range(k)), F.lit(0.0))
        d = cells.withColumn("p", 1 / (1 + F.exp(-F.greatest(F.least(e, F.lit(30.0)), F.lit(-30.0)))))
        return d.withColumn("r", F.col("n") * (F.col("y") - F.col("p")))

    def sums(d: DataFrame):  # noqa: ANN202
        w = F.col("n") * F.col("p") * (1 - F.col("p"))
        like = F.sum(F.col("n") * F.log(F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))))
        row = d.agg(*[F.sum(w * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs], *[F.sum(F.col("r") * F.col(f"x{j}")) for j in range(k)], like).first()
        return square(row[: len(pairs)]) + ridge * np.eye(k), np.array(row[len(pairs) : -1], float), row[-1]

    def square(values: tuple) -> np.ndarray:
        m = np.zeros((k, k))
        for (i, j), v in zip(pairs, values, strict=True):
            m[i, j] = m[j, i] = v or 0.0
        return m

    for _ in range(turns):
        curve, slope, _ = sums(fitted())
        step = np.linalg.solve(curve, np.nan_to_num(slope))
        b = b + step
        if np.abs(step).max() < 1e-10:
            break
    d = fitted()
    curve, _, like = sums(d)
    scores = d.groupBy("cluster").agg(*[F.sum(F.col("r") * F.col(f"x{j}")).alias(f"s{j}") for j in range(k)])
    row = scores.agg(F.count(F.lit(1)), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i, j in pairs]).first()
    bread = np.linalg.inv(curve)
    cov = row[0] / max(1, row[0] - 1) * bread @ square(row[1:]) @ bread
    return {"coef": b, "se": np.sqrt(np.diag(cov)), "log_likelihood": like or 0.0}


def design(df: DataFrame, y: str, numeric: list[str], categorical: list[str], extra: list[str] | None = None, most_levels: int = 200) -> tuple[DataFrame, list[str]]:
    """(y, x0, x1, ..., extra) of the rows in which nothing that is used is null, and the terms of the x: the intercept, numbers, and a 0/1 column for each level but the first.

    The levels of a categorical column, most_levels at most, are those of the rows used.
    """
    extra = extra or []
    used = df.select(y, *numeric, *categorical, *extra).na.drop()
    used = used.where(~F.isnan(F.col(y).cast("double")))
    for c in numeric:
        used = used.where(~F.isnan(F.col(c).cast("double")))
    terms, columns = ["intercept", *numeric], [F.lit(1.0), *[F.col(c).cast("double") for c in numeric]]
    for c in categorical:
        levels = [r[0] for r in used.select(c).distinct().orderBy(c).limit(most_levels + 1).collect()]
        if len(levels) > most_levels:
            raise ValueError(f"{c} has over {most_levels} levels")
        for v in levels[1:]:
            terms.append(f"{c}={v}")
            columns.append((F.col(c) == F.lit(v)).cast("double"))
    return used.select(F.col(y).cast("double").alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(columns)], *extra), terms


def moments(d: DataFrame, k: int, weight, *more) -> tuple[np.ndarray, tuple]:  # noqa: ANN001
    """Sums of weight * x_i * x_j over the rows, and those of more."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = d.agg(*[F.sum(weight * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs], *more).first()
    m = np.zeros((k, k))
    for (i, j), v in zip(pairs, row, strict=False):
        m[i, j] = m[j, i] = v or 0.0
    return m, tuple(row)[len(pairs) :]


def linear(columns: list[int], b: np.ndarray):  # noqa: ANN201
    return sum((F.col(f"x{i}") * float(v) for i, v in zip(columns, b, strict=True)), F.lit(0.0))


def ols_of(cells: DataFrame, gram: np.ndarray, xy: np.ndarray, columns: list[int], rows: int, clustered: bool) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and errors of y on some of the x columns of cells (y, x, n, and cluster if clustered), given the sums of all products."""
    some = np.ix_(columns, columns)
    bread = np.linalg.inv(gram[some])
    b = bread @ xy[columns]
    k = len(columns)
    r = F.col("y") - linear(columns, b)
    if clustered:
        scores = cells.groupBy("cluster").agg(*[F.sum(F.col("n") * r * F.col(f"x{i}")).alias(f"x{m}") for m, i in enumerate(columns)])
        meat, (groups,) = moments(scores, k, F.lit(1.0), F.count(F.lit(1)))
        meat *= groups / max(1, groups - 1) * (rows - 1) / max(1, rows - k)
    else:
        lever = sum((F.col(f"x{i}") * F.col(f"x{j}") * float(bread[p, q]) for p, i in enumerate(columns) for q, j in enumerate(columns)), F.lit(0.0))
        s = r / (1 - lever)
        chosen = cells.select("n", s.alias("s"), *[F.col(f"x{i}").alias(f"x{m}") for m, i in enumerate(columns)])
        meat, _ = moments(chosen, k, F.col("n") * F.col("s") * F.col("s"))
    return b, np.sqrt(np.diag(bread @ meat @ bread))


def ols_cells(df: DataFrame, y: str, numeric: list[str], categorical: list[str], cluster: str | None) -> tuple[DataFrame, list[str], np.ndarray, np.ndarray, int]:
    """Counts of equal rows of the design, its terms, the sums of x'x and x'y, and the number of rows."""
    d, terms = design(df, y, numeric, categorical, [cluster] if cluster else [])
    d = d.withColumnRenamed(cluster, "cluster") if cluster else d
    cells = cut(d.groupBy(*d.columns).agg(F.count(F.lit(1)).alias("n")))
    k = len(terms)
    gram, more = moments(cells, k, F.col("n"), *[F.sum(F.col("n") * F.col("y") * F.col(f"x{i}")) for i in range(k)], F.coalesce(F.sum("n"), F.lit(0)))
    return cells, terms, gram, np.array([v or 0.0 for v in more[:k]]), int(more[k])


def ols(df: DataFrame, y: str, numeric: list[str], categorical: list[str] | None = None, cluster: str | None = None) -> DataFrame:
    """term, coef, se, p, n: least squares of y, with errors by cluster, or HC3 without one; p by the normal approximation.

    The plan makes the design and counts its equal rows; the driver gets sums of products alone. The second pass carries the
    inverse of x'x to the rows, for their leverages and residuals.
    """
    cells, terms, gram, xy, n = ols_cells(df, y, numeric, categorical or [], cluster)
    b, se = ols_of(cells, gram, xy, list(range(len(terms))), n, cluster is not None)
    return df.sparkSession.createDataFrame([(t, float(x), float(e), math.erfc(abs(x / e) / math.sqrt(2)) if e else None, n) for t, x, e in zip(terms, b, se, strict=True)], "term string, coef double, se double, p double, n bigint")


def mediation(df: DataFrame, y: str, treated: str, mediator: str, numeric: list[str] | None = None, categorical: list[str] | None = None, cluster: str | None = None) -> DataFrame:
    """One row: the coefficient of treated without the mediator and with it, that of the mediator, their errors, and n.

    Both models go over the same rows, those complete in all columns, and share one set of sums.
    """
    cells, terms, gram, xy, n = ols_cells(df, y, [treated, mediator, *(numeric or [])], categorical or [], cluster)
    whole = list(range(len(terms)))
    without = [i for i in whole if i != 2]
    b0, e0 = ols_of(cells, gram, xy, without, n, cluster is not None)
    b1, e1 = ols_of(cells, gram, xy, whole, n, cluster is not None)
    row = (float(b0[1]), float(e0[1]), float(b1[1]), float(e1[1]), float(b1[2]), float(e1[2]), n)
    return df.sparkSession.createDataFrame([row], "total double, total_se double, direct double, direct_se double, mediator double, mediator_se double, n bigint")


def chi2_tail(x: float, df: int) -> float:
    """P(chi-squared with df degrees > x), by the series of the incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, z = df / 2, x / 2
    term = total = 1 / a
    for i in range(1, 1000):
        term *= z / (a + i)
        total += term
        if term < total * 1e-15:
            break
    return max(0.0, 1 - total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def two_sided(z: Column) -> Column:
    """P(|standard normal| > |z|)."""

    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)), na_action="ignore")

    return tail(z)


def rank_sum_test(df: DataFrame, value: str, flag: str, by: list[str] | None = None) -> DataFrame:
    """by, n1, n0, u, z, p: Mann-Whitney of the values with flag 1 against those with flag 0, by the normal approximation, corrected for ties and continuity.

    Ranks are summed over counts of equal values, which are dealt by ranges: no group is one task. Nulls are left out.
    A group with one side only, or one value only, has p = 1.
    """
    by = by or []
    x, n1, n0, n, first = free_names(by, "x", "n1", "n0", "n", "first")
    counts = df.where(F.col(value).isNotNull() & F.col(flag).isin(0, 1)).groupBy(*by, F.col(value).cast("double").alias(x)).agg(F.count_if(F.col(flag) == 1).alias(n1), F.count_if(F.col(flag) == 0).alias(n0))
    counts = running_totals(counts.withColumn(n, F.col(n1) + F.col(n0)), by, [x], n, first)
    ranks = F.sum(F.col(n1) * (F.col(first) + (F.col(n) + 1) / F.lit(2.0)))
    ties = F.sum(F.pow(F.col(n).cast("double"), 3) - F.col(n))
    s = counts.groupBy(*by).agg(F.sum(n1).alias("n1"), F.sum(n0).alias("n0"), ranks.alias("r"), ties.alias("t"))
    a, b = F.col("n1").cast("double"), F.col("n0").cast("double")
    spread = a * b / 12 * (a + b + 1 - F.coalesce(F.col("t") / F.nullif((a + b) * (a + b - 1), F.lit(0.0)), F.lit(0.0)))
    s = s.withColumn("u", F.col("r") - a * (a + 1) / 2)
    off = F.col("u") - a * b / 2
    z = F.when(spread > 0, F.signum(off) * F.greatest(F.lit(0.0), F.abs(off) - 0.5) / F.sqrt(spread)).otherwise(0.0)
    return s.withColumn("z", z).select(*by, "n1", "n0", "u", "z", two_sided(F.col("z")).alias("p"))


def signed_rank_test(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """by, n, w, z, p: Wilcoxon of differences, by the normal approximation, corrected for ties; nulls and zeros are left out. w: the ranks of the positive ones."""
    by = by or []
    x, up, n, first = free_names(by, "x", "up", "n", "first")
    d = F.col(value).cast("double")
    counts = df.where(d.isNotNull() & (d != 0)).groupBy(*by, F.abs(d).alias(x)).agg(F.count_if(d > 0).alias(up), F.count(F.lit(1)).alias(n))
    counts = running_totals(counts, by, [x], n, first)
    m = F.col(n).cast("double")
    s = counts.groupBy(*by).agg(F.sum(n).alias("n"), F.sum(F.col(up) * (F.col(first) + (m + 1) / 2)).alias("w"), F.sum(m * m * m - m).alias("t"))
    k = F.col("n").cast("double")
    spread = k * (k + 1) * (2 * k + 1) / 24 - F.col("t") / 48
    s = s.withColumn("z", F.when(spread > 0, (F.col("w") - k * (k + 1) / 4) / F.sqrt(spread)).otherwise(0.0))
    return s.select(*by, "n", "w", "z", two_sided(F.col("z")).alias("p"))


def detectable_effect(n: int, base: float, *, alpha: float = 0.05, power: float = 0.8, turns: int = 50) -> float:
    """The difference of two shares that n a side detect, by fixed-point iteration."""
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    d = 0.1
    for _ in range(turns):
        other = min(0.999, base + d)
        d = z * math.sqrt((base * (1 - base) + other * (1 - other)) / n)
    return d
