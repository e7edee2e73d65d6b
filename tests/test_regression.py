"""Linear models against dense linear algebra on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakelens.functions import special as S
from lakelens.operators import regression
from lakelens.operators.regression import factors, least_squares, random_intercept


def make(n=160, seed=2, noise=1.0):
    rng = random.Random(seed)
    effect = {f"g{i}": rng.gauss(0, 2) for i in range(14)}
    out = []
    for i in range(n):
        a, b, c, g = rng.uniform(0, 10), rng.gauss(1e6, 3), rng.choice(["red", "blue", "green"]), f"g{min(rng.randrange(14), rng.randrange(14))}"
        y = 3 + 2 * a + 0.5 * (b - 1e6) + {"red": 0, "blue": 4, "green": -1}[c] * (1 + a / 5) + effect[g] + rng.gauss(0, noise * (0.2 + a / 4))
        out.append((y, a, b, c, g, i % 2 == 0))
    return out


ROWS = make()
SCHEMA = "y double, a double, b double, c string, g string, even boolean"


@pytest.fixture(scope="module")
def table(spark):
    odd = [(None, 1.0, 1.0, "red", "g1", True), (1.0, float("nan"), 1.0, "red", "g1", True), (1.0, 1.0, 1.0, None, "g1", True)]
    return spark.createDataFrame(ROWS + odd, SCHEMA).repartition(5).cache()


def dense(columns, y):
    x = np.column_stack(columns)
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    e = y - x @ beta
    h = np.einsum("ij,jk,ik->i", x, inv, x)
    n, k = x.shape
    plain = np.sqrt(np.diag(inv) * (e @ e) / (n - k))
    w = x * (e / (1 - h))[:, None]
    hc3 = np.sqrt(np.diag(inv @ (w.T @ w) @ inv))
    g = np.linalg.lstsq(x, e**2, rcond=None)[0]
    bp = n * (1 - ((e**2 - x @ g) ** 2).sum() / ((e**2 - (e**2).mean()) ** 2).sum())
    return beta, plain, hc3, bp, 1 - (e @ e) / ((y - y.mean()) ** 2).sum()


def columns():
    y, a, b, c, _, even = map(np.array, zip(*ROWS, strict=True))
    return y, [np.ones(len(y)), a, b, c == "green", c == "red", (c == "green") * a, (c == "red") * a, even * 1.0], ["intercept", "a", "b", "C(c)[green]", "C(c)[red]", "a:C(c)[green]", "a:C(c)[red]", "C(even)[true]"]


@pytest.mark.parametrize("errors", ["plain", "hc3"])
def test_categories_interactions_and_errors(table, errors):
    y, x, names = columns()
    x[2] = x[2] - 1e6  # the dense way needs centred columns
    fit = least_squares(table, "y ~ a + b + c + a:c + C(even)", errors)
    terms = {t[0]: t for t in fit.terms}
    order = ["intercept", "a", "b", "C(c)[green]", "C(c)[red]", "a:C(c)[green]", "a:C(c)[red]", "C(even)[true]"]
    assert names == order == [t[0] for t in fit.terms]
    beta, plain, hc3, bp, r2 = dense([np.asarray(v, float) for v in x], y)
    want = plain if errors == "plain" else hc3
    for i, name in enumerate(names[1:], 1):
        assert terms[name][1] == pytest.approx(beta[i], rel=1e-7) and terms[name][2] == pytest.approx(want[i], rel=1e-7)
        t = beta[i] / want[i]
        assert terms[name][4] == pytest.approx(S.t_two_sided(t, len(y) - 8), rel=1e-5) and terms[name][5] < beta[i] < terms[name][6]
    assert terms["intercept"][1] == pytest.approx(beta[0] - 1e6 * beta[2], rel=1e-7)
    assert fit.model["bp"] == pytest.approx(bp, rel=1e-7) and fit.model["r2"] == pytest.approx(r2) and fit.model["n"] == len(y)


def test_route_by_the_breusch_pagan_test(spark, table):
    assert least_squares(table, "y ~ a").model["errors"] == "hc3"
    even = spark.createDataFrame([(float(i % 7) + (i * 7919 % 13) / 13, float(i % 7)) for i in range(91)], "y double, x double")
    fit = least_squares(even, "y ~ x")
    assert fit.model["errors"] == "plain" and fit.model["bp_p"] > 0.05


def test_factors_are_merged_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(regression, "FAN", 2)
    x = spark.createDataFrame(ROWS, SCHEMA).repartition(9)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert least_squares(x, "y ~ a").terms[1][1] == pytest.approx(np.polyfit([r[1] for r in ROWS], [r[0] for r in ROWS], 1)[0])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_columns_that_others_determine_and_times(spark, table):
    x = table.dropna().withColumn("double", F.col("a") * 2 + 1).withColumn("one", F.lit(1.0)).withColumn("at", (F.lit(1.7e9) + F.col("a") * 86400).cast("timestamp"))
    fit = {t[0]: t for t in least_squares(x, "y ~ a + double + one").terms}
    assert math.isnan(fit["double"][1]) and math.isnan(fit["one"][1])
    slope = np.polyfit([r[1] for r in ROWS], [r[0] for r in ROWS], 1)[0]
    assert fit["a"][1] == pytest.approx(slope)
    assert least_squares(x, "y ~ at").terms[1][1] * 86400 == pytest.approx(slope, rel=1e-5)
    with pytest.raises(ValueError):
        least_squares(x, "at ~ a")


def test_few_constant_and_no_rows(spark):
    x = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "y double, x double")
    fit = least_squares(x, "y ~ x")
    assert fit.terms[1][1] == pytest.approx(1.0) and math.isnan(fit.terms[1][4])
    assert math.isnan(least_squares(x.where("false"), "y ~ x").terms[0][1])
    flat = least_squares(spark.createDataFrame([(1.0, float(i)) for i in range(9)], "y double, x double"), "y ~ x")
    assert flat.terms[0][1] == pytest.approx(1.0) and abs(flat.terms[1][1]) < 1e-12 and math.isnan(flat.model["r2"])
    assert math.isnan(random_intercept(x.withColumn("g", F.lit(1)), "y ~ x", "g").terms[0][1])


def test_formulas():
    assert factors("y ~ a*b + C(d) + a:d") == ("y", [("a",), ("b",), ("a", "b"), ("C(d)",), ("a", "d")])
    for bad in ("y", "y ~", "~ x", "y ~ a +"):
        with pytest.raises(ValueError):
            factors(bad)


def restricted(x, y, g, ratio):
    """Restricted log likelihood by the full covariance matrix."""
    n, k = x.shape
    v = np.eye(n) + ratio * (g[:, None] == g[None, :])
    vi = np.linalg.inv(v)
    a = x.T @ vi @ x
    beta = np.linalg.solve(a, x.T @ vi @ y)
    rss = (y - x @ beta) @ vi @ (y - x @ beta)
    s2 = rss / (n - k)
    return -0.5 * ((n - k) * (math.log(2 * math.pi * s2) + 1) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1]), beta, s2, np.sqrt(np.diag(np.linalg.inv(a)) * s2)


def test_random_intercept_equals_the_dense_likelihood(table):
    y, a, b, c, g, _ = map(np.array, zip(*ROWS, strict=True))
    x = np.column_stack([np.ones(len(y)), a, c == "green", c == "red"]).astype(float)
    fit = random_intercept(table, "y ~ a + c", "g")
    lo, hi = 0.0, 5.0
    for _ in range(60):
        p, q = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (p, hi) if restricted(x, y, g, p)[0] < restricted(x, y, g, q)[0] else (lo, q)
    best, beta, s2, se = restricted(x, y, g, lo)
    assert fit.model["log_likelihood"] == pytest.approx(best, rel=1e-8) and fit.model["groups"] == len(set(g)) and fit.model["n"] == len(y)
    assert fit.model["sigma2"] == pytest.approx(s2, rel=1e-3) and fit.model["tau2"] == pytest.approx(lo * s2, rel=1e-2)
    assert [t[1] for t in fit.terms] == pytest.approx(beta.tolist(), rel=1e-3) and [t[2] for t in fit.terms] == pytest.approx(se.tolist(), rel=1e-3)


def test_no_variance_between_groups(spark):
    rows = [(float(x + r), float(x), g) for g in range(6) for x in range(5) for r in (-1, 1)]  # every group has the mean of all
    fit = random_intercept(spark.createDataFrame(rows, "y double, x double, g int"), "y ~ x", "g")
    assert fit.model["tau2"] == pytest.approx(0.0, abs=1e-6)
