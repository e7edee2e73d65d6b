"""Power, Shapiro and Wilk's test and degenerate groups, against published values."""

import math
import random

import numpy as np
import pytest

from lakelens.functions import special as S
from lakelens.operators import inference


def test_published_sample_sizes():
    """Cohen's tables: two-sided, level 0.05, power 0.8."""
    assert [S.least_n(lambda n: S.t_power(d, n, n), 0.8, 2) for d in (0.2, 0.5, 0.8)] == [394, 64, 26]  # noqa: B023
    assert [math.ceil(S.least_n(lambda n: S.anova_power(0.25, k, n), 0.8, k + 1) / k) for k in (3, 4, 5)] == [53, 45, 40]  # noqa: B023
    assert [S.least_n(lambda n: S.regression_power(0.15, u, n), 0.8, u + 2) for u in (2, 3, 5)] == [68, 77, 92]  # noqa: B023
    assert S.t_power(0.5, 64, 64) == pytest.approx(0.8015, abs=1e-3) and S.t_power(0.0, 20, 20) == pytest.approx(0.05, abs=1e-9)


def test_noncentral_f_against_draws():
    rng = np.random.default_rng(3)
    num = ((rng.normal(size=(400000, 3)) + np.array([2.0, 0, 0])) ** 2).sum(1) / 3
    den = (rng.normal(size=(400000, 12)) ** 2).sum(1) / 12
    assert S.noncentral_f_tail(2.5, 3, 12, 4.0) == pytest.approx(float((num / den > 2.5).mean()), abs=3e-3)


def test_shapiro_wilk():
    men = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]  # weights of Shapiro and Wilk's paper: W = 0.79
    w, p = S.shapiro_wilk(men)
    assert w == pytest.approx(0.7888, abs=2e-3) and p == pytest.approx(0.0067, abs=1e-3)
    assert S.shapiro_wilk([1.0, 2.0, 3.0]) == pytest.approx((1.0, 1.0))
    rng = random.Random(1)
    rejected = [S.shapiro_wilk([rng.gauss(0, 1) for _ in range(n)])[1] < 0.05 for n in (8, 40, 300) for _ in range(300)]
    assert 0.03 < sum(rejected) / len(rejected) < 0.07
    assert S.shapiro_wilk([rng.expovariate(1) for _ in range(200)])[1] < 1e-6


def test_degenerate_tables_give_nan_or_a_plain_error(spark):
    x = spark.createDataFrame([(1.0, 2.0, "a"), (1.0, 3.0, "a"), (1.0, 5.0, "b"), (1.0, 8.0, "b")], "c double, v double, g string")
    none = x.where("false")
    nan = lambda v: math.isnan(v)
    assert nan(inference.normality(x, "c").first().p) and nan(inference.normality(none, "c").first().p) and nan(inference.normality(x.limit(2), "v").first().p)
    assert inference.t_route(x, "c", "g")[0] == "mannwhitney"
    assert {r.term: r.vif for r in inference.vif(x.selectExpr("c", "v", "v * v as w"), ["c", "v", "w"]).collect()}["v"] > 1
    assert nan({r.term: r.vif for r in inference.vif(x, ["c", "v"]).collect()}["c"])
    assert all(math.isinf(r.vif) for r in inference.vif(x.selectExpr("v", "v * 2 as w"), ["v", "w"]).collect())
    assert nan(inference.bayes_t_test(x, "c", "g").first().bf10) and nan(inference.correlation(x, "c", "v").first().r)
    assert nan(inference.proportion_interval(none, "v > 1").first().p)
    assert nan(inference.mean_difference(x.where("v <> 3"), "v", "g").first().low)
    for f in (inference.mean_difference, inference.bayes_t_test, inference.t_power):
        with pytest.raises(ValueError, match="two groups"):
            f(x.where("g = 'a'"), "v", "g")
    assert nan(inference.t_power(x, "c", "g").first().power) and nan(inference.anova_power(x, "c", "g").first().power)
    got = inference.t_power(x, "v", "g").first()
    assert (got.n1, got.n2) == (2, 2) and 0.05 < got.power < 1 and got.needed >= 2
