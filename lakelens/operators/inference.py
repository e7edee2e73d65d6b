"""Statistical tests: one distributed aggregation each, whose few rows are finished on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakelens.functions import special as S
from lakelens.operators.aggregates import clean_number
from lakelens.operators.quantiles import average_ranks, median
from lakelens.operators.regression import least_squares
from lakelens.sources.shared import staged


def result(data: DataFrame, /, **values: object) -> DataFrame:
    """One row of named doubles, longs and strings."""
    kind = {float: "double", int: "long", str: "string"}
    plain = {k: v.item() if isinstance(v, np.generic) else v for k, v in values.items()}
    return data.sparkSession.createDataFrame([tuple(plain.values())], ", ".join(f"{k} {kind[type(v)]}" for k, v in plain.items()))


NAN = float("nan")


def over(a: float, b: float) -> float:
    """a / b, infinite or NaN where b is 0."""
    return a / b if b else (math.copysign(math.inf, a) if a else NAN)


def p_of(tail, statistic: float, *dof: float) -> float:
    """The tail's p value; 0 at infinity, NaN without a statistic or a degree of freedom."""
    if math.isnan(statistic) or any(not d > 0 for d in dof):
        return NAN
    return 0.0 if math.isinf(statistic) else tail(statistic, *dof)


def group_stats(df: DataFrame, value: str, group: str) -> DataFrame:
    """n, mean and var (sample) of each group, nulls left out."""
    x = df.select(F.col(group).alias("g"), clean_number(value).alias("v")).where("g is not null and v is not null")
    return x.groupBy("g").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.coalesce(F.var_samp("v"), F.lit(0.0)).alias("var"))


def safe_corr(x: str, y: str) -> Column:
    """Pearson r as an aggregate, NaN where a side does not vary."""
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return F.when(spread > 0, F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))).otherwise(F.lit(NAN))


def correlation(df: DataFrame, x: str, y: str, confidence: float = 0.95) -> DataFrame:
    """Pearson r, its p value and Fisher interval (n >= 4) over complete pairs."""
    r, n = df.select(clean_number(x).alias("x"), clean_number(y).alias("y")).dropna().agg(safe_corr("x", "y"), F.count(F.lit(1))).first()
    if n < 3 or r is None or math.isnan(r):
        return result(df, n=n, r=float("nan"), p=float("nan"), low=float("nan"), high=float("nan"))
    t = r * math.sqrt((n - 2) / max(1e-300, 1 - r * r))
    from statistics import NormalDist

    half = NormalDist().inv_cdf(0.5 + confidence / 2) / math.sqrt(n - 3) if n >= 4 and abs(r) < 1 else 0.0
    z = math.atanh(max(min(r, 1 - 1e-16), -1 + 1e-16))
    return result(df, n=n, r=r, p=S.t_two_sided(t, n - 2), low=math.tanh(z - half), high=math.tanh(z + half))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation of complete pairs with average ranks, its p value beside it.

    Equal pairs are counted first, so a frequent value meets its rank once for each value it is paired with.
    """
    d = df.select(clean_number(x).alias("x"), clean_number(y).alias("y")).dropna().groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
    d = staged(d, "pairs")
    n = d.agg(F.sum("w")).first()[0] or 0
    for c in ("x", "y"):
        d = d.join(average_ranks(d, c, "w").select(F.col("value").alias(c), F.col("rank").alias(f"r{c}")), c)
    if n < 3:
        return result(df, n=n, r=NAN, p=NAN)
    a, b = (F.col(c) - (n + 1) / 2 for c in ("rx", "ry"))  # every rank's mean is (n + 1) / 2
    sxy, sxx, syy = d.agg(F.sum(F.col("w") * a * b), F.sum(F.col("w") * a * a), F.sum(F.col("w") * b * b)).first()
    r = over(sxy, math.sqrt(sxx * syy))
    if math.isnan(r):
        return result(df, n=n, r=NAN, p=NAN)
    return result(df, n=n, r=r, p=S.t_two_sided(r * math.sqrt((n - 2) / max(1e-300, 1 - r * r)), n - 2))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x, y, r) of every pair, all in one aggregation."""
    d = df.select(*[clean_number(c).alias(c) for c in columns])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    rows = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), safe_corr(a, b).alias("r")) for a, b in pairs])
    return d.agg(rows.alias("rows")).select(F.inline("rows"))


def two_groups(df: DataFrame, value: str, group: str) -> list:
    """The statistics of the only two groups, in order; any other number of groups is an error."""
    rows = group_stats(df, value, group).orderBy("g").limit(3).collect()
    if len(rows) != 2:
        raise ValueError(f"two groups are needed, there are {'more' if len(rows) > 2 else len(rows)}")
    return rows


def t_test(df: DataFrame, value: str, group: str, equal_variances: bool = False) -> DataFrame:
    """Two-sample t (Welch unless equal_variances), groups in order of value: t, df, p, Cohen's d and the difference."""
    a, b = two_groups(df, value, group)
    if min(a.n, b.n) < 2:
        return result(df, t=NAN, df=NAN, p=NAN, d=NAN, diff=a["mean"] - b["mean"])
    pooled = ((a.n - 1) * a["var"] + (b.n - 1) * b["var"]) / (a.n + b.n - 2)
    va, vb = (pooled / a.n, pooled / b.n) if equal_variances else (a["var"] / a.n, b["var"] / b.n)
    dof = float(a.n + b.n - 2) if equal_variances else over((va + vb) ** 2, va**2 / (a.n - 1) + vb**2 / (b.n - 1))
    diff = a["mean"] - b["mean"]
    t = over(diff, math.sqrt(va + vb))
    return result(df, t=t, df=dof, p=NAN if math.isnan(dof) else p_of(S.t_two_sided, t, dof), d=over(diff, math.sqrt(pooled)), diff=diff)


def paired_t_test(df: DataFrame, x: str, y: str) -> DataFrame:
    d = df.select((clean_number(x) - clean_number(y)).alias("d")).dropna()
    n, mean, sd = d.agg(F.count("d"), F.avg("d"), F.stddev_samp("d")).first()
    if n < 2:
        return result(df, n=n, t=NAN, p=NAN, dz=NAN)
    t = over(mean, sd / math.sqrt(n))
    return result(df, n=n, t=t, p=p_of(S.t_two_sided, t, n - 1), dz=over(mean, sd))


def bayes_t_test(df: DataFrame, value: str, group: str, r: float = 0.707) -> DataFrame:
    a, b = two_groups(df, value, group)
    dof = a.n + b.n - 2
    pooled = over((a.n - 1) * a["var"] + (b.n - 1) * b["var"], dof)
    t = over(a["mean"] - b["mean"], math.sqrt(pooled * (1 / a.n + 1 / b.n))) if pooled >= 0 else NAN
    if not math.isfinite(t):
        return result(df, t=float(t), bf10=NAN if math.isnan(t) else math.inf)
    return result(df, t=t, bf10=S.jzs_bf10(t, a.n * b.n / (a.n + b.n), dof, r))


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """One-way analysis of variance: F, p, eta squared; Welch's F and p beside it."""
    rows = [r for r in group_stats(df, value, group).collect() if r.n > 1]
    k, n = len(rows), sum(r.n for r in rows)
    if k < 2:
        return result(df, k=k, n=n, f=NAN, p=NAN, eta2=NAN, welch_f=NAN, welch_p=NAN)
    grand = sum(r.n * r["mean"] for r in rows) / n
    between = sum(r.n * (r["mean"] - grand) ** 2 for r in rows)
    within = sum((r.n - 1) * r["var"] for r in rows)
    f = over(between / (k - 1), within / (n - k))
    if any(r["var"] == 0 for r in rows):  # Welch's weights are not defined
        return result(df, k=k, n=n, f=f, p=p_of(S.f_tail, f, k - 1, n - k), eta2=over(between, between + within), welch_f=NAN, welch_p=NAN)
    w = [r.n / r["var"] for r in rows]
    m = sum(wi * r["mean"] for wi, r in zip(w, rows, strict=True)) / sum(w)
    spread = sum((1 - wi / sum(w)) ** 2 / (r.n - 1) for wi, r in zip(w, rows, strict=True))
    wf = sum(wi * (r["mean"] - m) ** 2 for wi, r in zip(w, rows, strict=True)) / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * spread)
    return result(df, k=k, n=n, f=f, p=S.f_tail(f, k - 1, n - k), eta2=between / (between + within), welch_f=wf, welch_p=S.f_tail(wf, k - 1, (k * k - 1) / (3 * spread)))


def levene(df: DataFrame, value: str, group: str) -> DataFrame:
    """Levene's test about the medians: one-way F of the absolute deviations."""
    x = df.select(F.col(group).alias("g"), clean_number(value).alias("v")).where("g is not null and v is not null")
    med = median(x, "v", ["g"], "m")
    a = anova(x.join(med, "g").select("g", F.abs(F.col("v") - F.col("m")).alias("z")), "z", "g")
    return a.select("k", "n", "f", "p")


def rank_sums(df: DataFrame, value: str, group: str) -> tuple[list, float, int]:
    """Rank sum and n of each group, the tie term sum(t^3 - t), and n in all."""
    x = df.select(F.col(group).alias("g"), clean_number(value).alias("v")).where("g is not null and v is not null")
    x = staged(x.groupBy("g", "v").agg(F.count(F.lit(1)).alias("w")), "counts")
    ranks = average_ranks(x, "v", "w")
    rows = x.join(ranks.withColumnRenamed("value", "v"), "v").groupBy("g").agg(F.sum(F.col("w") * F.col("rank")).alias("r"), F.sum("w").alias("n")).orderBy("g").collect()
    ties = ranks.agg(F.sum(F.col("ties").cast("double") ** 3 - F.col("ties"))).first()[0] or 0.0
    return rows, ties, sum(r.n for r in rows)


def mann_whitney(df: DataFrame, value: str, group: str) -> DataFrame:
    """U of the first group (by value), two-sided p by the normal approximation with ties, rank-biserial 1 - 2U/(n1 n2)."""
    rows, ties, n = rank_sums(df, value, group)
    if len(rows) != 2:
        raise ValueError(f"two groups are needed, there are {len(rows)}")
    a, b = rows
    u = a.r - a.n * (a.n + 1) / 2
    sd = math.sqrt(a.n * b.n / 12 * ((n + 1) - ties / (n * (n - 1))))
    z = (max(u, a.n * b.n - u) - a.n * b.n / 2 - 0.5) / sd if sd > 0 else 0.0
    return result(df, u=float(u), p=min(1.0, S.normal_two_sided(max(z, 0.0))), rank_biserial=1 - 2 * u / (a.n * b.n))


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """H corrected for ties, p and epsilon squared (H - k + 1)/(n - k)."""
    rows, ties, n = rank_sums(df, value, group)
    k = len(rows)
    if k < 2 or n <= k or ties == n**3 - n:
        return result(df, k=k, n=n, h=NAN, p=NAN, epsilon2=NAN)
    h = (12 / (n * (n + 1)) * sum(r.r**2 / r.n for r in rows) - 3 * (n + 1)) / (1 - ties / (n**3 - n))
    return result(df, k=k, n=n, h=float(h), p=S.chi2_tail(h, k - 1), epsilon2=(h - k + 1) / (n - k))


def ols(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Least squares with an intercept: term, coefficient, std_error, t, p, low, high (see `regression.least_squares`)."""
    return least_squares(df, f"{y} ~ {' + '.join(xs)}", "plain").table(df)


def vif(df: DataFrame, xs: Sequence[str]) -> DataFrame:
    """Variance inflation: the diagonal of the inverse correlation matrix; NaN for columns that do not vary, infinite where some determine others."""
    r = np.eye(len(xs))
    for row in correlation_matrix(df.dropna(subset=list(xs)), xs).collect():
        i, j = xs.index(row.x), xs.index(row.y)
        r[i, j] = r[j, i] = row.r
    flat = [i for i in range(len(xs)) if len(xs) > 1 and np.isnan(np.delete(r[i], i)).all()]
    use = [i for i in range(len(xs)) if i not in flat]
    out = np.full(len(xs), NAN)
    if use:
        kept = r[np.ix_(use, use)]
        out[use] = np.diag(np.linalg.inv(kept)) if np.linalg.matrix_rank(kept, 1e-10) == len(use) else math.inf
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(xs, out, strict=True)], "term string, vif double")


def mean_interval(df: DataFrame, value: str, confidence: float = 0.95) -> DataFrame:
    n, mean, sd = df.select(clean_number(value).alias("v")).agg(F.count("v"), F.avg("v"), F.stddev_samp("v")).first()
    if n < 2:
        return result(df, n=n, mean=NAN if mean is None else mean, low=NAN, high=NAN)
    half = S.t_quantile(0.5 + confidence / 2, n - 1) * sd / math.sqrt(n)
    return result(df, n=n, mean=mean, low=mean - half, high=mean + half)


def proportion_interval(df: DataFrame, condition: str, confidence: float = 0.95) -> DataFrame:
    """Wald interval of the share of rows that meet an SQL condition."""
    from statistics import NormalDist

    n, k = df.agg(F.count(F.lit(1)), F.count_if(F.expr(condition))).first()
    if not n:
        return result(df, n=n, p=NAN, low=NAN, high=NAN)
    p = k / n
    half = NormalDist().inv_cdf(0.5 + confidence / 2) * math.sqrt(p * (1 - p) / n)
    return result(df, n=n, p=p, low=max(0.0, p - half), high=min(1.0, p + half))


def adjust_p(df: DataFrame, key: str, p: str) -> DataFrame:
    """(key, p, bonferroni, holm, bh): adjusted p values of a table of tests."""
    every = Window.partitionBy(F.lit(0))
    up = every.orderBy(p, key)
    n, i = F.count(F.lit(1)).over(every), F.row_number().over(up)
    x = df.select(key, F.col(p).alias("p")).withColumn("n", n).withColumn("i", i)
    rise = up.rowsBetween(Window.unboundedPreceding, 0)
    fall = every.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    one = lambda c: F.least(c, F.lit(1.0))
    return x.select(
        key, "p", one(F.col("p") * F.col("n")).alias("bonferroni"), one(F.max(F.col("p") * (F.col("n") - F.col("i") + 1)).over(rise)).alias("holm"), one(F.min(F.col("p") * F.col("n") / F.col("i")).over(fall)).alias("bh")
    )


def normality(df: DataFrame, value: str, most: int = 5000) -> DataFrame:
    """Whether the values may be normal: test, n, statistic, p.

    Shapiro and Wilk's W of up to `most` values, by Royston's coefficients; D'Agostino's K2 from the moments of more.
    Fewer than three values, or constant ones, have NaN.
    """
    v = df.select(clean_number(value).alias("v")).where("v is not null")
    n, g1, g2, sd = v.agg(F.count("v"), F.skewness("v"), F.kurtosis("v"), F.stddev_pop("v")).first()
    if n < 3 or not sd:
        return result(df, test="shapiro", n=n, statistic=NAN, p=NAN)
    if n <= most:  # a bounded number of values comes to the driver
        w, p = S.shapiro_wilk([r.v for r in v.collect()])
        return result(df, test="shapiro", n=n, statistic=w, p=p)
    k2 = S.k_squared(n, g1, g2)
    return result(df, test="k2", n=n, statistic=k2, p=S.chi2_tail(k2, 2))


def durbin_watson(df: DataFrame, residual: str, order: str, by: str) -> DataFrame:
    """Sum of squared successive differences over sum of squares, by group, in the given order."""
    e = F.col(residual)
    step = e - F.lag(residual).over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("_d", step * step).groupBy(by).agg((F.sum("_d") / F.sum(e * e)).alias("dw"))


def lag_correlation(df: DataFrame, x: str, y: str, by: str, order: Sequence[str], k: int = 1) -> DataFrame:
    """Pearson r of x with y k rows before, within each series."""
    lagged = F.lag(clean_number(y), k).over(Window.partitionBy(by).orderBy(*order))
    return correlation(df.select(F.col(x).alias("x"), lagged.alias("y")), "x", "y")


def mean_difference(df: DataFrame, value: str, group: str, confidence: float = 0.95) -> DataFrame:
    """Difference of two groups' means with its Welch interval."""
    a, b = two_groups(df, value, group)
    va, vb = a["var"] / a.n, b["var"] / b.n
    dof = over((va + vb) ** 2, va**2 / (a.n - 1) + vb**2 / (b.n - 1)) if min(a.n, b.n) > 1 else NAN
    diff = a["mean"] - b["mean"]
    half = NAN if math.isnan(dof) else S.t_quantile(0.5 + confidence / 2, dof) * math.sqrt(va + vb)
    return result(df, diff=diff, se=math.sqrt(va + vb), df=dof, low=diff - half, high=diff + half)


def paired_interval(df: DataFrame, x: str, y: str, confidence: float = 0.95) -> DataFrame:
    """Mean of x - y over complete pairs with its interval."""
    return mean_interval(df.select((clean_number(x) - clean_number(y)).alias("d")), "d", confidence)


def t_route(df: DataFrame, value: str, group: str, level: float = 0.05) -> tuple[str, DataFrame]:
    """The test that two groups call for, and its row: Mann-Whitney unless both look normal, else Welch unless variances agree, else t."""
    looks = [normality(df.where(F.col(group) == r.g), value).first().p for r in two_groups(df, value, group)]
    if not min(looks) >= level or any(map(math.isnan, looks)):  # what cannot be tested does not count as normal
        return "mannwhitney", mann_whitney(df, value, group)
    equal = levene(df, value, group).first().p >= level
    return ("ttest" if equal else "welch"), t_test(df, value, group, equal_variances=equal)


def post_hoc(df: DataFrame, value: str, group: str) -> DataFrame:
    """(a, b, diff, q, p) of every pair of groups by Tukey and Kramer; groups of fewer than two values are left out."""
    rows = [r for r in group_stats(df, value, group).orderBy("g").collect() if r.n > 1]
    n, k = sum(r.n for r in rows), len(rows)
    if k < 2 or n <= k:
        return df.sparkSession.createDataFrame([], "a string, b string, diff double, q double, p double")
    within = sum((r.n - 1) * r["var"] for r in rows) / (n - k)
    out = []
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            se = math.sqrt(within / 2 * (1 / a.n + 1 / b.n))
            diff = b["mean"] - a["mean"]
            q = abs(diff) / se if se else (math.inf if diff else 0.0)
            out.append((str(a.g), str(b.g), diff, q, S.studentized_range_tail(q, k, n - k)))
    return df.sparkSession.createDataFrame(out, "a string, b string, diff double, q double, p double")


def bootstrap_mean(df: DataFrame, value: str, key: str, replicates: int = 2000, confidence: float = 0.95, seed: int = 7) -> DataFrame:
    """Percentile interval of the mean over replicates in which each row counts a Poisson(1) number of times.

    The counts come from a hash of (key, replicate), so reruns agree however the rows are partitioned. Tasks send one
    sum and one count a replicate.
    """
    cuts = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])
    reps = np.random.default_rng(seed).integers(1, 2**63, replicates, dtype=np.uint64)

    def sums(batches):
        total, count = np.zeros(replicates), np.zeros(replicates)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                with np.errstate(over="ignore"):
                    h = part["h"].to_numpy().astype(np.uint64)[:, None] ^ reps
                    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    h ^= h >> np.uint64(31)
                w = np.searchsorted(cuts, (h >> np.uint64(11)) / 2.0**53, side="right")
                total += part["v"].to_numpy() @ w
                count += w.sum(0)
        yield pd.DataFrame({"r": np.arange(replicates), "s": total, "n": count})

    rows = df.select(F.xxhash64(key).alias("h"), clean_number(value).alias("v")).where("v is not null")
    means = rows.mapInPandas(sums, "r int, s double, n double").groupBy("r").agg((F.sum("s") / F.sum("n")).alias("m"))
    low, high = (1 - confidence) / 2, (1 + confidence) / 2
    ends = means.agg(F.percentile("m", low), F.percentile("m", high)).first()  # `replicates` rows
    n, mean = rows.agg(F.count("v"), F.avg("v")).first()
    return result(df, n=n, mean=float("nan") if mean is None else mean, low=float("nan") if ends[0] is None else ends[0], high=float("nan") if ends[1] is None else ends[1])


def t_power(df: DataFrame, value: str, group: str, level: float = 0.05, wanted: float = 0.8) -> DataFrame:
    """Power of the t test of two groups at the difference that they have, and the least size of each group for `wanted`.

    Columns: n1, n2, d, power, needed; groups that do not vary, or of fewer than two values, have NaN and no needed size.
    """
    r = t_test(df, value, group, equal_variances=True).first()
    a, b = two_groups(df, value, group)
    d = abs(r.d)
    if not math.isfinite(d) or d == 0:
        return result(df, n1=a.n, n2=b.n, d=d, power=level if d == 0 else NAN, needed=-1)
    return result(df, n1=a.n, n2=b.n, d=d, power=S.t_power(d, a.n, b.n, level), needed=S.least_n(lambda n: S.t_power(d, n, n, level), wanted, 2))


def anova_power(df: DataFrame, value: str, group: str, level: float = 0.05) -> DataFrame:
    """Power of the analysis of variance at the effect that the groups have: k, n, f (Cohen), power."""
    r = anova(df, value, group).first()
    if not (0 <= r.eta2 < 1) or r.n <= r.k:
        return result(df, k=r.k, n=r.n, f=NAN, power=NAN)
    f = math.sqrt(r.eta2 / (1 - r.eta2))
    return result(df, k=r.k, n=r.n, f=f, power=S.anova_power(f, r.k, r.n, level))
