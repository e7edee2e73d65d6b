"""Linear models over any number of rows: least squares with categories and interactions, and a random intercept.

The design is a column of arrays. Least squares reduces blocks of rows to triangular factors that are merged in rounds,
so nothing is squared and no round meets more than FAN factors in a task; a second pass, with the small inverse sent to
the tasks, gives leverages and what rests on them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakelens.functions import special as S
from lakelens.operators.aggregates import clean_number
from lakelens.sources.shared import staged

NAN, FAN = float("nan"), 64


@dataclass(frozen=True)
class Term:
    """A column of the design: the product of some factors, each a number's column or an indicator of a category."""

    name: str
    value: Column


def factors(formula: str) -> tuple[str, list[tuple[str, ...]]]:
    """("y", [("a",), ("b",), ("a", "b")]) of "y ~ a + b + a:b"; a*b stands for a + b + a:b, C(a) for a as categories."""
    left, tilde, right = formula.partition("~")
    if not tilde or not left.strip() or not right.strip():
        raise ValueError(f"not a formula: {formula!r}")
    out: list[tuple[str, ...]] = []
    for part in right.split("+"):
        names = [x.strip() for x in part.split("*")]
        if not all(names):
            raise ValueError(f"a term is missing in {formula!r}")
        every = [(n,) for n in names] + [tuple(names[i] for i in range(len(names)) if m >> i & 1) for m in range(1, 1 << len(names)) if m.bit_count() > 1] if len(names) > 1 else [tuple(x.strip() for x in part.split(":"))]
        out += [t for t in every if t not in out]
    return left.strip(), out


def design(df: DataFrame, formula: str, most: int = 500, group: str | None = None) -> tuple[DataFrame, list[str]]:
    """(x array<double>, y double) of the complete rows, and the names of x; the first is the intercept.

    Texts and booleans are categories, as is C(name): indicators of every level but the least. Dates and times are
    seconds since 1970. More than `most` columns are an error. With a group its column stays, as g.
    """
    y, terms = factors(formula)
    if df.schema[y].dataType.typeName() in ("timestamp", "timestamp_ntz", "date"):
        raise ValueError(f"{y} is a time, not a number")
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    names = {m[1] if (m := re.fullmatch(r"C\((.+)\)", n)) else n: bool(m) for t in terms for n in t}
    if unknown := set(names) - set(kinds):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    category = {n for n, c in names.items() if c or kinds[n] in ("string", "boolean")}

    def number(n: str) -> Column:
        return F.col(n).cast("timestamp").cast("double") if kinds[n] in ("timestamp", "timestamp_ntz", "date") else clean_number(n)

    kept = df.select(*[(F.col(n).cast("string") if n in category else number(n)).alias(f"_{i}") for i, n in enumerate(names)], clean_number(y).alias("_y"), *([F.col(group).alias("g")] if group else [])).dropna()
    at = {n: f"_{i}" for i, n in enumerate(names)}
    levels: dict[str, list[str]] = {}
    for n in category:
        found = [r[0] for r in kept.select(at[n]).distinct().orderBy(at[n]).limit(most + 1).collect()]
        if len(found) > most:
            raise ValueError(f"{n} has more than {most} levels")
        levels[n] = found

    def columns(factor: str) -> list[Term]:
        n = m[1] if (m := re.fullmatch(r"C\((.+)\)", factor)) else factor
        if n in category:
            return [Term(f"C({n})[{v}]", (F.col(at[n]) == v).cast("double")) for v in levels[n][1:]]
        return [Term(n, F.col(at[n]))]

    made = [Term("intercept", F.lit(1.0))]
    for t in terms:
        product = [Term("", F.lit(1.0))]
        for f in t:
            product = [Term(f"{a.name}:{b.name}".strip(":"), a.value * b.value) for a in product for b in columns(f)]
        made += product
    if len(made) > most:
        raise ValueError(f"the design has {len(made)} columns, more than {most}")
    return kept.select(F.array(*[c.value for c in made]).alias("x"), F.col("_y").alias("y"), *(["g"] if group else [])), [c.name for c in made]


def triangle(rows: DataFrame, k: int, shift: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The triangular factor of [x y] over all rows, columns less their shift and over their scale."""

    def reduce_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, k))
        for b in batches:
            if len(b):
                m = (np.column_stack([np.stack(b["x"].to_numpy()), b["y"].to_numpy()]) - shift) / scale
                r = np.linalg.qr(np.vstack([r, m]), "r")
        if len(r):
            yield pd.DataFrame({"part": [0], "r": [r.ravel().tolist()]})

    def merge(batch: pd.DataFrame) -> pd.DataFrame:
        r = np.linalg.qr(np.vstack([np.reshape(x, (-1, k)) for x in batch["r"]]), "r")
        return pd.DataFrame({"part": [0], "r": [r.ravel().tolist()]})

    kind = "part int, r array<double>"
    x = staged(rows.mapInPandas(reduce_, kind).withColumn("part", F.spark_partition_id()), "factors")
    while x.count() > FAN:
        x = staged(x.groupBy(F.floor(F.col("part") / FAN).cast("int").alias("p")).applyInPandas(lambda key, b: merge(b).assign(part=int(key[0])), kind), "factors")
    found = [np.reshape(r.r, (-1, k)) for r in x.collect()]  # at most FAN
    return np.linalg.qr(np.vstack(found), "r") if found else np.zeros((0, k))


@dataclass
class Fit:
    """A fitted model: a row a term, and the model's own figures."""

    terms: list[tuple[str, float, float, float, float, float, float]]
    model: dict[str, float | int | str]

    def table(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame(self.terms, "term string, coefficient double, std_error double, t double, p double, low double, high double")


def _t_rows(names, beta, se, dof, confidence):
    q = S.t_quantile(0.5 + confidence / 2, dof) if dof > 0 else NAN
    out = []
    for name, b, e in zip(names, beta.tolist(), se.tolist(), strict=True):
        t = b / e if e else (math.copysign(math.inf, b) if b else NAN)
        p = NAN if math.isnan(t) or not dof > 0 else 0.0 if math.isinf(t) else S.t_two_sided(t, dof)
        out.append((name, b, e, t, p, b - q * e, b + q * e))
    return out


def least_squares(df: DataFrame, formula: str, errors: str = "auto", level: float = 0.05, confidence: float = 0.95) -> Fit:
    """Least squares of a formula. errors: "plain", "hc3", or "auto": hc3 if Breusch and Pagan's test rejects at `level`.

    A column that the columns before it determine has NaN for its coefficient and is left out. Rows with a null or NaN
    are left out; fewer rows than columns give NaN. The model's figures: n, r2, adj_r2, f, p, f2 (Cohen), bp, bp_p, errors.
    """
    rows, names = design(df, formula)
    rows = staged(rows, "design")
    k = len(names)
    s = rows.agg(F.count(F.lit(1)), *[f(F.get("x", F.lit(i))) for i in range(1, k) for f in (F.avg, F.stddev_pop)], F.avg("y"), F.stddev_pop("y")).first()
    n, spread = s[0], [v or 0.0 for v in s[1:]]
    shift, scale = np.zeros(k + 1), np.ones(k + 1)
    shift[1:], scale[1:] = spread[::2], [v if v > 0 else 1.0 for v in spread[1::2]]
    r = triangle(rows, k + 1, shift, scale) if n else np.zeros((0, k + 1))
    r = np.vstack([r, np.zeros((max(0, k + 1 - len(r)), k + 1))])
    use = []  # the columns that those before them do not determine
    for j in range(k):
        q = np.linalg.lstsq(r[:, use], r[:, j], rcond=None)[0] if use else np.zeros(0)
        if np.linalg.norm(r[:, j] - r[:, use] @ q) > 1e-9 * max(math.sqrt(n), 1e-300) and (j == 0 or spread[2 * j - 1] > 0):
            use.append(j)
    dof = n - len(use)
    empty = Fit([(name, NAN, NAN, NAN, NAN, NAN, NAN) for name in names], dict(n=n, r2=NAN, adj_r2=NAN, f=NAN, p=NAN, f2=NAN, bp=NAN, bp_p=NAN, errors="plain"))
    if not use or dof < 0:
        return empty
    ru = np.linalg.qr(np.column_stack([r[:, use], r[:, k]]), "r")
    m = len(use)
    inv_r = np.linalg.inv(ru[:m, :m])
    gamma, rss = inv_r @ ru[:m, m], float(ru[m, m] ** 2) if len(ru) > m else 0.0
    inverse = inv_r @ inv_r.T

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums of squared residuals, their squares, with x; and of x x' by squared residuals over (1 - leverage)²."""
        total = np.zeros(2 + m + m * m)
        for b in batches:
            if len(b):
                z = (np.column_stack([np.stack(b["x"].to_numpy()), b["y"].to_numpy()]) - shift) / scale
                x = z[:, use]
                e = z[:, k] - x @ gamma
                h = np.minimum(np.einsum("ij,jk,ik->i", x, inverse, x), 1.0)
                left = np.where(h < 1 - 1e-12, 1 - h, np.inf)  # a row that fixes a column by itself has no residual
                w = (e / left)[:, None] * x
                total += np.concatenate([[np.sum(e**2), np.sum(e**4)], x.T @ e**2, (w.T @ w).ravel()])
        yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    sums = np.zeros(2 + m + m * m)
    for row in rows.mapInPandas(second, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        sums[row.i] = row.v
    e2, e4, xe2 = sums[0], sums[1], sums[2 : 2 + m]
    explained = float(xe2 @ inverse @ xe2) - e2**2 / n
    around = e4 - e2**2 / n
    tiny = 1e-20 * n  # y is scaled to one, so what is below is rounding
    bp = n * explained / around if m > 1 and around > tiny else NAN
    bp_p = S.chi2_tail(max(bp, 0.0), m - 1) if not math.isnan(bp) else NAN
    robust = errors == "hc3" or (errors == "auto" and bp_p < level)
    cov = inverse @ sums[2 + m :].reshape(m, m) @ inverse if robust else inverse * (rss / dof if dof else NAN)
    # Back from shifted and scaled columns.
    back = np.zeros((k, m))
    for i, j in enumerate(use):
        back[j, i] = scale[k] / scale[j]
        if j:
            back[0, i] = -scale[k] * shift[j] / scale[j]
    beta = back @ gamma
    beta[0] += shift[k]
    se = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", back, cov, back), 0.0))
    for j in set(range(k)) - set(use):
        beta[j] = se[j] = NAN
    total = n * (1.0 if spread[2 * k - 1] > 0 else 0.0)  # y is scaled, or constant
    r2 = 1 - rss / total if total > 0 else NAN
    f = (total - rss) / (m - 1) / (rss / dof) if m > 1 and dof > 0 and rss > tiny else NAN
    figures = dict(n=n, r2=r2, adj_r2=1 - (1 - r2) * (n - 1) / dof if dof else NAN, f=f, p=S.f_tail(f, m - 1, dof) if not math.isnan(f) else NAN, f2=r2 / (1 - r2) if r2 < 1 else NAN, bp=bp, bp_p=bp_p, errors="hc3" if robust else "plain")
    return Fit(_t_rows(names, beta, se, dof, confidence), figures)


def random_intercept(df: DataFrame, formula: str, group: str, points: int = 16, rounds: int = 9, confidence: float = 0.95) -> Fit:
    """A linear model with a random intercept a group, by restricted maximum likelihood.

    Each group becomes its number of rows and its sums of the design's columns, in one aggregation. The ratio of the
    two variances is searched on `points` values at a time: the groups' table gives all their criteria in one pass, and
    what comes to the driver does not depend on the number of groups. Rows with a null or NaN, group included, are left out. The
    model's figures: n, groups, log_likelihood (restricted), sigma2 and tau2 (the variances within and between groups).
    """
    rows, names = design(df, formula, group=group)
    k = len(names)
    rows = staged(rows, "design")
    s = rows.agg(F.count(F.lit(1)), *[f(F.get("x", F.lit(i))) for i in range(1, k) for f in (F.avg, F.stddev_pop)], F.avg("y"), F.stddev_pop("y")).first()
    n, spread = s[0], [v or 0.0 for v in s[1:]]
    shift, scale = np.zeros(k + 1), np.ones(k + 1)
    shift[1:], scale[1:] = spread[::2], [v if v > 0 else 1.0 for v in spread[1::2]]
    nothing = Fit([(name, NAN, NAN, NAN, NAN, NAN, NAN) for name in names], dict(n=n, groups=0, log_likelihood=NAN, sigma2=NAN, tau2=NAN))
    r = triangle(rows.drop("g"), k + 1, shift, scale) if n > k else np.zeros((0, k + 1))
    if n <= k or np.linalg.matrix_rank(r[:, :k]) < k:
        return nothing
    whole = r.T @ r
    z = [(F.lit(1.0) if i == 0 else (F.get("x", F.lit(i)) if i < k else F.col("y")) - float(shift[i])) / float(scale[i]) for i in range(k + 1)]
    groups = staged(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in z]).alias("s")).select("n", "s"), "groups")

    def criteria(ratios: np.ndarray) -> list[tuple[float, np.ndarray, float]]:
        """For each ratio tau2 / sigma2: the restricted log likelihood, the weighted cross products and the residual sum."""

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            logs, cross = np.zeros(len(ratios)), np.zeros((len(ratios), (k + 1) ** 2))
            for b in batches:
                if len(b):
                    size, s_ = b["n"].to_numpy(float), np.stack(b["s"].to_numpy())
                    for i, t in enumerate(ratios):
                        logs[i] += np.log1p(size * t).sum()
                        cross[i] += ((s_ * (t / (1 + size * t))[:, None]).T @ s_).ravel()
            yield pd.DataFrame({"i": np.arange(len(ratios)), "v": [[a, *c] for a, c in zip(logs.tolist(), cross.tolist(), strict=True)]})

        wide = groups.mapInPandas(sums, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
        found = np.zeros((len(ratios), 1 + (k + 1) ** 2))
        for row in wide.collect():  # points times the design's squared width
            found[row.i, row.j] = row.v
        out = []
        for logs, *cross in found.tolist():
            a = whole - np.reshape(cross, (k + 1, k + 1))
            beta = np.linalg.solve(a[:k, :k], a[:k, k])
            rss = max(a[k, k] - a[:k, k] @ beta, 1e-300)
            sign = np.linalg.slogdet(a[:k, :k])[1]
            out.append((-0.5 * ((n - k) * (math.log(2 * math.pi * rss / (n - k)) + 1) + logs + sign), a, rss))
        return out

    # The ratio on a scale from 0 to 1, u / (1 - u); each round keeps the two steps about the best point.
    lo, hi = 0.0, 1.0 - 1e-9
    for _ in range(rounds):
        us = np.linspace(lo, hi, points)
        at = int(np.argmax([c[0] for c in criteria(us / (1 - us))]))
        lo, hi = us[max(0, at - 1)], us[min(points - 1, at + 1)]
    u = us[at]
    best, a, rss = criteria(np.array([u / (1 - u)]))[0]
    sigma2 = rss / (n - k)
    gamma, cov = np.linalg.solve(a[:k, :k], a[:k, k]), np.linalg.inv(a[:k, :k]) * sigma2
    back = np.diag(scale[k] / scale[:k])
    back[0, 1:] = -scale[k] * shift[1:k] / scale[1:k]
    beta = back @ gamma
    beta[0] += shift[k]
    # Scaling the columns moved the likelihood by their Jacobians.
    best += -(n - k) * math.log(scale[k]) - float(np.log(scale[1:k]).sum())
    se = np.sqrt(np.einsum("ij,jk,ik->i", back, cov, back))
    q = NormalDist().inv_cdf(0.5 + confidence / 2)
    terms = [(name, b, e, b / e if e else NAN, S.normal_two_sided(b / e) if e else NAN, b - q * e, b + q * e) for name, b, e in zip(names, beta.tolist(), se.tolist(), strict=True)]
    y2 = float(scale[k] ** 2)
    return Fit(terms, dict(n=n, groups=groups.count(), log_likelihood=best, sigma2=sigma2 * y2, tau2=sigma2 * y2 * u / (1 - u)))
