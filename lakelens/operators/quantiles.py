"""Exact quantiles and ranks of any number of groups without a buffer of their values.

Values are counted, the counts are dealt by ranges of (group, value) and summed along each range; the ranges' totals,
one row a range and group, give every count its place in its group. Ranks, medians and quartiles are read off there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakelens.sources.shared import staged


def same(keys: Sequence[str], a: str, b: str) -> Column:
    """Equality of keys, nulls being equal."""
    return F.expr(" and ".join([f"{a}.`{k}` <=> {b}.`{k}`" for k in keys]) or "true")


def running(counts: DataFrame, keys: Sequence[str], value: str, n: str = "n") -> DataFrame:
    """counts (keys, value, n; a value once a group) with before and of: the rows of lesser values, and all rows, of its group.

    No task holds more than a range: a group of any size spans as many ranges as it needs.
    """
    group = F.xxhash64(*keys) if keys else F.lit(0).cast("long")
    x = counts.withColumn("_g", group).repartitionByRange(*keys, value).sortWithinPartitions(*keys, value).withColumn("_part", F.spark_partition_id())
    names = x.columns
    at, weight = names.index("_g"), names.index(n)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for b in batches:
            g, w = b.column(at).to_numpy(), b.column(weight).to_numpy()
            if not len(g):
                continue
            first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            run = np.diff(np.r_[first, len(g)])
            sums = np.cumsum(w) - w
            before = sums - np.repeat(sums[first], run)
            if g[0] == last:
                before[: run[0]] += total
            last, total = g[-1], before[-1] + w[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before, pa.int64())], [*names, "_before"])

    x = staged(x.mapInArrow(add, x.withColumn("_before", F.lit(0).cast("long")).schema), "running")
    cells = x.groupBy(*keys, "_part").agg(F.sum(n).alias("_n"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # without keys there is one row a range
    cells = cells.withColumn("_off", F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("of", F.sum("_n").over(w))
    x = x.alias("x").join(cells.drop("_n").alias("c"), same(["_part", *keys], "x", "c"))
    return x.select(*[F.col(f"x.`{c}`") for c in counts.columns], (F.col("_before") + F.col("_off")).alias("before"), "of")


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, value, n) of the values that are not null."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def picked(run: DataFrame, value: str, probabilities: dict[str, float], by: Sequence[str] = (), n: str = "n") -> DataFrame:
    """(by, of, a column a quantile) from running counts; between two values they are interpolated in proportion."""
    place = {k: (F.col("of") - 1) * F.lit(float(p)) for k, p in probabilities.items()}
    holds = lambda i: (F.col("before") <= i) & (i < F.col("before") + F.col(n))
    ends = {k: (holds(F.floor(h)), holds(F.ceil(h))) for k, h in place.items()}
    wanted = F.lit(False)
    for lo, hi in ends.values():
        wanted = wanted | lo | hi
    x = run.where(wanted).groupBy(*by, "of").agg(*[F.max(F.when(c, F.col(value))).alias(f"_{k}_{i}") for k, pair in ends.items() for i, c in enumerate(pair)])
    between = lambda k, h: F.col(f"_{k}_0") + (F.col(f"_{k}_1") - F.col(f"_{k}_0")) * (h - F.floor(h))
    return x.select(*by, "of", *[between(k, h).alias(k) for k, h in place.items()])


def quantiles(df: DataFrame, value: str, probabilities: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """(by, a column a quantile) of each group with a value that is not null; a null key is a group of its own."""
    return picked(running(value_counts(df, value, by), by, value), value, probabilities, by).drop("of")


def median(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "median") -> DataFrame:
    return quantiles(df, value, {name: 0.5}, by)


def average_ranks(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """(value, ties, rank): each distinct value's average rank; rows may stand for `weight` rows each."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(n.alias("ties"))
    return running(counts, [], "value", "ties").select("value", "ties", (F.col("before") + (F.col("ties") + 1) / 2).alias("rank"))
