"""Time series: frequency, resampling with empty bins, rolling windows, change, outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakelens.operators.aggregates import AGGREGATES
from lakelens.operators.quantiles import median

#: Greatest median gap in seconds of each frequency.
GAPS = (("S", 60), ("T", 3600), ("H", 129600), ("D", 1209600), ("W", 5184000), ("M", 15552000), ("Q", 62208000))
UNITS = {"S": "second", "T": "minute", "H": "hour", "D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}


def infer_frequency(df: DataFrame, at: str) -> DataFrame:
    """gap (median seconds between successive times) and frequency.

    Gaps are taken of the distinct times, range partitioned by day so that no task sorts the whole series; the gap
    across a day's edge uses the day before's last time.
    """
    t = df.select(F.col(at).cast("timestamp").alias("t")).where("t is not null").distinct().withColumn("d", F.to_date("t"))
    prev = F.lag("t").over(Window.partitionBy("d").orderBy("t"))
    days = t.groupBy("d").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    edge = days.withColumn("p", F.lag("last").over(Window.orderBy("d"))).select("d", F.col("first").alias("t"), "p")
    gaps = t.withColumn("p", prev).join(edge.withColumnRenamed("p", "q"), ["d", "t"], "left").select((F.unix_micros("t") - F.unix_micros(F.coalesce("p", "q"))).alias("g")).where("g is not null")
    out = df.sparkSession.range(1).select(F.lit(0)).join(median(gaps, "g", name="gap"), F.lit(True), "left").select((F.col("gap") / 1e6).alias("gap"))
    f = F.when(F.col("gap").isNull(), None)
    for name, most in GAPS:
        f = f.when(F.col("gap") <= most, name)
    return out.select("gap", f.otherwise("Y").alias("frequency"))


def bin_label(t: Column, unit: str) -> Column:
    """The bin's label: its start, but for weeks (to Sunday), months, quarters and years its last day."""
    if unit in ("S", "T", "H", "D"):
        return F.date_trunc(UNITS[unit], t)
    start = F.date_trunc(UNITS[unit], t)
    step = {"W": "interval 7 days", "M": "interval 1 month", "Q": "interval 3 months", "Y": "interval 1 year"}[unit]
    return start + F.expr(step) - F.expr("interval 1 day")


def resample(df: DataFrame, at: str, value: str, unit: str = "D", aggregate: str = "mean", spine: bool = True) -> DataFrame:
    """(bin, value): the aggregate of each bin; with spine the empty bins between first and last too (null; 0 for sum and count)."""
    x = df.select(bin_label(F.col(at).cast("timestamp"), unit).alias("bin"), F.col(value).cast("double").alias("v")).where("bin is not null")
    if aggregate == "median":
        out = x.select("bin").distinct().join(median(x, "v", ["bin"], "value"), "bin", "left")
    else:
        out = x.groupBy("bin").agg(AGGREGATES[aggregate]("v").cast("double").alias("value"))
    if not spine:
        return out
    out = empty_bins(out, unit).join(out, "bin", "left")
    return out.withColumn("value", F.coalesce("value", F.lit(0.0))) if aggregate in ("sum", "count") else out


def empty_bins(bins: DataFrame, unit: str) -> DataFrame:
    """All bins of a unit from the first to the last of the column bin.

    Bins shorter than a day are made day by day in many tasks, so that no array holds more than a day of them.
    """
    ends = bins.agg(F.min("bin").alias("a"), F.max("bin").alias("b")).where("a is not null")
    if unit in ("S", "T", "H"):
        days = ends.select("a", "b", F.explode(F.sequence(F.date_trunc("day", "a"), F.date_trunc("day", "b"), F.expr("interval 1 day"))).alias("day")).repartition("day")
        step = F.expr(f"interval 1 {UNITS[unit]}")
        return days.select("a", "b", F.explode(F.sequence("day", F.col("day") + F.expr("interval 1 day") - step, step)).alias("bin")).where("bin between a and b").select("bin")
    step = {"D": "interval 1 day", "W": "interval 7 days", "M": "interval 1 month", "Q": "interval 3 months", "Y": "interval 1 year"}[unit]
    starts = F.sequence(F.date_trunc(UNITS[unit], "a"), F.date_trunc(UNITS[unit], "b"), F.expr(step))
    return ends.select(F.explode(starts).alias("start")).select(bin_label(F.col("start"), unit).alias("bin"))


def over(name: str, value: str, w) -> Column:
    """An aggregate over a window frame; the median is taken of the frame's sorted values."""
    if name != "median":
        return AGGREGATES[name](value).over(w)
    v = F.array_sort(F.collect_list(value).over(w))
    n = F.size(v)
    return F.when(n > 0, (F.element_at(v, F.greatest(F.floor((n + 1) / 2), F.lit(1)).cast("int")) + F.element_at(v, F.greatest(F.ceil((n + 1) / 2), F.lit(1)).cast("int"))) / 2)


def rolling(df: DataFrame, order: str, value: str, rows: int, aggregates: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Aggregates over the last `rows` rows, the current included; fewer at the start."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - rows, 0)
    return df.select(*df.columns, *[over(a, value, w).alias(f"rolling_{a}") for a in aggregates])


def rolling_time(df: DataFrame, at: str, value: str, days: int, aggregate: str, by: Sequence[str] = ()) -> DataFrame:
    """Aggregate over the time (t - days, t], open at the left."""
    w = Window.partitionBy(*by).orderBy("_us").rangeBetween(-days * 86_400_000_000 + 1, 0)
    x = df.withColumn("_us", F.unix_micros(F.col(at).cast("timestamp")))
    return x.withColumn(f"rolling_{aggregate}", over(aggregate, value, w)).drop("_us")


def changes(df: DataFrame, order: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """diff, cumsum and pct_change (in percent) in the given order."""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.lag(value).over(w)
    total = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.select(*df.columns, (F.col(value) - before).alias("diff"), total.alias("cumsum"), F.when(before != 0, (F.col(value) / before - 1) * 100).alias("pct_change"))


def only(row: DataFrame) -> Column:
    """The value of a table of one column and at most one row."""
    found = row.first()
    return F.lit(None if found is None else found[0]).cast("double")


def robust_outliers(df: DataFrame, value: str, by: str | None = None, limit: float = 3.5) -> DataFrame:
    """df with outlier: 0.6745 |x - median| / MAD above limit, a MAD of 0 taken as 1."""
    keys = [by] if by else []
    med = median(df, value, keys, "_med")
    x = df.join(med, keys) if by else df.withColumn("_med", only(med))
    dev = F.abs(F.col(value) - F.col("_med"))
    mad = median(x.withColumn("_dev", dev), "_dev", keys, "_mad")
    x = x.join(mad, keys) if by else x.withColumn("_mad", only(mad))
    scale = F.when(F.col("_mad") == 0, 1.0).otherwise(F.col("_mad"))
    return x.withColumn("outlier", 0.6745 * dev / scale > limit).drop("_med", "_mad")
