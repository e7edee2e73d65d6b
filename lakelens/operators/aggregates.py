"""Summaries, group aggregation, distributions and chart inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakelens.operators.quantiles import median, quantiles, same

#: Aggregations by name, as callers give them; the median, which Spark can only take of a buffer of all values, is read off running counts.
AGGREGATES = {"mean": F.avg, "sum": F.sum, "count": F.count, "median": median, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp}

QUARTILES = {"q1": 0.25, "med": 0.5, "q3": 0.75}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")]


def clean_number(c: str | Column) -> Column:
    """A number as double, NaN as null."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(x), x)


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row a numeric column: count, nulls, mean, median, std, sum, min, max, q1, q3, iqr; a column without values has nulls."""
    columns = list(columns or numeric_columns(df))
    x = df.select(*[clean_number(c).alias(c) for c in columns])
    long = x.unpivot([], columns, "column", "value")
    plain = long.groupBy("column").agg(
        F.count("value").alias("count"), F.count_if(F.col("value").isNull()).alias("nulls"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    q = quantiles(long, "value", QUARTILES, ["column"])
    return plain.join(q, "column", "left").select("column", "count", "nulls", "mean", F.col("med").alias("median"), "std", "sum", "min", "max", "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"))


def categorical_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, unique, top (least of the most frequent) and freq of each column."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value").where("value is not null")
    freq = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "value"))
    return freq.groupBy("column").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), best.alias("b")).select("column", "count", "unique", F.col("b.value").alias("top"), (-F.col("b.m")).alias("freq"))


def group_aggregate(df: DataFrame, keys: Sequence[str], values: Sequence[str], aggregates: Sequence[str], keep_null_keys: bool = False) -> DataFrame:
    """Several aggregates of several columns by key, named value_aggregate; rows with a null key go unless kept."""
    if unknown := set(aggregates) - set(AGGREGATES):
        raise ValueError(f"unknown aggregates: {sorted(unknown)}")
    x = df if keep_null_keys else df.dropna(subset=list(keys))
    out = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *[AGGREGATES[a](v).alias(f"{v}_{a}") for v in values for a in aggregates if a != "median"])
    if "median" in aggregates:  # all values' medians from one table of running counts
        long = x.select(*keys, F.inline(F.array(*[F.struct(F.lit(v).alias("_of"), F.col(v).cast("double").alias("_v")) for v in values])))
        m = median(long, "_v", [*keys, "_of"], "_m").groupBy(*keys).agg(*[F.max(F.when(F.col("_of") == v, F.col("_m"))).alias(f"{v}_median") for v in values])
        out = out.alias("x").join(m.alias("m"), same(keys, "x", "m"), "left").select("x.*", *[f"m.{v}_median" for v in values])
    return out.select(*keys, *[f"{v}_{a}" for v in values for a in aggregates])


def parsed_number(c: str | Column) -> Column:
    """The number in a text, everything but digits, point and minus stripped; null if none is left."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"[^0-9.\-]", "").try_cast("double")


def share_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """Sum by key (null key kept) with its share of the whole."""
    total = F.sum("total").over(Window.partitionBy(F.lit(0)))
    return df.groupBy(key).agg(F.sum(value).alias("total")).withColumn("share", F.col("total") / total)


def box_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, whiskers (extremes within 1.5 iqr of the quartiles), number of fliers, mean and n by group."""
    x = df.select(F.col(group).alias("group"), clean_number(value).alias("v")).where("group is not null and v is not null")
    q = quantiles(x, "v", QUARTILES, ["group"])
    q = q.withColumn("lo", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).withColumn("hi", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    inside = F.col("v").between(F.col("lo"), F.col("hi"))
    return x.join(q, "group").groupBy("group", "q1", "med", "q3").agg(
        F.min(F.when(inside, F.col("v"))).alias("whislo"), F.max(F.when(inside, F.col("v"))).alias("whishi"), F.count_if(~inside).alias("fliers"), F.avg("v").alias("mean"), F.count("v").alias("n")
    )


def moments(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, std and bias-corrected skewness and excess kurtosis (null where undefined)."""
    x = df.select(*by, clean_number(value).alias("v")).where("v is not null")
    s = x.groupBy(*by).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.skewness("v").alias("g1"), F.kurtosis("v").alias("g2"))
    n = F.col("n")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return s.select(*by, "n", "mean", "std", skew.alias("skew"), kurt.alias("kurtosis"))


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Equal-width bins from least to greatest, the last closed: bin, low, high, count. Empty bins count 0."""
    x = df.select(clean_number(value).alias("v")).where("v is not null")
    ends = x.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    counts = x.crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = ends.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return spine.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def value_counts(df: DataFrame, columns: Sequence[str], top: int = 10) -> DataFrame:
    """The `top` most frequent values of each column, ties by value."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value").where("value is not null")
    n = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "value"))
    return n.withColumn("rank", rank).where(F.col("rank") <= top)


def entropy(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Shannon entropy (bits) and the share of the commonest value of each column, nulls left out."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value").where("value is not null")
    n = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    # log2 N - sum(n log2 n) / N needs no second pass
    s = n.groupBy("column").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("l"), F.max("n").alias("m"))
    return s.select("column", (F.log2("t") - F.col("l") / F.col("t")).alias("entropy"), (F.col("m") / F.col("t")).alias("top_ratio"))


def exploded_counts(df: DataFrame, column: str, separator: str = ",", top: int = 10) -> DataFrame:
    """Most frequent items of a separated list column, trimmed and lower-cased, ties by item."""
    items = df.select(F.explode(F.split(column, F.lit(separator))).alias("tag")).select(F.lower(F.trim("tag")).alias("tag")).where("tag <> ''")
    return items.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(top)


def telemetry(df: DataFrame, key: str, status: str, at: str) -> DataFrame:
    """Latest status and numbers of success and failure by key."""
    ok = F.lower(status).isin("ok", "success")
    return df.groupBy(key).agg(F.max_by(status, at).alias("latest"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))
