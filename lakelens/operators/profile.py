"""Table profiles: nulls, duplicates, key candidates, semantic types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.operators.aggregates import numeric_columns


def profile_columns(df: DataFrame) -> DataFrame:
    """One row a column: rows, nulls, null_pct, unique, duplicates (rows beyond the first of each value), key.

    key: unique_key (no null, no duplicate), likely_key (under 1 % duplicates) or none. Values are compared as text.
    """
    long = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]).unpivot([], df.columns, "column", "value")
    n = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    some = F.col("value").isNotNull()
    s = n.groupBy("column").agg(F.sum("n").alias("rows"), F.sum(F.when(some, 0).otherwise(F.col("n"))).alias("nulls"), F.count_if(some).alias("unique"), F.sum(F.col("n") - 1).alias("duplicates"))
    key = F.when((F.col("nulls") == 0) & (F.col("duplicates") == 0), "unique_key").when(F.col("duplicates") / F.col("rows") < 0.01, "likely_key").otherwise("none")
    return s.select("column", "rows", "nulls", F.round(100 * F.col("nulls") / F.col("rows"), 2).alias("null_pct"), "unique", "duplicates", key.alias("key"))


def semantic_types(df: DataFrame) -> DataFrame:
    """(column, semantic): identifier by name, else measure if numeric, else category."""
    numbers = set(numeric_columns(df))
    kind = lambda c: "identifier" if c.lower().endswith(("id", "key", "code")) else "measure" if c in numbers else "category"
    return df.sparkSession.createDataFrame([(c, kind(c)) for c in df.columns], "column string, semantic string")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """rows, distinct_rows and duplicate_rows of the whole table."""
    n = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return n.agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"), F.sum(F.col("_n") - 1).alias("duplicate_rows"))


def sample_size(rows: int) -> int | None:
    """Rows to profile: all below 200,000, else 5 % (5,000 to 100,000) up to 2 million, else 1 % (10,000 to 100,000)."""
    if rows < 200_000:
        return None
    share, low = (0.05, 5_000) if rows <= 2_000_000 else (0.01, 10_000)
    return int(min(max(rows * share, low), 100_000))


def hashed_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows whose key's hash is least: random-like and the same on every run."""
    return df.withColumn("_h", F.md5(F.col(key).cast("string"))).orderBy("_h", key).limit(n).drop("_h")
