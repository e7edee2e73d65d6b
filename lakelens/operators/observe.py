"""Observation and comparison: snapshots, events, line and folder comparison, classification, chains."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def state_events(old: DataFrame, new: DataFrame, key: str, digest: str, size: str) -> DataFrame:
    """(key, event): CREATED, DELETED, REPLACED (other content of the same size) or UPDATED; unchanged keys are left out."""
    a = old.select(key, F.col(digest).alias("_da"), F.col(size).alias("_sa"), F.lit(True).alias("_a"))
    b = new.select(key, F.col(digest).alias("_db"), F.col(size).alias("_sb"), F.lit(True).alias("_b"))
    e = F.when(F.col("_a").isNull(), "CREATED").when(F.col("_b").isNull(), "DELETED").when(~F.col("_da").eqNullSafe(F.col("_db")), F.when(F.col("_sa") == F.col("_sb"), "REPLACED").otherwise("UPDATED"))
    return a.join(b, key, "full_outer").select(key, e.alias("event")).where("event is not null")


def field_events(snapshots: DataFrame, key: str, at: str, fields: Sequence[str]) -> DataFrame:
    """(key, at, field, old, new) wherever a field differs from the key's snapshot before."""
    w = Window.partitionBy(key).orderBy(at)
    x = snapshots.select(key, at, *[F.col(f).cast("string").alias(f) for f in fields], F.row_number().over(w).alias("_n"), *[F.lag(F.col(f).cast("string")).over(w).alias(f"_{f}") for f in fields])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("old"), F.col(f).alias("new")) for f in fields])
    return x.where("_n > 1").select(key, at, F.inline(rows)).where(~F.col("old").eqNullSafe(F.col("new")))


def mapped_events(events: DataFrame, names: dict[str, str]) -> DataFrame:
    """Events with the domain name of their field, those without one left out."""
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return events.withColumn("event", F.element_at(m, F.col("field"))).where("event is not null")


def column_diff(old: Column, new: Column) -> list[Column]:
    """Sorted columns added and removed between two arrays of names."""
    return [F.array_sort(F.array_except(new, old)).alias("added"), F.array_sort(F.array_except(old, new)).alias("removed")]


def compare_lines(a: DataFrame, b: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, old, new) of the lines that differ by position."""
    lines = lambda d, name: d.select(F.col(key).alias("key"), F.posexplode(F.split(text, "\n")).alias("line_no", name))
    x = lines(a, "old").join(lines(b, "new"), ["key", "line_no"], "full_outer")
    return x.where(~F.col("old").eqNullSafe(F.col("new")))


def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def similarity(a: str | Column, b: str | Column) -> Column:
    """Ratio of matching characters of two texts, null-safe."""
    return F.pandas_udf(ratios, "double")(a, b)


def compare_folders(a: DataFrame, b: DataFrame, key: str, digest: str) -> DataFrame:
    """Counts of identical, modified, missing_a and missing_b keys."""
    x = a.select(key, F.col(digest).alias("_a")).join(b.select(key, F.col(digest).alias("_b")), key, "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return x.agg(
        F.count_if(both & (F.col("_a") == F.col("_b"))).alias("identical"), F.count_if(both & (F.col("_a") != F.col("_b"))).alias("modified"), F.count_if(F.col("_a").isNull()).alias("missing_a"), F.count_if(F.col("_b").isNull()).alias("missing_b")
    )


def chains(spark: SparkSession, links: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, root, depth): each row's ancestor without a parent, followed by doubling the step each round.

    Rows of a cycle, or with a parent that is missing, have a null root.
    """
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lakelens-"))
    x = links.select(F.col(key).alias("key"), F.col(parent).alias("up"), F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("depth"))
    n, moved = max(1, x.count()), True
    while moved and n:  # at most log2 of the rows, the longest chain there can be
        y = x.select(F.col("key").alias("_k"), F.col("up").alias("_u"), F.col("depth").alias("_d"))
        x = x.join(y, F.col("up") == F.col("_k"), "left")
        x = x.select("key", F.when(F.col("_k").isNull(), F.col("up")).otherwise(F.coalesce("_u", "up")).alias("up"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), F.col("_u").isNotNull().alias("moved")).checkpoint()
        n, moved = n >> 1, not x.where("moved").isEmpty()
    roots = links.where(F.col(parent).isNull()).select(F.col(key).alias("_r"))
    top = x.withColumn("up", F.coalesce("up", "key")).join(roots, F.col("up") == F.col("_r"), "left")
    return top.select("key", F.col("_r").alias("root"), F.when(F.col("_r").isNotNull(), F.col("depth")).alias("depth"))


def numbered_targets(df: DataFrame, target: str, order: str) -> DataFrame:
    """Targets made unique: the second and later of equal ones get _01, _02, ... in the given order."""
    n = F.row_number().over(Window.partitionBy(target).orderBy(order)) - 1
    return df.withColumn("unique_target", F.when(n == 0, F.col(target)).otherwise(F.concat(F.col(target), F.lit("_"), F.lpad(n.cast("string"), 2, "0"))))


def day_counters(df: DataFrame, day: str, order: str, by: str) -> DataFrame:
    """A counter that starts again whenever the day differs from the row before."""
    w = Window.partitionBy(by).orderBy(order)
    run = F.sum(F.when(F.col(day).eqNullSafe(F.lag(day).over(w)), 0).otherwise(1)).over(w)
    return df.withColumn("_run", run).withColumn("counter", F.row_number().over(Window.partitionBy(by, "_run").orderBy(order))).drop("_run")


def classify(path: str, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The label of the first rule whose pattern the lower-cased path matches."""
    out = None
    for pattern, label in rules:
        cond = F.lower(path).rlike(pattern)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return (out if out is not None else F.when(F.lit(False), default)).otherwise(default)


def fingerprint(files: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """SHA-256 of a folder's sorted rows; a group is one folder's listing."""
    row = F.concat_ws("|", *columns)
    return files.groupBy(by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n").cast("binary"), 256).alias("fingerprint"))
