"""Joins behind a cardinality guard, keyed comparison of two tables, as-of lookup."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakelens.operators.aggregates import numeric_columns


class JoinSafetyError(ValueError):
    """A join whose keys repeat on several sides, refused."""


def has_duplicate_keys(df: DataFrame, keys: Sequence[str]) -> bool:
    return not df.dropna(subset=list(keys)).groupBy(*keys).count().where("count > 1").isEmpty()


def cardinality(duplicated: Sequence[bool]) -> str:
    """one-to-one, many-to-one (first input repeats), one-to-many, or many-to-many (several repeat)."""
    if not any(duplicated):
        return "one-to-one"
    if sum(duplicated) > 1:
        return "many-to-many"
    return "many-to-one" if duplicated[0] else "one-to-many"


def join_estimate(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact rows of the inner join from both sides' key counts: left_rows, right_rows, rows."""
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_a"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_b"))
    return a.join(b, list(keys)).agg(F.sum("_a").alias("left_rows"), F.sum("_b").alias("right_rows"), F.coalesce(F.sum(F.col("_a") * F.col("_b")), F.lit(0)).alias("rows"))


def pre_aggregate(df: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """One row a key: mean or sum of the numeric columns; without any, the distinct keys."""
    f = {"mean": F.avg, "sum": F.sum}[how]
    values = [c for c in numeric_columns(df) if c not in keys]
    return df.groupBy(*keys).agg(*[f(c).alias(c) for c in values]) if values else df.select(*keys).distinct()


def guarded_join(tables: Sequence[DataFrame], keys: Sequence[str], how: str = "inner", aggregate: str = "none", max_rows: int | None = 5_000_000) -> DataFrame:
    """Left-deep equi-join of the tables on keys, after checks that run before the join is planned.

    how: inner, left, right or outer. Key types must agree. If keys repeat in more than one table the join is
    refused unless `aggregate` (mean or sum) first reduces the repeating tables to a row a key. A two-table inner
    join is also refused above max_rows rows (None: no limit). Null keys match nothing.
    """
    if how not in ("inner", "left", "right", "outer"):
        raise ValueError(f"unknown join type: {how}")
    for k in keys:
        if len({t.schema[k].dataType.simpleString() for t in tables}) > 1:
            raise TypeError(f"the types of key {k} differ")
    repeats = [has_duplicate_keys(t, keys) for t in tables]
    kind = cardinality(repeats)
    if kind == "many-to-many":
        if aggregate == "none":
            raise JoinSafetyError(f"{kind} join on {list(keys)}: aggregate first")
        tables = [pre_aggregate(t, keys, aggregate) if r else t for t, r in zip(tables, repeats, strict=True)]
    if max_rows is not None and len(tables) == 2 and how == "inner" and (n := join_estimate(tables[0], tables[1], keys).first()["rows"]) > max_rows:
        raise JoinSafetyError(f"the join would have {n} rows")
    return reduce(lambda a, b: a.join(b, list(keys), how), tables)


def keyed_diff(old: DataFrame, new: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """(key, change): added, deleted, modified or unchanged, null-safe on the values."""
    a = old.select(F.col(key), F.struct(*values).alias("_a"), F.lit(True).alias("_o"))
    b = new.select(F.col(key), F.struct(*values).alias("_b"), F.lit(True).alias("_n"))
    same = F.col("_a").eqNullSafe(F.col("_b"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "deleted").when(same, "unchanged").otherwise("modified")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def as_of(events: DataFrame, key: str, at: str, limit) -> DataFrame:
    """The latest row of each key not after `limit`; of equal times the one that sorts last in all columns."""
    w = Window.partitionBy(key).orderBy(F.desc(at), *[F.desc(c) for c in events.columns if c not in (key, at)])
    return events.where(F.col(at) <= limit).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def keep_latest(df: DataFrame, key: str, at: str, n: int = 10) -> DataFrame:
    """At most n latest rows a key."""
    w = Window.partitionBy(key).orderBy(F.desc(at), *[F.desc(c) for c in df.columns if c not in (key, at)])
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def duplicate_marks(df: DataFrame, key: str) -> DataFrame:
    """df with duplicate: whether its key occurs more than once (the first occurrence included)."""
    n = df.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(n, F.col(key).eqNullSafe(F.col("_k"))).select(*df.columns, (F.col("_n") > 1).alias("duplicate"))


def relations(columns: DataFrame, files: Sequence[str] = ("file_index", "file_metadata", "file_tags", "files")) -> DataFrame:
    """Guess references from (table, column): X_id points to table X, high if there is one, else low and without target.

    A column called path points to each of the `files` tables but its own, medium. Case is ignored.
    """
    low = columns.select("table", "column", F.lower("column").alias("_c"))
    names = columns.select(F.lower("table").alias("_t"), F.col("table").alias("target")).groupBy("_t").agg(F.min("target").alias("target"))
    ids = low.where(F.col("_c").rlike("..*_id$")).withColumn("_t", F.regexp_replace("_c", "_id$", "")).join(names, "_t", "left")
    ids = ids.select("table", "column", "target", F.when(F.col("target").isNotNull(), "high").otherwise("low").alias("confidence"))
    paths = low.where("_c = 'path'").select("table", "column", F.explode(F.array(*map(F.lit, files))).alias("target"), F.lit("medium").alias("confidence"))
    return ids.unionByName(paths.where("target <> table"))


def relation_graph(references: DataFrame) -> DataFrame:
    """(table, targets): the tables that each table points to, sorted, from rows (table, target); rows without a target are left out."""
    return references.where("target is not null").groupBy("table").agg(F.array_sort(F.collect_set("target")).alias("targets"))
