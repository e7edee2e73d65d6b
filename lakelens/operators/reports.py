"""Reports without a fixed schema: JSON texts taken apart into typed paths, rolled up, and recognised by their keys."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATHS = "path string, kind string, number double, text string"


def json_paths(reports: DataFrame, key: str, json: str, depth: int = 16) -> DataFrame:
    """(key, path, kind, number, text) of every leaf and empty container of the JSON texts, down to `depth` levels.

    Members are joined by points; places in arrays are left out, so a path names all items of a list. kind is object,
    array, number, boolean, string or null. A text that is no JSON has one row of kind invalid and no path; a null text
    none. Containers at the last level are rows themselves.
    """
    spark = reports.sparkSession
    x = reports.where(F.col(json).isNotNull()).select(F.col(key).alias("key"), F.lit("").alias("path"), F.try_parse_json(json).alias("v"))
    out = x.where("v is null").select("key", F.lit(None).cast("string").alias("path"), F.lit("invalid").alias("kind"), F.lit(None).cast("double").alias("number"), F.lit(None).cast("string").alias("text"))
    level = x.where("v is not null")
    for i in range(depth + 1):
        kind = F.schema_of_variant("v")
        level = level.withColumn("kind", F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "VOID", "null").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string").otherwise("number"))
        inner = spark.sql("select x.key, x.path, x.v, x.kind, e.key as member, e.value as item from {x} x, lateral variant_explode_outer(x.v) e", x=level) if i < depth else level.withColumn("member", F.lit(None).cast("string")).withColumn("item", F.lit(None).cast("variant"))
        ends = inner.where("item is null")
        out = out.unionByName(ends.select("key", "path", "kind", F.when(F.col("kind") == "number", F.try_variant_get("v", "$", "double")).alias("number"), F.when(F.col("kind").isin("string", "boolean"), F.try_variant_get("v", "$", "string")).alias("text")))
        name = F.when(F.col("member").isNull(), F.col("path")).when(F.col("path") == "", F.col("member")).otherwise(F.concat("path", F.lit("."), "member"))
        level = inner.where("item is not null").select("key", name.alias("path"), F.col("item").alias("v"))
        if level.isEmpty():
            break
    return out


def rolled_up(paths: DataFrame) -> DataFrame:
    """(path, kind, reports, rows, total, least, greatest) by path and kind; a path whose kind varies has a row for each."""
    return paths.where("path is not null").groupBy("path", "kind").agg(
        F.count_distinct("key").alias("reports"), F.count(F.lit(1)).alias("rows"), F.sum("number").alias("total"), F.min("number").alias("least"), F.max("number").alias("greatest")
    )


def recognised(paths: DataFrame, weights: Mapping[str, float], least: float = 0.5) -> DataFrame:
    """(key, share, recognised): of the weights of known paths the share that each report has, itself or below it.

    Reports are recognised from `least` on; unknown paths count nothing, a path that stands often counts once.
    """
    known = F.array(*[F.struct(F.lit(p).alias("known"), F.lit(float(w)).alias("weight")) for p, w in sorted(weights.items())])
    x = paths.select("key", F.coalesce("path", F.lit("")).alias("path")).distinct().select("key", "path", F.explode(known).alias("k"))
    hit = (F.col("path") == F.col("k.known")) | F.startswith(F.col("path"), F.concat(F.col("k.known"), F.lit(".")))
    each = x.groupBy("key", "k").agg(F.max(hit.cast("int")).alias("hit"))
    share = F.sum(F.col("hit") * F.col("k.weight")) / F.lit(float(sum(weights.values())))
    return each.groupBy("key").agg(share.alias("share")).withColumn("recognised", F.col("share") >= least)
