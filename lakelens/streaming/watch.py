"""Structured Streaming: folder watch with upserts, debounce, windowed series, state per file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def watch_folder(spark: SparkSession, path: str, schema: str = "path string, content string, modified timestamp", fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of each key, ties by all other columns."""
    w = Window.partitionBy(key).orderBy(F.desc(at), *[F.desc(c) for c in df.columns if c not in (key, at)])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert_into(spark: SparkSession, target: str, key: str, at: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps an append-only table of versions; read_current gives the newest of each key.

    The batch number is part of every row's folder, so that a repeated batch overwrites itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, key, at).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return write


def read_current(spark: SparkSession, target: str, key: str, at: str) -> DataFrame:
    """The newest row of each key; keys whose newest row is a deletion (column `deleted`) are left out."""
    x = latest(spark.read.parquet(target).drop("batch"), key, at)
    return x.where("not deleted").drop("deleted") if "deleted" in x.columns else x


LISTED = "path string, modified timestamp, size long, content binary, deleted boolean, batch long"


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, size) of all files below a folder; their bytes are not read."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return x.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def mirrored(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """(path, modified, size, content): the files that stand after all batches, or after those before one."""
    x = spark.read.schema(LISTED).parquet(target)
    x = x if before is None else x.where(F.col("batch") < before)
    last = x.groupBy("path").agg(F.max("batch").alias("batch"))  # contents are not aggregated
    return x.join(last, ["path", "batch"]).where("not deleted").drop("deleted", "batch")


def mirror_folder(spark: SparkSession, folder: str, target: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that compares the folder's listing with what `target` holds and appends what changed.

    New and changed files (by time or size) are appended with their bytes, files that are gone as deletions, which a file
    stream cannot see. A batch that is repeated compares with the batches before it and overwrites itself.
    """

    def write(_: DataFrame, number: int) -> None:
        spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in (f.split(" ") for f in LISTED.split(", ")) if n != "batch"]).write.mode("overwrite").parquet(f"{target}/batch={number}")
        old = mirrored(spark, target, number).select("path", F.col("modified").alias("_m"), F.col("size").alias("_s"))
        x = listed(spark, folder).join(old, "path", "full")
        fresh = x.where("modified is not null and not (modified <=> _m and size <=> _s)").select("path")
        gone = x.where("modified is null").select("path", "_m", "_s")
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).join(fresh, "path", "left_semi")
        rows = files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content", F.lit(False).alias("deleted"))
        dead = gone.select("path", F.col("_m").alias("modified"), F.col("_s").alias("size"), F.lit(None).cast("binary").alias("content"), F.lit(True).alias("deleted"))
        rows.unionByName(dead).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return write


def ticks(spark: SparkSession) -> DataFrame:
    """A stream with a row a trigger, for work that is due though no file has come."""
    return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()


def debounced(stream: DataFrame, key: str, at: str, seconds: int = 1) -> DataFrame:
    """The first event of each key within the delay."""
    return stream.withWatermark(at, f"{seconds} seconds").dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, at: str, value: str, width: str = "1 day", late: str = "1 hour", by: tuple[str, ...] = ()) -> DataFrame:
    """Count and sum of tumbling windows; events later than the watermark are left out."""
    x = stream.withWatermark(at, late).groupBy(F.window(at, width), *by)
    return x.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sessions(stream: DataFrame, at: str, gap: str, by: str, late: str = "1 hour") -> DataFrame:
    x = stream.withWatermark(at, late).groupBy(F.session_window(at, gap), by)
    return x.agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def state_changes(stream: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, event) CREATED or UPDATED whenever a key's digest differs from the state kept for it."""
    kind = stream.schema[key].dataType.simpleString()

    def update(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, out = (state.get[0] if state.exists else None), []
        for f in frames:
            for d in f[digest]:
                if d != last:
                    out.append((k[0], "CREATED" if last is None else "UPDATED"))
                    last = d
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, "event"])

    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, event string", "digest string", "append", "NoTimeout")


def run_once(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Work through what is there and stop."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
