"""Where queries register under their names, with the SQL they are held against."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.operators.textindex import TextIndex
from lakelens.sources.shared import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (t) -> DataFrame under its name; t(name) reads a table of the data folder."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums taken in another order compare equal."""
    return df.select(*[(F.round(F.col(c), digits) if t == "double" else F.col(c)).alias(c) for c, t in df.dtypes])


def index_of(docs: DataFrame, stemming: bool = False) -> TextIndex:
    """The search index of a table, kept in the shared folder for the files that the table has now."""
    files = docs.select("_metadata.file_path", "_metadata.file_modification_time").distinct().orderBy("file_path").collect()
    name = hashlib.sha256(repr((stemming, *files)).encode()).hexdigest()[:24]
    return TextIndex.build(docs, "doc_id", "text", f"{shared_folder(docs.sparkSession)}/index-{name}", stemming=stemming)
