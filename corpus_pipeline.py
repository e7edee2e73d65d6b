"""The corpus pipeline: language ID, line dedup, near-copy removal, source mixing, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns the columns of documents, the last one the packed pieces. run() applies them, each stage's result written
as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm.common import stage
from lakelens.llm.langid import identify, train
from lakelens.llm.lines import drop_lines
from lakelens.llm.mixing import apply_mix
from lakelens.llm.nearcopies import drop_near_copies
from lakelens.llm.packing import pack

#: SQL has no form of the network, the signatures or the packing; tests hold the stages against brute force.
ORACLE_SQL = None

#: A text is rejected if no language reaches this probability; four equally likely ones would have 0.25.
LEAST_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have letters and a language; null and letterless texts are `und` and go."""
    net = train(docs)
    x = identify(docs, net, out=("_lang_pred", "_lang_score"))
    return x.where((F.col("_lang_pred") != "und") & (F.col("_lang_score") >= LEAST_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that another line of the corpus stands for; n_chars follows the text."""
    out = drop_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and the bins that hold them."""
    return pack(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_copies), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
