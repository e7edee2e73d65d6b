"""What is wrong with text inputs, found in one pass before they are loaded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_bad"


def csv_rows(spark: SparkSession, path: str, schema: T.StructType, separator: str = ",", header: bool = True) -> DataFrame:
    """The rows of CSV files with the raw line of those that do not fit the schema in `_bad`."""
    kept = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    return spark.read.schema(kept).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).option("header", header).option("sep", separator).option("enforceSchema", "true").csv(path)


def json_kind(line: Column) -> Column:
    """object, array, scalar, invalid or blank for a line of JSON."""
    text = F.trim(F.regexp_replace(line, r"[\r\n\t]", " "))
    parsed = F.try_parse_json(text)
    kind = F.schema_of_variant(parsed)
    return F.when(text == "", "blank").when(parsed.isNull(), "invalid").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise("scalar")


def check_csv(spark: SparkSession, path: str, schema: T.StructType, separator: str = ",", header: bool = True, examples: int = 5) -> DataFrame:
    """(rows, bad, empty, examples): all rows of CSV files, those that do not fit, those without any value, and a few raw lines that do not fit."""
    x = csv_rows(spark, path, schema, separator, header)
    names = [f.name for f in schema.fields]
    empty = F.col(BAD).isNull() & F.coalesce(*[F.col(n).cast("string") for n in names]).isNull()
    first = F.slice(F.array_sort(F.collect_set(F.when(F.pmod(F.xxhash64(BAD), F.lit(97)) == 0, F.col(BAD)))), 1, examples)
    x = x.select("*").agg(F.count(F.lit(1)).alias("rows"), F.count(F.col(BAD)).alias("bad"), F.count_if(empty).alias("empty"), F.min(BAD).alias("_one"), first.alias("_some"))
    return x.select("rows", "bad", "empty", F.when(F.size("_some") > 0, F.col("_some")).otherwise(F.array_compact(F.array("_one"))).alias("examples"))


def check_json_lines(lines: DataFrame, line: str) -> DataFrame:
    """(kind, rows, example) of lines that should hold one JSON object each; see `json_kind`. The example is the least."""
    x = lines.select(F.coalesce(F.col(line), F.lit("")).alias("line"))
    return x.select(json_kind(F.col("line")).alias("kind"), "line").groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.min("line").alias("example"))


def check_xml(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, problem) of XML texts that are not well formed enough to be read: empty, no_root, unclosed or unbalanced.

    Opening and closing tags are counted by name, comments, declarations and CDATA left out; a text has a root if its
    first tag is closed by its last.
    """
    bare = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^>]*>", "")
    x = texts.select(F.col(key).alias("key"), F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("t"))
    tag = r"([A-Za-z_][\w.:-]*)"
    quoted = r"""(?:[^<>"']|"[^"]*"|'[^']*')*"""
    x = x.withColumn("opened", F.regexp_extract_all("t", F.lit(f"<{tag}(?![\\w.:-]){quoted}(?<!/)>"), F.lit(1)))
    x = x.withColumn("closed", F.regexp_extract_all("t", F.lit(f"</{tag}\\s*>"), F.lit(1))).withColumn("alone", F.regexp_extract_all("t", F.lit(f"<{tag}(?![\\w.:-]){quoted}/>"), F.lit(1)))
    rooted = (F.get("opened", F.lit(0)) == F.element_at("closed", -1)) | ((F.size("opened") == 0) & (F.size("alone") == 1))
    problem = (
        F.when(F.col("t") == "", "empty").when(~F.col("t").startswith("<") | (F.size("opened") + F.size("alone") == 0), "no_root").when(F.size("opened") > F.size("closed"), "unclosed")
        .when(F.array_sort("opened") != F.array_sort("closed"), "unbalanced").when(~F.col("t").endswith(">") | ~F.coalesce(rooted, F.lit(False)), "no_root")
    )
    return x.select("key", problem.alias("problem")).where("problem is not null")
