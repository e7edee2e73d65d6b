"""File sources: type and delimiter detection, ignore rules, readers, nested records to columns."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = {"csv": "csv", "tsv": "csv", "json": "json", "ndjson": "ndjson", "jsonl": "ndjson", "xml": "xml", "parquet": "parquet", "txt": "text", "md": "text", "log": "text", "yaml": "yaml", "yml": "yaml", "db": "sqlite", "sqlite": "sqlite"}
DELIMITERS = (",", ";", "\t", "|", ":", "~")


def detect_type(path: str) -> str:
    """A format by extension, compression endings ignored; unknown ones are text."""
    name = re.sub(r"\.(gz|bz2|zst|xz)$", "", path.lower())
    return TYPES.get(name.rpartition(".")[2], "text")


def detect_delimiter(head: Sequence[str]) -> str:
    """The candidate that is most frequent and even over the first lines: mean / (1 + variance) of its counts."""

    def score(d: str) -> float:
        n = [line.count(d) for line in head[:10] if line.strip()]
        if not n or not any(n):
            return 0.0
        mean = sum(n) / len(n)
        return mean / (1 + sum((x - mean) ** 2 for x in n) / len(n))

    best = max(DELIMITERS, key=score)
    return best if score(best) > 0 else ","


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, strict: bool = False, infer: bool = False) -> DataFrame:
    """CSV with a header; the delimiter is taken from the first lines if not given. strict fails on bad lines."""
    if delimiter is None:
        delimiter = detect_delimiter([r.value for r in spark.read.text(path).limit(10).collect()])
    return spark.read.csv(path, header=True, sep=delimiter, inferSchema=infer, mode="FAILFAST" if strict else "DROPMALFORMED")


def read_ndjson(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """One object a line; a bad line rejects the input. limit is a feature of previews."""
    df = spark.read.json(path, mode="FAILFAST")
    return df if limit is None else df.limit(limit)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return promote(spark.read.json(path, multiLine=True))


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read a path by its detected type."""
    kind = options.pop("kind", None) or detect_type(path)
    readers = {"csv": read_csv, "json": read_json, "ndjson": read_ndjson, "xml": read_xml}
    if kind in readers:
        return readers[kind](spark, path, **options)
    if kind == "parquet":
        columns = options.get("columns")
        df = spark.read.parquet(path)
        return df.select(*columns) if columns else df
    if kind == "sqlite":
        from lakelens.sources.sqlite import SqliteSource

        spark.dataSource.register(SqliteSource)
        return spark.read.format("sqlite").options(path=path, **options).load()
    return spark.read.text(path, wholetext=True)


def promote(df: DataFrame) -> DataFrame:
    """Rows of one struct column are that struct's columns."""
    while len(df.columns) == 1 and isinstance(df.schema[0].dataType, T.StructType):
        df = df.select(f"`{df.columns[0]}`.*")
    return df


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Structs to columns named by their path, arrays to rows (empty ones to null); sibling arrays give all combinations."""
    while True:
        for f in df.schema:
            if isinstance(f.dataType, T.StructType):
                inner = [F.col(f"`{f.name}`.`{g}`").alias(f"{f.name}{separator}{g}") for g in f.dataType.names]
                df = df.select(*[x for c in df.columns for x in (inner if c == f.name else [F.col(f"`{c}`")])])
                break
            if isinstance(f.dataType, T.ArrayType):
                df = df.withColumn(f.name, F.explode_outer(F.col(f"`{f.name}`")))
                break
        else:
            return df


def socrata(spark: SparkSession, path: str) -> DataFrame:
    """{columns: [{fieldName}], data: [[...]]} as a table of text columns."""
    v = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    names = [r.n for r in v.select(F.explode(F.expr("variant_get(v, '$.columns', 'array<struct<fieldName: string>>')")).alias("c")).select(F.col("c.fieldName").alias("n")).collect()]
    rows = v.select(F.explode(F.expr("variant_get(v, '$.data', 'array<variant>')")).alias("r"))
    return rows.select(*[F.try_variant_get("r", f"$[{i}]", "string").alias(n) for i, n in enumerate(names)])


def ignored(path: str | Column, rules: Sequence[str]) -> Column:
    """Whether a path meets a rule: dir/ anywhere in it, a file name glob, or a path glob; # begins a comment."""
    p = F.regexp_replace(F.col(path) if isinstance(path, str) else path, r"\\", "/")
    patterns = [r"(^|/)~\$[^/]*$"]
    for rule in rules:
        rule = rule.strip()
        if not rule or rule.startswith("#"):
            continue
        body = fnmatch.translate(rule.rstrip("/")).replace(r"(?s:", "").removesuffix(r")\Z").removesuffix(r")\z")
        patterns.append(f"(^|/){body}/" if rule.endswith("/") else f"^(.*/)?{body}$" if "/" in rule else f"(^|/){body.replace('.*', '[^/]*')}$")
    out = p.rlike(patterns[0])
    for x in patterns[1:]:
        out = out | p.rlike(x)
    return out


def corpus(spark: SparkSession, root: str, rules: Sequence[str] = (), extensions: Sequence[str] = ()) -> DataFrame:
    """Every file below root: path, modificationTime, length, content, without ignored ones."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(~ignored("path", rules))
    return df.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*[e.lower().lstrip(".") for e in extensions])) if extensions else df


def rename_headers(df: DataFrame) -> DataFrame:
    """Trimmed column names, repeats numbered."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = c.strip() or "column"
        seen[n] = seen.get(n, 0) + 1
        names.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return df.toDF(*names)
