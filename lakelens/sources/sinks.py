"""Writers: tables in the usual formats with a metadata row beside them, logs as compressed NDJSON by day."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

FORMATS = ("csv", "json", "json.gz", "parquet", "txt", "md")


def export(df: DataFrame, path: str, kind: str, meta: Mapping[str, str] | None = None, rows_per_file: int = 0) -> None:
    """Write df as a folder of one of FORMATS; meta goes to `path`_meta as one JSON row, with the columns and the kind.

    txt joins the columns by tabs and md writes table rows (the heading is a row of each file's folder, `path`_head).
    Nested columns become JSON texts where the format has no form for them. An existing folder is replaced.
    """
    if kind not in FORMATS:
        raise ValueError(f"{kind!r} is none of {FORMATS}")
    plain = df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (ArrayType, MapType, StructType, VariantType)) else F.col(f"`{f.name}`") for f in df.schema])
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in plain.columns]
    w = lambda x: x.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    if kind == "csv":
        w(plain).option("header", True).option("escape", '"').csv(path)
    elif kind == "parquet":
        w(df).parquet(path)
    elif kind.startswith("json"):
        w(df).option("compression", "gzip" if kind == "json.gz" else "none").option("ignoreNullFields", False).json(path)
    elif kind == "txt":
        w(plain.select(F.concat_ws("\t", *[F.regexp_replace(c, r"[\t\r\n]+", " ") for c in cells]).alias("value"))).text(path)
    else:
        cell = [F.replace(F.regexp_replace(c, r"[\r\n]+", " "), F.lit("|"), F.lit("\\|")) for c in cells]
        w(plain.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cell), F.lit(" |")).alias("value"))).text(path)
        head = [("| " + " | ".join(plain.columns) + " |",), ("|" + " --- |" * len(plain.columns),)]
        df.sparkSession.createDataFrame(head, "value string").coalesce(1).write.mode("overwrite").text(f"{path}_head")
    notes = {**(meta or {}), "kind": kind, "columns": ",".join(df.columns)}
    df.sparkSession.createDataFrame([(notes,)], "meta map<string,string>").coalesce(1).write.mode("overwrite").json(f"{path}_meta")


def write_log(events: DataFrame, path: str, at: str, rows_per_file: int = 100_000) -> None:
    """Append events as gzip NDJSON in folders by year, month and day, each file bounded; old days go by dropping folders."""
    day = [F.date_format(F.col(at), p).alias(name) for name, p in (("year", "yyyy"), ("month", "MM"), ("day", "dd"))]
    events.select("*", *day).write.mode("append").partitionBy("year", "month", "day").option("compression", "gzip").option("maxRecordsPerFile", rows_per_file).json(path)
