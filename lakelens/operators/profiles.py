"""Profiles of several tables at once, each under its own job tag and time limit, and a summary of their schemas."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.operators.aggregates import numeric_columns, numeric_summary
from lakelens.operators.profile import profile_columns, sample_size

COLUMNS = "table string, column string, kind string, rows long, nulls long, null_pct double, unique long, key string, mean double, median double, min double, max double"
TABLES = "table string, status string, rows long, profiled long, columns int, error string"


@dataclass(frozen=True)
class Profiles:
    """tables: a row a table, its status done, timed_out or failed; columns: a row a column of the tables that are done."""

    tables: DataFrame
    columns: DataFrame


def profile_table(df: DataFrame) -> tuple[int, int, list[tuple]]:
    """Rows, rows profiled, and a row a column; large tables are sampled by hash of the row, so reruns agree."""
    n = df.count()
    wanted = sample_size(n)
    if wanted is not None:
        share = min(1.0, wanted / n)
        df = df.where(F.shiftrightunsigned(F.xxhash64(*df.columns), 11) < int(share * 2**53))
    kinds, numbers = dict(df.dtypes), numeric_columns(df)
    stats = {r.column: r for r in numeric_summary(df, numbers).collect()} if numbers else {}
    out, profiled = [], 0
    for r in profile_columns(df).collect():  # one row a column
        s = stats.get(r.column)
        profiled = r.rows
        out.append((r.column, kinds[r.column], r.rows, r.nulls, r.null_pct, r.unique, r.key, *((s.mean, s.median, s.min, s.max) if s else (None,) * 4)))
    return n, profiled, out


def profile_tables(tables: Mapping[str, DataFrame], seconds: float = 300.0, at_once: int = 4, profile=profile_table) -> Profiles:
    """Profile tables side by side; a table that takes longer than `seconds` has its jobs cancelled and is marked.

    Every table's jobs carry a tag of their own, so cancelling one leaves the others alone. A table that fails is marked
    with its error; tables without columns have no column rows.
    """
    if not tables:
        raise ValueError("there are no tables")
    spark = next(iter(tables.values())).sparkSession
    run = uuid.uuid4().hex

    def one(name: str) -> tuple:
        sc, tag, late = spark.sparkContext, f"profile-{run}-{name}", threading.Event()
        sc.addJobTag(tag)
        sc.setInterruptOnCancel(True)

        def stop() -> None:
            late.set()
            while not over.wait(0.2):  # a job that starts after the others were cancelled goes too
                sc.cancelJobsWithTag(tag)

        over = threading.Event()
        timer = threading.Timer(seconds, stop)
        timer.start()
        try:
            n, profiled, rows = profile(tables[name])
            return (name, "done", n, profiled, len(tables[name].columns), None), [(name, *r) for r in rows]
        except Exception as e:  # noqa: BLE001  the other tables go on
            return (name, "timed_out" if late.is_set() else "failed", None, None, len(tables[name].columns), None if late.is_set() else str(e).split("\n")[0][:500]), []
        finally:
            over.set()
            timer.cancel()
            sc.removeJobTag(tag)

    with ThreadPoolExecutor(at_once) as pool:
        done = [f.result() for f in [pool.submit(inheritable_thread_target(spark)(one), name) for name in tables]]
    return Profiles(spark.createDataFrame([t for t, _ in done], TABLES), spark.createDataFrame([r for _, rows in done for r in rows], COLUMNS))


def schema_summary(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, column, kind, nullable, position) of several tables, nested fields with their paths."""

    def fields(schema, path=""):
        for f in schema.fields:
            yield path + f.name, f.dataType.simpleString(), f.nullable
            if f.dataType.typeName() == "struct":
                yield from fields(f.dataType, f"{path}{f.name}.")

    rows = [(name, column, kind, nullable, i) for name, df in tables.items() for i, (column, kind, nullable) in enumerate(fields(df.schema))]
    return spark.createDataFrame(rows, "table string, column string, kind string, nullable boolean, position int")
