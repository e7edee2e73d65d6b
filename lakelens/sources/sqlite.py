"""SQLite tables as a Spark data source, read in ranges of rowid."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

KINDS = (("INT", "bigint"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("BLOB", "binary"))


class Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.columns, self.path, self.table = schema.names, options["path"], options["table"]
        self.rows = int(options.get("rows", 100_000))

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(self.path) as con:
            low, high = con.execute(f'select min(rowid), max(rowid) from "{self.table}"').fetchone()
        return [Range(0, 0)] if low is None else [Range(a, min(a + self.rows, high + 1)) for a in range(low, high + 1, self.rows)]

    def read(self, part: Range) -> Iterator[tuple]:
        names = ", ".join(f'"{c}"' for c in self.columns)
        with sqlite3.connect(self.path) as con:
            yield from con.execute(f'select {names} from "{self.table}" where rowid >= ? and rowid < ?', (part.low, part.high))


class SqliteSource(DataSource):
    """Options: path (on a folder that all executors share), table, rows (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with sqlite3.connect(self.options["path"]) as con:
            info = con.execute(f'pragma table_info("{self.options["table"]}")').fetchall()
        kind = lambda t: next((k for p, k in KINDS if p in t.upper()), "string")
        return ", ".join(f"`{c[1]}` {kind(c[2] or '')}" for c in info)

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(schema, self.options)


def foreign_keys(path: str) -> list[tuple[str, str, str, str]]:
    """(table, column, target table, target column) of every declared reference."""
    with sqlite3.connect(path) as con:
        tables = [r[0] for r in con.execute("select name from sqlite_master where type = 'table'")]
        return [(t, r[3], r[2], r[4]) for t in tables for r in con.execute(f'pragma foreign_key_list("{t}")')]
