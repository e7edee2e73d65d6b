"""Tables whose parts become visible by a commit, and a registry of datasets and their versions kept in such tables."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

RECORD = "source string, name string, file_name string, source_hash string, rows long, columns long, cleaned_version int, raw_version int, created string, updated string, fields array<struct<kind:string,ordinal:int,column:string,type:string>>"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def names(path: str) -> list[str]:
    files, root = opened(path)
    return sorted(x.base_name for x in files.get_file_info(fs.FileSelector(root, allow_not_found=True)))


def put(path: str, value: dict) -> None:
    """Write JSON under a name of its own, then move it in place, so that readers see the old value or the new one."""
    files, target = opened(path)
    files.create_dir(os.path.dirname(target), recursive=True)
    with files.open_output_stream(part := f"{os.path.dirname(target)}/.{uuid.uuid4().hex}") as out:
        out.write(json.dumps(value).encode())
    files.move(part, target)


def get(path: str) -> dict | None:
    files, target = opened(path)
    if files.get_file_info(target).type == fs.FileType.NotFound:
        return None
    with files.open_input_stream(target) as x:
        return json.loads(x.read())


def commits(path: str) -> list[dict]:
    """All commits of a table of parts by version; unfinished ones have no file yet."""
    return [get(f"{path}/commits/{n}") for n in names(f"{path}/commits") if not n.startswith(".")]


def drop_parts(path: str, parts: list[str]) -> None:
    files, root = opened(path)
    for part in parts:
        try:
            files.delete_file(f"{root}/parts/{part}")
        except FileNotFoundError:
            pass  # another run has removed it


def nullable(t: pa.DataType) -> pa.DataType:
    """The type with every field in it nullable: a null struct has null fields, whatever its schema says of them."""
    if pa.types.is_struct(t):
        return pa.struct([pa.field(f.name, nullable(f.type)) for f in t.fields])
    if pa.types.is_map(t):
        return pa.map_(nullable(t.key_type), nullable(t.item_type))
    return pa.list_(nullable(t.value_type)) if pa.types.is_list(t) else t


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


class PartsWriter(DataSourceArrowWriter):
    def __init__(self, path: str, run: str, schema: StructType, overwrite: bool) -> None:
        self.path, self.run, self.overwrite, self.schema = path, run, overwrite, schema.jsonValue()
        last = commits(path)[-1:]
        if not overwrite and last and [(f["name"], f["type"]) for f in last[0]["schema"]["fields"]] != [(f["name"], f["type"]) for f in self.schema["fields"]]:
            raise ValueError(f"rows to append differ in their columns from those of {path}")
        files, root = opened(path)
        files.create_dir(f"{root}/parts", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        files, root = opened(self.path)
        name = f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex}.parquet"
        rows, out = 0, None
        try:
            for batch in iterator:
                if batch.num_rows:
                    kinds = pa.schema([pa.field(f.name, nullable(f.type)) for f in batch.schema])
                    batch = pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(batch.columns, kinds, strict=True)], schema=kinds)
                    out = out or pq.ParquetWriter(f"{root}/parts/{name}", batch.schema, filesystem=files, compression="zstd")
                    out.write_batch(batch)
                    rows += batch.num_rows
        except BaseException:
            if out:
                out.close()
                drop_parts(self.path, [name])
            raise
        if out:
            out.close()
        return Part(name, rows)

    def commit(self, messages: list[Part | None]) -> None:
        parts = [m for m in messages if m and m.rows]
        before = commits(self.path)
        if any(c["run"] == self.run for c in before):
            return drop_parts(self.path, [m.name for m in parts])
        version = before[-1]["version"] + 1 if before else 1
        put(f"{self.path}/commits/{version:08d}.json", {"version": version, "run": self.run, "replaces": self.overwrite, "schema": self.schema, "rows": sum(m.rows for m in parts), "parts": [m.name for m in parts]})

    def abort(self, messages: list[Part | None]) -> None:
        drop_parts(self.path, [m.name for m in messages if m and m.rows])


class PartsSink(DataSource):
    """df.write.format("parts").mode("append" or "overwrite").option("run", key).save(path).

    Each task writes Parquet parts of its own name; one file of the commit, written after all tasks, makes those of
    the attempts that count visible. What failed, lost or doubled attempts leave is never read. A run whose key is
    committed already adds nothing, so a job may be run again; without a key each run counts. Overwriting is a commit
    that replaces all before it; their parts stay for readers of older versions until `prune`. One writer at a time
    for each table. The folder must be open to the driver and all executors.
    """

    @classmethod
    def name(cls) -> str:
        return "parts"

    def writer(self, schema: StructType, overwrite: bool) -> PartsWriter:
        return PartsWriter(self.options["path"].rstrip("/"), self.options.get("run") or uuid.uuid4().hex, schema, overwrite)


def write_parts(df: DataFrame, path: str, run: str | None = None, overwrite: bool = False) -> dict:
    """Write through PartsSink and give the commit that holds the rows: this run's, or that of the run with its key."""
    run = run or uuid.uuid4().hex
    df.sparkSession.dataSource.register(PartsSink)
    df.write.format("parts").mode("overwrite" if overwrite else "append").option("run", run).save(path)
    return next(c for c in commits(path) if c["run"] == run)


def read_parts(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows that the commits up to a version (default: all) leave; the parts are a plain Parquet scan."""
    path = path.rstrip("/")
    seen = [c for c in commits(path) if version is None or c["version"] <= version]
    if not seen or (version is not None and seen[-1]["version"] != version):
        raise ValueError(f"{path} has no version {version or 1}")
    first = max((i for i, c in enumerate(seen) if c["replaces"]), default=0)
    schema = StructType.fromJson(seen[-1]["schema"])
    parts = [f"{path}/parts/{p}" for c in seen[first:] for p in c["parts"]]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def prune(path: str, keep_from: int, hours: float = 24) -> int:
    """Remove the commits before version keep_from that a later kept one replaces, their parts, and parts of no commit
    older than some hours (younger ones may belong to a writer at work); the number of parts removed."""
    path = path.rstrip("/")
    files, root = opened(path)
    all_of = commits(path)
    needed = max((c["version"] for c in all_of if c["replaces"] and c["version"] <= keep_from), default=0)
    gone = [c for c in all_of if c["version"] < needed]
    for c in gone:
        files.delete_file(f"{root}/commits/{c['version']:08d}.json")
    known = {p for c in all_of for p in c["parts"]}
    old = {p for c in gone for p in c["parts"]}
    for x in files.get_file_info(fs.FileSelector(f"{root}/parts", allow_not_found=True)):
        if x.base_name not in known and x.mtime.timestamp() < time.time() - hours * 3600:
            old.add(x.base_name)
    drop_parts(path, sorted(old))
    return len(old)


def free_name(file_name: str, taken: set[str]) -> str:
    """The file's stem, else its name, else the stem with the first free number from 2."""
    stem = os.path.splitext(file_name)[0] or file_name
    if stem not in taken or file_name not in taken:
        return stem if stem not in taken else file_name
    numbers = {int(m[1]) for t in taken if (m := re.fullmatch(re.escape(stem) + r"-([1-9]\d*)", t))}
    return f"{stem}-{next(n for n in range(2, len(numbers) + 3) if n not in numbers)}"


def folder_hash(spark: SparkSession, path: str) -> str:
    """Digest of the files under a path by name, size and time of change; contents are not read, order does not count."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    h = F.xxhash64("path", "length", "modificationTime")
    row = files.agg(F.count("*"), F.sum("length"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first()
    return hashlib.sha256(repr(tuple(row)).encode()).hexdigest()


class StaleDataset(ValueError):
    """The source has changed since the dataset was registered."""


class Registry:
    """Datasets by source in a folder: a record for each source, its cleaned and raw rows as tables of parts.

    A source registered again keeps its name and time of creation and gets new versions; the record moves to them
    after their commits and the superseded parts go after that, so an interrupted registration leaves the last one
    whole. One registration at a time in a folder.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _key(self, source: str) -> str:
        return hashlib.sha256(source.encode()).hexdigest()[:32]

    def records(self) -> DataFrame:
        """One row a dataset."""
        if not names(f"{self.folder}/records"):
            return self.spark.createDataFrame([], RECORD)
        return self.spark.read.schema(RECORD).json(f"{self.folder}/records")

    def columns(self) -> DataFrame:
        """One row a column of each dataset's cleaned and raw rows."""
        return self.records().select("name", F.inline("fields"))

    def register(self, source: str, cleaned: DataFrame, raw: DataFrame | None = None, source_hash: str = "", keep_history: bool = False) -> dict | None:
        """Write the rows and upsert the record, which is returned; no cleaned rows register nothing."""
        source = source.replace("\\", "/").rstrip("/")
        key, base = self._key(source), f"{self.folder}/tables"
        now = datetime.now(UTC).isoformat()
        old = get(f"{self.folder}/records/{key}.json")
        written, fields = {}, []
        for kind, df in (("cleaned", cleaned), ("raw", raw)):
            if df is not None:
                written[kind] = write_parts(df, f"{base}/{key}-{kind}", overwrite=True)
                if kind == "cleaned" and not written[kind]["rows"]:
                    return None
                fields += [{"kind": kind, "ordinal": i, "column": c, "type": t} for i, (c, t) in enumerate(df.dtypes)]
        file_name = source.rsplit("/", 1)[-1]
        if old is None:
            taken = {r[0] for r in self.records().where(F.col("name").startswith(os.path.splitext(file_name)[0] or file_name)).select("name").collect()}
        record = {
            "source": source, "name": old["name"] if old else free_name(file_name, taken), "file_name": file_name, "source_hash": source_hash, "rows": written["cleaned"]["rows"],
            "columns": len(cleaned.columns), "cleaned_version": written["cleaned"]["version"], "raw_version": written["raw"]["version"] if raw is not None else None,
            "created": old["created"] if old else now, "updated": now, "fields": fields,
        }
        put(f"{self.folder}/records/{key}.json", record)
        if not keep_history:
            for kind, c in written.items():
                prune(f"{base}/{key}-{kind}", c["version"])
        return record

    def find(self, ref: str) -> dict | None:
        """The record whose name it is, else the latest with that file name, else that of the source."""
        ref = ref.replace("\\", "/").rstrip("/")
        order = F.when(F.col("name") == ref, 0).when(F.col("file_name") == ref, 1).otherwise(2)
        hit = self.records().where((F.col("name") == ref) | (F.col("file_name") == ref) | (F.col("source") == ref)).orderBy(order, F.desc("updated"), "source").first()
        return hit.asDict(True) if hit else None

    def read(self, ref: str, kind: str = "cleaned", source_hash: str | None = None) -> DataFrame:
        """The rows of a dataset as its record has them; a source_hash unlike the record's raises StaleDataset."""
        record = self.find(ref)
        if record is None or record[f"{kind}_version"] is None:
            raise ValueError(f"no {kind} dataset is registered under {ref!r}")
        if source_hash is not None and source_hash != record["source_hash"]:
            raise StaleDataset(f"{record['source']} has changed since {record['updated']}: register it again")
        return read_parts(self.spark, f"{self.folder}/tables/{self._key(record['source'])}-{kind}", record[f"{kind}_version"])
