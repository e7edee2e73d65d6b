"""Parts made visible by commits, and the registry of datasets."""

import os
import time

import pytest
from pyspark.sql import functions as F

from lakelens.sources import datasets as D


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def failing(df, at):
    return df.select(F.when(F.col("id") == at, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))


def test_a_failed_task_leaves_no_row_and_a_rerun_adds_none_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    D.write_parts(spark.range(10, numPartitions=4), path, "a")
    with pytest.raises(Exception, match="lost"):
        D.write_parts(failing(spark.range(10, 20, numPartitions=4), 19), path, "b")
    assert ids(D.read_parts(spark, path)) == list(range(10))
    assert D.write_parts(spark.range(10, 20, numPartitions=3), path, "b")["version"] == 2
    assert D.write_parts(spark.range(10, 20, numPartitions=2), path, "b")["version"] == 2
    assert ids(D.read_parts(spark, path)) == list(range(20))
    assert len(os.listdir(f"{path}/parts")) == sum(len(c["parts"]) for c in D.commits(path))


def test_parts_of_no_commit_are_never_read_and_go_when_old(spark, tmp_path):
    path = str(tmp_path / "t")
    D.write_parts(spark.range(5, numPartitions=1), path)
    (part,) = os.listdir(f"{path}/parts")
    for name, age in (("0-lost.parquet", 30 * 3600), ("0-young.parquet", 0)):
        with open(f"{path}/parts/{part}", "rb") as a, open(f"{path}/parts/{name}", "wb") as b:
            b.write(a.read())
        os.utime(f"{path}/parts/{name}", (time.time() - age,) * 2)
    assert ids(D.read_parts(spark, path)) == list(range(5))
    assert D.prune(path, 1) == 1 and sorted(os.listdir(f"{path}/parts")) == sorted([part, "0-young.parquet"])


def test_versions_overwrite_and_prune(spark, tmp_path):
    path = str(tmp_path / "t")
    for i, over in enumerate((False, False, True, False)):
        D.write_parts(spark.range(i, i + 1), path, overwrite=over)
    want = {1: [0], 2: [0, 1], 3: [2], 4: [2, 3]}
    assert {v: ids(D.read_parts(spark, path, v)) for v in want} == want
    assert D.prune(path, 2) == 0 and ids(D.read_parts(spark, path, 2)) == [0, 1]
    assert D.prune(path, 4) == 2 and ids(D.read_parts(spark, path)) == [2, 3]
    for v in (2, 9):
        with pytest.raises(ValueError, match="no version"):
            D.read_parts(spark, path, v)
    with pytest.raises(Exception, match="differ in their columns"):
        D.write_parts(spark.range(1).select(F.lit("x").alias("id")), path)


def test_types_nulls_and_no_rows(spark, tmp_path):
    df = spark.sql("select 1 as `a b`, cast(null as string) as s, timestamp'2024-01-02 03:04:05' as t, date'2024-01-02' as d, 1.50bd as m, array(1, null) as l, named_struct('x', 'y') as n union all select null, '', null, null, null, null, null")
    D.write_parts(df, f"{tmp_path}/t")
    back = D.read_parts(spark, f"{tmp_path}/t")
    assert back.dtypes == df.dtypes and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    D.write_parts(df.limit(0), f"{tmp_path}/e")
    assert D.read_parts(spark, f"{tmp_path}/e").dtypes == df.dtypes and D.read_parts(spark, f"{tmp_path}/e").count() == 0


def test_free_names():
    assert D.free_name("a.csv", set()) == "a" and D.free_name("a.csv", {"a"}) == "a.csv"
    assert D.free_name("a.csv", {"a", "a.csv"}) == "a-2" and D.free_name("a.csv", {"a", "a.csv", "a-2", "a-4"}) == "a-3"
    assert D.free_name(".csv", set()) == ".csv" and D.free_name("a.csv", {"a", "a.csv", "a-02", "a-x"}) == "a-2"


def test_registry(spark, tmp_path):
    r = D.Registry(spark, str(tmp_path / "r"))
    assert r.records().count() == 0 and r.find("a") is None
    first = r.register("/x/a.csv", spark.range(3), spark.range(5), "h1")
    assert (first["name"], first["rows"], first["cleaned_version"], first["raw_version"]) == ("a", 3, 1, 1)
    assert r.register("/y/a.csv", spark.range(4))["name"] == "a.csv" and r.register("\\z\\a.csv", spark.range(6))["name"] == "a-2"
    assert r.register("/w/empty.csv", spark.range(0)) is None and r.find("empty") is None
    again = r.register("/x/a.csv", spark.range(7).withColumn("b", F.lit("x")), None, "h2")
    assert (again["name"], again["created"], again["cleaned_version"], again["raw_version"], again["columns"]) == ("a", first["created"], 2, None, 2)
    assert r.read("a").count() == 7 and r.read("/y/a.csv").count() == 4 and r.read("a-2").count() == 6
    assert r.find("a.csv")["source"] == "/y/a.csv"  # a name goes before a file name
    assert [tuple(x) for x in r.columns().where("name = 'a'").orderBy("ordinal").collect()] == [("a", "cleaned", 0, "id", "bigint"), ("a", "cleaned", 1, "b", "string")]
    with pytest.raises(D.StaleDataset):
        r.read("a", source_hash="h1")
    with pytest.raises(ValueError, match="raw"):
        r.read("a", "raw")
    key = r._key("/x/a.csv")
    assert [c["version"] for c in D.commits(f"{r.folder}/tables/{key}-cleaned")] == [2]
    r.register("/x/a.csv", spark.range(8), keep_history=True)
    assert [c["version"] for c in D.commits(f"{r.folder}/tables/{key}-cleaned")] == [2, 3]


def test_an_interrupted_registration_leaves_the_last_one(spark, tmp_path):
    r = D.Registry(spark, str(tmp_path / "r"))
    r.register("/x/a.csv", spark.range(3, numPartitions=2), source_hash="h1")
    with pytest.raises(Exception, match="lost"):
        r.register("/x/a.csv", spark.range(9), failing(spark.range(9, numPartitions=3), 8), "h2")
    assert r.read("a", source_hash="h1").count() == 3


def test_folder_hash(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text("x" * i)
    before = D.folder_hash(spark, str(tmp_path))
    assert before == D.folder_hash(spark, str(tmp_path))
    (tmp_path / "1.txt").write_text("yy")
    assert before != D.folder_hash(spark, str(tmp_path))
