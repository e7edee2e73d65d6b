"""Observers as a graph, and a mirrored folder with creations, changes and deletions over restarts."""

import os
import time

import pytest
from pyspark.sql import functions as F

from lakelens.operators.observers import CsvObserver, FieldObserver, IdentityObserver, Observer, Registry, SnapshotStore, StateObserver, observe
from lakelens.streaming import watch

SCHEMA = "path string, content string, meta map<string,string>"


def events(df):
    return sorted((r.observer, r.path, r.event, r.field or "", r.old or "", r.new or "") for r in df.collect())


def registry():
    fields = FieldObserver({"patient": [r"patient:\s*(\w+)", "toml:patient", "meta:patient"], "tags": [r"#(\w+)"]}, ["tags"])
    return Registry().add(IdentityObserver("patient"), StateObserver(), fields, CsvObserver())


def test_two_runs_of_the_graph(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    first = spark.createDataFrame([("a.txt", "Patient: p1\n#x #y", None), ("b.toml", 'patient = "p2"', None), ("c.txt", "plain", {"patient": "p3"}), ("t.csv", 'id,"n,m",v\n1,x,2\n2,"a,b",3\n', None), ("gone.csv", "q\n1", None)], SCHEMA)
    got, metrics = observe(first, registry(), store)
    assert {e[2] for e in events(got)} == {"CREATED", "CSV_CREATED"}
    assert {(r.observer, r.files, r.events) for r in metrics.collect()} == {("state", 5, 5), ("fields", 5, 5), ("identity", 3, 3), ("csv", 2, 2)}
    second = spark.createDataFrame([("a.txt", "patient: p1\n#y #z #z", None), ("b.toml", 'patient = "p9"', None), ("c.txt", "plain", {"patient": "p3"}), ("t.csv", 'id,w,v\n1,x,2\n2,"a,b",4\n3,long,\n', None)], SCHEMA)
    want = [
        ("csv", "gone.csv", "CSV_DELETED", "", "", ""), ("csv", "t.csv", "COLUMN_ADDED", "w", "", ""), ("csv", "t.csv", "COLUMN_REMOVED", "n,m", "", ""), ("csv", "t.csv", "DATA_DISTRIBUTION_SHIFTED", "", "", ""), ("csv", "t.csv", "ROW_COUNT_CHANGED", "", "2", "3"),
        ("fields", "a.txt", "CHANGED", "tags", "x; y", "y; z"), ("fields", "b.toml", "CHANGED", "patient", "p2", "p9"), ("fields", "gone.csv", "DELETED", "", "", ""),
        ("identity", "a.txt", "TOUCHED", "identity", "", "p1"), ("identity", "b.toml", "CHANGED", "identity", "p2", "p9"), ("identity", "b.toml", "TOUCHED", "identity", "", "p9"),
    ]
    for _ in range(2):  # a run that is repeated has the same events
        got, _ = observe(second, registry(), store, 2)
        assert [e for e in events(got) if e[0] != "state"] == want
        assert [e[1:3] for e in events(got) if e[0] == "state"] == [("a.txt", "UPDATED"), ("b.toml", "REPLACED"), ("gone.csv", "DELETED"), ("t.csv", "UPDATED")]
    assert events(observe(second, registry(), store)[0]) == []


def test_order_switches_and_circles():
    class Needs(Observer):
        def __init__(self, name, *needs):
            self.name, self.needs = name, needs

        def extract(self, files, given):
            return files.select("path", F.lit(sorted(given)).alias("given"))

    r = Registry().add(Needs("c", "b"), Needs("a"), Needs("b", "a"))
    assert [o.name for o in r.in_order()] == ["a", "b", "c"]
    r.enable("a", False)
    assert r.in_order() == []
    with pytest.raises(ValueError):
        r.add(Needs("a"))
    with pytest.raises(KeyError):
        r.enable("z")
    with pytest.raises(ValueError):
        Registry().add(Needs("a", "b"), Needs("b", "a")).in_order()


def test_old_runs_are_dropped(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    files = spark.createDataFrame([("a", "x", None)], SCHEMA)
    for run in range(1, 5):
        store.keep("state", run, files)
        store.finish(run, 2)
    assert store.runs() == [3, 4] and not os.path.exists(tmp_path / "s" / "states" / "state" / "run=1")


def test_folder_is_mirrored_with_deletions_and_restarts(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    (src / "sub").mkdir(parents=True)
    (src / "a.txt").write_text("one")
    (src / "sub" / "b.txt").write_text("two")

    def run():
        watch.run_once(watch.ticks(spark), cp, watch.mirror_folder(spark, str(src), out)).awaitTermination(60)  # a new query each time, from the checkpoint
        return {os.path.basename(r.path): bytes(r.content).decode() for r in watch.mirrored(spark, out).collect()}

    assert run() == {"a.txt": "one", "b.txt": "two"}
    (src / "a.txt").write_text("one more")
    (src / "sub" / "b.txt").unlink()
    (src / "c.txt").write_text("three")
    time.sleep(1.1)
    assert run() == {"a.txt": "one more", "c.txt": "three"}
    time.sleep(1.1)
    assert run() == {"a.txt": "one more", "c.txt": "three"}
    rows = spark.read.parquet(out).groupBy("batch").agg(F.count_if("deleted").alias("dead"), F.count_if(~F.col("deleted")).alias("kept")).orderBy("batch").collect()
    assert [(r.dead, r.kept) for r in rows if r.dead or r.kept] == [(0, 2), (1, 2)]
    before = watch.mirrored(spark, out).count()
    watch.mirror_folder(spark, str(src), out)(None, rows[0].batch if len(rows) == 1 else rows[1].batch)  # a batch again
    assert watch.mirrored(spark, out).count() == before


def test_deletions_of_an_upserted_table(spark, tmp_path):
    x = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, False)], "k string, at int, deleted boolean")
    x.write.parquet(str(tmp_path / "t" / "batch=1"))
    assert [tuple(r) for r in watch.read_current(spark, str(tmp_path / "t"), "k", "at").collect()] == [("b", 1)]
