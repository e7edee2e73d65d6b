import json
import sqlite3

import pytest

from lakelens.sources import files, sqlite, text
from lakelens.streaming import watch


def test_types_and_delimiters():
    assert files.detect_type("x/y.CSV.gz") == "csv" and files.detect_type("a.jsonl") == "ndjson"
    assert files.detect_delimiter(["timestamp,value", "12:30:00,1", "12:31:00,2"]) == ","
    assert files.detect_delimiter(["a;b;c", "1;2;3"]) == ";"


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Name;Age\nAnn;3\nBob;4\n")
    assert files.load(spark, str(tmp_path / "x.csv")).columns == ["Name", "Age"]


def test_bad_ndjson_is_rejected(spark, tmp_path):
    (tmp_path / "x.ndjson").write_text('{"id":1}\nnot json\n{"id":2}\n')
    with pytest.raises(Exception):
        files.read_ndjson(spark, str(tmp_path / "x.ndjson")).collect()


def test_promotion_and_flattening(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps([{"employee": {"id": i, "name": "n", "tags": ["a", "b"]}} for i in range(2)]))
    df = files.read_json(spark, str(tmp_path / "x.json"))
    assert df.columns == ["id", "name", "tags"]
    assert files.flatten(df).count() == 4
    (tmp_path / "y.json").write_text(json.dumps({"records": [{"x": 1}, {"x": 2}], "n": 1}))
    flat = files.flatten(files.read_json(spark, str(tmp_path / "y.json")))
    assert set(flat.columns) == {"records.x", "n"} and flat.count() == 2


def test_socrata(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"columns": [{"fieldName": "id"}, {"fieldName": "value"}], "data": [[1, 10], [2, 20]]}))
    assert sorted(tuple(r) for r in files.socrata(spark, str(tmp_path / "s.json")).collect()) == [("1", "10"), ("2", "20")]


def test_xml(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<root><entry><id>1</id><val>a</val></entry><entry><id>2</id><val>b</val></entry></root>")
    assert files.read_xml(spark, str(tmp_path / "x.xml"), "entry").count() == 2


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as con:
        con.execute("create table parent(ParentId integer primary key, name text)")
        con.execute("create table child(ChildId integer primary key, ParentId integer references parent(ParentId), value real)")
        con.executemany("insert into child values (?, ?, ?)", [(i, i, 1.5 * i) for i in range(100)])
    assert files.load(spark, path, table="child", rows="30").agg({"value": "sum"}).first()[0] == 1.5 * sum(range(100))
    assert sqlite.foreign_keys(path) == [("child", "ParentId", "parent", "ParentId")]


def test_ignore_rules(spark):
    x = spark.createDataFrame([("a/node_modules/b.txt",), ("a/b.tmp",), ("a/~$b.docx",), ("a/b.txt",)], "path string")
    assert [r.path for r in x.where(~files.ignored("path", ["node_modules/", "*.tmp", "# note"])).collect()] == ["a/b.txt"]


def test_text_of_pages_and_mail():
    assert text.page_text("<title>T</title><script>x</script><p>a <b>b</b></p>") == "T\na b"
    assert "hello" in text.mail_text(b"From: a@b\nSubject: s\nContent-Type: text/plain\n\nhello\n")
    assert text.edit_ratio("color", "colour") > 85


def test_upsert_stream(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps({"path": p, "content": c, "modified": f"2024-01-0{d}T00:00:00"}) for p, c, d in (("x", "old", 1), ("x", "new", 2), ("y", "y", 1))))
    stream = watch.watch_folder(spark, str(src))
    watch.run_once(stream, str(tmp_path / "cp"), watch.upsert_into(spark, out, "path", "modified")).awaitTermination(60)
    assert {(r.path, r.content) for r in watch.read_current(spark, out, "path", "modified").collect()} == {("x", "new"), ("y", "y")}


def test_state_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    got = []
    changes = watch.state_changes(watch.watch_folder(spark, str(src)), "path", "content")
    for i, c in enumerate(("one", "one", "two")):
        (src / f"{i}.json").write_text(json.dumps({"path": "x", "content": c, "modified": "2024-01-01T00:00:00"}))
        watch.run_once(changes, str(tmp_path / "cp"), lambda b, _: got.extend(r.event for r in b.collect())).awaitTermination(60)
    assert got == ["CREATED", "UPDATED"]
