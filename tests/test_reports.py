"""Paths, roll-ups and recognition of JSON without a schema."""

import pytest

from lakelens.operators.reports import json_paths, recognised, rolled_up

REPORTS = [
    (1, '{"summary": {"ok": 3, "failed": 1}, "items": [{"id": 1, "tags": []}, {"id": "two"}], "at": "2024-01-01", "done": true, "none": null}'), (2, '{"summary": {"ok": "x"}, "extra": 5.5}'), (3, "not json"), (4, None), (5, "[1, 2, [3]]"), (6, "{}"), (7, "7"),
]


@pytest.fixture(scope="module")
def paths(spark):
    return json_paths(spark.createDataFrame(REPORTS, "key int, path string"), "key", "path").cache()


def test_paths(paths):
    got = {(r.key, r.path, r.kind, r.number, r.text) for r in paths.collect()}
    assert paths.count() == len(got) == 16 and got == {
        (1, "at", "string", None, "2024-01-01"), (1, "done", "boolean", None, "true"), (1, "items.id", "number", 1.0, None), (1, "items.id", "string", None, "two"), (1, "items.tags", "array", None, None), (1, "none", "null", None, None),
        (1, "summary.failed", "number", 1.0, None), (1, "summary.ok", "number", 3.0, None), (2, "extra", "number", 5.5, None), (2, "summary.ok", "string", None, "x"), (3, None, "invalid", None, None), (5, "", "number", 1.0, None),
        (5, "", "number", 2.0, None), (5, "", "number", 3.0, None), (6, "", "object", None, None), (7, "", "number", 7.0, None),
    }


def test_roll_up(paths):
    got = {(r.path, r.kind): (r.reports, r.rows, r.total) for r in rolled_up(paths).collect()}
    assert got["summary.ok", "number"] == (1, 1, 3.0) and got["summary.ok", "string"] == (1, 1, None) and got["", "number"] == (2, 4, 13.0)
    assert not any(k == "invalid" for _, k in got)


def test_recognition(paths):
    got = {r.key: (round(r.share, 3), r.recognised) for r in recognised(paths, {"summary": 2, "items": 1, "at": 1}).collect()}
    assert got == {1: (1.0, True), 2: (0.5, True), 3: (0.0, False), 5: (0.0, False), 6: (0.0, False), 7: (0.0, False)}


def test_depth(spark):
    x = spark.createDataFrame([(1, '{"a": {"b": {"c": 1}}}')], "k int, j string")
    assert [(r.path, r.kind) for r in json_paths(x, "k", "j", depth=2).collect()] == [("a.b", "object")]
    assert json_paths(x.where("false"), "k", "j").isEmpty()
