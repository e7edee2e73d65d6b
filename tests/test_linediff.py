"""Line differences against the quadratic longest common subsequence."""

import random

import duckdb
import pytest

from lakelens.operators.linediff import compare_texts, edit_script, line_diff
from lakelens.plans import catalog


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("seed", range(6))
def test_scripts_are_right_and_shortest(seed):
    rng = random.Random(seed)
    for _ in range(150):
        a, b = ([rng.randrange(rng.choice([2, 4, 40])) for _ in range(rng.randrange(30))] for _ in range(2))
        if rng.random() < 0.5:
            b = [x for x in a if rng.random() < 0.8]
        script = list(edit_script(a, b))
        assert [a[i] for s, i, _ in script if s != "+"] == a and [b[j] for s, _, j in script if s != "-"] == b
        assert all(a[i] == b[j] for s, i, j in script if s == " ")
        assert sum(s == " " for s, *_ in script) == common(a, b)


def test_script_of_long_texts_with_few_changes():
    a = list(range(60000))
    b = [x for x in a if x % 3000] + [-1]
    assert sum(s != " " for s, *_ in edit_script(a, b)) == 21


def rows(df):
    return [tuple(r) for r in df.orderBy("key", "hunk", "old_no", "new_no").collect()]


def test_hunks_of_changed_texts(spark):
    text = "\n".join(f"line {i}" for i in range(1, 21)) + "\n"
    new = text.replace("line 3\n", "line three\n").replace("line 12\n", "").replace("line 14\n", "line 14\nmore\n")
    a = spark.createDataFrame([(1, text, 0), (2, "same", 0), (3, "gone\n", 0), (5, None, 0), (None, "x", 0)], "key int, t string, hunk int")
    b = spark.createDataFrame([(1, new, 0), (2, "same", 0), (4, "new\nhere", 0), (5, "", 0), (None, "y", 0)], "key int, t string, hunk int")
    got = line_diff(a, b, "key", "t", 1).collect()
    one = [(r.hunk, r.old_no, r.new_no, r.sign, r.line) for r in got if r.key == 1]
    assert one == [
        (1, 2, 2, " ", "line 2"), (1, 3, None, "-", "line 3"), (1, None, 3, "+", "line three"), (1, 4, 4, " ", "line 4"), (2, 11, 11, " ", "line 11"), (2, 12, None, "-", "line 12"),
        (2, 13, 12, " ", "line 13"), (2, 14, 13, " ", "line 14"), (2, None, 14, "+", "more"), (2, 15, 15, " ", "line 15"),
    ]
    assert [(r.sign, r.line) for r in got if r.key == 3] == [("-", "gone")] and [(r.sign, r.line) for r in got if r.key == 4] == [("+", "new"), ("+", "here"), ("\\", "new")]
    assert {r.key for r in got} == {1, 3, 4}  # null keys never match
    assert {r.key for r in line_diff(a, b, "key", "t", 1, limit=20).collect()} == {3, 4}


def test_status_and_ratio(spark):
    a = spark.createDataFrame([(1, "abcd"), (2, "same"), (3, "gone"), (5, "x" * 100), (6, None)], "k int, t string")
    b = spark.createDataFrame([(1, "abcx"), (2, "same"), (4, "new"), (5, "y" * 100), (6, None)], "k int, t string")
    got = {r.key: (r.status, r.ratio, r.similar) for r in compare_texts(a, b, "k", "t", 0.25, limit=50).collect()}
    assert got == {1: ("changed", 0.75, True), 2: ("identical", 1.0, True), 3: ("missing_b", None, None), 4: ("missing_a", None, None), 5: ("large", None, None), 6: ("identical", 1.0, True)}
    assert {r.similar for r in compare_texts(a, b, "k", "t").collect()} == {None}


def test_the_query_agrees_with_its_sql_about_the_bytes_at_the_limit(spark, tmp_path):
    rows = [(3 * n, "x" * k) for n, k in ((1, 1997), (2, 1998), (3, 1999), (4, 2000), (6, 2001), (7, 0))] + [(10, "é" * 1000), (27, "é" * 999 + "x"), (15, "y")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = {tuple(r) for r in duck.sql(catalog.SQL["compare_texts"]).fetchall()}
    got = {(r.key, r.status, r.ratio) for r in catalog.QUERIES["compare_texts"](spark, str(tmp_path)).collect()}
    assert got == want and {k for k, s, _ in got if s == "large"} == {12, 18}
