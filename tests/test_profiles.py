"""Several profiles at once with a time limit, and checks of inputs before they are loaded."""

import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.operators.profiles import profile_table, profile_tables, schema_summary
from lakelens.sources import preflight


def test_a_slow_table_is_cancelled_and_the_others_return(spark):
    slow = F.udf(lambda i: (time.sleep(60), i)[1], "long")
    tables = {
        "small": spark.createDataFrame([(1, "a", None), (2, "a", 2.5), (3, "b", 4.5)], "id long, t string, v double"),
        "slow": spark.range(8, numPartitions=2).select(slow("id").alias("x")).where("x >= 0"),
        "broken": spark.range(3).select(F.raise_error(F.lit("no such thing")).cast("int").alias("x")),
        "empty": spark.createDataFrame([], "a int, b string"),
    }
    at = time.time()
    got = profile_tables(tables, seconds=25)
    assert time.time() - at < 60  # one slow row alone takes a minute, and there are four a task
    status = {r.table: (r.status, r.rows, r.columns) for r in got.tables.collect()}
    assert status == {"small": ("done", 3, 3), "slow": ("timed_out", None, 1), "broken": ("failed", None, 1), "empty": ("done", 0, 2)}
    cols = {(r.table, r.column): r for r in got.columns.collect()}
    assert cols["small", "id"].key == "unique_key" and cols["small", "v"].nulls == 1 and cols["small", "v"].median == 3.5 and cols["small", "t"].unique == 2
    assert "no such thing" in got.tables.where("table = 'broken'").first().error
    with pytest.raises(ValueError):
        profile_tables({})


def test_large_tables_are_sampled_by_hash(spark):
    x = spark.range(250_000).select("id", (F.col("id") % 10).alias("k"))
    n, profiled, rows = profile_table(x)
    assert n == 250_000 and 11_000 < profiled < 14_000 and {r[0] for r in rows} == {"id", "k"} and profile_table(x)[1] == profiled


def test_schema_summary(spark):
    got = schema_summary(spark, {"t": spark.createDataFrame([], "a int, s struct<b:string,c:struct<d:double>>")}).collect()
    assert [(r.column, r.kind) for r in got if not r.kind.startswith("struct")] == [("a", "int"), ("s.b", "string"), ("s.c.d", "double")]


def test_csv_rows_that_do_not_fit(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,2.5\nx,3\n2,\n,\n3,1,9\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.DoubleType())])
    r = preflight.check_csv(spark, str(tmp_path / "a.csv"), schema).first()
    assert (r.rows, r.bad, r.empty) == (5, 2, 1) and set(r.examples) <= {"x,3", "3,1,9"} and r.examples


def test_json_lines_that_are_no_objects(spark):
    lines = ['{"a": 1}', '{"a": ', "[1]", "3", '"s"', "", None, "  ", '{"b": {}}', "null"]
    got = {r.kind: r.rows for r in preflight.check_json_lines(spark.createDataFrame([(x,) for x in lines], "l string"), "l").collect()}
    assert got == {"object": 2, "invalid": 1, "array": 1, "scalar": 3, "blank": 3}


def test_xml_that_is_not_well_formed(spark):
    texts = {
        1: "<?xml version='1.0'?><a><b x='>'/>t</a>", 2: "<a><b></a>", 3: "", 4: None, 5: "plain", 6: "<a></a><b></b>", 7: "<!-- c --><a/>", 8: "<a><b></a></b>x", 9: "<a><![CDATA[<c>]]></a>", 10: "<a></b>", 11: "<ab></a><b></b>",
    }
    got = {r.key: r.problem for r in preflight.check_xml(spark.createDataFrame(list(texts.items()), "k int, t string"), "k", "t").collect()}
    assert got == {2: "unclosed", 3: "empty", 4: "empty", 5: "no_root", 6: "no_root", 8: "no_root", 10: "unbalanced", 11: "unbalanced"}
