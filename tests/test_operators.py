import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakelens.functions import scalar, special
from lakelens.operators import aggregates, cleaning, inference, joins, observe, profile, search


def test_one_to_many_join(spark):
    left = spark.createDataFrame([(1, "A"), (2, "B")], "id int, g string")
    right = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "id int, value int")
    assert joins.guarded_join([left, right], ["id"]).count() == 3
    assert joins.cardinality([False, True]) == "one-to-many"


def test_many_to_many_is_refused_and_estimated(spark):
    x = spark.createDataFrame([(1,), (1,)], "id int")
    with pytest.raises(joins.JoinSafetyError):
        joins.guarded_join([x, x], ["id"])
    assert joins.join_estimate(x, x, ["id"]).first()["rows"] == 4
    assert joins.guarded_join([x, x], ["id"], aggregate="mean").count() == 1


def test_composite_keys_and_types(spark):
    a = spark.createDataFrame([(1, 1, 5), (1, 2, 6)], "id int, day int, v int")
    b = spark.createDataFrame([(1, 1, 7), (1, 2, 8)], "id int, day int, w int")
    assert joins.guarded_join([a, b], ["id", "day"]).count() == 2
    with pytest.raises(TypeError):
        joins.guarded_join([a, b.withColumn("id", F.col("id").cast("string"))], ["id"])


def test_numeric_summary_of_three(spark):
    r = aggregates.numeric_summary(spark.createDataFrame([(1,), (2,), (3,), (None,)], "value int")).first()
    assert (r["count"], r["nulls"], r["mean"], r["median"]) == (3, 1, 2.0, 2.0)


def test_mixed_dates_all_parse(spark):
    x = spark.createDataFrame([(s,) for s in ("12/03/2024", "2024/04/05", "04-06-2024", "05.07.2024", "2024-08-10T13:00:00")], "d string")
    assert x.where(scalar.parse_date("d").isNull()).count() == 0


def test_fill_keeps_columns_without_values(spark):
    x = spark.createDataFrame([(None, 1, "a"), (None, None, None)], "a double, b int, c string")
    y = cleaning.fill_missing(x)
    assert sorted(tuple(r) for r in y.select("b", "c").collect()) == [(1, "a"), (1, "a")]
    notes = {r.column: r.note for r in cleaning.cleaning_report(x, y).collect()}
    assert notes["a"] == "preserved missing values" and notes["b"] == "filled"


def test_inferred_columns(spark):
    x = spark.createDataFrame([("A", "1", "2024-01-02"), ("2", "2.5", "3/4/2024")], "code string, amount string, created string")
    assert cleaning.infer_columns(x) == {"code": "string", "amount": "double", "created": "timestamp"}


def test_query_syntax():
    assert search.parse("search and replace") == search.Node("phrase", ("search", "and", "replace"))
    assert search.parse("a OR b AND c").kind == "or"
    assert search.parse("NEAR(a b, 5)") == search.Node("near", ("a", "b"), 5)
    with pytest.raises(ValueError):
        search.parse("a AND")


def test_search_semantics(spark):
    docs = spark.createDataFrame([(1, "This guide explains search and replace workflows."), (2, "This guide explains search workflows and replace commands."), (3, None)], "id int, t string")
    found = lambda q: {r.key for r in search.search(docs, "id", "t", q).collect()}
    assert found("search and replace") == {1}
    assert found("search AND replace") == {1, 2}
    assert found("search NOT commands") == {1}
    assert found("workf*") == {1, 2}
    assert found("NEAR(search replace, 1)") == {1}


def test_tails_against_known_values():
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert special.f_tail(3.0, 2, 20) == pytest.approx(0.0725, abs=1e-4)
    assert special.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert special.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)


def test_tails_against_the_jvm(spark):
    d = spark.sparkContext._jvm.org.apache.commons.math3.distribution
    for df in (1.0, 3.0, 30.0):
        assert special.t_two_sided(1.7, df) == pytest.approx(2 * (1 - d.TDistribution(df).cumulativeProbability(1.7)), abs=1e-9)
        assert special.f_tail(1.7, df, 12.0) == pytest.approx(1 - d.FDistribution(df, 12.0).cumulativeProbability(1.7), abs=1e-9)


def test_bayes_factor_direction(spark):
    same = [(float(i), g) for g in "ab" for i in range(1, 9)]
    moved = [(float(i) + 6 * (g == "b"), g) for g in "ab" for i in range(1, 9)]
    assert inference.bayes_t_test(spark.createDataFrame(same, "v double, g string"), "v", "g").first().bf10 < 1
    assert inference.bayes_t_test(spark.createDataFrame(moved, "v double, g string"), "v", "g").first().bf10 > 1


def test_adjusted_p(spark):
    x = spark.createDataFrame([("a", 0.04), ("b", 0.001), ("c", 0.03), ("d", 0.2)], "k string, p double")
    r = {row.k: row for row in inference.adjust_p(x, "k", "p").collect()}
    assert [round(r[k].holm, 6) for k in "abcd"] == [0.09, 0.004, 0.09, 0.2]
    assert [round(r[k].bh, 6) for k in "abcd"] == [0.053333, 0.004, 0.053333, 0.2]


def test_profile_keys(spark):
    r = {x.column: x.key for x in profile.profile_columns(spark.createDataFrame([(i, i % 2) for i in range(10)], "a int, b int")).collect()}
    assert r == {"a": "unique_key", "b": "none"}
    assert profile.sample_size(100) is None and profile.sample_size(1_000_000) == 50_000


def test_field_events_mapped(spark):
    x = spark.createDataFrame([("p", 1, "Ann", "x"), ("p", 2, "Eve", "y")], "path string, at int, patient_name string, patient_address string")
    e = observe.mapped_events(observe.field_events(x, "path", "at", ["patient_name", "patient_address"]), {"patient_name": "PATIENT_NAME_UPDATED", "patient_address": "PATIENT_ADDRESS_UPDATED"})
    assert {r.event for r in e.collect()} == {"PATIENT_NAME_UPDATED", "PATIENT_ADDRESS_UPDATED"}


def test_similarity_and_lines(spark):
    x = spark.createDataFrame([(1, "alpha", "beta"), (2, "same", "same")], "id int, a string, b string")
    r = {row.id: row.s for row in x.select("id", observe.similarity("a", "b").alias("s")).collect()}
    assert r[2] == 1.0 and 0 < r[1] < 1
    d = observe.compare_lines(x.select("id", F.lit("a\nb").alias("t")), x.select("id", F.lit("a\nc\nd").alias("t")), "id", "t")
    assert d.count() == 4


def test_cycle_has_no_root(spark):
    x = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4)], "id int, parent int")
    r = {row.key: (row.root, row.depth) for row in observe.chains(spark, x, "id", "parent").collect()}
    assert r == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (None, None), 5: (None, None)}


def test_bits_of_scalars(spark):
    x = spark.createDataFrame([("a/b\\2024-03/x.CSV", float("nan"))], "p string, v double")
    r = x.select(*scalar.path_facets("p"), scalar.json_safe("v").alias("v")).first()
    assert (r.name, r.extension, r.folder, r.year, r.month, r.v) == ("x.CSV", "csv", "a/b/2024-03", "2024", "03", None)
    assert math.isclose(x.select(scalar.decimal_degrees(F.lit(10), F.lit(30), F.lit(0), F.lit("S"))).first()[0], -10.5)


def test_postings_shuffle_no_word_unless_keys_repeat(spark, monkeypatch):
    rows = [(1, "b a B"), (2, None), (3, "..."), (4, "a-b c"), (5, "Ä1 c c")]
    docs = spark.createDataFrame(rows, "id long, t string")
    got = lambda x: {(r.term, r.key): (r.tf, list(r.positions)) for r in x.collect()}
    want = {("b", 1): (2, [0, 2]), ("a", 1): (1, [1]), ("a", 4): (1, [0]), ("b", 4): (1, [1]), ("c", 4): (1, [2]), ("ä1", 5): (1, [0]), ("c", 5): (2, [1, 2])}
    x = search.postings(docs, "id", "t")
    assert got(x) == want and "Exchange" not in x._jdf.queryExecution().executedPlan().toString()
    twice = search.postings(docs.union(spark.createDataFrame([(1, "a b"), (None, "a"), (None, "b a")], docs.schema)), "id", "t")
    assert got(twice) == want | {("a", 1): (2, [0, 1]), ("b", 1): (3, [0, 1, 2]), ("a", None): (2, [0, 1]), ("b", None): (1, [0])}
    assert {(r.term, r.docs, r.occurrences) for r in search.vocabulary(docs, "id", "t").collect()} == {("a", 2, 2), ("b", 2, 3), ("c", 2, 3), ("ä1", 1, 1)}
    monkeypatch.setattr(search, "RUN", 2)
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([["x", "y", "x"], [], ["y"], ["z", "x"], []])], ["key", "terms"])
    assert [tuple(r.values()) for b in search.by_text(iter([batch])) for r in b.to_pylist()] == [("x", 0, 2, [0, 2]), ("y", 0, 1, [1]), ("y", 2, 1, [0]), ("z", 3, 1, [0]), ("x", 3, 1, [1])]
