import glob
import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakelens.functions import special
from lakelens.operators import filing as P
from lakelens.operators import inference as I
from lakelens.operators import records as L
from lakelens.operators import search as X
from lakelens.sources import sinks


def test_studentized_range_matches_published_critical_values():
    for q, k, df in ((3.877, 3, 10), (3.578, 3, 20), (4.232, 5, 20), (3.398, 3, 60)):
        assert special.studentized_range_tail(q, k, df) == pytest.approx(0.05, abs=5e-4)
    assert special.studentized_range_tail(0.0, 3, 10) == 1.0


def test_two_groups_of_post_hoc_agree_with_the_t_test(spark):
    d = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 4.0, 3.0)] + [("b", v) for v in (2.0, 5.0, 6.0, 4.5)], "g string, v double")
    assert I.post_hoc(d, "v", "g").first().p == pytest.approx(I.t_test(d, "v", "g", equal_variances=True).first().p, abs=1e-5)
    assert I.post_hoc(d.where("g = 'a'"), "v", "g").count() == 0


def test_route_follows_normality_and_variance(spark):
    r = np.random.default_rng(3)
    rows = [("a", float(v)) for v in r.normal(0, 1, 200)] + [("b", float(v)) for v in r.normal(0, 5, 200)]
    assert I.t_route(spark.createDataFrame(rows, "g string, v double"), "v", "g")[0] == "welch"
    rows = [("a", float(v)) for v in r.exponential(1, 200)] + [("b", float(v)) for v in r.normal(0, 1, 200)]
    assert I.t_route(spark.createDataFrame(rows, "g string, v double"), "v", "g")[0] == "mannwhitney"


def test_bootstrap_is_repeatable_and_near_the_t_interval(spark):
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate(np.random.default_rng(5).normal(10, 2, 2000))], "k long, v double")
    a, b = (I.bootstrap_mean(x, "v", "k").first() for x in (d, d.repartition(7)))
    t = I.mean_interval(d, "v").first()
    assert (a.low, a.high) == pytest.approx((b.low, b.high), abs=1e-9)
    assert (a.low, a.high) == pytest.approx((t.low, t.high), abs=0.02)
    assert np.isnan(I.bootstrap_mean(d.where("false"), "v", "k").first().low)


def test_exports_read_back(spark, tmp_path):
    d = spark.createDataFrame([(1, 'a "q", b', [1, 2]), (2, None, None)], "k int, s string, v array<int>")
    for kind in sinks.FORMATS:
        sinks.export(d, f"{tmp_path}/{kind}", kind, {"source": "test"})
        assert json.loads(spark.read.text(f"{tmp_path}/{kind}_meta").first()[0])["meta"]["kind"] == kind
    back = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv").orderBy("k").collect()
    assert [tuple(r) for r in back] == [("1", 'a "q", b', "[1,2]"), ("2", None, None)]
    assert spark.read.json(f"{tmp_path}/json.gz").where("k = 1").first().v == [1, 2]
    assert "| 1 | a \"q\", b | [1,2] |" in [r[0] for r in spark.read.text(f"{tmp_path}/md").collect()]
    with pytest.raises(ValueError):
        sinks.export(d, f"{tmp_path}/x", "xlsx")


def test_log_folders_by_day(spark, tmp_path):
    d = spark.sql("select timestamp '2024-01-02 03:04:05' as at, 'a' as event union all select timestamp '2024-02-03 00:00:00', 'b'")
    sinks.write_log(d, f"{tmp_path}/log", "at")
    (f,) = glob.glob(f"{tmp_path}/log/year=2024/month=01/day=02/*.json.gz")
    assert json.loads(gzip.open(f).read())["event"] == "a"


def test_placement_order_of_rules(spark):
    names = ["/x/Clean.csv", "/x/clean.txt", "/x/README", "/x/.hidden"]
    d = spark.createDataFrame([(n,) for n in names], "path string")
    got = {r.path: r.destination for r in P.placed(d, "path", P.data_folder("path")).collect()}
    assert got["/x/Clean.csv"] == "Data/Projects/Unnamed_Project/Data/Raw/Clean.csv"
    assert got["/x/clean.txt"] == "Data/Projects/Unnamed_Project/Data/Processed/clean.txt"
    assert got["/x/README"] == "Data/Archive/README" and got["/x/.hidden"] == "Data/Archive/.hidden"
    got = d.select(P.business_folder(F.lit("salary bill.pdf"), 2020).alias("b"), P.business_folder(F.lit("offer.pdf"), 2020, project="p").alias("p")).first()
    assert got.b == "Business/Invoices/Outgoing/Unpaid/2020" and got.p == "Business/Projects/Active/p"


def test_rotation_takes_what_stands_on_old_fulls(spark):
    rows = [(1, None, 1), (2, 1, 2), (3, 2, 3), (4, None, 4), (5, 4, 5), (6, None, 6), (7, None, 7), (8, 99, 8)]
    d = spark.createDataFrame(rows, "archive long, parent long, made long")
    assert sorted(r.archive for r in P.rotation(d, "archive", "parent", "made").collect()) == [1, 2, 3]
    assert P.rotation(d.where("made > 3"), "archive", "parent", "made").count() == 0


def test_tags_prefer_metadata(spark):
    d = spark.sql("select 'Kunde: A, B' as t, map('KUNDE', ' Meta. ', 'Ort', 'x', 'Art', 'yes') as m union all select null, null")
    got = [r.v for r in d.select(L.virtual_tags("t", F.col("m")).alias("v")).collect()]
    assert got == [["art: yes", "kunde: meta"], []]


def test_fuzzy_fallback(spark):
    d = spark.createDataFrame([(1, "the quick fox"), (2, "a slow box"), (3, None)], "k int, t string")
    assert [r.key for r in X.search_or_fuzzy(d, "k", "t", "quick").collect()] == [1]
    assert [r.key for r in X.search_or_fuzzy(d, "k", "t", "quikc").collect()] == [1]  # 2 * 4 / 10 in common
    assert X.search_or_fuzzy(d, "k", "t", "zzzzz").isEmpty()
    with pytest.raises(ValueError):
        X.ranked(d, "k", "t", "fox", order="newest")


def test_date_column_rules(spark):
    d = spark.sql("select 'x' as a, '2024-01-02' as created, '2024-05-06' as b")
    assert L.date_column(d) == "created" and L.date_column(d, "b") == "b"
    assert L.date_column(d.select("a", "b")) == "b" and L.date_column(d.select("a")) is None
    assert L.date_column(d.where("false")) is None


def test_degenerate_groups_give_no_errors(spark):
    one = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 1.0), (None, None)], "g string, v double")
    assert np.isnan(I.t_test(one, "v", "g").first().t) and np.isnan(I.anova(one, "v", "g").first().f) and np.isnan(I.kruskal(one, "v", "g").first().h)
    assert I.mann_whitney(one, "v", "g").first().p == 1.0
    apart = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)], "g string, v double")
    assert np.isinf(I.anova(apart, "v", "g").first().f) and I.anova(apart, "v", "g").first().p == 0.0
    assert np.isnan(I.mean_interval(one.where("false"), "v").first().mean) and np.isnan(I.anova(one.where("false"), "v", "g").first().f)
    pairs = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "x double, y double")
    assert np.isinf(I.paired_t_test(pairs, "x", "y").first().t) and np.isnan(I.spearman(pairs, "x", "y").first().p)
    with pytest.raises(ValueError):
        I.mann_whitney(one.where("g = 'a'"), "v", "g")
