"""Quantiles and ranks by running counts against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakelens.operators import aggregates, inference, timeseries
from lakelens.operators.quantiles import average_ranks, median, quantiles

ROWS = [(g, rng.choice([None, float(rng.randrange(12)), rng.gauss(0, 5), -0.5])) for rng in [random.Random(4)] for g in rng.choices(["a", "b", None, "c"], [8, 3, 2, 1], k=400)] + [("lone", 2.5), ("none", None)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in ROWS], "g string, v double, n int, before int, of string").repartition(3)


@pytest.mark.parametrize("parts", ["1", "7"])
def test_quantiles_of_groups(spark, table, parts):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.g: (r.lo, r.med, r.hi) for r in quantiles(table, "v", {"lo": 0.1, "med": 0.5, "hi": 1.0}, ["g"]).collect()}
        all_ = quantiles(table, "v", {"q": 0.37}).first().q
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for g in {g for g, v in ROWS if v is not None}:
        assert got.pop(g) == pytest.approx(tuple(np.quantile([v for k, v in ROWS if k == g and v is not None], [0.1, 0.5, 1.0])))
    assert not got and all_ == pytest.approx(np.quantile([v for _, v in ROWS if v is not None], 0.37))


def test_nothing_to_take(spark, table):
    assert median(table.where("v is null"), "v").isEmpty() and median(table.where("false"), "v", ["g"]).isEmpty()
    got = aggregates.numeric_summary(table.where("v is null").select("v")).first()
    assert (got["count"], got.median, got.iqr) == (0, None, None)


def test_ranks_with_ties_and_weights(spark):
    x = spark.createDataFrame([(1.0, 2), (3.0, 1), (1.0, 1), (2.0, 4), (None, 9)], "v double, w int")
    assert sorted((r.value, r.ties, r["rank"]) for r in average_ranks(x, "v", "w").collect()) == [(1.0, 3, 2.0), (2.0, 4, 5.5), (3.0, 1, 8.0)]
    assert sorted((r.value, r["rank"]) for r in average_ranks(x, "v").collect()) == [(1.0, 1.5), (2.0, 3.0), (3.0, 4.0)]


def test_medians_by_name_keep_groups_without_values(table):
    got = {r.g: (r.v_median, r.v_count) for r in aggregates.group_aggregate(table, ["g"], ["v"], ["median", "count"]).collect()}
    assert got["none"] == (None, 0) and got["lone"] == (2.5, 1) and None not in got


def test_spearman_of_constant_and_few_rows(spark):
    x = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "x double, y double")
    assert np.isnan(inference.spearman(x, "x", "y").first().r) and np.isnan(inference.spearman(x.limit(2), "x", "y").first().r)
    y = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (2.0, 2.0), (3.0, 9.0)] * 2, "x double, y double")
    assert inference.spearman(y, "x", "y").first().r == pytest.approx(0.9486832980505138)


def test_frequency_of_one_time(spark):
    x = spark.createDataFrame([("2024-01-01",)], "t string")
    assert timeseries.infer_frequency(x, "t").first().frequency is None
    assert timeseries.infer_frequency(x.withColumn("t", F.explode(F.expr("sequence(date'2024-01-01', date'2024-01-09')"))), "t").first().frequency == "H"  # a gap of a day is within 36 hours
