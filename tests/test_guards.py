"""Inputs that used to be lost, cut or let through without a word."""

import datetime
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelwright import session
from panelwright.operators.challenger import residual_variance
from panelwright.operators.evaluate import promotion
from panelwright.operators.ewma import ewma_forecast
from panelwright.operators.fracdiff import ffd_weights, fracdiff
from panelwright.operators.ingest import append, clean_numeric, duplicate_keys
from panelwright.operators.ranks import nearest_rank
from panelwright.operators.windows import purged_holdout
from panelwright.plans.walk_forward import ridge_latest

DAY = datetime.date(2020, 1, 1)


def series(spark, **lengths):
    rnd = np.random.default_rng(1)
    rows = [(a, DAY + datetime.timedelta(i), float(x)) for a, n in lengths.items() for i, x in enumerate(rnd.normal(size=n).cumsum())]
    return spark.createDataFrame(rows, "asset string, date date, log_price double")


@pytest.mark.parametrize("d,threshold", [(1.0, 1e-5), (0.4, 1e-2), (0.5, 1e-3)])
def test_fracdiff_treats_gaps_and_short_keys_alike_at_every_width(spark, d, threshold):
    terms = len(ffd_weights(d, threshold))
    whole = series(spark, A=terms + 40, B=terms - 1, C=terms)
    holed = whole.withColumn("log_price", F.when((F.col("asset") == "C") & (F.col("date") == F.lit(DAY)), None).otherwise(F.col("log_price")))
    good, report = fracdiff(holed, d, threshold, on_invalid="quarantine")
    assert {r["asset"]: r["count"] for r in good.groupBy("asset").count().collect()} == {"A": 41}
    assert {r["asset"]: r["reason"] for r in report.collect()} == {"B": "fewer rows than the window", "C": "value not finite"}
    with pytest.raises(PySparkException, match="not finite"):
        fracdiff(holed.filter("asset <> 'B'"), d, threshold).collect()
    with pytest.raises(PySparkException, match="the window needs"):
        fracdiff(whole, d, threshold).collect()
    assert fracdiff(whole.filter("asset <> 'B'"), d, threshold).count() == 42


@pytest.mark.parametrize("halflife", [0.01, 0.7, 2.0, 63.0])
def test_ewma_takes_any_halflife_on_long_histories(spark, halflife):
    n = 3000
    rnd = np.random.default_rng(2).normal(0, 0.01, n)
    df = spark.createDataFrame([("A", DAY + datetime.timedelta(i), float(x)) for i, x in enumerate(rnd)], "asset string, date date, log_return double")
    got = {r["n_bars"]: r["mu"] for r in ewma_forecast(df, halflife=halflife).collect()}
    for bars in (60, 1023, 1024, 1025, 1434, 1435, 2049, n):
        weights = np.exp2(-np.arange(bars)[::-1] / halflife)
        assert got[bars] == pytest.approx(21 * (weights @ rnd[:bars]) / weights.sum(), rel=1e-9, abs=1e-12)


def test_young_assets_take_the_pooled_variance(spark):
    held = spark.createDataFrame([("A", i, "holdout", 0.1 * i, 0.0) for i in range(5)], "asset string, pos int, role string, realized_h double, prediction double")
    listed = spark.createDataFrame([("A",), ("NEW",)], "asset string")
    got = {r["asset"]: (r["n_holdout"], r["residual_var"]) for r in residual_variance(held, assets=listed).collect()}
    assert got["NEW"] == (0, got["A"][1]) and got["A"][1] == pytest.approx(np.var(np.arange(5) * 0.1, ddof=1))


def test_young_assets_get_a_ridge_forecast(spark):
    rnd = np.random.default_rng(3)
    rows = [(a, DAY + datetime.timedelta(i), float(rnd.normal(0, 0.01))) for a, first in (("A", 0), ("B", 0), ("NEW", 370)) for i in range(first, 400)]
    out = {r["asset"]: r["sigma"] for r in ridge_latest(spark.createDataFrame(rows, "asset string, date date, log_return double")).collect()}
    assert set(out) == {"A", "B", "NEW"} and all(s > 0 for s in out.values())


def test_a_key_without_training_windows_is_named(spark):
    rows = [("A", i) for i in range(200)] + [("SHORT", i) for i in range(10)]
    windows = spark.createDataFrame(rows, "asset string, pos long")
    with pytest.raises(PySparkException, match="no training windows before the holdout of SHORT"):
        purged_holdout(windows).collect()
    good, report = purged_holdout(windows, on_invalid="quarantine")
    assert {r["asset"] for r in good.collect()} == {"A"} and [r["asset"] for r in report.collect()] == ["SHORT"]


def test_numeric_text_has_no_suffixes(spark):
    texts = ["5d", "12f", "1e5", " 2.5 ", ".5", "-3.", "inf", "nan", ".", "", None, "0x10", "1_000"]
    got = {r["raw"]: (r["value"], r["violation"]) for r in clean_numeric(spark.createDataFrame([(t, t) for t in texts], "raw string, value string"), "value").collect()}
    assert {t for t, (_, bad) in got.items() if bad} == {"5d", "12f", "0x10", "1_000"}
    assert got["1e5"][0] == 1e5 and got[" 2.5 "][0] == 2.5 and got[".5"][0] == 0.5 and got["-3."][0] == -3.0 and math.isinf(got["inf"][0])


def test_append_refuses_repeated_keys(spark):
    stored = spark.createDataFrame([("A", DAY, 1.0)], "asset string, date date, adj_close double")
    fresh = spark.createDataFrame([("A", DAY + datetime.timedelta(1), 2.0)], stored.schema)
    assert append(stored, fresh).count() == 2
    for rows in (stored, fresh.union(fresh)):
        with pytest.raises(PySparkException, match="already stored or occurs twice"):
            append(stored, rows).collect()
    assert [(r["n_stored"], r["n_new"]) for r in duplicate_keys(stored, stored, ["asset", "date"]).collect()] == [(1, 1)]


def test_percentiles_leave_nulls_out(spark):
    df = spark.createDataFrame([("g", None)] * 5 + [("g", float(i)) for i in range(4)] + [("h", None)], "g string, x double")
    assert [(r["g"], r["low"], r["n"]) for r in nearest_rank(df, ["g"], "x", {"low": 0.0}).collect()] == [("g", 0.0, 4)]


def test_an_unknown_baseline_decides_nothing(spark):
    metrics = spark.createDataFrame([("ridge", None, 1.0, 0.9)], "model string, asset string, mse double, coverage double")
    with pytest.raises(PySparkException, match="no pooled metrics of the baseline ewma"):
        promotion(metrics, "ewma").collect()


def test_stored_frames_are_refused_on_a_cluster_without_shared_folder_and_can_be_released(spark, monkeypatch):
    mark = session.stored_mark()
    kept = session.durable(spark.range(3))
    assert kept.count() == 3 and session.release(spark, mark) == 1
    with pytest.raises(PySparkException):
        spark.read.parquet(kept.inputFiles()[0]).count()

    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: {})})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Elsewhere)
