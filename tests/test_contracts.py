import datetime as dt

import pytest
from conftest import walk_frame
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelwright.operators.ewma import ewma_forecast
from panelwright.operators.returns import log_returns, realized_vol

DAY = dt.date(2024, 1, 1)


def prices(spark, rows):
    return spark.createDataFrame([(k, DAY + dt.timedelta(days=i), p) for k, i, p in rows], "asset string, date date, adj_close double")


@pytest.mark.parametrize("bad", [None, float("nan"), 0.0, -1.0, float("inf")])
def test_bad_price_raises(spark, bad):
    df = prices(spark, [("a", 0, 1.0), ("a", 1, bad), ("a", 2, 2.0), ("a", 3, 2.5)])
    with pytest.raises(PySparkException, match="must be finite and positive"):
        log_returns(df).collect()


def test_single_price_raises(spark):
    with pytest.raises(PySparkException, match="at least 2 prices for b"):
        log_returns(prices(spark, [("a", 0, 1.0), ("a", 1, 1.0), ("b", 0, 1.0)])).collect()


def test_duplicate_date_raises(spark):
    with pytest.raises(PySparkException, match="duplicate date"):
        log_returns(prices(spark, [("a", 0, 1.0), ("a", 1, 1.0), ("a", 1, 2.0)])).collect()


def test_quarantine_keeps_good_keys(spark):
    rows = [("a", i, 1.0 + i) for i in range(5)] + [("b", i, -1.0 if i > 1 else 1.0) for i in range(9)] + [("c", 0, 1.0)]
    good, report = log_returns(prices(spark, rows), on_invalid="quarantine")
    assert {r["asset"] for r in good.collect()} == {"a"}
    got = {r["asset"]: (r["n_bad"], list(r["first_keys"])) for r in report.collect()}
    assert got["b"] == (7, [str(DAY + dt.timedelta(days=i)) for i in range(2, 7)])
    assert got["c"][0] == 1


def test_constant_window_is_exactly_zero(spark):
    df = prices(spark, [("a", i, 7.0) for i in range(40)])
    assert {r["realized_vol"] for r in realized_vol(log_returns(df)).collect()} == {0.0}


def test_window_bounds(spark, walk):
    with pytest.raises(ValueError):
        realized_vol(log_returns(walk), window=1)
    with pytest.raises(ValueError):
        ewma_forecast(log_returns(walk), halflife=0.0)


@pytest.mark.parametrize("block", ["auto", 20])
def test_short_and_constant_history(spark, block):
    short = spark.createDataFrame(walk_frame(days=52), "asset string, date date, adj_close double")
    with pytest.raises(PySparkException, match="51 bars, need 52"):
        ewma_forecast(log_returns(short), rows_per_block=block).collect()
    flat = prices(spark, [("a", i, 2.0) for i in range(80)])
    with pytest.raises(PySparkException, match="constant"):
        ewma_forecast(log_returns(flat), rows_per_block=block).collect()


def test_forecast_quarantine(spark, walk):
    mixed = walk.unionByName(prices(spark, [("flat", i, 2.0) for i in range(80)])).unionByName(prices(spark, [("new", i, 1.0 + i) for i in range(9)]))
    good, report = ewma_forecast(log_returns(mixed), on_invalid="quarantine")
    assert {r["asset"] for r in good.select("asset").distinct().collect()} == {"SPY", "ACWI", "AGG"}
    assert {r["asset"]: r["reason"] for r in report.collect()} == {"flat": "constant returns", "new": "history too short"}


def test_exactly_enough_history(spark):
    df = spark.createDataFrame(walk_frame(days=53), "asset string, date date, adj_close double")
    assert ewma_forecast(log_returns(df)).filter(F.col("n_bars") == 52).count() == 3


def test_the_normal_quantile_is_exact_to_double_precision(spark):
    from statistics import NormalDist

    from panelwright.functions.scalars import two_sided_z

    chances = [0.0, 1e-9, 0.02, 0.5, 0.8499, 0.85, 0.8501, 0.93, 0.95, 0.999]
    got = [r.z for r in spark.createDataFrame([(c,) for c in chances], "c double").select("c", two_sided_z(F.col("c")).alias("z")).orderBy("c").collect()]
    assert all(abs(z - NormalDist().inv_cdf((1 + c) / 2)) <= 1e-14 * max(1.0, z) for c, z in zip(chances, got, strict=True))
    assert spark.range(1).select(two_sided_z(F.lit(None).cast("double")).alias("z")).first().z is None


def test_folds_of_several_panels_are_audited_apart(spark):
    from panelwright.operators.folds import leakage_audit

    rows = [("a", 0, 0, 20, 60, 80), ("a", 1, 0, 40, 80, 99), ("b", 0, 0, 10, 40, 50), ("b", 1, 0, 15, 45, 70)]
    folds = spark.createDataFrame(rows, "panel string, fold long, train_start long, train_end long, test_start long, test_end long")
    assert [tuple(r) for r in leakage_audit(folds, 21, ["panel"]).collect()] == [("b", 1, "test windows overlap or run backwards")]
