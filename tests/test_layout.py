"""The blocked layout must give what whole-key windows give, also when one key holds most rows."""

import numpy as np
import pandas as pd
import pytest
from conftest import frame
from pyspark.sql import functions as F

from panelwright.operators.ewma import ewma_forecast
from panelwright.operators.fracdiff import fracdiff
from panelwright.operators.layout import index_rows
from panelwright.operators.returns import bar_positions, forward_return, log_returns, realized_vol, return_features
from panelwright.operators.windows import context_windows


def same(a, b):
    a, b = frame(a, "asset", "date"), frame(b, "asset", "date")
    pd.testing.assert_frame_equal(a, b[a.columns], rtol=1e-10, atol=1e-13)


@pytest.mark.parametrize("fn", [log_returns, return_features])
@pytest.mark.parametrize("block", [23, 100])
def test_price_operators(long_walk, fn, block):
    same(fn(long_walk), fn(long_walk, rows_per_block=block))


@pytest.mark.parametrize("fn", [realized_vol, forward_return, ewma_forecast, context_windows, bar_positions])
@pytest.mark.parametrize("block", [37, 128])
def test_return_operators(long_walk, fn, block):
    returns = log_returns(long_walk)
    same(fn(returns), fn(returns, rows_per_block=block))


def test_short_halflife_needs_no_care_in_blocks(long_walk):
    returns = log_returns(long_walk)
    same(ewma_forecast(returns, halflife=2.0), ewma_forecast(returns, halflife=2.0, rows_per_block=64))


@pytest.mark.parametrize("d", [1.0, 0.6, 0.3])
def test_fracdiff(long_walk, d):
    logs = long_walk.select("asset", "date", F.log("adj_close").alias("log_price"))
    same(fracdiff(logs, d, 1e-3), fracdiff(logs, d, 1e-3, rows_per_block=50))


@pytest.mark.parametrize("rows", [10**6, 200])
def test_positions_of_a_hot_key(spark, rows):
    stamps = pd.date_range("2024-01-01", periods=3000, freq="7min")
    hot = pd.DataFrame({"asset": "hot", "ts": stamps})
    cold = pd.DataFrame({"asset": [f"k{i % 9}" for i in range(300)], "ts": stamps[:300]})
    df = spark.createDataFrame(pd.concat([hot, cold]).sample(frac=1, random_state=1))
    got = index_rows(df, ["asset"], "ts", rows_per_bucket=rows).toPandas().sort_values(["asset", "ts"])
    want = got.groupby("asset").cumcount()
    assert np.array_equal(got["_pos"], want)
    assert got.groupby("asset")["_n"].first()["hot"] == 3000
    whole = index_rows(df.filter("asset = 'hot'").select("ts"), [], "ts", rows_per_bucket=rows).toPandas().sort_values("ts")
    assert np.array_equal(whole["_pos"], np.arange(3000))


def test_ewma_against_pandas(long_walk):
    returns = log_returns(long_walk)
    got = frame(ewma_forecast(returns), "asset", "date")
    raw = frame(returns, "asset", "date")
    for asset, r in raw.groupby("asset"):
        x = r["log_return"].reset_index(drop=True)
        mu = x.ewm(halflife=63, adjust=True).mean() * 21
        err = (mu - x.rolling(21).sum().shift(-21)).where(lambda e: e.index >= 21)
        mine = got[got["asset"] == asset].reset_index(drop=True)
        assert np.allclose(mine["mu"], mu[51:], rtol=1e-12)
        want = [err[: t - 20].std(ddof=1) for t in range(51, len(x))]
        assert np.allclose(mine["sigma"], want, rtol=1e-10)


def test_positions_in_a_burst_and_at_one_instant(spark):
    from panelwright.operators.layout import index_rows
    from panelwright.operators.ranged import dealt

    # One key with most rows; 99 % of them in one hour and a third at one instant.
    minute = F.when(F.col("id") % 100 == 0, F.col("id") * 1000).when(F.col("id") % 3 == 0, F.lit(5_000_000)).otherwise(5_000_000 + F.pmod(F.hash("id"), F.lit(3600)))
    big = spark.range(30_000).select(F.lit("hot").alias("key"), F.timestamp_seconds(minute).alias("at"), F.col("id").alias("n"))
    rows = big.unionByName(spark.range(3_000).select(F.concat(F.lit("k"), F.col("id") % 40).alias("key"), F.timestamp_seconds("id").alias("at"), F.col("id").alias("n")))
    got = index_rows(rows, ["key"], "at", rows_per_bucket=5_000).toPandas()
    assert len(got) == 33_000
    for key, own in got.groupby("key"):
        own = own.sort_values("_pos")
        assert own["_pos"].tolist() == list(range(len(own))) and own["at"].is_monotonic_increasing and set(own["_n"]) == {len(own)}
    whole = index_rows(big, [], "at", rows_per_bucket=1_000).toPandas().sort_values("_pos")
    assert whole["_pos"].tolist() == list(range(30_000)) and whole["at"].is_monotonic_increasing
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        laid = dealt(big.withColumn("_tie", F.xxhash64("key", "at", "n")), ["key"], ["at", "_tie"])
        sizes = [r["count"] for r in laid.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 2 * 30_000 / 4
