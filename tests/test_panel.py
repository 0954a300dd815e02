import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from conftest import frame
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelwright.operators.asof import asof_join, available_date
from panelwright.operators.covariance import empirical_cov, ledoit_wolf, pair_moments, psd_check, shrinkage_stats
from panelwright.operators.panel import common_date_panel, feature_matrix, split_matrix
from panelwright.operators.ranks import average_ranks, nearest_rank, spearman
from panelwright.operators.returns import log_returns

D = dt.date
MACRO = "series_id string, obs_date date, value double, available_date date"


def test_nothing_is_seen_before_its_release(spark):
    t = D(2024, 3, 13)
    macro = spark.createDataFrame(
        [("DGS10", t - dt.timedelta(days=3), 1.0, t), ("DGS10", t, 99.0, t + dt.timedelta(days=1))], MACRO
    )
    days = spark.createDataFrame([(t + dt.timedelta(days=i),) for i in (-1, 0, 1)], "date date")
    got = {r["date"]: r["value"] for r in asof_join(days, macro).collect()}
    assert got == {t - dt.timedelta(days=1): None, t: 1.0, t + dt.timedelta(days=1): 99.0}


def test_null_match_stays_null_and_ties_take_the_newest(spark):
    rows = [("s", D(2024, 1, 1), 5.0, D(2024, 1, 8)), ("s", D(2024, 1, 3), None, D(2024, 1, 8)), ("s", D(2024, 1, 2), 6.0, D(2024, 1, 8))]
    days = spark.createDataFrame([(D(2024, 1, 8),), (D(2026, 9, 1),)], "date date")
    assert [r["value"] for r in asof_join(days, spark.createDataFrame(rows, MACRO)).collect()] == [None, None]


@pytest.mark.parametrize("width", [None, 7])
def test_asof_matches_merge_asof_across_buckets(spark, width):
    rng = np.random.default_rng(0)
    obs = pd.bdate_range("2020-01-01", periods=400)[rng.random(400) < 0.4]
    macro = pd.DataFrame({"series_id": "s", "obs_date": obs.date, "value": rng.normal(size=len(obs)), "available_date": (obs + pd.Timedelta(days=3)).date})
    days = pd.date_range("2019-12-20", periods=700)
    want = pd.merge_asof(pd.DataFrame({"d": days}), macro.assign(a=pd.to_datetime(macro["available_date"])), left_on="d", right_on="a")["value"]
    got = asof_join(spark.createDataFrame(pd.DataFrame({"date": days.date}), "date date"), spark.createDataFrame(macro, MACRO), width=width)
    assert np.allclose(frame(got, "date")["value"], want, equal_nan=True)


def test_release_lags(spark):
    days = [D(2024, 1, 5), D(2024, 1, 6), D(2024, 1, 7), D(2024, 1, 8), D(2024, 1, 10)]
    rows = [(s, d, 1.0) for s in ("one", "three") for d in days]
    out = available_date(spark.createDataFrame(rows, "series_id string, obs_date date, value double"), {"one": 1, "three": 3})
    for r in out.collect():
        want = pd.Timestamp(r["obs_date"]) + pd.offsets.BDay({"one": 1, "three": 3}[r["series_id"]])
        assert pd.Timestamp(r["available_date"]) == want
    with pytest.raises(PySparkException, match="unknown series zero"):
        available_date(spark.createDataFrame([("zero", days[0], 1.0)], "series_id string, obs_date date, value double"), {"one": 1}).collect()


def test_returns_are_not_rechained_over_gaps(spark):
    rows = [("a", D(2024, 1, i), float(i)) for i in (1, 2, 3, 4)] + [("b", D(2024, 1, i), float(i)) for i in (1, 2, 4)]
    panel = common_date_panel(log_returns(spark.createDataFrame(rows, "asset string, date date, adj_close double")))
    got = {(r["asset"], r["date"].day): r["log_return"] for r in panel.collect()}
    assert set(got) == {("a", 2), ("b", 2), ("a", 4), ("b", 4)}
    assert got[("a", 4)] == pytest.approx(math.log(4 / 3))


def test_matrix_round_trip(spark, long_walk):
    obs = pd.bdate_range("2020-01-01", periods=90)
    macro = spark.createDataFrame(
        pd.DataFrame({"series_id": "m", "obs_date": obs.date, "value": np.arange(90.0), "available_date": (obs + pd.offsets.BDay(1)).date}), MACRO
    )
    assets = ["ACWI", "AGG", "SPY"]
    matrix = feature_matrix(long_walk, assets, macro, ["m"], d_by_asset={a: 0.5 for a in assets}, threshold=1e-2)
    assert matrix.columns[1:4] == ["ACWI_log_return", "ACWI_realized_vol", "ACWI_fracdiff"]
    assert feature_matrix(long_walk, assets, None).columns[-1] == "SPY_realized_vol"
    back = split_matrix(matrix, assets, ["log_return", "realized_vol", "fracdiff"])
    assert back.count() == 3 * matrix.count()
    assert back.columns == ["asset", "date", "log_return", "realized_vol", "fracdiff", "m"]


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 7)) @ rng.normal(size=(7, 7)) * 0.01
    days = pd.bdate_range("2020-01-01", periods=300).date
    long = pd.DataFrame([(f"a{j}", days[i], x[i, j]) for i in range(300) for j in range(7)], columns=["asset", "date", "log_return"])
    return x, spark.createDataFrame(long, "asset string, date date, log_return double")


@pytest.mark.parametrize("tiles,dates", [(512, 256), (2, 50)])
def test_shrunk_covariance_matches_the_definition(wide, tiles, dates):
    x, panel = wide
    moments = pair_moments(panel, tile_assets=tiles, tile_dates=dates)
    c = x - x.mean(axis=0)
    n, p = c.shape
    s = c.T @ c / n
    got = frame(empirical_cov(moments), "asset_i", "asset_j")["cov"].to_numpy().reshape(p, p)
    assert np.allclose(got, s, rtol=1e-10)
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = sum(((np.outer(r, r) - s) ** 2).sum() for r in c) / (n * n * p)
    shrink = min(beta, delta) / delta
    assert shrinkage_stats(moments).first()["shrinkage"] == pytest.approx(shrink, rel=1e-9)
    want = 252 * ((1 - shrink) * s + shrink * mu * np.eye(p))
    cov = ledoit_wolf(moments)
    assert np.allclose(frame(cov, "asset_i", "asset_j")["cov"].to_numpy().reshape(p, p), want, rtol=1e-9)
    check = psd_check(cov.withColumn("g", F.lit(1)), ["g"]).first()
    assert check["is_psd"] and check["min_eigenvalue"] == pytest.approx(np.linalg.eigvalsh(want).min(), rel=1e-6)


def test_covariance_needs_sixty_rows(wide):
    _, panel = wide
    with pytest.raises(PySparkException, match="needs 60 common rows, got 59"):
        ledoit_wolf(pair_moments(panel.filter(F.col("date") < sorted({r["date"] for r in panel.select("date").distinct().collect()})[59]))).collect()


def test_ranks_with_ties_and_a_hot_group(spark):
    rng = np.random.default_rng(5)
    hot = pd.DataFrame({"g": "hot", "x": rng.integers(0, 50, 4000) / 7.0, "y": rng.normal(size=4000)})
    cold = pd.DataFrame({"g": "cold", "x": [1.0, 2.0, 2.0, 9.0], "y": [3.0, 1.0, 2.0, 0.0]})
    same = pd.DataFrame({"g": "same", "x": [1.0, 1.0], "y": [3.0, 1.0]})
    data = pd.concat([hot, cold, same])
    df = spark.createDataFrame(data)
    want = data.groupby("g")["x"].rank()
    got = average_ranks(df, ["g"], "x", "r").toPandas().set_index(["g", "x"])["r"]
    assert np.allclose([got[(g, x)] for g, x in zip(data["g"], data["x"])], want)
    ic = {r["g"]: r["ic"] for r in spearman(df, ["g"], "x", "y", "ic").collect()}
    assert ic["same"] is None
    for g in ("hot", "cold"):
        part = data[data["g"] == g]
        assert ic[g] == pytest.approx(part["x"].rank().corr(part["y"].rank()), rel=1e-10)
    p = {r["g"]: (r["p50"], r["p95"]) for r in nearest_rank(df, ["g"], "x", {"p50": 0.5, "p95": 0.95}).collect()}
    ordered = np.sort(hot["x"])
    assert p["hot"] == (ordered[2000], ordered[3800]) and p["cold"] == (2.0, 9.0)
