import numpy as np
import pandas as pd
import pytest
from conftest import walk_frame
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelwright.operators.evaluate import promotion
from panelwright.operators.ewma import ewma_forecast
from panelwright.operators.folds import eval_points, folds_from_ranges, leakage_audit, walk_forward_folds
from panelwright.operators.returns import log_returns
from panelwright.plans.walk_forward import evaluation_frame, joint_positions, ridge_walk_forward, walk_forward


def bars(spark, n):
    return spark.createDataFrame([(n,)], "n_panel long")


def test_fold_geometry(spark):
    rows = walk_forward_folds(bars(spark, 100), 3, horizon=5).orderBy("fold").collect()
    assert [(r["train_end"], r["test_start"], r["test_end"]) for r in rows] == [(20, 25, 50), (45, 50, 75), (70, 75, 100)]
    last = walk_forward_folds(bars(spark, 103), 3, horizon=5, embargo=2).orderBy("fold").collect()[-1]
    assert (last["train_end"], last["test_start"], last["test_end"]) == (71, 78, 103)


@pytest.mark.parametrize("n,k,h,e", [(3, 5, 0, 0), (100, 3, 25, 0), (100, 3, 20, 5)])
def test_impossible_geometry_raises(spark, n, k, h, e):
    with pytest.raises(PySparkException, match="do not fit"):
        walk_forward_folds(bars(spark, n), k, h, e).collect()


def test_bad_parameters():
    for bad in ((0, 5, 0), (3, -1, 0), (3, 5, -1)):
        with pytest.raises(ValueError):
            walk_forward_folds(None, *bad)


def test_leakage_audit(spark):
    assert leakage_audit(walk_forward_folds(bars(spark, 200), 4, 21), 21).count() == 0
    leaky = folds_from_ranges(spark, [(0, 30, 50, 60), (0, 45, 50, 70), (0, 0, 80, 90), (0, 20, 95, 95)])
    got = {(r["fold"], r["reason"]) for r in leakage_audit(leaky, 21).collect()}
    assert got == {
        (0, "train horizon reaches test"),
        (1, "train horizon reaches test"),
        (1, "test windows overlap or run backwards"),
        (2, "train is empty"),
        (3, "test is empty"),
    }


def test_eval_positions(spark):
    positions = spark.range(120).select(F.col("id").alias("pos"), F.lit(120).alias("n_panel"), F.col("id").alias("date"))
    got = sorted(r["pos"] for r in eval_points(positions, 1, horizon=21).collect())
    assert got == [60, 81]


@pytest.mark.parametrize(
    "base,other,failed",
    [
        ((2.0, 0.90), (1.0, 0.90), ""),
        ((1.0, 0.90), (1.0, 0.90), "mse not strictly lower"),
        ((2.0, 0.99), (1.0, 0.95), ""),
        ((2.0, 0.60), (1.0, 0.80), "coverage outside band"),
        ((2.0, 0.91), (1.0, 0.93), "coverage distance worse"),
        ((1.0, 0.90), (2.0, 0.70), "mse not strictly lower; coverage outside band; coverage distance worse"),
    ],
)
def test_promotion(spark, base, other, failed):
    rows = [("base", None, base[0], base[1]), ("new", None, other[0], other[1]), ("new", "a", 9.0, 0.1)]
    row = promotion(spark.createDataFrame(rows, "model string, asset string, mse double, coverage double"), "base").first()
    assert row["failed"] == failed
    assert row["decision"] == ("challenger promoted" if not failed else "baseline remains")


def _manual(prices, halflife, n_splits=4, h=21):
    """The same evaluation, one point at a time."""
    rets = {a: np.log(g.set_index("date")["adj_close"]).diff().dropna() for a, g in prices.groupby("asset")}
    panel = pd.concat(rets, axis=1, join="inner").sort_index()
    n, rows = len(panel), []
    size = n // (n_splits + 1)
    for fold in range(n_splits):
        start = n - n_splits * size + fold * size
        end = n if fold == n_splits - 1 else start + size
        for t in range(start, end, h):
            if t + h > n - 1:
                continue
            for a, r in rets.items():
                x = r[r.index <= panel.index[t]].reset_index(drop=True)
                mu = x.ewm(halflife=halflife).mean() * h
                e = (mu - x.rolling(h).sum().shift(-h)).iloc[21 : len(x) - h]
                rows.append((a, panel.index[t], mu.iloc[-1], e.std(ddof=1), panel[a].iloc[t + 1 : t + h + 1].sum()))
    return pd.DataFrame(rows, columns=["asset", "date", "mu", "sigma", "y"]).sort_values(["asset", "date"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def uneven(spark):
    """One asset with 63 extra leading bars: forecasts must use them, targets must not."""
    pdf = walk_frame(days=500, seed=11, start="2020-01-01")
    cut = sorted(set(pdf["date"]))[63]
    pdf = pdf[(pdf["asset"] == "SPY") | (pdf["date"] >= cut)]
    return pdf, spark.createDataFrame(pdf, "asset string, date date, adj_close double")


def test_evaluation_points_use_own_history(uneven):
    pdf, prices = uneven
    returns = log_returns(prices)
    got = evaluation_frame(returns, {"m": ewma_forecast(returns)}, joint_positions(returns), 4).toPandas()
    got = got.sort_values(["asset", "date"]).reset_index(drop=True)
    want = _manual(pdf, 63)
    assert list(got["date"]) == list(want["date"])
    for mine, theirs in (("mu", "mu"), ("sigma", "sigma"), ("realized_h", "y")):
        assert np.allclose(got[mine], want[theirs], rtol=1e-9, atol=1e-12)


def test_metrics(uneven):
    pdf, prices = uneven
    out = walk_forward(prices, {"ewma63": 63.0, "ewma21": 21.0}, "ewma63")
    want = _manual(pdf, 63)
    rows = {r["asset"]: r for r in out["metrics"].filter("model = 'ewma63'").collect()}
    for asset, part in [*want.groupby("asset"), (None, want)]:
        assert rows[asset]["n_points"] == len(part)
        assert rows[asset]["mse"] == pytest.approx(((part["mu"] - part["y"]) ** 2).mean(), rel=1e-9)
        assert rows[asset]["coverage"] == pytest.approx(((part["y"] - part["mu"]).abs() <= 1.64 * part["sigma"]).mean())
        assert rows[asset]["ic"] == pytest.approx(part["mu"].rank().corr(part["y"].rank()), rel=1e-9)
    assert out["decision"].count() == 1 and out["report"].count() == 4 and out["folds"].count() == 4


def test_changing_the_future_changes_no_earlier_forecast(spark, uneven):
    pdf, prices = uneven
    days = sorted(set(pdf["date"]))
    later = pdf["date"] > days[-30]
    poisoned = pdf.assign(adj_close=pdf["adj_close"].where(~later, pdf["adj_close"] * 3))
    other = spark.createDataFrame(poisoned, "asset string, date date, adj_close double")
    early = F.col("date") <= F.lit(days[-30])
    a = ewma_forecast(log_returns(prices)).filter(early).toPandas().sort_values(["asset", "date"]).reset_index(drop=True)
    b = ewma_forecast(log_returns(other)).filter(early).toPandas().sort_values(["asset", "date"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)
    r1, r2 = log_returns(prices), log_returns(other)
    points = joint_positions(r1)
    f1 = ridge_walk_forward(r1, points).filter(early).toPandas().sort_values(["asset", "date"]).reset_index(drop=True)
    f2 = ridge_walk_forward(r2, points).filter(early).toPandas().sort_values(["asset", "date"]).reset_index(drop=True)
    assert len(f1) > 20
    pd.testing.assert_frame_equal(f1, f2)


def test_ranks_follow_groups_with_ranges_of_their_own(spark):
    from panelwright.operators.ranks import nearest_rank, spearman

    # A thousand groups of disjoint ranges, and one that holds a third of all rows.
    small = spark.range(20_000).select((F.col("id") % 1000).alias("g"), ((F.col("id") % 1000) * 1000 + F.pmod(F.hash("id"), F.lit(50))).cast("double").alias("x"))
    both = small.unionByName(spark.range(10_000).select(F.lit(-1).cast("long").alias("g"), F.pmod(F.hash("id"), F.lit(3000)).cast("double").alias("x")))
    both = both.withColumn("y", F.pmod(F.hash("x", "g"), F.lit(7)).cast("double"))
    plain = both.toPandas()
    got = nearest_rank(both, ["g"], "x", {"p50": 0.5, "p95": 0.95}).toPandas().set_index("g")
    for g, own in plain.groupby("g"):
        values = sorted(own["x"])
        assert (got.p50[g], got.p95[g], got.n[g]) == (values[min(len(values) - 1, int(0.5 * len(values)))], values[min(len(values) - 1, int(0.95 * len(values)))], len(values))
    some = both.filter("g IN (-1, 5, 77)")
    ic = {r.g: r.ic for r in spearman(some, ["g"], "x", "y", "ic").collect()}
    for g, own in plain[plain["g"].isin([-1, 5, 77])].groupby("g"):
        assert ic[g] == pytest.approx(own["x"].rank().corr(own["y"].rank()), abs=1e-12)


def test_windows_from_a_moment_tree_equal_a_scan(spark):
    import datetime as dt

    from panelwright.operators.moment_tree import LEVELS, window_moments, window_nodes

    day = dt.date(2019, 12, 25)
    rows = [(a, day + dt.timedelta(days=k), 1e6 + (k * 7919 % 101) / 100 if k % 9 else None) for a in "AB" for k in range(0, 400, 1 if a == "A" else 3)]
    returns = spark.createDataFrame(rows, "asset string, date date, log_return double")
    bounds = [(None, None), (0, 0), (5, 4), (3, 3), (-50, 10), (390, 900), (500, 600), (None, 77), (100, None), *[(k, k + 2**j + k % 3) for k in range(0, 40, 7) for j in range(8)]]
    at = lambda k: None if k is None else day + dt.timedelta(days=k)
    windows = spark.createDataFrame([(i, at(a), at(b)) for i, (a, b) in enumerate(bounds)], "scenario_id long, window_start date, window_end date")
    got = {(r.scenario_id, r.asset): (r.n, r["mean"], r.square) for r in window_moments(returns, windows).collect()}
    want = {}
    for i, (a, b) in enumerate(bounds):
        for asset in "AB":
            x = np.array([v for s, d, v in rows if s == asset and v is not None and (a is None or d >= at(a)) and (b is None or d <= at(b))])
            if len(x):
                want[i, asset] = (len(x), x.mean(), ((x - x.mean()) ** 2).sum())
    assert set(got) == set(want)
    assert all(got[k][0] == want[k][0] and np.allclose(got[k][1:], want[k][1:], rtol=1e-9, atol=1e-6) for k in want)
    nodes = window_nodes(windows, F.lit(1 << 20), F.lit((1 << 20) + 30_000)).groupBy("scenario_id").count().agg(F.max("count")).first()[0]
    assert nodes <= 2 * LEVELS
    assert window_moments(returns.limit(0), windows).count() == 0 and window_moments(returns, windows.limit(0)).count() == 0
