import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from conftest import by_asset
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelwright.functions.quadratic import solve, tidy
from panelwright.functions.scalars import confidence, horizon_sigma
from panelwright.operators.allocate import allocate, box_feasibility, expand_previous, turnover
from panelwright.operators.blend import equilibrium_prior, posterior, posterior_report, view_terms
from panelwright.operators.views import check_forecasts, counterfactual_views, historical_views, parse_windows

SIGMA = np.array([[0.0289, 0.0258, 0.0009], [0.0258, 0.0256, 0.0010], [0.0009, 0.0010, 0.0025]])
NAMES = ["SPY", "ACWI", "AGG"]
W = {"SPY": 0.3, "ACWI": 0.3, "AGG": 0.4}


def cov_frame(spark, sigma=SIGMA, names=NAMES, groups=(1,)):
    rows = [(g, a, b, float(sigma[i, j])) for g in groups for i, a in enumerate(names) for j, b in enumerate(names)]
    return spark.createDataFrame(rows, "g long, asset_i string, asset_j string, cov double")


def weights(spark, w=W):
    return spark.createDataFrame(list(w.items()), "asset string, weight double")


def test_confidence_map(spark):
    rows = [(0.0, 1.0), (1.0, 1.0), (-1.0, 1.0), (25.0, 0.1), (1e-9, 5.0), (0.5, 0.7)]
    got = [r[0] for r in spark.createDataFrame(rows, "mu double, sigma double").select(confidence(F.col("mu"), F.col("sigma"))).collect()]
    want = [min(max(math.erf(abs(m / s) / math.sqrt(2)), 0.02), 0.95) for m, s in rows]
    assert got == pytest.approx(want, abs=1e-15)


def test_inverse_map_round_trips(spark):
    rows = [(0.01, c) for c in (0.0, 0.02, 0.4, 0.5, 0.95, 1.0)] + [(0.0, 0.5)]
    df = spark.createDataFrame(rows, "mu double, c double").withColumn("sigma", horizon_sigma(F.col("mu"), F.col("c")))
    got = [(r["sigma"], r["k"]) for r in df.withColumn("k", confidence(F.col("mu"), F.col("sigma"))).collect()]
    assert [k for _, k in got[:6]] == pytest.approx([0.02, 0.02, 0.4, 0.5, 0.95, 0.95], abs=1e-12)
    assert got[6][0] == 1e-8


def views(spark, rows):
    return spark.createDataFrame(rows, "g long, asset string, mu double, sigma double")


def test_posterior_matches_the_closed_form_and_ignores_missing_views(spark):
    cov = cov_frame(spark, groups=(1, 2, 3))
    prior = equilibrium_prior(cov, weights(spark), by=["g"])
    rows = [(1, a, m, 0.03) for a, m in zip(NAMES, (0.01, -0.02, 0.004))] + [(2, "AGG", 0.01, 0.02)]
    terms = view_terms(views(spark, rows), cov, ["g"])
    post = posterior(cov, prior, terms, ["g"])
    report = posterior_report(post, prior, terms, ["g"]).toPandas()
    pi = 2.5 * SIGMA @ np.array([W[n] for n in NAMES])
    for g in (1, 2, 3):
        mine = report[report["g"] == g].set_index("asset").loc[NAMES]
        seen = [i for i, n in enumerate(NAMES) if any(r[0] == g and r[1] == n for r in rows)]
        p = np.eye(3)[seen]
        if seen:
            q = np.array([12 * r[2] for r in rows if r[0] == g])
            c = np.array([math.erf(abs(r[2] / r[3]) / math.sqrt(2)) for r in rows if r[0] == g])
            omega = np.diag(0.05 * (1 - c) / c * np.diag(SIGMA)[seen])
            inner = np.linalg.inv(np.linalg.inv(0.05 * SIGMA) + p.T @ np.linalg.inv(omega) @ p)
            mu = inner @ (np.linalg.inv(0.05 * SIGMA) @ pi + p.T @ np.linalg.inv(omega) @ q)
        else:
            inner, mu = 0.05 * SIGMA, pi
        assert np.allclose(mine["posterior_mu"], mu, rtol=1e-9)
        assert np.allclose(mine["posterior_sigma"], np.sqrt(np.diag(SIGMA + inner)), rtol=1e-10)
        assert mine["view_mu"].notna().sum() == len(seen)
        assert np.allclose(mine["tilt"], mu - pi, atol=1e-12)


def test_tilt_is_proportional_to_confidence(spark):
    cov = cov_frame(spark)
    prior = equilibrium_prior(cov, weights(spark), by=["g"])
    tilts = {}
    for c in (0.25, 0.5, 0.95):
        z = NormalDist().inv_cdf((1 + c) / 2)
        terms = view_terms(views(spark, [(1, "SPY", 0.01, 0.01 / z)]), cov, ["g"])
        tilts[c] = np.array(list(dict(sorted(by_asset(posterior_report(posterior(cov, prior, terms, ["g"]), prior, terms, ["g"]), "tilt").items())).values()))
    assert np.allclose(tilts[0.25] / 0.25, tilts[0.5] / 0.5, rtol=1e-8)
    assert np.allclose(tilts[0.25] / 0.25, tilts[0.95] / 0.95, rtol=1e-8)


def test_benchmark_must_cover_and_sum(spark):
    cov = cov_frame(spark).drop("g")
    for bad in ({"SPY": 0.3, "ACWI": 0.3, "AGG": 0.3}, {"SPY": 0.5, "ACWI": 0.5}):
        with pytest.raises(PySparkException, match="benchmark weights"):
            equilibrium_prior(cov, weights(spark, bad)).collect()
    with pytest.raises(ValueError):
        equilibrium_prior(cov, weights(spark), rf=0.02)


def kkt_gap(w, mu, sigma, prev, delta, cost, low, high):
    """Best first-order gain from moving weight between two assets; zero at the optimum."""
    grad = mu - delta * sigma @ w
    up = grad - (cost * np.where(w >= prev - 1e-9, 1, -1) if prev is not None else 0)
    down = grad - (cost * np.where(w > prev + 1e-9, 1, -1) if prev is not None else 0)
    up, down = np.where(w < high - 1e-7, up, -np.inf), np.where(w > low + 1e-7, down, np.inf)
    return up.max() - down.min()


@pytest.mark.parametrize("n", [3, 8, 40])
@pytest.mark.parametrize("with_prev", [False, True])
def test_solver_is_optimal(n, with_prev):
    rng = np.random.default_rng(n)
    for _ in range(10):
        f = rng.normal(size=(n, n + 3)) * 0.1
        sigma, mu = f @ f.T / n + 1e-4 * np.eye(n), rng.normal(size=n) * 0.05
        prev = rng.dirichlet(np.ones(n)) if with_prev else None
        high = max(0.6, 1.5 / n)
        w = solve(mu, sigma, prev, 2.5, 0.002 if with_prev else 0.0, 0.0, high)
        assert w is not None and abs(w.sum() - 1) < 1e-10 and w.min() > -1e-9 and w.max() < high + 1e-9
        assert kkt_gap(w, mu, sigma, prev, 2.5, 0.002, 0.0, high) < 1e-6


def test_nearly_singular_and_corner_cases():
    s = np.array([0.17, 0.16, 0.05])
    corr = np.array([[1, 0.999999, 0.1], [0.999999, 1, 0.1], [0.1, 0.1, 1]])
    w = tidy(solve(np.array([0.05, 0.05, 0.01]), np.outer(s, s) * corr, np.array([0.3, 0.3, 0.4]), 2.5, 0.002, 0.0, 0.6))
    assert abs(w.sum() - 1) < 1e-12
    assert np.allclose(solve(np.zeros(4), np.eye(4), None, 1.0, 0.0, 0.0, 0.25), 0.25)
    market = np.array([0.3, 0.3, 0.4])
    assert np.allclose(solve(2.5 * SIGMA @ market, SIGMA, None, 2.5, 0.0, 0.0, 0.6), market, atol=1e-6)
    assert np.allclose(solve(2.5 * SIGMA @ market, SIGMA, market, 2.5, 0.002, 0.0, 0.6), market, atol=1e-7)


def test_allocate_groups_and_quarantine(spark):
    cov = cov_frame(spark, groups=(1, 2, 3, 4))
    post = cov.withColumn("mu", F.when(F.col("asset_i") == F.col("asset_j"), F.when(F.col("asset_i") == "SPY", 0.5).otherwise(0.01)))
    recipes = spark.createDataFrame([(1, "mvu", 0.0), (2, "min_variance", 0.1), (3, "mvu", 0.5), (4, "magic", 0.0)], "g long, optimizer string, min_weight double")
    prev = spark.createDataFrame([(1, "AGG", 1.0)], "g long, asset string, weight double")
    good, bad = allocate(post, recipes, prev, ["g"], on_invalid="quarantine")
    rows = {(r["g"], r["asset"]): r for r in good.collect()}
    assert rows[(1, "SPY")]["weight"] == pytest.approx(0.6, abs=1e-6)
    assert rows[(1, "AGG")]["prev_weight"] == 1.0 and rows[(1, "AGG")]["turnover"] == pytest.approx(1 - rows[(1, "AGG")]["weight"])
    assert rows[(2, "AGG")]["weight"] == pytest.approx(0.6, abs=1e-6) and rows[(2, "SPY")]["weight"] >= 0.1 - 1e-7
    assert rows[(2, "SPY")]["prev_weight"] is None
    assert {r["g"]: r["reason"] for r in bad.collect()} == {3: "invalid: min_weight too large for the budget", 4: "invalid: unknown optimizer magic"}
    with pytest.raises(PySparkException, match="min_weight too large"):
        allocate(post, recipes, prev, ["g"]).collect()


def test_indefinite_matrix_is_refused(spark):
    bad = SIGMA.copy()
    bad[0, 1] = bad[1, 0] = 0.2
    post = cov_frame(spark, bad).withColumn("mu", F.when(F.col("asset_i") == F.col("asset_j"), 0.01))
    recipe = spark.createDataFrame([(1, "mvu")], "g long, optimizer string")
    assert allocate(post, recipe, None, ["g"], on_invalid="quarantine")[1].first()["reason"] == "invalid: covariance is indefinite"


def test_box_and_previous(spark):
    boxes = [(1, 3, 0.6, 0.0), (2, 3, 0.2, 0.0), (3, 3, 1.2, 0.0), (4, 3, 0.6, -0.1), (5, 3, 0.5, 0.6), (6, 3, 0.9, 0.4)]
    got = {r["g"]: r["reason"] for r in box_feasibility(spark.createDataFrame(boxes, "g long, n_assets long, w_max double, min_weight double"), ["g"]).collect()}
    assert set(got) == {2, 3, 4, 5, 6} and got[6] == "min_weight too large for the budget"
    universe = weights(spark)
    prev = spark.createDataFrame([(1, "SPY", 0.4), (1, "AGG", 0.6), (2, "SPY", 0.4), (3, "XX", 1.0), (4, "SPY", 1.5), (4, "AGG", -0.5)], "g long, asset string, weight double")
    out = expand_previous(prev, universe, ["g"]).toPandas()
    assert len(out) == 12 and out[(out["g"] == 1) & (out["asset"] == "ACWI")]["prev_weight"].item() == 0.0
    assert out.groupby("g")["reason"].first().dropna().to_dict() == {2: "weights do not sum to 1", 3: "asset outside the universe", 4: "weight outside [0, 1]"}


def test_turnover_is_zero_on_cold_start(spark):
    now = spark.createDataFrame([(1, "a", 0.7), (1, "b", 0.3), (2, "a", 1.0)], "g long, asset string, weight double")
    old = spark.createDataFrame([(1, "a", 1.0)], "g long, asset string, weight double")
    got = {(r["g"], r["asset"]): (r["prev_weight"], r["turnover"]) for r in turnover(now, old, ["g"]).collect()}
    assert got[(1, "b")] == (0.0, 0.3) and got[(2, "a")] == (None, 0.0)


def test_scenarios(spark, walk):
    from panelwright.operators.returns import log_returns

    universe = walk.select("asset").distinct()
    rows = [
        (1, "historical", "{}"), (2, "historical", '{"window_start": "2026-02-01", "window_end": "2026-03-01"}'), (3, "historical", '{"window_start": "2030-01-01"}'),
        (4, "counterfactual", '{"SPY": {"mu": 0.066, "confidence": 0.45}}'), (5, "counterfactual", '{"AGG": {"mu": -0.017}}'),
        (6, "counterfactual", '{"OIL": {"mu": 0.012}}'), (7, "counterfactual", '{"SPY": {"confidence": 0.5}}'), (8, "counterfactual", "broken"),
    ]
    s = spark.createDataFrame(rows, "scenario_id long, kind string, payload_json string")
    returns = log_returns(walk)
    got = historical_views(returns, parse_windows(s)).toPandas()
    raw = returns.toPandas()
    for sid, keep in ((1, raw["date"].notna()), (2, (raw["date"].astype(str) >= "2026-02-01") & (raw["date"].astype(str) <= "2026-03-01"))):
        for a, x in raw[keep].groupby("asset")["log_return"]:
            mine = got[(got["scenario_id"] == sid) & (got["asset"] == a)].iloc[0]
            assert mine["mu"] == pytest.approx(x.mean() * 21) and mine["sigma"] == pytest.approx(x.std() * math.sqrt(21))
    assert 3 not in set(got["scenario_id"])
    good, bad = counterfactual_views(s, universe, on_invalid="quarantine")
    out = {(r["scenario_id"], r["asset"]): r for r in good.withColumn("c", confidence(F.col("mu"), F.col("sigma"))).collect()}
    assert set(out) == {(4, "SPY"), (5, "AGG")}
    assert out[(4, "SPY")]["mu"] == pytest.approx(0.066 * 21 / 252) and out[(5, "AGG")]["c"] == pytest.approx(0.5)
    assert {r["scenario_id"]: r["reason"] for r in bad.collect()} == {6: "asset not in universe", 7: "view has no mu"}
    with pytest.raises(PySparkException, match="asset not in universe|view has no mu"):
        counterfactual_views(s, universe).collect()


def test_forecast_contract(spark):
    f = spark.createDataFrame([("SPY", 0.1, 0.0), ("ACWI", float("nan"), 1.0), ("GLD", 0.1, 1.0)], "asset string, mu double, sigma double")
    got = {r["asset"]: r["reason"] for r in check_forecasts(f, weights(spark)).collect()}
    assert got == {"SPY": "sigma not positive and finite", "ACWI": "mu not finite", "AGG": "no forecast", "GLD": "not in universe"}
