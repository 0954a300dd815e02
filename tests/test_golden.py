"""One full cycle on the seeded walk against published values."""

import pytest
from conftest import by_asset
from pyspark.sql import functions as F

from panelwright.operators.blend import posterior_report
from panelwright.operators.ewma import latest_forecast
from panelwright.operators.panel import covariance_window
from panelwright.operators.returns import latest_rows, log_returns, return_features
from panelwright.functions.scalars import confidence
from panelwright.plans.recipes import run_recipes
from panelwright.plans.registry import Recipe

# Fixed values published for this input.
GOLDEN = {
    "mu": {"SPY": -0.02403215520822318, "ACWI": -0.021584490235697876, "AGG": 0.0051017786962446205},
    "sigma": {"SPY": 0.039022689065715106, "ACWI": 0.030436091094374722, "AGG": 0.015119942007118433},
    "confidence": {"SPY": 0.46200701977842007, "ACWI": 0.5217836116887912, "AGG": 0.26420008208714424},
    "prior_mu": {"SPY": 0.016600440777860128, "ACWI": 0.01950252677310725, "AGG": 0.004000532423273196},
    "view_mu": {"SPY": -0.28838586249867815, "ACWI": -0.2590138828283745, "AGG": 0.061221344354935446},
    "posterior_mu": {"SPY": -0.12986061247309325, "ACWI": -0.13517908302253184, "AGG": 0.01628969842808235},
    "posterior_sigma": {"SPY": 0.1382243754627312, "ACWI": 0.15681238398853126, "AGG": 0.0616647605101888},
    "weight": {"SPY": 0.26502133516636167, "ACWI": 0.13497866537766512, "AGG": 0.5999999994559733},
    "log_return": {"SPY": -0.012735277924842513, "ACWI": -0.002613078993895508, "AGG": -0.0033355307215679722},
    "realized_vol": {"SPY": 0.14186852853868342, "ACWI": 0.18655618969980908, "AGG": 0.044113098701801766},
}


@pytest.fixture(scope="module")
def batch(spark, walk):
    universe = walk.select("asset").distinct()
    benchmark = spark.createDataFrame([("SPY", 0.3), ("ACWI", 0.3), ("AGG", 0.4)], "asset string, weight double")
    scenarios = spark.createDataFrame([(1, "forecast", None)], "scenario_id long, kind string, payload_json string")
    return run_recipes(walk, [Recipe(1, "central")], scenarios, {1: "forecast"}, universe, benchmark)


@pytest.mark.parametrize("blocks", ["auto", 16])
def test_forecast(walk, blocks):
    out = latest_forecast(log_returns(walk, rows_per_block=blocks), rows_per_block=blocks)
    out = out.withColumn("confidence", confidence(F.col("mu"), F.col("sigma")))
    for name in ("mu", "sigma", "confidence"):
        assert by_asset(out, name) == pytest.approx(GOLDEN[name], rel=1e-12)


def test_features(walk):
    out = latest_rows(return_features(walk))
    for name in ("log_return", "realized_vol"):
        assert by_asset(out, name) == pytest.approx(GOLDEN[name], rel=1e-12)


def test_posterior(batch):
    for name in ("prior_mu", "view_mu", "posterior_mu", "posterior_sigma"):
        assert by_asset(batch["posteriors"], name) == pytest.approx(GOLDEN[name], rel=1e-11)


def test_weights(batch):
    rows = batch["target_weights"].collect()
    assert {r["asset"]: r["weight"] for r in rows} == pytest.approx(GOLDEN["weight"], abs=1e-6)
    assert abs(sum(r["weight"] for r in rows) - 1) < 1e-12
    assert all(r["prev_weight"] is None and r["turnover"] == 0 for r in rows)


def test_covariance_window(walk):
    row = covariance_window(log_returns(walk)).first()
    assert (str(row["start"]), str(row["end"]), row["bars"]) == ("2026-01-05", "2026-04-09", 69)
