"""Recipes as rows: one pass for all halflives, blocks of recipes by one matrix, kept results, published runs."""

import datetime as dt
import json
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import frame, walk_frame
from panelwright.operators.ewma import ewma_forecast, latest_forecast
from panelwright.operators.ewma_grid import forecast_grid
from panelwright.operators.returns import log_returns
from panelwright.plans.recipe_table import recipe_settings, run_recipe_table, solve_blocks
from panelwright.plans.recipes import publish_versioned, run_recipes
from panelwright.plans.registry import Recipe, recipe_rows
from panelwright.session import durable, shared_folder
from panelwright.sources.versioned import Store
from panelwright.streaming import price_ingest

SCENARIOS = [
    (1, "forecast", None),
    (2, "historical", '{"window_start": "2020-03-01", "window_end": "2020-12-31"}'),
    (3, "counterfactual", '{"SPY": {"mu": 0.07, "confidence": 0.6}}'),
]


@pytest.fixture(scope="module")
def scenarios(spark):
    return spark.createDataFrame(SCENARIOS, "scenario_id long, kind string, payload_json string")


@pytest.fixture(scope="module")
def panel(spark, long_walk):
    return durable(long_walk)


@pytest.fixture(scope="module")
def universe(panel):
    return durable(panel.select("asset").distinct())


@pytest.fixture(scope="module")
def benchmark(universe):
    return universe.withColumn("weight", F.lit(1.0) / 3)


def folder(spark):
    return f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"


@pytest.mark.parametrize("latest", [False, True])
def test_a_grid_of_halflives_equals_one_forecast_each(spark, panel, latest):
    returns = log_returns(panel)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        grid = forecast_grid(returns, [63.0, 0.4, 5000.0, 63.0], latest=latest).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for h in (63.0, 0.4, 5000.0):
        want = frame((latest_forecast if latest else ewma_forecast)(returns, halflife=h), "asset", "date")
        got = grid[grid["halflife"] == h].sort_values(["asset", "date"]).reset_index(drop=True)
        assert got[["asset", "date", "n_bars"]].equals(want[["asset", "date", "n_bars"]])
        assert np.allclose(got[["mu", "sigma"]], want[["mu", "sigma"]], rtol=1e-9, atol=1e-14)


def test_grid_in_several_blocks_far_from_zero_and_at_the_edges(spark, panel, monkeypatch):
    from panelwright.operators import ewma_grid

    returns = log_returns(panel)
    monkeypatch.setattr(ewma_grid, "SLOTS", 3)
    assert forecast_grid(returns, [10.0 + k for k in range(8)], latest=True).count() == 24
    assert forecast_grid(returns, []).count() == 0
    monkeypatch.undo()
    near, far = (forecast_grid(returns.withColumn("log_return", F.col("log_return") + shift), [21.0], latest=True) for shift in (0.0, 1e6))
    assert np.allclose(frame(near, "asset")["sigma"], frame(far, "asset")["sigma"], rtol=1e-5)
    short = returns.filter((F.col("asset") != "AGG") | (F.col("date") < F.lit("2020-02-15").cast("date")))
    flat = short.withColumn("log_return", F.when(F.col("asset") == "SPY", F.lit(0.001)).otherwise(F.col("log_return")))
    good, report = forecast_grid(flat, [21.0], latest=True, on_invalid="quarantine")
    assert [r.asset for r in good.collect()] == ["ACWI"]
    assert {(r.asset, r.reason) for r in report.collect()} == {("AGG", "history too short"), ("SPY", "constant returns")}
    with pytest.raises(Exception, match="history of AGG"):
        forecast_grid(short, [21.0]).collect()
    for bad in (0.0, -1.0, float("nan")):
        with pytest.raises(ValueError):
            forecast_grid(returns, [bad])


def recipes():
    return [
        Recipe(1, "central"),
        Recipe(2, "slow", params={"forecaster": {"halflife": 126.0}}),
        Recipe(3, "past", scenario_id=2, optimizer="min_variance"),
        Recipe(4, "floored", scenario_id=3, params={"optimizer": {"min_weight": 0.05}}),
    ]


def test_rows_give_what_recipes_in_code_gave(spark, panel, scenarios, universe, benchmark):
    old = run_recipes(panel, recipes(), scenarios, {i: k for i, k, _ in SCENARIOS}, universe, benchmark)
    new = run_recipe_table(panel, recipe_rows(spark, recipes()), scenarios, universe, benchmark)
    for table, names in (("posteriors", ["prior_mu", "view_mu", "omega", "posterior_mu", "posterior_sigma", "tilt"]), ("target_weights", ["weight", "turnover"])):
        a, b = (frame(x[table], "config_id", "asset") for x in (old, new))
        assert a[["config_id", "asset"]].equals(b[["config_id", "asset"]])
        assert np.allclose(a[names].astype(float), b[names].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True)
    made = new["forecasts"].collect()
    assert {r.model_version for r in made} == {"ewma:63.0", "ewma:126.0"} and {r.horizon_days for r in made} == {21}
    assert {r.as_of for r in made} == {panel.agg(F.max("date")).first()[0]}


def test_hundreds_of_recipes_in_blocks(spark, panel, scenarios, universe, benchmark):
    rows = spark.range(1, 301).select(
        F.col("id").alias("config_id"), F.lit("basic").alias("feature_set"), F.lit("ewma").alias("forecaster"), (F.col("id") % 3 + 1).alias("scenario_id"),
        F.lit("mvu").alias("optimizer"), F.format_string('{"forecaster": {"halflife": %s}}', F.col("id") + 20).alias("params_json"),
    )
    out = run_recipe_table(panel, rows, scenarios, universe, benchmark, allocations=False)
    assert out["posteriors"].count() == 900
    one = run_recipe_table(panel, rows.filter("config_id = 150"), scenarios, universe, benchmark, allocations=False)
    a, b = frame(one["posteriors"], "asset"), frame(out["posteriors"].filter("config_id = 150"), "asset")
    assert len(a) == 3 and np.allclose(a.drop(columns="asset").astype(float), b.drop(columns="asset").astype(float), rtol=1e-9, atol=1e-12)


def test_bad_recipes_stop_or_leave(spark, panel, scenarios, universe, benchmark):
    bad = [Recipe(5, "x", forecaster="magic"), Recipe(6, "x", scenario_id=99), Recipe(7, "x", params={"forecaster": {"halflife": -1.0}}), Recipe(8, "x", params={"optimizer": {"min_weight": 0.5}})]
    rows = recipe_rows(spark, [*recipes(), *bad]).withColumn("params_json", F.when(F.col("config_id") == 2, "{broken").otherwise(F.col("params_json")))
    out = run_recipe_table(panel, rows, scenarios, universe, benchmark, on_invalid="quarantine")
    problems = {r.config_id: r.problem for r in out["rejected"].collect()}
    assert set(problems) == {2, 5, 6, 7, 8}
    assert "JSON" in problems[2] and "magic" in problems[5] and "scenario" in problems[6] and "halflife" in problems[7] and "min_weight" in problems[8]
    assert {r.config_id for r in out["target_weights"].select("config_id").distinct().collect()} == {1, 3, 4}
    with pytest.raises(Exception, match="recipe 5"):
        recipe_settings(recipe_rows(spark, bad[:1]), scenarios).collect()


def test_previous_weights_enter_and_are_checked(spark, panel, scenarios, universe, benchmark):
    rows = recipe_rows(spark, recipes()[:2])
    held = spark.createDataFrame([(1, "SPY", 0.5), (1, "AGG", 0.5)], "config_id long, asset string, weight double")
    weights = {(r.config_id, r.asset): r for r in run_recipe_table(panel, rows, scenarios, universe, benchmark, previous=held)["target_weights"].collect()}
    assert weights[1, "SPY"].prev_weight == 0.5 and weights[1, "ACWI"].prev_weight == 0.0 and weights[2, "SPY"].prev_weight is None
    assert weights[1, "AGG"].turnover == pytest.approx(abs(weights[1, "AGG"].weight - 0.5))
    gone = held.withColumn("asset", F.when(F.col("asset") == "AGG", "GONE").otherwise(F.col("asset")))
    with pytest.raises(Exception, match="outside the universe"):
        run_recipe_table(panel, rows, scenarios, universe, benchmark, previous=gone)


def test_features_follow_each_recipe(spark, panel, scenarios, universe, benchmark):
    macro = spark.createDataFrame([("RATE", dt.date(2020, 1, 1), dt.date(2020, 1, 2), 1.5), ("RATE", dt.date(2021, 1, 1), dt.date(2030, 1, 1), 9.0)], "series_id string, obs_date date, available_date date, value double")
    rows = recipe_rows(spark, [Recipe(1, "a"), Recipe(2, "b", feature_set="fracdiff_macro", params={"features": {"series_ids": '["RATE"]'}})])
    out = run_recipe_table(panel, rows, scenarios, universe, benchmark, macro=macro, allocations=False, features=True)["features"].collect()
    names = {c: {r.name for r in out if r.config_id == c} for c in (1, 2)}
    assert names == {1: {"log_return", "realized_vol"}, 2: {"log_return", "realized_vol", "RATE"}}
    assert {r.value for r in out if r.name == "RATE"} == {1.5}


def test_results_are_computed_once_per_content(spark, panel, scenarios, universe, benchmark):
    store = Store(spark, folder(spark))
    args = (scenarios, universe, benchmark)
    rows = recipe_rows(spark, [*recipes(), Recipe(9, "same as central")])
    first = run_recipe_table(panel, rows, *args, results=store)
    assert sorted(r.config_id for r in first["computed"].collect()) == [1, 2, 3, 4]
    second = run_recipe_table(panel, rows, *args, results=store)
    assert second["computed"].count() == 0 and second["forecasts"].count() == 0
    for table in ("posteriors", "target_weights"):
        assert frame(first[table], "config_id", "asset").equals(frame(second[table], "config_id", "asset"))
    assert first["posteriors"].count() == 15
    edited = rows.withColumn("params_json", F.when(F.col("config_id") == 2, json.dumps({"forecaster": {"halflife": 30.0}})).otherwise(F.col("params_json")))
    assert [r.config_id for r in run_recipe_table(panel, edited, *args, results=store)["computed"].collect()] == [2]
    held = spark.createDataFrame([(3, "SPY", 1.0)], "config_id long, asset string, weight double")
    assert [r.config_id for r in run_recipe_table(panel, rows, *args, previous=held, results=store)["computed"].collect()] == [3]


def test_a_revised_asset_recomputes_its_own_universe_only(spark, panel, scenarios):
    store = Store(spark, folder(spark))
    other = spark.createDataFrame(walk_frame(days=200, seed=3).replace({"SPY": "X", "ACWI": "Y", "AGG": "Z"}), "asset string, date date, adj_close double")
    both = durable(panel.unionByName(other))
    sides = [spark.createDataFrame([(a,) for a in names], "asset string") for names in (("SPY", "ACWI", "AGG"), ("X", "Y", "Z"))]
    rows = recipe_rows(spark, recipes()[:1])
    run = lambda data, side: run_recipe_table(data, rows, scenarios, side, side.withColumn("weight", F.lit(1.0) / 3), results=store)["computed"].count()
    assert [run(both, s) for s in sides] == [1, 1]
    newest = both.filter("asset = 'X'").agg(F.max("date")).first()[0]
    revised = both.withColumn("adj_close", F.when((F.col("asset") == "X") & (F.col("date") == F.lit(newest)), F.col("adj_close") * 1.01).otherwise(F.col("adj_close")))
    assert [run(durable(revised), s) for s in sides] == [0, 1]


def test_blocks_do_not_change_results(spark, panel, scenarios, universe, benchmark):
    from panelwright.operators.blend import equilibrium_prior, view_terms
    from panelwright.operators.covariance import ledoit_wolf, pair_moments
    from panelwright.operators.panel import common_date_panel
    from panelwright.plans.recipe_table import model_forecasts, recipe_views

    settings, returns = durable(recipe_settings(recipe_rows(spark, recipes()), scenarios)), log_returns(panel)
    cov = durable(ledoit_wolf(durable(pair_moments(common_date_panel(returns)))))
    terms = durable(view_terms(recipe_views(settings, scenarios, model_forecasts(returns, settings), returns, universe), cov, ["config_id"]))
    prior = durable(equilibrium_prior(cov, benchmark))
    a, b = (frame(solve_blocks(settings, terms, cov, prior, None, per_block=n), "config_id", "asset") for n in (1, 256))
    numbers = ["posterior_mu", "posterior_sigma", "tilt", "weight"]
    assert a[["config_id", "asset"]].equals(b[["config_id", "asset"]]) and np.allclose(a[numbers], b[numbers], rtol=1e-9, atol=1e-9)


def test_a_run_is_visible_at_once_or_not_at_all(spark):
    store = Store(spark, folder(spark))
    data = spark.createDataFrame([("a", 1.0)], "asset string, value double")
    seen = []

    def fails():
        seen.append(store.manifest()["tables"].get("target_weights", {}).get("deltas"))
        raise RuntimeError("no prices")

    good = {"features": lambda: ({"target_weights": data}, {"n": 1}), "forecast": lambda: ({"forecasts": data}, {})}
    assert publish_versioned(store, 1, 5, good) == "ok"
    assert publish_versioned(store, 2, 5, {"features": lambda: ({"target_weights": data}, {}), "forecast": fails}) == "error"
    assert publish_versioned(store, 3, 5, {"freshness": lambda: ({}, {"skip": True}), "features": fails}) == "skipped"
    assert len(seen) == 1 and len(seen[0]) == 1
    assert [r.run_id for r in store.snapshot("target_weights").read().collect()] == [1]
    assert {r.run_id: r.status for r in store.snapshot("runs").read().collect()} == {1: "ok", 2: "error", 3: "skipped"}
    stages = {(r.run_id, r.stage): r.status for r in store.snapshot("run_stages").read().collect()}
    assert stages == {(1, "features"): "ok", (1, "forecast"): "ok", (2, "features"): "ok", (2, "forecast"): "error", (3, "freshness"): "skipped"}
    assert store.vacuum(keep=1) == 1


def test_stream_batches_commit_versions_and_refresh_revised_keys(spark):
    store = Store(spark, folder(spark))
    shape = "asset string, date date, adj_close double, fetched_at timestamp"
    stamp = dt.datetime(2024, 1, 1)
    rows = lambda *given: spark.createDataFrame([(a, dt.date.fromisoformat(d), p, stamp + dt.timedelta(hours=h)) for a, d, p, h in given], shape)
    store.declare("prices", rows(), ["asset", "date"], "date")
    days = [f"2024-01-{d:02d}" for d in range(2, 13)]
    whole = rows(*[("A", d, 50.0, 9) for d in days])
    asked, moved = [], {}

    def history(keys):
        asked.append(sorted(r.asset for r in keys.collect()))
        return whole.join(keys, "asset", "left_semi")

    handler = price_ingest.foreach_batch_versioned(
        store, full_history=history, recompute=lambda keys, b, snapshot: moved.__setitem__(b, (sorted(r.asset for r in keys.collect()), snapshot.version)), compact_after=2
    )
    handler(rows(*[(a, d, 100.0, 0) for a in "AB" for d in days[:-1]]), 0)
    handler(rows(("A", days[-2], 100.0, 1), ("B", days[-1], 101.0, 1), ("B", days[-1], 102.0, 2)), 1)
    again = store.manifest()["version"]
    handler(rows(("A", days[-2], 100.0, 1), ("B", days[-1], 101.0, 1), ("B", days[-1], 102.0, 2)), 1)
    assert store.manifest()["version"] == again
    handler(rows(("A", days[3], 50.0, 3), ("A", days[-1], 50.0, 3)), 2)
    assert asked == [[], ["A"]] and {b: k for b, (k, _) in moved.items()} == {0: ["A", "B"], 1: ["A", "B"], 2: ["A"]}
    held = {(r.asset, str(r.date)): r.adj_close for r in store.snapshot("prices").read().collect()}
    assert all(held["A", d] == 50.0 for d in days) and held["B", days[-1]] == 102.0 and len(held) == 22
