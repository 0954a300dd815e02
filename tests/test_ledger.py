import datetime as dt
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelwright.operators import ledger as led
from panelwright.plans.recipes import publish_run
from panelwright.plans.registry import REGISTRY, Recipe, known_keys, manifest, resolve

T = dt.datetime(2024, 1, 1)


def runs(spark, *rows):
    return spark.createDataFrame([(i, c, s, "manual", T + dt.timedelta(hours=i)) for i, c, s in rows], "run_id long, config_id long, status string, trig string, started_at timestamp_ntz")


def noted(spark, *rows):
    return spark.createDataFrame([(i, "freshness", "ok", d) for i, d in rows], "run_id long, stage string, status string, detail_json string")


def marks(spark, date, fetched):
    return spark.createDataFrame([(date, fetched)], "data_max_date string, data_fetched_at string")


def seen(date, fetched):
    return json.dumps({"data_max_date": date, "data_fetched_at": fetched})


def configs(spark, *ids, updated=T):
    return spark.createDataFrame([(i, f"c{i}", i == 1, updated) for i in ids], "config_id long, name string, is_central boolean, updated_at timestamp_ntz")


@pytest.mark.parametrize(
    "date,fetched,detail,force,decision",
    [
        ("d", "f", seen("d", "f"), False, "skip"),
        ("d", "f", seen("d", "f"), True, "recompute"),
        ("e", "f", seen("d", "f"), False, "recompute"),
        ("d", "g", seen("d", "f"), False, "recompute"),
        (None, "f", seen(None, "f"), False, "recompute"),
        ("d", None, seen("d", None), False, "recompute"),
        ("d", "f", "not json", False, "recompute"),
        ("d", "f", None, False, "recompute"),
    ],
)
def test_freshness(spark, date, fetched, detail, force, decision):
    r = runs(spark, (1, 1, "ok"), (2, 1, "error"), (3, 2, "error"))
    out = {x["config_id"]: x["decision"] for x in led.freshness_gate(r, noted(spark, (1, detail)), configs(spark, 1, 2, 3), marks(spark, date, fetched), force).collect()}
    assert out == {1: decision, 2: "recompute", 3: "recompute"}


def test_edited_recipe_is_stale(spark):
    r, s, m = runs(spark, (1, 1, "ok")), noted(spark, (1, seen("d", "f"))), marks(spark, "d", "f")
    at = lambda h: {x["config_id"]: x["cached_run_id"] for x in led.cached_runs(r, s, configs(spark, 1, updated=T + dt.timedelta(hours=h)), m).collect()}[1]
    assert (at(0), at(1), at(2)) == (1, 1, None)


def test_history_and_limits(spark):
    r = runs(spark, *[(i, 1, "ok") for i in range(1, 8)])
    w = spark.createDataFrame([(7, "b", 0.4), (7, "a", 0.6)], "run_id long, asset string, weight double")
    out = led.run_history(r, w, 3).collect()
    assert [x["run_id"] for x in out] == [7, 6, 5]
    assert [y["asset"] for y in out[0]["target_weights"]] == ["a", "b"] and out[1]["target_weights"] is None
    for bad in (0, 201):
        with pytest.raises(ValueError):
            led.run_history(r, w, bad)


def test_latest_ok_is_null_without_ok_runs(spark):
    assert led.latest_ok_run(runs(spark, (1, 1, "error"))).first()["run_id"] is None


def test_sweep_and_central(spark):
    r = runs(spark, (1, 1, "running"), (2, 1, "ok")).withColumn("error_text", F.lit(None).cast("string")).withColumn("finished_at", F.lit(None).cast("timestamp_ntz"))
    got = {x["run_id"]: (x["status"], x["error_text"]) for x in led.sweep_stale(r, F.lit(T)).collect()}
    assert got[1][0] == "error" and got[1][1] and got[2] == ("ok", None)
    c = configs(spark, 1, 2, 3)
    assert [x["config_id"] for x in led.set_central(c, 2).filter("is_central").collect()] == [2]
    with pytest.raises(PySparkException, match="unknown config 9"):
        led.set_central(c, 9).collect()


def test_durations(spark):
    s = spark.createDataFrame([("2024-01-01 00:00:00", "2024-01-01 00:01:30"), (None, "2024-01-01 00:00:00"), ("soon", "2024-01-01 00:00:00")], "started_at string, finished_at string")
    assert [x["seconds"] for x in led.stage_durations(s).collect()] == [90.0, None, None]


def test_registry(spark):
    assert known_keys() == {"feature_set": ["basic", "fracdiff_macro"], "forecaster": ["ewma", "ridge"], "kind": ["counterfactual", "forecast", "historical"], "optimizer": ["min_variance", "mvu"]}
    stack = resolve(Recipe(1, "x", optimizer="min_variance", params={"optimizer": {"min_weight": 0.1}}), "historical")
    assert (stack.view_kind, stack.optimizer, stack.optimizer_params) == ("historical", "min_variance", {"min_weight": 0.1})
    for bad in (Recipe(1, "x", feature_set="no"), Recipe(1, "x", forecaster="no"), Recipe(1, "x", optimizer="no"), Recipe(1, "x", params={"forecaster": {"halflife": "9"}})):
        with pytest.raises(ValueError):
            resolve(bad, "forecast")
    with pytest.raises(ValueError, match="unknown kind"):
        resolve(Recipe(1, "x"), "dream")
    marker = object()
    assert resolve(Recipe(1, "x", forecaster="no"), "forecast", marker).forecaster is marker
    rows = manifest(spark).collect()
    assert {(r["stage"], r["key"]) for r in rows} == {(s, k) for s, e in REGISTRY.items() for k in e}


def test_failed_run_leaves_ledger_and_no_data(spark, tmp_path):
    root = str(tmp_path)
    data = spark.createDataFrame([("a", 1.0)], "asset string, x double")

    def fails():
        raise RuntimeError("no prices")

    assert publish_run(spark, root, 1, 5, {"features": lambda: ({"features": data}, {"n": 1}), "forecast": lambda: ({"forecasts": data}, {})}) == "ok"
    assert publish_run(spark, root, 2, 5, {"features": lambda: ({"features": data}, {}), "forecast": fails}) == "error"
    assert publish_run(spark, root, 3, 5, {"freshness": lambda: ({}, {"skip": True}), "features": fails}) == "skipped"
    assert [r["run_id"] for r in spark.read.parquet(f"{root}/features").select("run_id").distinct().collect()] == [1]
    stages = {(r["run_id"], r["stage"]): r["status"] for r in spark.read.parquet(f"{root}/run_stages").collect()}
    assert stages == {(1, "features"): "ok", (1, "forecast"): "ok", (2, "features"): "ok", (2, "forecast"): "error", (3, "freshness"): "skipped"}
    ledger = {r["run_id"]: r for r in spark.read.parquet(f"{root}/runs").collect()}
    assert "no prices" in ledger[2]["error_text"] and ledger[1]["error_text"] is None
