"""Run many recipes and scenarios in one job, and publish the results with a ledger."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.defaults import STAGES
from panelwright.operators.allocate import allocate
from panelwright.operators.blend import equilibrium_prior, posterior, posterior_report, view_terms
from panelwright.operators.covariance import ledoit_wolf, pair_moments
from panelwright.operators.panel import common_date_panel
from panelwright.operators.returns import log_returns
from panelwright.operators.views import counterfactual_views, historical_views, parse_windows
from panelwright.plans.registry import Recipe, resolve
from panelwright.session import durable, unite
from panelwright.sources.versioned import Prepared, Store

GROUP = ["config_id"]


def run_recipes(
    prices: DataFrame,
    recipes: list[Recipe],
    scenarios: DataFrame,
    kinds: dict[int, str],
    universe: DataFrame,
    benchmark: DataFrame,
    previous: DataFrame | None = None,
    on_invalid: str = "raise",
) -> dict[str, DataFrame]:
    """Forecasts, posteriors and allocations of every recipe, grouped by ``config_id``.

    Each distinct forecaster setting is planned once and shared; the covariance is planned once.
    ``prices`` is read several times: pass a stored panel, not one derived on the fly.
    ``kinds`` maps scenario to view kind, so unknown names fail before any job starts.
    """
    spark = prices.sparkSession
    stacks = {r.config_id: resolve(r, kinds[r.scenario_id]) for r in recipes}
    returns = log_returns(prices)
    planned: dict[str, DataFrame] = {}
    rows = []
    for r in recipes:
        tag = json.dumps([r.forecaster, dict(r.params.get("forecaster", {}))], sort_keys=True)
        if tag not in planned:
            planned[tag] = stacks[r.config_id].forecaster(prices).withColumn("model", F.lit(tag))
        s = stacks[r.config_id]
        rows.append((r.config_id, r.name, r.scenario_id, s.view_kind, tag, s.optimizer, s.optimizer_params["min_weight"]))
    settings = spark.createDataFrame(
        rows, "config_id long, name string, scenario_id long, kind string, model string, optimizer string, min_weight double"
    )
    forecasts = unite(*planned.values())
    from_model = settings.filter("kind = 'forecast'").join(forecasts, "model").select(*GROUP, "asset", "mu", "sigma")
    past = historical_views(returns, parse_windows(scenarios))
    written = counterfactual_views(scenarios, universe)
    chosen = settings.filter("kind <> 'forecast'").select(*GROUP, "scenario_id")
    views = unite(from_model, chosen.join(unite(past, written), "scenario_id").select(*GROUP, "asset", "mu", "sigma"))
    # Stored once: prior, views, posterior and report all read the matrix, which is far smaller than the panel.
    single = ledoit_wolf(durable(pair_moments(common_date_panel(returns))))
    # Each group's task needs its own copy of the matrix; groups x matrix is also the output's size.
    everyone = F.array(*[F.lit(r.config_id).cast("long") for r in recipes])
    cov = single.withColumn("config_id", F.explode(everyone))
    prior = equilibrium_prior(cov, benchmark, by=GROUP)
    terms = view_terms(views, cov, GROUP)
    post = posterior(cov, prior, terms, GROUP)
    result = allocate(post, settings.select(*GROUP, "optimizer", "min_weight"), previous, GROUP, on_invalid=on_invalid)
    weights, rejected = result if isinstance(result, tuple) else (result, None)
    out = {
        "forecasts": settings.join(forecasts, "model").select(*GROUP, "asset", "mu", "sigma"),
        "posteriors": posterior_report(post, prior, terms, GROUP),
        "target_weights": weights,
    }
    if rejected is not None:
        out["rejected"] = rejected
    return out


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None, microsecond=0)


def publish_run(spark: SparkSession, root: str, run_id: int, config_id: int, stages: dict, trig: str = "manual") -> str:
    """Evaluate stages in order, store their outputs, and record the run whatever happens.

    ``stages`` maps a stage name to a function returning ``({table: DataFrame}, detail dict)``. Outputs
    go to ``root/<table>/run_id=N``; on failure those folders are removed, so a failed run leaves ledger
    rows and no data. A run counts only once its ledger row says ok.
    """
    started, records, written, status, error = _now(), [], [], "ok", None
    for name in [s for s in STAGES if s in stages]:
        begun = _now()
        try:
            outputs, detail = stages[name]()
            for table, df in outputs.items():
                target = f"{root}/{table}/run_id={run_id}"
                written.append(target)
                df.write.mode("overwrite").parquet(target)
            skipped = bool(detail.get("skip"))
            records.append((run_id, name, "skipped" if skipped else "ok", begun, _now(), json.dumps(detail, sort_keys=True, default=str)))
            if skipped:
                status = "skipped"
                break
        except Exception as problem:  # the ledger must record any failure
            status, error = "error", f"{name}: {type(problem).__name__}: {problem}"
            records.append((run_id, name, "error", begun, _now(), json.dumps({"error": error})))
            break
    if status == "error":
        for target in written:
            folder = spark._jvm.org.apache.hadoop.fs.Path(target)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    spark.createDataFrame(
        records, "run_id long, stage string, status string, started_at timestamp_ntz, finished_at timestamp_ntz, detail_json string"
    ).coalesce(1).write.mode("append").parquet(f"{root}/run_stages")
    spark.createDataFrame(
        [(run_id, config_id, status, trig, started, _now(), error)],
        "run_id long, config_id long, status string, trig string, started_at timestamp_ntz, finished_at timestamp_ntz, error_text string",
    ).coalesce(1).write.mode("append").parquet(f"{root}/runs")
    return status


RUN_KEYS = {
    "features": ["run_id", "asset", "name"],
    "forecasts": ["run_id", "asset"],
    "posteriors": ["run_id", "asset"],
    "target_weights": ["run_id", "asset"],
    "run_stages": ["run_id", "stage"],
    "runs": ["run_id"],
}


def publish_versioned(store: Store, run_id: int, config_id: int, stages: dict, trig: str = "manual") -> str:
    """``publish_run`` into a versioned store: outputs and ledger rows of a run become visible in one version.

    Each stage's tables are written as soon as it ends but named by no version until all have succeeded; a failed
    run publishes its ledger rows only. Tables are declared when first met; their keys are ``RUN_KEYS``, or the run
    and the first column.
    """
    started, records, parts, status, error = _now(), [], [], "ok", None

    def prepared(tables: dict[str, DataFrame]) -> Prepared:
        known = store.manifest()["tables"]
        tables = {n: (df if "run_id" in df.columns else df.select(F.lit(run_id).cast("long").alias("run_id"), "*")) for n, df in tables.items()}
        for name, df in tables.items():
            if name not in known:
                store.declare(name, df, RUN_KEYS.get(name, ["run_id", df.columns[1]]))
        return store.prepare(tables)

    for name in [s for s in STAGES if s in stages]:
        begun = _now()
        try:
            outputs, detail = stages[name]()
            parts.append(prepared(outputs))
            skipped = bool(detail.get("skip"))
            records.append((run_id, name, "skipped" if skipped else "ok", begun, _now(), json.dumps(detail, sort_keys=True, default=str)))
            if skipped:
                status = "skipped"
                break
        except Exception as problem:  # the ledger must record any failure
            status, error, parts = "error", f"{name}: {type(problem).__name__}: {problem}", []
            records.append((run_id, name, "error", begun, _now(), json.dumps({"error": error})))
            break
    lines = store.spark.createDataFrame(records, "run_id long, stage string, status string, started_at timestamp_ntz, finished_at timestamp_ntz, detail_json string")
    run = store.spark.createDataFrame(
        [(run_id, config_id, status, trig, started, _now(), error)],
        "run_id long, config_id long, status string, trig string, started_at timestamp_ntz, finished_at timestamp_ntz, error_text string",
    )
    store.publish([*parts, prepared({"run_stages": lines, "runs": run})])
    return status
