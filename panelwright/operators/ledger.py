"""Queries over the run ledger: runs, stages, stored weights, configs and evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.defaults import STAGES
from panelwright.functions.scalars import json_object
from panelwright.operators.ranks import nearest_rank
from panelwright.session import unite

SWEEP_TEXT = "interrupted: the process stopped before this run finished"
MAX_HISTORY = 200
_MARKS = "data_max_date string, data_fetched_at string"
_OBJECTIVE = "objective struct<form: string>"


def run_history(runs: DataFrame, weights: DataFrame, limit: int = 50) -> DataFrame:
    """The newest runs, each with its weights nested. The limit is the feature: a report of 1 to 200 runs."""
    if not 1 <= limit <= MAX_HISTORY:
        raise ValueError(f"limit must be in 1..{MAX_HISTORY}, got {limit}")
    newest = runs.orderBy(F.col("run_id").desc()).limit(limit)
    # Only weights of those few runs are nested; a run holds one row per asset.
    chosen = weights.join(F.broadcast(newest.select("run_id")), "run_id", "left_semi")
    nested = chosen.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("asset", "weight"))).alias("target_weights"))
    return newest.join(nested, "run_id", "left").orderBy(F.col("run_id").desc())


def latest_ok_run(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Newest ok run overall (NULL when there is none) or per group."""
    return runs.filter("status = 'ok'").groupBy(*(by or [])).agg(F.max("run_id").alias("run_id"))


def latest_ok_per_config(runs: DataFrame, configs: DataFrame) -> DataFrame:
    return configs.select("config_id").join(latest_ok_run(runs, ["config_id"]), "config_id", "left")


def data_watermarks(prices: DataFrame, date: str = "date", fetched: str = "fetched_at") -> DataFrame:
    return prices.agg(F.max(date).alias("data_max_date"), F.max(fetched).alias("data_fetched_at"))


def recorded_marks(runs: DataFrame, stages: DataFrame) -> DataFrame:
    """Per config: the latest ok run and the watermarks its freshness stage recorded (NULL when unreadable)."""
    last = latest_ok_run(runs, ["config_id"])
    marks = json_object(F.col("detail_json"), _MARKS)
    noted = stages.filter("stage = 'freshness'").select(
        "run_id", marks["data_max_date"].alias("seen_max_date"), marks["data_fetched_at"].alias("seen_fetched_at")
    )
    return last.join(noted, "run_id", "left")


def _unchanged(current_date: Column, current_fetched: Column) -> Column:
    # Plain equality on purpose: an unknown mark on either side must mean recompute.
    same = (current_date == F.col("seen_max_date")) & (current_fetched == F.col("seen_fetched_at"))
    return F.coalesce(same, F.lit(False))


def freshness_gate(runs: DataFrame, stages: DataFrame, configs: DataFrame, marks: DataFrame, force: bool = False) -> DataFrame:
    """``(config_id, run_id, decision)``: skip only if an ok run already used exactly the current data."""
    now = marks.select(F.struct(F.col("data_max_date").cast("string").alias("d"), F.col("data_fetched_at").cast("string").alias("f"))).scalar()
    noted = recorded_marks(runs, stages)
    joined = configs.select("config_id").join(noted, "config_id", "left").withColumn("_now", now)
    skip = F.col("run_id").isNotNull() & _unchanged(F.col("_now.d"), F.col("_now.f")) & F.lit(not force)
    return joined.select("config_id", "run_id", F.when(skip, "skip").otherwise("recompute").alias("decision"))


def cached_runs(runs: DataFrame, stages: DataFrame, configs: DataFrame, marks: DataFrame) -> DataFrame:
    """The run that can be served for each config, NULL where it must be recomputed.

    On top of the data marks, a recipe edited strictly after the run started makes it stale.
    """
    gate = freshness_gate(runs, stages, configs, marks)
    started = runs.select("run_id", "started_at")
    joined = gate.join(started, "run_id", "left").join(configs.select("config_id", "updated_at"), "config_id")
    edited = F.coalesce(F.col("updated_at") > F.col("started_at"), F.lit(False))
    return joined.select("config_id", F.when((F.col("decision") == "skip") & ~edited, F.col("run_id")).alias("cached_run_id"))


def last_weights(runs: DataFrame, weights: DataFrame) -> DataFrame:
    """Stored weights of each config's latest ok run; a config without one has no rows (cold start)."""
    return weights.join(latest_ok_run(runs, ["config_id"]), "run_id").select("config_id", "run_id", "asset", "weight")


def compare_configs(configs: DataFrame, runs: DataFrame, weights: DataFrame, stages: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """Each config with the weights and objective of its latest ok run; NULLs where it never ran."""
    chosen = configs if wanted is None else configs.filter(F.col("config_id").isin(wanted))
    objective = stages.filter("stage = 'optimize'").select(
        "run_id", json_object(F.col("detail_json"), _OBJECTIVE)["objective"]["form"].alias("objective")
    )
    rows = last_weights(runs, weights).select("run_id", "asset", "weight")
    return (
        chosen.select("config_id", "name", "is_central")
        .join(latest_ok_run(runs, ["config_id"]), "config_id", "left")
        .join(objective, "run_id", "left")
        .join(rows, "run_id", "left")
        .select("config_id", "name", "is_central", "run_id", "objective", "asset", "weight")
    )


def compare_grid(compared: DataFrame, config_ids: list[int]) -> DataFrame:
    """Weights side by side: one row per asset, one column per listed config."""
    rows = compared.filter(F.col("asset").isNotNull())
    return rows.groupBy("asset").pivot("config_id", config_ids).agg(F.first("weight"))


def central_run(configs: DataFrame, runs: DataFrame, stages: DataFrame) -> DataFrame:
    """Stages of the central config's latest ok run."""
    central = configs.filter("is_central").select("config_id")
    last = latest_ok_run(runs.join(central, "config_id", "left_semi"))
    return stages.join(last, "run_id").select("run_id", "stage", "status")


def sweep_stale(runs: DataFrame, now: Column) -> DataFrame:
    """Runs left in ``running`` become errors with a fixed text and a finish time."""
    stale = F.coalesce(F.col("status") == "running", F.lit(False))
    return (
        runs.withColumn("error_text", F.when(stale, SWEEP_TEXT).otherwise(F.col("error_text")))
        .withColumn("finished_at", F.when(stale, now).otherwise(F.col("finished_at")))
        .withColumn("status", F.when(stale, "error").otherwise(F.col("status")))
    )


def set_central(configs: DataFrame, config_id: int) -> DataFrame:
    """Make one config central and all others not; an unknown id stops the job."""
    from panelwright import contracts

    known = configs.filter(F.col("config_id") == config_id).select(F.count(F.lit(1))).scalar()
    chosen = F.when(known == 0, contracts.fail(f"unknown config {config_id}", type_="boolean")).otherwise(F.col("config_id") == config_id)
    return configs.withColumn("is_central", chosen)


def stage_completeness(runs: DataFrame, stages: DataFrame, weights: DataFrame, universe: DataFrame, required: tuple[str, ...] = STAGES) -> DataFrame:
    """Per ok run: required stages missing or not ok, and whether weights cover the universe and sum to one."""
    by_run = stages.filter(F.col("stage").isin(list(required))).groupBy("run_id").agg(
        F.collect_set("stage").alias("_have"), F.collect_set(F.when(F.col("status") != "ok", F.col("stage"))).alias("_bad")
    )
    size = universe.select(F.count_distinct("asset")).scalar()
    known = universe.select("asset", F.lit(1).alias("_k")).distinct()
    held = weights.join(known, "asset", "left").groupBy("run_id").agg(
        F.count("_k").alias("_covered"), F.count(F.lit(1)).alias("_rows"), F.sum("weight").alias("_sum")
    )
    wanted = F.array(*[F.lit(s) for s in required])
    joined = runs.filter("status = 'ok'").select("run_id").join(by_run, "run_id", "left").join(held, "run_id", "left").withColumn("_size", size)
    none = F.array().cast("array<string>")
    missing = F.array_sort(F.array_except(wanted, F.coalesce("_have", none)))
    bad = F.array_sort(F.coalesce("_bad", none))
    whole = F.coalesce((F.col("_covered") == F.col("_size")) & (F.col("_rows") == F.col("_size")), F.lit(False))
    sums = F.coalesce(F.abs(F.col("_sum") - 1.0) <= 1e-9, F.lit(False))
    return joined.select(
        "run_id",
        F.array_join(missing, ",").alias("missing_stages"),
        F.array_join(bad, ",").alias("failed_stages"),
        whole.alias("covers_universe"),
        sums.alias("sums_to_one"),
        ((F.size(missing) == 0) & (F.size(bad) == 0) & whole & sums).alias("complete"),
    )


def stage_durations(stages: DataFrame) -> DataFrame:
    """Seconds between text stamps; NULL when either is missing or unreadable."""
    start, finish = F.try_to_timestamp(F.col("started_at")), F.try_to_timestamp(F.col("finished_at"))
    return stages.withColumn("seconds", (F.unix_micros(finish.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6)


def model_versions(evaluations: DataFrame, by: str = "evaluation_id") -> DataFrame:
    """Distinct model versions in fold order, as one label. Folds per evaluation are few."""
    first = evaluations.groupBy(by, "model_version").agg(F.min("fold").alias("_f"))
    ordered = F.array_sort(F.collect_list(F.struct("_f", "model_version")))
    return first.groupBy(by).agg(F.array_join(F.transform(ordered, lambda x: x["model_version"]), ", ").alias("versions"))


def run_counts(runs: DataFrame) -> DataFrame:
    """Runs per trigger: total, by status, and stuck."""
    return runs.groupBy("trig").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count(F.when(F.col("status") == "ok", 1)).alias("n_ok"),
        F.count(F.when(F.col("status") == "error", 1)).alias("n_error"),
        F.count(F.when(F.col("status") == "skipped", 1)).alias("n_skipped"),
        F.count(F.when(F.col("status").isin("running", "queued"), 1)).alias("n_stuck"),
    )


def latency_percentiles(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    return nearest_rank(samples, by, value, {"p50": 0.50, "p95": 0.95})


def reference_checks(scenarios: DataFrame, configs: DataFrame, runs: DataFrame) -> DataFrame:
    """Which scenarios and configs are in use and so must not be deleted: ``(entity, id, in_use)``."""

    def used(left: DataFrame, column: str, right: DataFrame, entity: str) -> DataFrame:
        hits = right.select(column).distinct().withColumn("_hit", F.lit(True))
        return left.select(column).join(hits, column, "left").select(
            F.lit(entity).alias("entity"), F.col(column).cast("long").alias("id"), F.coalesce("_hit", F.lit(False)).alias("in_use")
        )

    return unite(used(scenarios, "scenario_id", configs, "scenario"), used(configs, "config_id", runs, "config"))


def recipe_problems(configs: DataFrame, scenarios: DataFrame, known: dict[str, list[str]]) -> DataFrame:
    """``(config_id, problem)`` for recipes naming an unknown stage implementation or scenario."""
    joined = configs.join(scenarios.select("scenario_id", "kind"), "scenario_id", "left")
    checks = [
        F.when(~F.col(column).isin(keys), F.concat(F.lit(f"unknown {column} "), F.col(column)))
        for column, keys in known.items()
        if column != "kind"
    ]
    checks.append(F.when(F.col("kind").isNull(), F.lit("unknown scenario")).when(~F.col("kind").isin(known["kind"]), F.concat(F.lit("unknown kind "), F.col("kind"))))
    return joined.select("config_id", F.explode(F.array_compact(F.array(*checks))).alias("problem"))
