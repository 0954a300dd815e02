"""Recipes as rows: forecasts, posteriors and allocations of a whole table of recipes in one job.

Nothing here grows a plan with the number of recipes. Parameters are parsed as columns; all halflives are slots of one
pass over the panel (``ewma_grid``); views of all scenarios are joined. The covariance matrix goes once to every block
of ``RECIPES_PER_BLOCK`` recipes, and one grouped step blends and allocates the whole block next to it, so no matrix is
copied per recipe and no posterior matrix leaves its task.

Results can be kept in a versioned store under the hash of everything they follow from (the recipe with its scenario,
the marks of the universe's data, the previous weights). Recipes found there are read, not computed.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright import contracts
from panelwright.defaults import HALFLIFE_BARS, HORIZON_BARS, MAX_WEIGHT, RISK_AVERSION, TAU, TURNOVER_COST
from panelwright.functions.scalars import json_error, json_object
from panelwright.operators.allocate import one_allocation
from panelwright.operators.blend import blended, equilibrium_prior, view_terms
from panelwright.operators.covariance import ledoit_wolf, pair_moments
from panelwright.operators.ewma_grid import forecast_grid
from panelwright.operators.layout import fresh
from panelwright.operators.ledger import recipe_problems
from panelwright.operators.panel import common_date_panel
from panelwright.operators.returns import latest_rows, log_returns
from panelwright.operators.views import counterfactual_views, historical_views, parse_windows
from panelwright.plans.registry import REGISTRY, known_keys
from panelwright.session import durable, unite
from panelwright.sources.versioned import Store

RECIPES_PER_BLOCK = 256
RESULTS = "recipe_results"
PARAMS = "forecaster struct<halflife: double, members: int, ridge: double>, optimizer struct<min_weight: double>, features map<string, string>"
RESULT_COLUMNS = (
    "asset string, prior_mu double, view_mu double, view_confidence double, omega double, posterior_mu double, posterior_sigma double, "
    "tilt double, weight double, prev_weight double, turnover double, relaxed_turnover boolean, status string"
)
NUMBERS = ["prior_mu", "view_mu", "view_confidence", "omega", "posterior_mu", "posterior_sigma", "tilt", "weight", "prev_weight", "turnover"]


def recipe_settings(recipes: DataFrame, scenarios: DataFrame, on_invalid: str = "raise"):
    """Every recipe with its parsed parameters, the kind of its scenario and the version of its model.

    ``recipes``: config_id, feature_set, forecaster, scenario_id, optimizer and, optionally, ``params_json`` such as
    ``{"forecaster": {"halflife": 21}, "optimizer": {"min_weight": 0.05}}``; missing parameters take their defaults.
    Unknown names, scenarios and parameters out of range stop the job, or leave with ``"quarantine"`` as
    ``(settings, problems)``.
    """
    contracts.check_mode(on_invalid)
    text = F.col("params_json") if "params_json" in recipes.columns else F.lit(None).cast("string")
    parsed = recipes.withColumn("_text", text).withColumn("_p", json_object(F.col("_text"), PARAMS))
    halflife = F.coalesce("_p.forecaster.halflife", F.lit(float(HALFLIFE_BARS)))
    members, ridge = F.coalesce("_p.forecaster.members", F.lit(3)), F.coalesce("_p.forecaster.ridge", F.lit(0.1))
    version = F.when(F.col("forecaster") == "ridge", F.concat(F.lit("ridge:"), members.cast("string"), F.lit(":"), ridge.cast("string")))
    columns = parsed.join(scenarios.select("scenario_id", "kind", "payload_json"), "scenario_id", "left").select(
        "config_id", "feature_set", "forecaster", "scenario_id", "kind", "payload_json", "optimizer",
        halflife.alias("halflife"), members.alias("members"), ridge.alias("ridge"),
        F.coalesce("_p.optimizer.min_weight", F.lit(0.0)).alias("min_weight"),
        F.coalesce(F.to_json("_p.features"), F.lit("{}")).alias("feature_params"),
        F.coalesce(version, F.concat("forecaster", F.lit(":"), halflife.cast("string"))).alias("model_version"),
        json_error(F.col("_text")).alias("_corrupt"),
    )
    in_range = (
        F.when(F.col("_corrupt"), F.lit("parameters are not a JSON object"))
        .when(contracts.not_finite(F.col("halflife")) | (F.col("halflife") <= 0), F.lit("halflife must be finite and positive"))
        .when(contracts.not_finite(F.col("min_weight")) | (F.col("min_weight") < 0), F.lit("min_weight must be >= 0"))
        .when((F.col("members") < 1) | contracts.not_finite(F.col("ridge")) | (F.col("ridge") < 0), F.lit("members and ridge must be positive"))
    )
    own = columns.select("config_id", in_range.alias("problem")).filter(F.col("problem").isNotNull())
    problems = unite(recipe_problems(recipes, scenarios, known_keys()).select("config_id", "problem"), own)
    worst = problems.groupBy("config_id").agg(F.min("problem").alias("_problem"))
    joined = columns.drop("_corrupt").join(worst, "config_id", "left")
    if on_invalid == contracts.QUARANTINE:
        return joined.filter(F.col("_problem").isNull()).drop("_problem"), problems
    stop = contracts.fail("recipe ", F.col("config_id"), ": ", F.col("_problem"), type_="long")
    return joined.withColumn("config_id", F.when(F.col("_problem").isNotNull(), stop).otherwise(F.col("config_id").cast("long"))).drop("_problem")


def model_forecasts(returns: DataFrame, settings: DataFrame) -> DataFrame:
    """``model_version, asset, as_of, horizon_days, mu, sigma``: the newest forecast of every distinct model.

    Distinct halflives come to the driver (a number each) and share one pass. Ridge settings are few by nature and
    are fitted one after the other.
    """
    from panelwright.plans.walk_forward import ridge_latest

    follow = settings.filter("kind = 'forecast'")
    halflives = {r["model_version"]: r["halflife"] for r in follow.filter("forecaster = 'ewma'").select("model_version", "halflife").distinct().collect()}
    named = returns.sparkSession.createDataFrame(sorted(halflives.items()), "model_version string, halflife double")
    grid = forecast_grid(returns, list(halflives.values()), latest=True).join(named, "halflife")
    parts = [grid.select("model_version", "asset", F.col("date").alias("as_of"), F.lit(HORIZON_BARS).alias("horizon_days"), "mu", "sigma")]
    for r in follow.filter("forecaster = 'ridge'").select("model_version", "members", "ridge").distinct().collect():
        made = ridge_latest(returns, r["members"], r["ridge"])
        parts.append(made.select(F.lit(r["model_version"]).alias("model_version"), "asset", F.col("date").alias("as_of"), F.lit(HORIZON_BARS).alias("horizon_days"), "mu", "sigma"))
    return unite(*parts)


def recipe_features(prices: DataFrame, settings: DataFrame, macro: DataFrame | None = None) -> DataFrame:
    """``config_id, asset, name, value``: the newest features of each recipe's feature set.

    Each distinct feature set with its parameters is built once; there are as many as sets are registered times the
    parameters in use. Values of macro series are those released by the asset's newest bar.
    """
    parts = []
    for r in settings.select("feature_set", "feature_params").distinct().collect():
        params = {k: json.loads(v) if v[:1] in "{[" else v for k, v in json.loads(r["feature_params"]).items()}
        built = REGISTRY["feature_set"][r["feature_set"]].build(params)(prices, macro)
        if "series_id" in built.columns:
            values = [c for c in built.columns if c not in ("asset", "date", "series_id", "value")]
            own = built.select("asset", "date", *values).distinct()
            newest = built.groupBy("asset", "series_id").agg(F.max_by("value", "date").alias("value")).filter("series_id IS NOT NULL")
            released = newest.select("asset", F.col("series_id").alias("name"), "value")
        else:
            values, own, released = [c for c in built.columns if c not in ("asset", "date")], built, None
        rows = latest_rows(own, "asset", "date").unpivot(["asset"], values, "name", "value")
        rows = unite(rows, released) if released is not None else rows
        parts.append(rows.withColumn("feature_set", F.lit(r["feature_set"])).withColumn("feature_params", F.lit(r["feature_params"])))
    if not parts:
        return settings.sparkSession.createDataFrame([], "config_id long, asset string, name string, value double")
    return settings.select("config_id", "feature_set", "feature_params").join(unite(*parts), ["feature_set", "feature_params"]).select("config_id", "asset", "name", "value")


def recipe_views(settings: DataFrame, scenarios: DataFrame, forecasts: DataFrame, returns: DataFrame, universe: DataFrame) -> DataFrame:
    """``config_id, asset, mu, sigma`` from each recipe's own source of views."""
    used = settings.select("scenario_id").distinct()
    wanted = scenarios.join(used, "scenario_id", "left_semi")
    from_model = settings.filter("kind = 'forecast'").select("config_id", "model_version").join(forecasts, "model_version").select("config_id", "asset", "mu", "sigma")
    written = unite(historical_views(returns, parse_windows(wanted)), counterfactual_views(wanted, universe))
    others = settings.filter("kind <> 'forecast'").select("config_id", "scenario_id").join(written, "scenario_id")
    return unite(from_model, others.select("config_id", "asset", "mu", "sigma"))


def solve_blocks(
    settings: DataFrame,
    terms: DataFrame,
    cov: DataFrame,
    prior: DataFrame,
    previous: DataFrame | None,
    allocations: bool = True,
    strict: bool = True,
    tau: float = TAU,
    per_block: int = RECIPES_PER_BLOCK,
) -> DataFrame:
    """``config_id`` and ``RESULT_COLUMNS``: posterior and weights of every recipe, blocks of recipes by the matrix.

    A block is one group: at most about ``per_block`` recipes and one matrix of the universe, whatever the number of
    recipes. A recipe that can't be allocated stops the job or, not ``strict``, has its reason in ``status``.
    """
    blocks = max(1, math.ceil(settings.count() / per_block))
    block = F.pmod(F.xxhash64("config_id"), F.lit(blocks)).cast("int").alias("_block")
    lines = [settings.select("config_id", "optimizer", "min_weight"), terms.select("config_id", "asset", "view_mu", "view_confidence", "omega")]
    if previous is not None:
        # Weights of assets that left the universe come along, so they are noticed.
        lines.append(previous.join(settings.select("config_id"), "config_id", "left_semi").select("config_id", "asset", F.col("weight").alias("prev_weight")))
    inputs = unite(*lines, fill=True)
    if previous is None:
        inputs = inputs.withColumn("prev_weight", F.lit(None).cast("double"))
    row = cov.groupBy(F.col("asset_i").alias("asset")).agg(F.array_sort(F.collect_list(F.struct("asset_j", "cov"))).alias("row"))
    matrix = row.join(prior, "asset").withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    columns = ["config_id", *[c.split()[0] for c in RESULT_COLUMNS.split(", ")]]

    def run(matrix: pd.DataFrame, inputs: pd.DataFrame) -> pd.DataFrame:
        if matrix.empty or inputs.empty:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in columns})
        matrix = matrix.sort_values("asset", kind="stable").reset_index(drop=True)
        names = matrix["asset"].to_numpy()
        s = np.array([[x["cov"] for x in r] for r in matrix["row"]], float)
        s = (s + s.T) / 2
        pi = matrix["prior_mu"].to_numpy(float)
        out = []
        for config, own in inputs.groupby("config_id", sort=False):
            line = own[own["asset"].isna()].iloc[0]
            stated = own[own["view_mu"].notna()].set_index("asset").reindex(names)
            m, total = blended(s, pi, stated["view_mu"].to_numpy(float), stated["omega"].to_numpy(float), tau)
            part = pd.DataFrame({"config_id": config, "asset": names, "prior_mu": pi, "view_mu": stated["view_mu"].to_numpy(float)})
            part["view_confidence"], part["omega"] = stated["view_confidence"].to_numpy(float), stated["omega"].to_numpy(float)
            part["posterior_mu"], part["posterior_sigma"], part["tilt"] = m, np.sqrt(np.diag(total)), m - pi
            weights, old, relaxed, status = None, None, False, "not asked"
            if allocations:
                stored = own[own["prev_weight"].notna()]
                rule = {"optimizer": line["optimizer"], "min_weight": line["min_weight"], "w_max": MAX_WEIGHT, "delta": RISK_AVERSION, "cost": TURNOVER_COST}
                values = stored.set_index("asset")["prev_weight"].astype(float) if len(stored) else None
                weights, old, relaxed, status, problem = one_allocation(names, m, total, rule, values)
                if problem is not None:
                    if strict:
                        raise ValueError(f"allocation of recipe {config}: {problem}")
                    weights, status = None, f"invalid: {problem}"
            part["weight"] = weights if weights is not None else np.nan
            part["prev_weight"] = old if old is not None else np.nan
            part["turnover"] = np.abs(part["weight"] - part["prev_weight"]) if old is not None else 0.0
            part["relaxed_turnover"], part["status"] = relaxed, status
            out.append(part)
        return pd.concat(out, ignore_index=True)[columns]

    solved = fresh(matrix).groupBy("_block").cogroup(fresh(inputs.withColumn("_block", block)).groupBy("_block")).applyInPandas(run, f"config_id long, {RESULT_COLUMNS}")
    for c in NUMBERS:
        solved = solved.withColumn(c, F.nanvl(c, F.lit(None).cast("double")))
    return solved


def data_mark(prices: DataFrame, universe: DataFrame) -> Column:
    """A digest of the universe's data: its assets, their newest date, row count and the sum of the rows' hashes, which
    a revision of any bar changes. One map-side combined pass; two assets can't trade places."""
    rows = prices.join(universe.select("asset"), "asset", "left_semi").select("asset", "date", "adj_close")
    digest = F.sum(F.xxhash64("asset", "date", "adj_close").cast("decimal(20,0)"))
    each = rows.groupBy("asset").agg(F.struct("asset", F.max("date"), F.count(F.lit(1)), digest).alias("m"))
    return each.agg(F.sha2(F.to_json(F.array_sort(F.collect_list("m"))), 256)).scalar()


def with_result_keys(settings: DataFrame, mark: Column, previous: DataFrame | None) -> DataFrame:
    """``result_key``: the hash of all that a recipe's results follow from. Its id and name are no part of it."""
    rule = F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in ("model_version", "kind", "payload_json", "optimizer", "min_weight", "scenario_id")]))
    out = settings
    if previous is not None:
        held = previous.groupBy("config_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("asset", "weight")))).alias("_held"))
        out = out.join(held, "config_id", "left")
    else:
        out = out.withColumn("_held", F.lit(None).cast("string"))
    return out.withColumn("result_key", F.sha2(F.concat_ws("|", rule, F.coalesce("_held", F.lit("cold")), mark), 256)).drop("_held")


def run_recipe_table(
    prices: DataFrame,
    recipes: DataFrame,
    scenarios: DataFrame,
    universe: DataFrame,
    benchmark: DataFrame,
    previous: DataFrame | None = None,
    macro: DataFrame | None = None,
    results: Store | None = None,
    allocations: bool = True,
    features: bool = False,
    on_invalid: str = "raise",
) -> dict[str, DataFrame]:
    """All stages of all recipes over one universe; tables by ``config_id``.

    ``forecasts`` (with ``as_of, horizon_days, model_version``), ``posteriors``, ``target_weights`` and, on wish,
    ``features``; ``computed`` has the recipes that were computed rather than read from ``results``. ``previous`` is
    ``config_id, asset, weight`` (see ``ledger.last_weights``); a recipe without rows there starts cold. ``prices``
    is read several times: pass a stored panel. With ``"quarantine"`` bad recipes leave as ``rejected``
    (``config_id, problem``), and recipes without a feasible allocation have no weights but a ``status``.
    """
    chosen = recipe_settings(recipes, scenarios, on_invalid)
    settings, rejected = chosen if isinstance(chosen, tuple) else (chosen, None)
    settings = durable(settings)
    mine = prices.join(universe.select("asset"), "asset", "left_semi")
    todo, known = settings, None
    if results is not None:
        settings = durable(with_result_keys(settings, data_mark(mine, universe), previous))
        if RESULTS not in results.manifest()["tables"]:
            shape = settings.sparkSession.createDataFrame([], f"result_key string, {RESULT_COLUMNS}")
            results.declare(RESULTS, shape, ["result_key", "asset"])
        # The version read here is the one all of this run sees, whoever commits meanwhile.
        held = results.snapshot(RESULTS)
        known = held.read()
        todo = settings.join(known.select("result_key").distinct(), "result_key", "left_anti")
        # One of the recipes with equal keys is computed for all of them.
        todo = durable(todo.withColumn("_first", F.col("config_id")).groupBy("result_key").agg(F.min_by(F.struct(*todo.columns), "_first").alias("r")).select("r.*").select(*todo.columns))
    returns = log_returns(mine)
    if results is not None and todo.isEmpty():
        solved = None
        forecasts = todo.sparkSession.createDataFrame([], "model_version string, asset string, as_of date, horizon_days int, mu double, sigma double")
    else:
        forecasts = durable(model_forecasts(returns, todo))
        ours, alike = todo, None
        if not allocations and results is None:
            # Without allocations a posterior follows from the views alone: one recipe of each kind of views is solved.
            views = F.when(F.col("kind") == "forecast", F.concat(F.lit("model "), "model_version")).otherwise(F.concat(F.lit("scenario "), F.col("scenario_id").cast("string")))
            alike = todo.withColumn("_views", views)
            ours = durable(alike.groupBy("_views").agg(F.min_by(F.struct(*todo.columns), "config_id").alias("r")).select("r.*"))
        cov = durable(ledoit_wolf(durable(pair_moments(common_date_panel(returns)))))
        terms = view_terms(recipe_views(ours, scenarios, forecasts, returns, universe), cov, ["config_id"])
        solved = durable(solve_blocks(ours, terms, cov, equilibrium_prior(cov, benchmark), previous, allocations, on_invalid == contracts.RAISE))
        if alike is not None:
            shared = solved.join(alike.select("config_id", "_views"), "config_id").drop("config_id")
            solved = alike.select("config_id", "_views").join(shared, "_views").drop("_views").select(*solved.columns)
    if results is not None:
        if solved is not None:
            keyed = solved.join(todo.select("config_id", "result_key"), "config_id").drop("config_id")
            results.commit({RESULTS: keyed}, unique=True)
            fresh_rows = keyed.select(*known.columns)
            known = unite(known.join(todo.select("result_key"), "result_key", "left_anti").select(*known.columns), fresh_rows)
        solved = settings.select("config_id", "result_key").join(known, "result_key").drop("result_key")
    out = {
        "forecasts": settings.filter("kind = 'forecast'").select("config_id", "model_version").join(forecasts, "model_version").select("config_id", "asset", "as_of", "horizon_days", "model_version", "mu", "sigma"),
        "posteriors": solved.select("config_id", "asset", *NUMBERS[:7]),
        "target_weights": solved.filter(F.col("weight").isNotNull()).select("config_id", "asset", "weight", "prev_weight", "turnover", "relaxed_turnover", "status"),
        "computed": todo.select("config_id"),
    }
    if features:
        out["features"] = recipe_features(mine, settings, macro)
    if on_invalid == contracts.QUARANTINE:
        failed = solved.filter(F.col("status").startswith("invalid")).select("config_id", F.col("status").alias("problem")).distinct()
        out["rejected"] = unite(rejected.select("config_id", "problem"), failed)
    return out
