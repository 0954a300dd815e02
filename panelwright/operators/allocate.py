"""Constrained allocations for many groups in one job."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright import contracts
from panelwright.defaults import MAX_WEIGHT, RISK_AVERSION, TURNOVER_COST, WEIGHT_CLIP
from panelwright.functions.quadratic import box_problem, regularized, solve, tidy
from panelwright.operators.layout import fresh

OPTIMIZERS = ("mvu", "min_variance")
_PREVIOUS_TOLERANCE = 1e-6


def box_feasibility(groups: DataFrame, by: list[str]) -> DataFrame:
    """``(by, reason)`` for groups whose bounds cannot meet the budget. Needs n_assets, w_max, min_weight."""
    n, high, low = F.col("n_assets"), F.col("w_max"), F.col("min_weight")
    reason = (
        F.when(contracts.not_finite(high) | (high <= 0) | (high > 1), "w_max must be in (0, 1]")
        .when(high * n < 1, "w_max too small for the budget")
        .when(contracts.not_finite(low) | (low < 0), "min_weight must be >= 0")
        .when(low > high, "min_weight exceeds w_max")
        .when(low * n > 1, "min_weight too large for the budget")
    )
    return groups.select(*by, reason.alias("reason")).filter(F.col("reason").isNotNull())


def expand_previous(previous: DataFrame, universe: DataFrame, by: list[str]) -> DataFrame:
    """Stored weights filled with zeros over the universe, with the reason a group's weights are unusable."""
    # Every group times every asset is the result; which side is sent around is left to Spark's size check.
    grid = previous.select(*by).distinct().crossJoin(universe.select("asset").distinct())
    filled = grid.join(previous.select(*by, "asset", "weight"), [*by, "asset"], "left").select(
        *by, "asset", F.coalesce("weight", F.lit(0.0)).alias("prev_weight")
    )
    unknown = previous.join(universe.select("asset"), "asset", "left_anti").select(*by).distinct().withColumn("_unknown", F.lit(True))
    bounds = filled.groupBy(*by).agg(
        F.sum("prev_weight").alias("_sum"), F.min("prev_weight").alias("_low"), F.max("prev_weight").alias("_high")
    ).join(unknown, by, "left")
    reason = (
        F.when(F.col("_unknown"), "asset outside the universe")
        .when(~((F.col("_low") >= 0) & (F.col("_high") <= 1)), "weight outside [0, 1]")
        .when(~(F.abs(F.col("_sum") - 1) <= _PREVIOUS_TOLERANCE), "weights do not sum to 1")
    )
    return filled.join(bounds.select(*by, reason.alias("reason")), by)


def clip_renormalize(weights: DataFrame, by: list[str], weight: str = "weight", clip: float = WEIGHT_CLIP) -> DataFrame:
    """Weights under the clip become zero and each group sums to one again (map-side combined totals)."""
    kept = weights.withColumn(weight, F.when(F.col(weight) < clip, 0.0).otherwise(F.col(weight)))
    totals = kept.groupBy(*by).agg(F.sum(weight).alias("_total"))
    return kept.join(totals, by).withColumn(weight, F.col(weight) / F.col("_total")).drop("_total")


def turnover(weights: DataFrame, previous: DataFrame, by: list[str]) -> DataFrame:
    """Absolute change per asset; zero where the group has no previous weights."""
    old = previous.select(*by, "asset", F.col("weight").alias("_old"))
    known = previous.select(*by).distinct().withColumn("_known", F.lit(True))
    joined = weights.join(old, [*by, "asset"], "left").join(known, by, "left")
    was = F.when(F.col("_known"), F.coalesce("_old", F.lit(0.0)))
    return joined.withColumn("prev_weight", was).withColumn(
        "turnover", F.coalesce(F.abs(F.col("weight") - was), F.lit(0.0))
    ).drop("_old", "_known")


def one_allocation(
    names: np.ndarray, mu: np.ndarray, sigma: np.ndarray, line: pd.Series | dict, stored: pd.Series | None
) -> tuple[np.ndarray | None, np.ndarray | None, bool, str, str | None]:
    """Weights of one portfolio, its previous ones, whether turnover was given up, a status, and what is wrong.

    ``line`` holds optimizer, min_weight, w_max, delta and cost; ``stored`` the previous weights by asset, if any.
    """
    old = None
    problem = box_problem(len(names), line["min_weight"], line["w_max"])
    if stored is not None:
        if not set(stored.index) <= set(names):
            problem = problem or "previous weights hold an asset outside the universe"
        elif not ((stored >= 0) & (stored <= 1)).all() or abs(stored.sum() - 1.0) > _PREVIOUS_TOLERANCE:
            problem = problem or "previous weights must be in [0, 1] and sum to 1"
        old = stored.reindex(names).fillna(0.0).to_numpy(float)
    if line["optimizer"] not in OPTIMIZERS:
        problem = problem or f"unknown optimizer {line['optimizer']}"
    if not (np.isfinite(line["delta"]) and line["delta"] > 0 and np.isfinite(line["cost"]) and line["cost"] >= 0):
        problem = problem or "delta must be positive and cost not negative"
    if not np.isfinite(sigma).all() or (line["optimizer"] == "mvu" and not np.isfinite(mu).all()):
        problem = problem or "mu or covariance not finite"
    elif not np.allclose(sigma, sigma.T, rtol=0.0, atol=1e-10):
        problem = problem or "covariance not symmetric"
    safe = regularized((sigma + sigma.T) / 2) if problem is None else None
    if problem is None and safe is None:
        problem = "covariance is indefinite"
    weights, relaxed, status = None, False, "optimal"
    if problem is None:
        low, high = float(line["min_weight"]), float(line["w_max"])
        if line["optimizer"] == "min_variance":
            weights = solve(np.zeros(len(names)), safe, None, 2.0, 0.0, low, high)
        else:
            weights = solve(mu, safe, old, float(line["delta"]), float(line["cost"]), low, high)
            if weights is None and old is not None:
                weights, relaxed, status = solve(mu, safe, None, float(line["delta"]), 0.0, low, high), True, "optimal without turnover"
        problem = None if weights is not None else "solver did not converge"
    return None if weights is None else tidy(weights), old, relaxed, status, problem


def allocate(
    post: DataFrame,
    recipes: DataFrame,
    previous: DataFrame | None,
    by: list[str],
    delta: float = RISK_AVERSION,
    cost: float = TURNOVER_COST,
    w_max: float = MAX_WEIGHT,
    on_invalid: str = "raise",
):
    """Solve every group of ``post`` (long matrix with ``mu`` on the diagonal).

    ``recipes`` carries ``optimizer`` and optionally ``min_weight``, ``w_max``, ``delta``, ``cost`` per
    group; ``previous`` carries stored weights. A group without previous weights drops the turnover term.
    A failing solve is retried once without turnover and flagged.
    """
    contracts.check_mode(on_invalid)
    settings = recipes.select(
        *by,
        "optimizer",
        *[
            (F.coalesce(F.col(c).cast("double"), F.lit(v)) if c in recipes.columns else F.lit(float(v))).alias(c)
            for c, v in (("min_weight", 0.0), ("w_max", w_max), ("delta", delta), ("cost", cost))
        ],
    )
    if previous is None:
        inputs = settings.withColumn("asset", F.lit(None).cast("string")).withColumn("weight", F.lit(None).cast("double"))
    else:
        inputs = settings.join(previous.select(*by, "asset", "weight"), by, "left")
    types = {f.name: f.dataType.simpleString() for f in post.schema.fields}
    columns = [*by, "asset", "weight", "prev_weight", "turnover", "relaxed_turnover", "status"]
    strict = on_invalid == contracts.RAISE

    def run(matrix: pd.DataFrame, inputs: pd.DataFrame) -> pd.DataFrame:
        if matrix.empty or inputs.empty:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in columns})
        wide = matrix.pivot(index="asset_i", columns="asset_j", values="cov")
        names = wide.index.to_numpy()
        sigma = wide.loc[names, names].to_numpy(float)
        diagonal = matrix[matrix["asset_i"] == matrix["asset_j"]].set_index("asset_i")
        mu = diagonal.loc[names, "mu"].to_numpy(float)
        line = inputs.iloc[0]
        stored = inputs.dropna(subset=["asset"])
        values = stored.set_index("asset")["weight"].astype(float) if len(stored) else None
        weights, old, relaxed, status, problem = one_allocation(names, mu, sigma, line, values)
        if problem is not None:
            group = {b: matrix[b].iloc[0] for b in by}
            if strict:
                raise ValueError(f"allocation {group}: {problem}")
            weights, status = np.full(len(names), np.nan), f"invalid: {problem}"
        frame = pd.DataFrame({"asset": names, "weight": weights})
        frame["prev_weight"] = old if old is not None else np.nan
        frame["turnover"] = np.abs(weights - old) if old is not None else 0.0
        frame["relaxed_turnover"], frame["status"] = relaxed, status
        for b in by:
            frame[b] = matrix[b].iloc[0]
        return frame[columns]

    schema = ", ".join(f"{b} {types[b]}" for b in by) + (
        f", asset {types['asset_i']}, weight double, prev_weight double, turnover double, relaxed_turnover boolean, status string"
    )
    solved = fresh(post).groupBy(*by).cogroup(fresh(inputs).groupBy(*by)).applyInPandas(run, schema)
    for c in ("weight", "prev_weight", "turnover"):
        solved = solved.withColumn(c, F.nanvl(c, F.lit(None).cast("double")))
    if strict:
        return solved
    bad = solved.filter(F.col("status").startswith("invalid"))
    report = bad.groupBy(*by).agg(F.first("status").alias("reason"), F.count(F.lit(1)).alias("n_bad"))
    return solved.filter(~F.col("status").startswith("invalid")), report
