"""Where views come from: the forecaster, a past window, or hand-written scenarios."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright import contracts
from panelwright.defaults import HORIZON_BARS, SIGMA_FLOOR
from panelwright.functions.scalars import horizon_mean, horizon_sigma, json_object
from panelwright.operators.moment_tree import window_moments
from panelwright.session import unite

KINDS = ("forecast", "historical", "counterfactual")
_PAYLOAD = "map<string, struct<mu: double, confidence: double>>"
_WINDOW = "window_start string, window_end string"


def check_forecasts(forecasts: DataFrame, universe: DataFrame, key: str = "asset") -> DataFrame:
    """``(asset, reason)`` for forecasts that are not finite, have no spread, or do not cover the universe."""
    mu, sigma = F.col("mu"), F.col("sigma")
    broken = forecasts.select(
        key,
        F.when(contracts.not_finite(mu), "mu not finite").when(contracts.not_finite(sigma) | (sigma <= 0), "sigma not positive and finite").alias("reason"),
    ).filter(F.col("reason").isNotNull())
    missing = universe.select(key).join(forecasts, key, "left_anti").select(key, F.lit("no forecast").alias("reason"))
    unknown = forecasts.join(universe.select(key), key, "left_anti").select(key, F.lit("not in universe").alias("reason"))
    return unite(broken, missing, unknown)


def forecast_views(forecasts: DataFrame, key: str = "asset") -> DataFrame:
    return forecasts.select(key, "mu", "sigma")


def parse_windows(scenarios: DataFrame, scenario: str = "scenario_id") -> DataFrame:
    """Historical scenarios with their window bounds; a missing bound is open."""
    parsed = json_object(F.col("payload_json"), _WINDOW)
    return scenarios.filter("kind = 'historical'").select(
        scenario,
        F.to_date(parsed["window_start"]).alias("window_start"),
        F.to_date(parsed["window_end"]).alias("window_end"),
    )


def historical_views(
    returns: DataFrame, windows: DataFrame, scenario: str = "scenario_id", key: str = "asset", order: str = "date", ret: str = "log_return"
) -> DataFrame:
    """Mean and deviation of each asset's returns inside each scenario's window, on the H-day scale.

    Windows are put together from a tree of moments over power-of-two date ranges, so neither a return row nor a
    plan grows with the number of scenarios.
    """
    moments = window_moments(returns, windows, scenario, key, order, ret)
    deviation = F.sqrt(F.col("square") / (F.col("n") - 1))
    return moments.filter("n >= 2").select(
        scenario,
        key,
        (F.col("mean") * HORIZON_BARS).alias("mu"),
        F.greatest(deviation * math.sqrt(HORIZON_BARS), F.lit(SIGMA_FLOOR)).alias("sigma"),
    )


def counterfactual_views(
    scenarios: DataFrame, universe: DataFrame, scenario: str = "scenario_id", key: str = "asset", on_invalid: str = "raise"
):
    """Hand-written annual views from JSON, turned into the H-day pair the blend takes.

    A view for an asset outside the universe, or without ``mu``, is a violation. Views may cover any
    subset of assets.
    """
    contracts.check_mode(on_invalid)
    listed = scenarios.filter("kind = 'counterfactual'").select(
        scenario, F.explode(json_object(F.col("payload_json"), _PAYLOAD)).alias(key, "_view")
    )
    known = universe.select(key, F.lit(True).alias("_known"))
    checked = listed.join(known, key, "left").withColumn(
        "reason",
        F.when(F.col("_known").isNull(), F.lit("asset not in universe")).when(F.col("_view.mu").isNull(), F.lit("view has no mu")),
    )
    mu = horizon_mean(F.col("_view.mu"))
    if on_invalid == contracts.RAISE:
        mu = F.when(
            F.col("reason").isNotNull(), contracts.fail("scenario ", F.col(scenario), " view for ", F.col(key), ": ", F.col("reason"))
        ).otherwise(mu)
        good = checked
    else:
        good = checked.filter(F.col("reason").isNull())
    out = good.select(scenario, key, mu.alias("mu"), F.coalesce("_view.confidence", F.lit(0.5)).alias("_c"))
    out = out.select(scenario, key, "mu", horizon_sigma(F.col("mu"), F.col("_c")).alias("sigma"))
    if on_invalid == contracts.RAISE:
        return out
    return out, checked.filter(F.col("reason").isNotNull()).select(scenario, key, "reason")

