"""Stage implementations by name, their parameters, and recipe resolution."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from panelwright.defaults import HALFLIFE_BARS
from panelwright.operators.allocate import OPTIMIZERS as OPTIMIZER_KEYS
from panelwright.operators.asof import asof_join
from panelwright.operators.ewma import latest_forecast
from panelwright.operators.panel import feature_panel
from panelwright.operators.returns import log_returns, return_features
from panelwright.operators.views import KINDS


@dataclass(frozen=True)
class Param:
    name: str
    type: str
    default: object
    description: str


@dataclass(frozen=True)
class Stage:
    build: Callable
    params: tuple[Param, ...]
    description: str


@dataclass(frozen=True)
class Recipe:
    config_id: int
    name: str
    feature_set: str = "basic"
    forecaster: str = "ewma"
    scenario_id: int = 1
    optimizer: str = "mvu"
    params: Mapping[str, Mapping[str, object]] = field(default_factory=dict)


@dataclass(frozen=True)
class Stack:
    features: Callable
    forecaster: Callable
    view_kind: str
    optimizer: str
    optimizer_params: dict


def number(params: Mapping[str, object], name: str, default: float) -> float:
    value = params.get(name, default)
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError(f"parameter {name!r} must be a number, got {value!r}")
    return float(value)


def _basic(params: Mapping[str, object]) -> Callable:
    return lambda prices, macro=None, n_assets=None: return_features(prices)


def _with_macro(params: Mapping[str, object]) -> Callable:
    orders = params.get("d_by_asset") or None

    def build(prices: DataFrame, macro: DataFrame | None = None, n_assets: int | None = None) -> DataFrame:
        panel = feature_panel(prices, n_assets, orders)
        if macro is None:
            return panel
        names = params.get("series_ids")
        return panel.join(asof_join(panel.select("date"), macro, series_ids=names), "date", "left")

    return build


def _ewma(params: Mapping[str, object]) -> Callable:
    halflife = number(params, "halflife", HALFLIFE_BARS)
    return lambda prices: latest_forecast(log_returns(prices), halflife=halflife).select("asset", "mu", "sigma")


def _ridge(params: Mapping[str, object]) -> Callable:
    from panelwright.plans.walk_forward import ridge_latest

    members, strength = int(number(params, "members", 3)), number(params, "ridge", 0.1)
    return lambda prices: ridge_latest(log_returns(prices), members, strength).select("asset", "mu", "sigma")


def _optimizer(key: str) -> Callable:
    return lambda params: (key, {"min_weight": number(params, "min_weight", 0.0)})


_MIN_WEIGHT = Param("min_weight", "float", 0.0, "lowest weight of every asset")
REGISTRY: dict[str, dict[str, Stage]] = {
    "feature_set": {
        "basic": Stage(_basic, (), "returns and realized volatility"),
        "fracdiff_macro": Stage(
            _with_macro,
            (
                Param("d_by_asset", "map", None, "frozen fractional order per asset; none leaves the column out"),
                Param("series_ids", "list", None, "macro series to join as of their release"),
            ),
            "returns, volatility, fractional differences and point-in-time macro values",
        ),
    },
    "forecaster": {
        "ewma": Stage(_ewma, (Param("halflife", "float", HALFLIFE_BARS, "halflife in bars"),), "weighted mean of returns"),
        "ridge": Stage(
            _ridge,
            (Param("members", "int", 3, "ensemble size"), Param("ridge", "float", 0.1, "penalty")),
            "ridge regression ensemble on return windows",
        ),
    },
    "kind": {
        "forecast": Stage(lambda p: KINDS[0], (), "views are the forecasts"),
        "historical": Stage(
            lambda p: KINDS[1],
            (Param("window_start", "str", None, "first date"), Param("window_end", "str", None, "last date")),
            "views are realized returns of a window",
        ),
        "counterfactual": Stage(lambda p: KINDS[2], (Param("views", "map", None, "annual mu and confidence per asset"),), "hand-written views"),
    },
    "optimizer": {
        OPTIMIZER_KEYS[0]: Stage(_optimizer(OPTIMIZER_KEYS[0]), (_MIN_WEIGHT,), "mean-variance utility with turnover cost"),
        OPTIMIZER_KEYS[1]: Stage(_optimizer(OPTIMIZER_KEYS[1]), (_MIN_WEIGHT,), "least variance"),
    },
}


def known_keys() -> dict[str, list[str]]:
    return {stage: sorted(entries) for stage, entries in REGISTRY.items()}


def _pick(stage: str, key: str) -> Stage:
    if key not in REGISTRY[stage]:
        raise ValueError(f"unknown {stage} {key!r}; registered: {sorted(REGISTRY[stage])}")
    return REGISTRY[stage][key]


def resolve(recipe: Recipe, kind: str, forecaster_override: Callable | None = None) -> Stack:
    """Turn a recipe into callables before any job starts; an override skips the recipe's forecaster."""
    features = _pick("feature_set", recipe.feature_set).build(recipe.params.get("features", {}))
    if forecaster_override is not None:
        forecaster = forecaster_override
    else:
        forecaster = _pick("forecaster", recipe.forecaster).build(recipe.params.get("forecaster", {}))
    view_kind = _pick("kind", kind).build({})
    optimizer, settings = _pick("optimizer", recipe.optimizer).build(recipe.params.get("optimizer", {}))
    return Stack(features, forecaster, view_kind, optimizer, settings)


def recipe_rows(spark: SparkSession, recipes: list[Recipe]) -> DataFrame:
    """Recipes written in code as rows, for ``recipe_table``."""
    rows = [(r.config_id, r.name, r.feature_set, r.forecaster, r.scenario_id, r.optimizer, json.dumps({k: dict(v) for k, v in r.params.items()})) for r in recipes]
    return spark.createDataFrame(rows, "config_id long, name string, feature_set string, forecaster string, scenario_id long, optimizer string, params_json string")


def manifest(spark: SparkSession) -> DataFrame:
    """Every registered stage and parameter as rows."""
    rows = [
        (stage, key, entry.description, p.name, p.type, None if p.default is None else str(p.default), p.description)
        for stage, entries in REGISTRY.items()
        for key, entry in entries.items()
        for p in (entry.params or (Param(None, None, None, None),))
    ]
    return spark.createDataFrame(
        rows, "stage string, key string, description string, param string, type string, default_value string, param_description string"
    )
