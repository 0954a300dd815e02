"""The registered queries: each operator run over whole benchmark tables or panels derived from them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.defaults import OVERLAP_DAYS
from panelwright.functions.scalars import annualize_mean, annualize_vol, confidence, json_error, json_object
from panelwright.operators import (
    allocate as al,
    asof,
    blend,
    challenger,
    covariance as cv,
    embeddings as em,
    evaluate as ev,
    folds as fo,
    fracdiff as fd,
    ingest as ing,
    ledger as led,
    panel as pn,
    returns as rt,
    views as vw,
    windows as win,
)
from panelwright.operators.ewma import ewma_forecast, ewma_means, latest_forecast
from panelwright.plans.recipe_table import recipe_features, recipe_settings, run_recipe_table
from panelwright.plans.registry import Recipe, known_keys, recipe_rows
from panelwright.plans.walk_forward import evaluation_frame, joint_positions, ridge_latest, ridge_walk_forward, weighted_models
from panelwright.session import durable, stored_folder, unite
from panelwright.sources import derived as src
from panelwright.sources.panel_store import normalize_bars, slice_panel
from panelwright.sources.versioned import Store
from panelwright.streaming import ewma_state, price_ingest
from panelwright.streaming.bars import tick_bars

ASSETS = ["AF", "AO", "NF", "NO", "RF", "RO"]
FEATURES = ["log_return", "realized_vol"]
FOLDS = 4
HALFLIVES = {"ewma63": 63.0, "ewma21": 21.0}
SCENARIOS = [
    (1, "forecast", None),
    (2, "historical", "{}"),
    (3, "historical", '{"window_start": "1996-01-01", "window_end": "1997-12-31"}'),
    (4, "historical", '{"window_end": "1998-12-31"}'),
    (5, "historical", '{"window_start": "1999-06-15"}'),
    (6, "counterfactual", '{"RO": {"mu": 0.073, "confidence": 0.62}}'),
    (7, "counterfactual", '{"NF": {"mu": 0.021, "confidence": 0.35}, "AO": {"mu": -0.088}, "RO": {"mu": 0.055, "confidence": 0.7}}'),
]
SUPPLIER_CONFIDENCES = (0.25, 0.4, 0.55, 0.8)
KINDS = {i: kind for i, kind, _ in SCENARIOS}

REGISTERED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
    REGISTERED[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    for name, n in digits.items():
        df = df.withColumn(name, F.round(name, n))
    return df


def longs(df: DataFrame, *names: str) -> DataFrame:
    for name in names:
        df = df.withColumn(name, F.col(name).cast("long"))
    return df


def scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCENARIOS, "scenario_id long, kind string, payload_json string")


def universe(df: DataFrame) -> DataFrame:
    return df.select("asset").distinct()


def wide_universe(df: DataFrame) -> DataFrame:
    """The assets of a panel and two that have no rows."""
    ghosts = df.sparkSession.createDataFrame([("XX",), ("YY",)], "asset string")
    return unite(universe(df), ghosts)


def joint(spark: SparkSession, sf: str) -> DataFrame:
    return pn.common_date_panel(rt.log_returns(src.prices(spark, sf)), len(ASSETS))


# --- ingest -----------------------------------------------------------------------------------


@query
def read_panel(spark, sf):
    return slice_panel(src.supplier_prices(spark, sf), None, "1995-01-01", "2001-01-01")


@query
def normalized_bars(spark, sf):
    bars = tick_bars(src.table(spark, sf, "events"))
    raw = bars.select(
        "asset", F.col("bar_start").alias("Date"), F.col("open").alias("Open"), F.col("high").alias("High"),
        F.col("low").alias("Low"), F.col("close").alias("Close"), F.col("n_ticks").alias("Volume"),
    )
    return normalize_bars(raw)


@query
def panel_contract(spark, sf):
    lines = src.table(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("asset"),
        F.when(F.col("l_quantity") == 50, F.date_format("l_shipdate", "yyyy/MM/dd")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("date"),
    )
    return ing.check_panel(lines, ["asset", "date"])


@query
def clean_numeric(spark, sf):
    orders = src.table(spark, sf, "orders")
    day = F.dayofmonth("o_orderdate")
    text = (
        F.when(day == 13, ".").when(day == 14, "  ").when(day == 15, "n/a").when(day == 16, "NaN")
        .otherwise(F.concat(F.lit(" "), F.col("o_totalprice").cast("string")))
    )
    return ing.clean_numeric(orders.select(F.col("o_orderkey").alias("row_id"), text.alias("value")), "value")


@query
def finite_audit(spark, sf):
    out = ing.finite_audit(src.macro(spark, sf), "value", "series_id", "obs_date")
    return out.select("series_id", "reason", "n_bad", F.array_join("first_keys", ",").alias("first_keys"))


def _split_store(spark, sf):
    panel = src.supplier_prices(spark, sf).select("asset", "date", "adj_close", "volume")
    stored = panel.filter(F.col("date") <= F.lit("2000-12-31").cast("date"))
    updates = panel.filter(F.col("date") >= F.lit("2000-07-01").cast("date")).select("asset", "date", (F.col("adj_close") * 2).alias("adj_close"))
    return panel, stored, updates


@query
def upsert_prices(spark, sf):
    _, stored, updates = _split_store(spark, sf)
    return ing.upsert(stored, updates, ["asset", "date"])


def _stored_versions(spark, sf):
    """A store holding the early history, then an upsert of later prices, compacted, then rows of one ending rebased."""
    panel, stored, updates = _split_store(spark, sf)
    store = Store(spark, f"{stored_folder(spark)}")
    store.declare("prices", stored, ["asset", "date"], "date")
    store.commit({"prices": stored}, unique=True)
    store.commit({"prices": updates})
    store.compact("prices")
    early = store.snapshot("prices")
    rebased = panel.filter(F.col("asset").endswith("7") & (F.col("date") >= F.lit("2000-12-01").cast("date")))
    store.commit({"prices": rebased.withColumn("adj_close", F.col("adj_close") * 0.7)})
    return early, store.snapshot("prices")


@query
def store_snapshot(spark, sf):
    """The newest version and the one before it, read from base files and deltas."""
    early, late = _stored_versions(spark, sf)
    return unite(early.read().withColumn("version", F.lit("early")), late.read().withColumn("version", F.lit("late")))


@query
def store_marks(spark, sf):
    """Newest date per key and the rows of the overlap, from the listings and the newest files alone."""
    _, late = _stored_versions(spark, sf)
    marks = late.marks().select("asset", "max_date")
    oldest = marks.agg(F.min("max_date")).first()[0]
    recent = late.read(low=oldest - timedelta(days=OVERLAP_DAYS)) if oldest else late.read()
    return recent.join(marks, "asset").filter(F.col("date") >= F.date_sub("max_date", OVERLAP_DAYS)).select("asset", "max_date", "date", "adj_close")


@query
def append_prices(spark, sf):
    panel, stored, _ = _split_store(spark, sf)
    newer = panel.filter(F.col("date") > F.lit("2000-12-31").cast("date")).drop("volume")
    return ing.append(stored, newer, universe(panel))


@query
def high_watermark(spark, sf):
    panel = src.supplier_prices(spark, sf)
    return ing.high_watermark(panel, wide_universe(panel))


@query
def incremental_prices(spark, sf):
    panel, stored, _ = _split_store(spark, sf)
    mark = ing.high_watermark(stored, wide_universe(panel))
    return ing.incremental(panel, mark, 10).select("asset", "date", "adj_close")


@query
def incremental_macro(spark, sf):
    macro = src.macro(spark, sf)
    stored = macro.filter((F.col("obs_date") <= F.lit("1998-06-30").cast("date")) & (F.col("series_id") != "5-LOW"))
    mark = ing.high_watermark(stored, macro.select("series_id").distinct(), "series_id", "obs_date")
    return rounded(ing.incremental(macro, mark, None, "series_id", "obs_date"), value=4)


def _revision(spark, sf):
    """Stored history and a refetch in which every asset of one ending was rebased."""
    panel = src.supplier_prices(spark, sf).select("asset", "date", "adj_close", "volume")
    stored = panel.filter(F.col("date") <= F.lit("2000-12-31").cast("date"))
    rebased = F.when(F.col("asset").endswith("7"), F.col("adj_close") * 0.7).otherwise(F.col("adj_close"))
    refetched = panel.withColumn("adj_close", rebased)
    return stored, refetched


@query
def overlap_mismatches(spark, sf):
    stored, refetched = _revision(spark, sf)
    return ing.overlap_mismatches(stored, refetched)


@query
def revision_merge(spark, sf):
    stored, refetched = _revision(spark, sf)
    return ing.merge_prices(stored, refetched, refetched)[0]


@query
def revision_counts(spark, sf):
    stored, refetched = _revision(spark, sf)
    return ing.merge_prices(stored, refetched, refetched, wide_universe(refetched))[1]


@query
def append_macro(spark, sf):
    macro = src.macro(spark, sf)
    stored = asof.available_date(macro.filter(F.col("obs_date") <= F.lit("1998-06-30").cast("date")), src.MACRO_LAGS)
    revised = macro.select("series_id", "obs_date", (F.col("value") + 1).alias("value"))
    return rounded(ing.append_macro(stored, revised, src.MACRO_LAGS), value=4)


@query
def release_lag(spark, sf):
    return asof.available_date(src.macro(spark, sf), src.MACRO_LAGS).select("series_id", "obs_date", "available_date")


@query
def coverage_report(spark, sf):
    panel = src.supplier_prices(spark, sf)
    return ing.coverage(panel, wide_universe(panel))


@query
def constraint_audit(spark, sf):
    tables = {
        "runs": src.runs(spark, sf), "configs": src.configs(spark, sf), "target_weights": src.target_weights(spark, sf),
        "run_stages": src.run_stages(spark, sf), "macro": src.macro(spark, sf), "lines": src.table(spark, sf, "lineitem"),
    }
    rules = [
        {"table": "macro", "rule": "not_null", "column": "value"},
        {"table": "macro", "rule": "unique", "columns": ["series_id", "obs_date"]},
        {"table": "runs", "rule": "not_null", "column": "run_id"},
        {"table": "runs", "rule": "domain", "column": "status", "values": ["ok", "error"]},
        {"table": "runs", "rule": "reference", "column": "config_id", "to": "configs", "to_column": "config_id"},
        {"table": "configs", "rule": "at_most_one", "column": "is_central"},
        {"table": "configs", "rule": "domain", "column": "forecaster", "values": ["ewma", "ridge"]},
        {"table": "target_weights", "rule": "reference", "column": "run_id", "to": "runs", "to_column": "run_id"},
        {"table": "run_stages", "rule": "not_null", "column": "detail_json"},
        {"table": "lines", "rule": "unique", "columns": ["l_orderkey", "l_linenumber"]},
    ]
    return ing.audit_tables(tables, rules)


# --- returns, features, forecasts ---------------------------------------------------------------


@query
def log_returns(spark, sf):
    return rounded(rt.log_returns(src.supplier_prices(spark, sf)), log_return=8)


@query
def realized_vol(spark, sf):
    return rounded(rt.realized_vol(rt.log_returns(src.supplier_prices(spark, sf))), realized_vol=8)


@query
def latest_features(spark, sf):
    return rounded(rt.latest_features(rt.return_features(src.supplier_prices(spark, sf)), 1), value=8)


@query
def bar_positions(spark, sf):
    return rt.bar_positions(src.supplier_prices(spark, sf).select("asset", "date"))


@query
def forward_return(spark, sf):
    return rounded(rt.forward_return(rt.log_returns(src.supplier_prices(spark, sf))).select("asset", "date", "realized_h"), realized_h=8)


@query
def ewma_forecasts(spark, sf):
    return rounded(ewma_forecast(rt.log_returns(src.supplier_prices(spark, sf))), mu=8, sigma=8)


@query
def bar_forecasts(spark, sf):
    """Hourly bars are ordered by timestamp, so this takes the blocked layout."""
    bars = tick_bars(src.table(spark, sf, "events")).select("asset", F.col("bar_start").alias("date"), F.col("close").alias("adj_close"))
    return rounded(ewma_forecast(rt.log_returns(bars, keep_index=True), rows_per_block=256), mu=8, sigma=8)


@query
def idzorek_confidence(spark, sf):
    latest = latest_forecast(rt.log_returns(src.supplier_prices(spark, sf)))
    return latest.select(
        "asset",
        "date",
        F.round(confidence(F.col("mu"), F.col("sigma")), 8).alias("confidence"),
        F.round(annualize_mean(F.col("mu")), 8).alias("annual_mu"),
        F.round(annualize_vol(F.col("sigma")), 8).alias("scaled_sigma"),
    )


@query
def forecast_contract(spark, sf):
    panel = src.supplier_prices(spark, sf)
    found = latest_forecast(rt.log_returns(panel)).select("asset", "mu", "sigma")
    broken = found.withColumn("sigma", F.when(F.col("asset").endswith("3"), 0.0).otherwise(F.col("sigma"))).filter(~F.col("asset").endswith("9"))
    return vw.check_forecasts(broken, wide_universe(panel).filter(~F.col("asset").endswith("1")))


@query
def common_date_panel(spark, sf):
    return rounded(joint(spark, sf), log_return=8).select("asset", "date", "log_return")


@query
def common_dates(spark, sf):
    """The number of assets is found in the same plan."""
    return pn.common_dates(rt.log_returns(src.prices(spark, sf)))


@query
def covariance_window(spark, sf):
    return pn.covariance_window(rt.log_returns(src.prices(spark, sf)), len(ASSETS))


@query
def macro_asof_join(spark, sf):
    macro = asof.available_date(src.macro(spark, sf), src.MACRO_LAGS)
    return rounded(asof.asof_join(src.prices(spark, sf), macro), value=4)


@query
def macro_wide(spark, sf):
    macro = asof.available_date(src.macro(spark, sf), src.MACRO_LAGS)
    joined = asof.asof_join(src.supplier_prices(spark, sf), macro, series_ids=src.MACRO_SERIES)
    return rounded(asof.macro_wide(joined, src.MACRO_SERIES), **{s: 4 for s in src.MACRO_SERIES})


def _matrix(spark, sf):
    macro = asof.available_date(src.macro(spark, sf), src.MACRO_LAGS)
    return pn.feature_matrix(src.prices(spark, sf), ASSETS, macro, src.MACRO_SERIES)


@query
def feature_matrix_wide(spark, sf):
    names = {pn.feature_column(a, f): 8 for a in ASSETS for f in FEATURES} | {s: 4 for s in src.MACRO_SERIES}
    return rounded(_matrix(spark, sf), **names)


@query
def split_feature_matrix(spark, sf):
    names = {f: 8 for f in FEATURES} | {s: 4 for s in src.MACRO_SERIES}
    return rounded(pn.split_matrix(_matrix(spark, sf), ASSETS, FEATURES), **names)


@query
def fracdiff_first(spark, sf):
    logs = src.supplier_prices(spark, sf).select("asset", "date", F.log("adj_close").alias("log_price"))
    return rounded(fd.fracdiff(logs, 1.0), fracdiff=8)


@query
def fracdiff_short(spark, sf):
    logs = src.supplier_prices(spark, sf).select("asset", "date", F.log("adj_close").alias("log_price"))
    return rounded(fd.fracdiff(logs, 0.4, 1e-2), fracdiff=8)


@query
def fracdiff_wide(spark, sf):
    logs = src.prices(spark, sf).select("asset", "date", F.log("adj_close").alias("log_price"))
    return rounded(fd.fracdiff(logs, 0.5, 1e-4), fracdiff=8)


@query
def memory_retained(spark, sf):
    logs = src.supplier_prices(spark, sf).select("asset", "date", F.log("adj_close").alias("log_price"))
    return rounded(fd.memory_retained(logs, fd.fracdiff(logs, 0.4, 1e-2)), memory=8)


@query
def min_d_search(spark, sf):
    logs = src.prices(spark, sf).select("asset", "date", F.log("adj_close").alias("log_price"))
    return rounded(fd.min_d_search(logs, on_invalid="quarantine")[0], adf_pvalue=8, corr=8)


# --- covariance, blend, allocation --------------------------------------------------------------


@query
def pair_moments(spark, sf):
    return rounded(cv.pair_moments(joint(spark, sf)), xy=7, x2y2=7)


@query
def tiled_pair_moments(spark, sf):
    """The same products from several tiles and short date blocks."""
    return rounded(cv.pair_moments(joint(spark, sf), tile_assets=2, tile_dates=64, centered=False), xy=6, x2y2=6)


@query
def empirical_cov(spark, sf):
    return rounded(cv.empirical_cov(cv.pair_moments(joint(spark, sf))), cov=9)


def _cov(spark, sf):
    return cv.ledoit_wolf(durable(cv.pair_moments(joint(spark, sf))))


@query
def ledoit_wolf_cov(spark, sf):
    return rounded(_cov(spark, sf), cov=8)


@query
def shrinkage_stats(spark, sf):
    return rounded(cv.shrinkage_stats(cv.pair_moments(joint(spark, sf))), mu=9, shrinkage=8)


@query
def psd_check(spark, sf):
    return rounded(cv.psd_check(_cov(spark, sf).withColumn("group_id", F.lit(1)), ["group_id"]), min_eigenvalue=8)


def _benchmark(df: DataFrame) -> DataFrame:
    n = universe(df).select(F.count(F.lit(1))).scalar()
    return universe(df).withColumn("weight", F.lit(1.0) / n)


@query
def equilibrium_prior(spark, sf):
    return rounded(blend.equilibrium_prior(_cov(spark, sf), _benchmark(src.prices(spark, sf))), prior_mu=8)


def _forecasts(spark, sf):
    return latest_forecast(rt.log_returns(src.prices(spark, sf))).select("asset", "mu", "sigma")


@query
def view_terms(spark, sf):
    terms = blend.view_terms(_forecasts(spark, sf), _cov(spark, sf), [])
    return rounded(terms, view_mu=8, view_confidence=8, omega=8)


def _blended(spark, sf):
    cov = _cov(spark, sf).withColumn("group_id", F.lit(1).cast("long"))
    prior = blend.equilibrium_prior(cov, _benchmark(src.prices(spark, sf)), by=["group_id"])
    terms = blend.view_terms(_forecasts(spark, sf).withColumn("group_id", F.lit(1).cast("long")), cov, ["group_id"])
    return prior, terms, blend.posterior(cov, prior, terms, ["group_id"])


@query
def bl_posterior(spark, sf):
    prior, terms, post = _blended(spark, sf)
    names = ("prior_mu", "view_mu", "view_confidence", "omega", "posterior_mu", "posterior_sigma", "tilt")
    return rounded(blend.posterior_report(post, prior, terms, ["group_id"]), **{n: 7 for n in names})


@query
def bl_posterior_cov(spark, sf):
    return rounded(_blended(spark, sf)[2].select("asset_i", "asset_j", "cov"), cov=8)


@query
def historical_views(spark, sf):
    windows = vw.parse_windows(scenarios(spark))
    return rounded(vw.historical_views(rt.log_returns(src.supplier_prices(spark, sf)), windows), mu=8, sigma=8)


@query
def order_views(spark, sf):
    """A window per order, thousands of them, over one asset per brand."""
    day = F.col("o_orderdate").cast("date")
    windows = src.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("long").alias("scenario_id"), F.date_sub(day, (F.col("o_orderkey") % 700).cast("int")).alias("window_start"), day.alias("window_end")
    )
    return rounded(vw.historical_views(rt.log_returns(src.brand_prices(spark, sf)), windows), mu=8, sigma=8)


@query
def counterfactual_views(spark, sf):
    return rounded(vw.counterfactual_views(scenarios(spark), universe(src.prices(spark, sf))), mu=10, sigma=8)


@query
def supplier_views(spark, sf):
    """Scenarios taken from a table: every supplier states an annual view on one asset."""
    confidences = F.array(*[F.lit(c) for c in SUPPLIER_CONFIDENCES])
    asset = F.element_at(F.array(*[F.lit(a) for a in ASSETS]), (F.col("s_suppkey") % len(ASSETS) + 1).cast("int"))
    view = F.struct((F.col("s_acctbal") / 100_000).alias("mu"), F.element_at(confidences, (F.col("s_suppkey") % len(SUPPLIER_CONFIDENCES) + 1).cast("int")).alias("confidence"))
    stated = src.table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("long").alias("scenario_id"), F.lit("counterfactual").alias("kind"), F.to_json(F.create_map(asset, view)).alias("payload_json")
    )
    return rounded(vw.counterfactual_views(stated, universe(src.prices(spark, sf))), mu=10, sigma=8)


def _recipes() -> list[Recipe]:
    slow = {"forecaster": {"halflife": 126.0}}
    return [
        Recipe(1, "central"),
        Recipe(2, "slow", params=slow),
        Recipe(3, "history", scenario_id=2),
        Recipe(4, "past window", scenario_id=3, optimizer="min_variance"),
        Recipe(5, "floored", scenario_id=7, params={"optimizer": {"min_weight": 0.05}}),
        Recipe(6, "one view", scenario_id=6),
    ]


def _batch(spark, sf, **how):
    prices = durable(src.prices(spark, sf))
    return run_recipe_table(prices, recipe_rows(spark, _recipes()), scenarios(spark), universe(prices), _benchmark(prices), **how)


def _customer_batch(spark, sf, **how):
    """A recipe per customer, with the weights of its latest run as the previous ones."""
    prices = durable(src.prices(spark, sf))
    return run_recipe_table(prices, src.recipes(spark, sf), scenarios(spark), universe(prices), _benchmark(prices), allocations=False, on_invalid="quarantine", **how)


@query
def customer_posteriors(spark, sf):
    """Hundreds of recipes read from a table: their halflives share one pass, their matrix is never copied."""
    names = ("prior_mu", "view_mu", "view_confidence", "omega", "posterior_mu", "posterior_sigma", "tilt")
    return rounded(_customer_batch(spark, sf)["posteriors"], **{n: 6 for n in names})


@query
def customer_forecasts(spark, sf):
    return rounded(_customer_batch(spark, sf)["forecasts"], mu=8, sigma=8)


@query
def customer_features(spark, sf):
    macro = asof.available_date(src.macro(spark, sf), src.MACRO_LAGS)
    settings, _ = recipe_settings(src.recipes(spark, sf), scenarios(spark), "quarantine")
    return rounded(recipe_features(durable(src.prices(spark, sf)), durable(settings), macro), value=4)


@query
def customer_rejects(spark, sf):
    return recipe_settings(src.recipes(spark, sf), scenarios(spark), "quarantine")[1]


@query
def recipe_posteriors(spark, sf):
    names = ("prior_mu", "view_mu", "view_confidence", "omega", "posterior_mu", "posterior_sigma", "tilt")
    return rounded(_batch(spark, sf)["posteriors"], **{n: 6 for n in names})


@query
def recipe_allocations(spark, sf):
    return rounded(_batch(spark, sf)["target_weights"], weight=6, turnover=6)


@query
def mvu_allocation(spark, sf):
    _, _, post = _blended(spark, sf)
    recipes = spark.createDataFrame([(1, "mvu")], "group_id long, optimizer string")
    previous = _benchmark(src.prices(spark, sf)).withColumn("group_id", F.lit(1).cast("long"))
    return rounded(al.allocate(post, recipes, previous, ["group_id"]), weight=6, prev_weight=6, turnover=6)


@query
def min_variance_allocation(spark, sf):
    _, _, post = _blended(spark, sf)
    recipes = spark.createDataFrame([(1, "min_variance", 0.02)], "group_id long, optimizer string, min_weight double")
    return rounded(al.allocate(post, recipes, None, ["group_id"]), weight=6, turnover=6)


@query
def box_feasibility(spark, sf):
    groups = src.target_weights(spark, sf).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_assets"),
        (F.max("weight") - 0.125).alias("w_max"),
        (F.min("weight") + F.lit(0.0625)).alias("min_weight"),
    )
    return al.box_feasibility(groups, ["run_id"])


@query
def previous_weights(spark, sf):
    weights = src.target_weights(spark, sf)
    known = spark.createDataFrame([(a,) for a in ASSETS if a != "RO"], "asset string")
    return rounded(al.expand_previous(weights, known, ["run_id"]), prev_weight=8)


@query
def clipped_weights(spark, sf):
    return rounded(al.clip_renormalize(src.target_weights(spark, sf), ["run_id"], clip=0.1), weight=8)


@query
def turnover(spark, sf):
    ok = src.runs(spark, sf).filter("status = 'ok'").select("config_id", "run_id")
    last = led.latest_ok_run(src.runs(spark, sf), ["config_id"])
    older = ok.join(last.withColumnRenamed("run_id", "_last"), "config_id").filter("run_id < _last").groupBy("config_id").agg(F.max("run_id").alias("run_id"))
    weights = src.target_weights(spark, sf)
    now = weights.join(last, "run_id").select("config_id", "asset", "weight")
    before = weights.join(older, "run_id").select("config_id", "asset", "weight")
    return rounded(al.turnover(now, before, ["config_id"]), weight=8, prev_weight=8, turnover=8)


# --- walk-forward -----------------------------------------------------------------------------


def _positions(spark, sf):
    return joint_positions(rt.log_returns(src.prices(spark, sf)), len(ASSETS))


@query
def panel_positions(spark, sf):
    return longs(_positions(spark, sf), "pos", "n_panel")


@query
def walk_forward_folds(spark, sf):
    return fo.walk_forward_folds(_positions(spark, sf).select("n_panel").distinct(), FOLDS).drop("n_panel")


@query
def leakage_audit(spark, sf):
    """Folds built without a purge, so every one of them leaks."""
    return fo.leakage_audit(fo.walk_forward_folds(_positions(spark, sf).select("n_panel").distinct(), FOLDS, horizon=0))


@query
def fold_roles(spark, sf):
    return fo.fold_roles(_positions(spark, sf), FOLDS).select("date", "pos", "fold", "role")


@query
def eval_points(spark, sf):
    return fo.eval_points(_positions(spark, sf), FOLDS).select("date", "pos", "fold")


@query
def fold_report(spark, sf):
    positions = _positions(spark, sf)
    return fo.fold_report(fo.fold_roles(positions, FOLDS), fo.eval_points(positions, FOLDS))


def _scored(spark, sf):
    returns = rt.log_returns(src.prices(spark, sf))
    return evaluation_frame(returns, weighted_models(returns, HALFLIVES), joint_positions(returns, len(ASSETS)), FOLDS)


@query
def evaluation_points(spark, sf):
    out = _scored(spark, sf).select("model", "asset", "date", "fold", "mu", "sigma", "realized_h")
    return rounded(out, mu=8, sigma=8, realized_h=8)


@query
def forecast_metrics(spark, sf):
    return rounded(ev.forecast_metrics(_scored(spark, sf)), mse=8, ic=8, coverage=8)


@query
def promotion_decision(spark, sf):
    return ev.promotion(ev.forecast_metrics(_scored(spark, sf)), "ewma63")


@query
def data_fingerprint(spark, sf):
    prices = src.prices(spark, sf)
    common = pn.common_dates(rt.log_returns(prices), len(ASSETS))
    recipe = F.to_json(F.struct(F.lit(21).alias("horizon"), F.lit(FOLDS).alias("n_splits"), F.lit(21).alias("stride")))
    return ev.data_fingerprint(prices, common, recipe)


# --- windows, challenger, embeddings -------------------------------------------------------------


@query
def context_windows(spark, sf):
    w = win.context_windows(rt.log_returns(src.supplier_prices(spark, sf)))
    cells = {"context_first": F.col("context")[0], "context_last": F.col("context")[15], "target_first": F.col("target")[0], "target_last": F.col("target")[15]}
    return w.select("asset", "date", "pos", F.size("context").alias("n"), *[F.round(c, 8).alias(n) for n, c in cells.items()], F.round("realized_h", 8).alias("realized_h")).withColumn("n", F.col("n").cast("long"))


@query
def purged_holdout(spark, sf):
    w = win.purged_holdout(win.context_windows(rt.log_returns(src.supplier_prices(spark, sf))))
    return w.select("asset", "date", "pos", "role")


@query
def standardized_windows(spark, sf):
    w = win.standardize(win.purged_holdout(win.context_windows(rt.log_returns(src.supplier_prices(spark, sf)))))
    return w.select("asset", "date", "role", F.round(F.col("context")[15], 7).alias("context_last"), F.round(F.col("target")[15], 7).alias("target_last"))


def _member_predictions(spark, sf):
    """Three halflives as ensemble members, scored where the horizon is complete."""
    returns = rt.log_returns(src.supplier_prices(spark, sf))
    means = {f"mu{i}": float(h) for i, h in enumerate((63, 42, 21))}
    realized = ewma_means(rt.bar_positions(rt.forward_return(returns)), means).filter("realized_h IS NOT NULL")
    role = F.when(F.col("pos") >= F.col("n_bars") * 3 / 4, "holdout").otherwise("train")
    members = F.array(*[F.struct(F.lit(i).cast("long").alias("member"), F.col(n).alias("prediction")) for i, n in enumerate(means)])
    return realized.select("asset", "date", "pos", role.alias("role"), "realized_h", F.explode(members).alias("_m")).select("asset", "date", "pos", "role", "realized_h", "_m.*")


@query
def residual_variance(spark, sf):
    return rounded(challenger.residual_variance(_member_predictions(spark, sf)), residual_var=8)


@query
def ensemble_forecast(spark, sf):
    predictions = _member_predictions(spark, sf)
    return rounded(challenger.ensemble_forecast(predictions, challenger.residual_variance(predictions)), mu=8, sigma=8)


@query
def ridge_challenger(spark, sf):
    return rounded(ridge_latest(durable(rt.log_returns(src.supplier_prices(spark, sf)))), mu=6, sigma=6)


@query
def ridge_evaluation(spark, sf):
    """Baseline and challenger on the same folds, then the decision."""
    returns = durable(rt.log_returns(src.prices(spark, sf)))
    positions = joint_positions(returns, len(ASSETS))
    forecasts = {"ewma63": ewma_forecast(returns), "ridge": ridge_walk_forward(returns, positions, FOLDS)}
    return ev.promotion(ev.forecast_metrics(evaluation_frame(returns, forecasts, positions, FOLDS)), "ewma63")


@query
def shuffled_control(spark, sf):
    windows = win.purged_holdout(win.context_windows(rt.log_returns(src.supplier_prices(spark, sf))))
    return rounded(challenger.shuffled_control(windows), real_mse=8, shuffled_mse=8)


@query
def embedding_collapse(spark, sf):
    out = em.collapse_metrics(src.table(spark, sf, "embeddings"), "embedding", ["label"])
    return rounded(out, std_median=6, effective_rank=5)


@query
def collapse_verdict(spark, sf):
    out = em.collapse_verdict(em.collapse_metrics(src.table(spark, sf, "embeddings"), "embedding", ["label"]))
    return rounded(out, std_median=6, effective_rank=5)


@query
def regularity_scores(spark, sf):
    out = em.regularity_scores(src.table(spark, sf, "embeddings"), "embedding", ["label"])
    return rounded(out, variance_term=6, covariance_term=6)


# --- ledger -------------------------------------------------------------------------------------


@query
def run_history(spark, sf):
    """The newest 50 runs with their weights: a top-k report."""
    out = led.run_history(src.runs(spark, sf), src.target_weights(spark, sf), 50)
    return out.select(
        "run_id", "config_id", "status", "trig", "started_at",
        F.array_join(F.transform("target_weights", lambda x: x["asset"]), ",").alias("assets"),
        F.round(F.aggregate("target_weights", F.lit(0.0), lambda a, x: a + x["weight"]), 8).alias("total"),
    )


@query
def latest_ok_run(spark, sf):
    return led.latest_ok_per_config(src.runs(spark, sf), src.configs(spark, sf))


def _marks(spark, sf):
    lines = src.table(spark, sf, "lineitem")
    return led.data_watermarks(
        lines.select(F.to_date("l_shipdate").alias("date"), F.date_add(F.to_date("l_shipdate"), 1).alias("fetched_at"))
    )


@query
def data_watermarks(spark, sf):
    return _marks(spark, sf)


@query
def freshness_gate(spark, sf):
    return led.freshness_gate(src.runs(spark, sf), src.run_stages(spark, sf), src.configs(spark, sf), _marks(spark, sf))


@query
def cached_runs(spark, sf):
    return led.cached_runs(src.runs(spark, sf), src.run_stages(spark, sf), src.configs(spark, sf), _marks(spark, sf))


@query
def last_weights(spark, sf):
    return rounded(led.last_weights(src.runs(spark, sf), src.target_weights(spark, sf)), weight=8)


def _compared(spark, sf, wanted=None):
    return led.compare_configs(src.configs(spark, sf), src.runs(spark, sf), src.target_weights(spark, sf), src.run_stages(spark, sf), wanted)


@query
def compare_configs(spark, sf):
    return rounded(_compared(spark, sf), weight=8)


@query
def compare_grid(spark, sf):
    out = led.compare_grid(_compared(spark, sf), [7, 8, 10])
    return rounded(out, **{"7": 8, "8": 8, "10": 8})


@query
def central_run(spark, sf):
    return led.central_run(src.configs(spark, sf), src.runs(spark, sf), src.run_stages(spark, sf))


@query
def swept_runs(spark, sf):
    runs = src.runs(spark, sf).withColumn("status", F.when(F.col("status") == "skipped", "running").otherwise(F.col("status")))
    blank = runs.withColumn("error_text", F.lit(None).cast("string")).withColumn("finished_at", F.lit(None).cast("timestamp_ntz"))
    return led.sweep_stale(blank, F.to_timestamp_ntz(F.lit("2002-01-01 00:00:00"))).select("run_id", "status", "error_text", "finished_at")


@query
def promoted_config(spark, sf):
    return led.set_central(src.configs(spark, sf), 12).select("config_id", "is_central")


@query
def stage_completeness(spark, sf):
    weights = src.target_weights(spark, sf)
    known = spark.createDataFrame([(a,) for a in ASSETS], "asset string")
    return led.stage_completeness(src.runs(spark, sf), src.run_stages(spark, sf), weights, known)


@query
def stage_durations(spark, sf):
    return led.stage_durations(src.run_stages(spark, sf)).select("run_id", "stage", "seconds")


@query
def model_versions(spark, sf):
    lines = src.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("evaluation_id"), F.col("l_linenumber").cast("long").alias("fold"), F.concat("l_returnflag", "l_linestatus").alias("model_version")
    )
    return led.model_versions(lines)


@query
def run_counts(spark, sf):
    return led.run_counts(src.runs(spark, sf))


@query
def poke_percentiles(spark, sf):
    return led.latency_percentiles(src.table(spark, sf, "events"), ["event_type"], "value")


@query
def reference_checks(spark, sf):
    configs = src.configs(spark, sf)
    return led.reference_checks(scenarios(spark), configs, src.runs(spark, sf))


@query
def recipe_problems(spark, sf):
    return led.recipe_problems(src.configs(spark, sf), scenarios(spark), known_keys())


@query
def json_details(spark, sf):
    stages = src.run_stages(spark, sf)
    marks = json_object(F.col("detail_json"), "data_max_date string")
    return stages.select("run_id", "stage", marks["data_max_date"].alias("data_max_date"), json_error(F.col("detail_json")).alias("parse_error"))


@query
def recent_runs(spark, sf):
    """Calendar arithmetic: runs within 365 days of the newest one."""
    runs = src.runs(spark, sf)
    newest = runs.select(F.max(F.to_date("started_at"))).scalar()
    return runs.filter(F.to_date("started_at") >= F.date_sub(newest, 365)).select("run_id", F.to_date("started_at").alias("day"))


@query
def unknown_assets(spark, sf):
    held = src.target_weights(spark, sf)
    priced = src.prices(spark, sf).filter(~F.col("asset").startswith("R")).select("asset")
    return ing.set_difference(held, priced, ["asset"])


@query
def hourly_bars(spark, sf):
    return tick_bars(src.table(spark, sf, "events"))


@query
def canonical_order(spark, sf):
    """Latest rows in universe order, the order as an explicit ordinal."""
    latest = rt.latest_rows(src.prices(spark, sf).select("asset", "date", "adj_close"))
    ordinal = F.array_position(F.array(*[F.lit(a) for a in reversed(ASSETS)]), F.col("asset"))
    return latest.withColumn("ordinal", ordinal.cast("long")).orderBy("ordinal")


@query
def incremental_forecast(spark, sf):
    """The streaming state fed in two batches gives the forecast of the whole history."""
    bars = src.supplier_prices(spark, sf).select("asset", "date", "adj_close")
    cut = F.lit("1998-12-31").cast("date")
    first, _ = ewma_state.advance(ewma_state.empty_state(spark), durable(bars.filter(F.col("date") <= cut)))
    state, _ = ewma_state.advance(durable(first), durable(bars.filter(F.col("date") > cut)))
    return rounded(ewma_state.state_forecast(state), mu=8)


@query
def moved_keys(spark, sf):
    """Assets whose data marks moved between two snapshots of the store."""
    bars = src.supplier_prices(spark, sf).select("asset", "date", F.to_timestamp("date").alias("fetched_at"))
    before = price_ingest.key_marks(bars.filter(F.col("date") <= F.lit("2001-10-31").cast("date")))
    return price_ingest.moved_keys(before, price_ingest.key_marks(bars))
