"""Purged walk-forward evaluation of several forecasters on one joint panel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.defaults import HORIZON_BARS
from panelwright.operators.challenger import ensemble_forecast, fit_moments, fits_of, predict_mean, predict_members, solve_fits, variance_of_errors
from panelwright.operators.evaluate import forecast_metrics, promotion, score_points
from panelwright.operators.ewma_grid import forecast_grid
from panelwright.operators.folds import eval_points, fold_report, fold_roles, walk_forward_folds
from panelwright.operators.panel import common_dates
from panelwright.operators.layout import AUTO, arrange, by_key, core_rows, index_rows
from panelwright.operators.returns import bar_positions, forward_return, log_returns
from panelwright.operators.windows import CONTEXT_BARS, HOLDOUT_SHARE
from panelwright.session import durable, unite


def joint_positions(returns: DataFrame, n_assets: int | None = None) -> DataFrame:
    """One row per common date: ``(date, pos, n_panel)``."""
    return index_rows(common_dates(returns, n_assets), [], "date", pos="pos", size="n_panel")


def evaluation_frame(
    returns: DataFrame, forecasts: dict[str, DataFrame] | DataFrame, positions: DataFrame, n_splits: int, horizon: int = HORIZON_BARS, stride: int = HORIZON_BARS
) -> DataFrame:
    """``(model, asset, date, fold, mu, sigma, realized_h)`` at every evaluation point; ``forecasts`` by model, or one
    frame with a ``model`` column.

    Forecast frames hold every as-of date already, so the points are joined, not looped over.
    """
    points = eval_points(positions, n_splits, horizon, stride)
    panel = returns.join(positions.select("date"), "date", "left_semi")
    realized = forward_return(panel, horizon=horizon).select("asset", "date", "realized_h")
    if isinstance(forecasts, dict):
        forecasts = unite(*[f.withColumn("model", F.lit(m)).select("model", "asset", "date", "mu", "sigma") for m, f in forecasts.items()])
    models = forecasts.select("model", "asset", "date", "mu", "sigma")
    return score_points(points, realized, models)


def weighted_models(returns: DataFrame, halflives: dict[str, float]) -> DataFrame:
    """``(model, asset, date, mu, sigma, n_bars)`` of every named halflife at every bar, in one pass over the returns."""
    names = F.array(*[F.struct(F.lit(float(h)).alias("h"), F.lit(m).alias("m")) for m, h in halflives.items()])
    grid = forecast_grid(returns, list(halflives.values()))
    named = grid.withColumn("_names", F.filter(names, lambda n: n["h"] == F.col("halflife")))
    return named.withColumn("model", F.explode("_names.m")).select("model", "asset", "date", "mu", "sigma", "n_bars")


def walk_forward(prices: DataFrame, halflives: dict[str, float], baseline: str, n_splits: int = 4, n_assets: int | None = None) -> dict[str, DataFrame]:
    """Metrics, decision and fold report for exponentially weighted forecasters."""
    returns = log_returns(prices)
    positions = joint_positions(returns, n_assets)
    metrics = forecast_metrics(evaluation_frame(returns, weighted_models(returns, halflives), positions, n_splits))
    return {
        "folds": walk_forward_folds(positions.select("n_panel").distinct(), n_splits),
        "report": fold_report(fold_roles(positions, n_splits), eval_points(positions, n_splits)),
        "metrics": metrics,
        "decision": promotion(metrics, baseline),
    }


def _contexts(returns: DataFrame, context: int, horizon: int, rows_per_block: int | str | None = AUTO) -> DataFrame:
    """Every bar with a full context; ``realized_h`` is NULL where the future is not complete yet."""
    placed = bar_positions(returns.select("asset", "date", "log_return"), rows_per_block=rows_per_block)
    frame, w = arrange(placed, ["asset"], "date", back=context - 1, ahead=horizon, rows_per_block=rows_per_block)
    coming = w.rowsBetween(1, horizon)
    out = frame.select(
        "*",
        F.collect_list("log_return").over(w.rowsBetween(-(context - 1), 0)).alias("context"),
        F.when(F.count("log_return").over(coming) == horizon, F.sum("log_return").over(coming)).alias("realized_h"),
    ).filter(F.col("pos") >= context - 1)
    return core_rows(out).select("asset", "date", "pos", "context", "realized_h")


def _role(bars: Column, context: int, horizon: int, share: float = HOLDOUT_SHARE) -> Column:
    """Role of the window at ``pos`` in a fold that knows ``bars`` bars of its asset."""
    windows = bars - horizon - (context - 1)
    start = (context - 1) + windows - F.greatest(F.lit(2), F.bround(windows * share).cast("long"))
    pos = F.col("pos")
    return F.when((pos >= start) & (pos + horizon <= bars - 1), "holdout").when(pos + horizon < start, "train")


def ridge_forecast(
    returns: DataFrame,
    cuts: DataFrame,
    targets: DataFrame,
    n_folds: int,
    members: int = 3,
    ridge: float = 0.1,
    context: int = CONTEXT_BARS,
    horizon: int = HORIZON_BARS,
) -> DataFrame:
    """Ensemble forecasts ``(fold, asset, date, mu, sigma)`` for target dates, all folds in one pass.

    ``cuts`` is ``(fold, last)`` for folds ``0..n_folds-1``: a fold sees bars up to ``last`` only, and
    holds out each asset's trailing windows for the residual variance. ``targets`` is ``(fold, date)``.
    """
    folds = range(n_folds)
    returns = by_key(returns, "asset")
    ends = cuts.groupBy().pivot("fold", list(folds)).agg(F.first("last")).select(F.struct(*[F.col(str(f)).alias(f"_e{f}") for f in folds])).scalar()
    history = (
        returns.select("asset", "date").withColumn("_e", ends).groupBy("asset")
        .agg(*[F.count(F.when(F.col("date") <= F.col(f"_e._e{f}"), 1)).alias(f"_h{f}") for f in folds])
    )
    windows = _contexts(returns, context, horizon).join(history, "asset")  # both lie by asset
    roles = [_role(F.col(f"_h{f}"), context, horizon).alias(f"_role{f}") for f in folds]
    # The windows feed the fits, the holdout scores and the targets, so they are stored once.
    windows = durable(windows.select("asset", "date", "pos", "context", "realized_h", *roles))
    labelled = windows.filter(F.col("realized_h").isNotNull())
    fits = {i: c for f in folds for i, c in fits_of(f, F.col(f"_role{f}"), "asset", members).items()}
    models = durable(solve_fits(fit_moments(labelled, context, fits), ridge, members))
    held = F.array_compact(F.array(*[F.when(F.col(f"_role{f}") == "holdout", F.lit(f).cast("long")) for f in folds]))
    held = predict_mean(labelled.withColumn("fold", F.explode(held)), models, ["fold", "asset", "realized_h"])
    errors = held.select("fold", "asset", (F.col("realized_h") - F.col("prediction")).alias("_e"))
    wanted = windows.select("asset", "date", "context").join(targets.select("fold", "date"), "date")
    residuals = variance_of_errors(errors, by=["fold"], assets=wanted.select("fold", "asset"))
    return ensemble_forecast(predict_members(wanted, models, ["fold", "asset", "date"]), residuals, by=["fold"])


def ridge_latest(returns: DataFrame, members: int = 3, ridge: float = 0.1, context: int = CONTEXT_BARS) -> DataFrame:
    """Forecast of the newest bar of every asset by the regression ensemble."""
    newest = returns.groupBy("asset").agg(F.max("date").alias("date"))
    cuts = returns.agg(F.max("date").alias("last")).withColumn("fold", F.lit(0).cast("long"))
    days = newest.select("date").distinct().withColumn("fold", F.lit(0).cast("long"))
    return ridge_forecast(returns, cuts, days, 1, members, ridge, context).join(newest, ["asset", "date"], "left_semi").drop("fold")


def ridge_walk_forward(returns: DataFrame, positions: DataFrame, n_splits: int = 4, members: int = 3, ridge: float = 0.1) -> DataFrame:
    """Ensemble forecasts at every evaluation point, each fold fitted on data up to its last training bar."""
    cuts = fold_roles(positions, n_splits).filter("role = 'train'").groupBy("fold").agg(F.max("date").alias("last"))
    return ridge_forecast(returns, cuts, eval_points(positions, n_splits).select("fold", "date"), n_splits, members, ridge)
