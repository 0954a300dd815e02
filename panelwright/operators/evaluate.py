"""Scoring forecasts against realized returns, and the promotion rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright import contracts
from panelwright.defaults import CALIBRATION_Z, COVERAGE_TARGET, COVERAGE_TOLERANCE
from panelwright.operators.ranks import spearman
from panelwright.session import durable

BASELINE_STAYS = "baseline remains"
CHALLENGER_WINS = "challenger promoted"


def score_points(points: DataFrame, realized: DataFrame, forecasts: DataFrame, key: str = "asset", order: str = "date") -> DataFrame:
    """Join evaluation dates, joint-panel realized returns and own-history forecasts.

    Targets come from the joint panel, forecasts from each asset's full history up to the date.
    """
    targets = realized.join(points.select(order, "fold"), order)
    return targets.join(forecasts, [key, order])


def forecast_metrics(scored: DataFrame, z: float = CALIBRATION_Z, key: str = "asset") -> DataFrame:
    """MSE, coverage and rank correlation per (model, asset), and pooled per model where asset is NULL.

    The points are stored first: ranking reads them several times, and they are a small share of the
    panel (one bar per horizon). Each point then counts once for its asset and once pooled.
    """
    levels = F.array(F.struct(F.lit(False).alias("pooled"), F.col(key).alias("level")), F.struct(F.lit(True).alias("pooled"), F.lit("").alias("level")))
    both = durable(scored.select("model", key, "mu", "sigma", "realized_h")).withColumn("_l", F.explode(levels))
    points = both.select("model", "_l.*", "mu", "sigma", "realized_h")
    by = ["model", "pooled", "level"]
    error = F.col("mu") - F.col("realized_h")
    inside = F.abs(error) <= F.col("sigma") * z
    base = points.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_points"), F.avg(error * error).alias("mse"), F.avg(inside.cast("double")).alias("coverage")
    )
    joined = base.join(spearman(points, by, "mu", "realized_h", "ic"), by)
    return joined.select("model", F.when(~F.col("pooled"), F.col("level")).alias(key), "n_points", "mse", "ic", "coverage")


def promotion(
    metrics: DataFrame,
    baseline: str,
    target: float = COVERAGE_TARGET,
    tolerance: float = COVERAGE_TOLERANCE,
    key: str = "asset",
) -> DataFrame:
    """Decide per challenger on pooled metrics; the baseline keeps every tie. A baseline without metrics stops the job."""
    pooled = metrics.filter(F.col(key).isNull())
    base = pooled.filter(F.col("model") == baseline).select(
        F.lit(1).alias("_k"), F.col("mse").alias("_mse"), F.abs(F.col("coverage") - target).alias("_distance")
    )
    rows = pooled.filter(F.col("model") != baseline).withColumn(
        "_b", base.select(F.struct("_mse", "_distance")).scalar()
    )
    known = F.when(F.col("_b").isNull(), contracts.fail("no pooled metrics of the baseline ", baseline, type_="boolean")).otherwise(F.lit(True))
    rows = rows.filter(known)
    distance = F.abs(F.col("coverage") - target)

    def clause(ok: Column, name: str) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))

    failed = F.array_compact(
        F.array(
            clause(F.col("mse") < F.col("_b._mse"), "mse not strictly lower"),
            clause(distance <= tolerance, "coverage outside band"),
            clause(distance <= F.col("_b._distance"), "coverage distance worse"),
        )
    )
    return rows.select(
        "model",
        F.when(F.size(failed) == 0, CHALLENGER_WINS).otherwise(BASELINE_STAYS).alias("decision"),
        F.array_join(failed, "; ").alias("failed"),
    )


def data_fingerprint(prices: DataFrame, common: DataFrame, recipe: Column, key: str = "asset", order: str = "date") -> DataFrame:
    """What was scored: rows and last date per asset, the common window, and a short recipe hash."""
    window = common.agg(
        F.count(F.lit(1)).alias("panel_bars"), F.min(order).alias("panel_start"), F.max(order).alias("panel_end")
    ).select(F.struct("*")).scalar()
    per_asset = prices.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.max(order).alias("max_date"))
    return per_asset.withColumn("_w", window).select(
        key, "n_rows", "max_date", "_w.*", F.substring(F.sha2(recipe, 256), 1, 12).alias("recipe_hash")
    )
