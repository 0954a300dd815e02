"""Training windows over a return panel: vectors, purged holdout and standardization."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright import contracts
from panelwright.defaults import HORIZON_BARS
from panelwright.operators.layout import AUTO, arrange, core_rows, is_date
from panelwright.operators.returns import bar_positions

CONTEXT_BARS = 16
HOLDOUT_SHARE = 0.25
_STD_FLOOR = 1e-8


def context_windows(
    returns: DataFrame,
    context: int = CONTEXT_BARS,
    horizon: int = HORIZON_BARS,
    key: str = "asset",
    order: str = "date",
    ret: str = "log_return",
    rows_per_block: int | str | None = AUTO,
) -> DataFrame:
    """``(asset, date, pos, context, target, realized_h)`` for bars with all three spans complete.

    Context is ``[t-C+1, t]``, target ``[t+H-C+1, t+H]`` and the realized return sums ``(t, t+H]``.
    """
    if horizon < 1 or not 2 <= context <= horizon:
        raise ValueError(f"need horizon >= 1 and 2 <= context <= horizon, got context={context}, horizon={horizon}")
    placed = bar_positions(returns.select(key, order, ret), key, order, rows_per_block)
    frame, w = arrange(placed, [key], order, back=context - 1, ahead=horizon, rows_per_block=rows_per_block)
    out = frame.select(
        "*",
        F.collect_list(ret).over(w.rowsBetween(-(context - 1), 0)).alias("context"),
        F.collect_list(ret).over(w.rowsBetween(horizon - context + 1, horizon)).alias("target"),
        F.sum(ret).over(w.rowsBetween(1, horizon)).alias("realized_h"),
    )
    complete = (F.col("pos") >= context - 1) & (F.col("pos") + horizon <= F.col("n_bars") - 1)
    return core_rows(out.filter(complete)).select(key, order, "pos", "context", "target", "realized_h")


def purged_holdout(
    windows: DataFrame, horizon: int = HORIZON_BARS, share: float = HOLDOUT_SHARE, key: str = "asset", on_invalid: str = "raise", order: str = "date"
):
    """Mark each key's trailing windows ``holdout`` and the earlier ones ``train``; windows whose label
    reaches the holdout are dropped. A key left without training windows stops the job; with
    ``on_invalid="quarantine"`` such keys are reported and left out.

    Where ``order`` is a DATE, a key's rows lie in one task anyway, so its span is read there and nothing before is
    done twice for it; otherwise spans are a table of their own."""
    contracts.check_mode(on_invalid)
    first, k = F.min("pos"), F.count(F.lit(1))
    if order in windows.columns and is_date(windows, order):
        whole = Window.partitionBy(key)
        spanned = windows.filter(F.col(key).isNotNull()).withColumns({"_begin": first.over(whole), "_k": k.over(whole)})
    else:
        spanned = windows.join(windows.groupBy(key).agg(first.alias("_begin"), k.alias("_k")), key)
    holdout = F.greatest(F.lit(2), F.bround(F.col("_k") * share).cast("long"))
    spanned = spanned.withColumn("_start", F.col("_begin") + F.col("_k") - holdout)
    role = F.when(F.col("pos") >= F.col("_start"), "holdout").when(F.col("pos") + horizon < F.col("_start"), "train")
    # Positions of a key's windows are consecutive, so the first window tells whether any trains.
    joined = spanned.withColumn("_empty", F.col("_begin") + horizon >= F.col("_start")).drop("_k")
    if on_invalid == contracts.RAISE:
        stop = contracts.fail("no training windows before the holdout of ", F.col(key), type_="string")
        role = F.when(F.col("_empty"), stop).otherwise(role)
        return joined.withColumn("role", role).filter(F.col("role").isNotNull()).drop("_start", "_begin", "_empty")
    report = contracts.violation_report(joined.filter("_empty"), key, "pos", "no training windows before the holdout")
    good = joined.filter("NOT _empty").withColumn("role", role).filter(F.col("role").isNotNull())
    return good.drop("_start", "_begin", "_empty"), report


def train_scale(windows: DataFrame, vector: str = "context") -> DataFrame:
    """One row: mean and population deviation over all training values of the vector column."""
    values = windows.filter("role = 'train'").select(F.explode(vector).alias("_x"))
    stats = values.agg(F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("_s"))
    return stats.select("mean", F.when(F.col("_s") < _STD_FLOOR, 1.0).otherwise(F.col("_s")).alias("std"))


def standardize(windows: DataFrame, vectors: tuple[str, ...] = ("context", "target"), base: str = "context") -> DataFrame:
    """Scale vectors by training statistics only, so nothing of the holdout leaks into its inputs."""
    scale = train_scale(windows, base).select(F.struct("mean", "std")).scalar()
    out = windows.withColumn("_s", scale)
    for name in vectors:
        out = out.withColumn(name, F.transform(name, lambda x: (x - F.col("_s.mean")) / F.col("_s.std")))
    return out.drop("_s")
