"""Exponentially weighted forecasts with their historical predictive error, at every bar."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright import contracts
from panelwright.defaults import ERROR_WARMUP_BARS, HALFLIFE_BARS, HORIZON_BARS, MIN_ERROR_SAMPLES
from panelwright.operators.layout import AUTO, arrange, index_rows, resolve_block
from panelwright.session import durable

# 2^(pos/halflife) stays inside the double range within a span of this many halflives.
_BLOCK_HALFLIVES = 512
# A decay over so many halflives is zero as a double.
_GONE_HALFLIVES = 1100


def _running(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def _with_mean(base: DataFrame, key: str, order: str, ret: str, halflife: float, horizon: int, name: str) -> DataFrame:
    """``base``, which has the position ``_pos``, with the weighted mean times the horizon as a column."""
    # Weights start again every span; what one span hands to the next fades by 2^-512, and what lay
    # before that by 2^-1024, so the last finished span is all that a double can show.
    w = Window.partitionBy(key).orderBy(order)
    span = max(1, int(_BLOCK_HALFLIVES * halflife))
    columns = base.columns
    base = base.withColumn("_span", F.floor(F.col("_pos") / span)).withColumn("_w", F.pow(F.lit(2.0), (F.col("_pos") % span) / halflife))
    near = _running(Window.partitionBy(key, "_span").orderBy(order))
    base = base.withColumn("_ln", F.sum(F.col(ret) * F.col("_w")).over(near)).withColumn("_lw", F.sum("_w").over(near))
    closing = (F.col("_pos") + 1) % span == 0
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    fade = 2.0 ** (-span / halflife)
    handed = [F.coalesce(F.last(F.when(closing, F.col(c)), ignorenulls=True).over(past) * fade, F.lit(0.0)) for c in ("_ln", "_lw")]
    base = base.withColumn("_cn", handed[0]).withColumn("_cw", handed[1])
    mu = (F.col("_ln") + F.col("_cn")) / (F.col("_lw") + F.col("_cw")) * horizon
    return base.select(*columns, mu.alias(name))


def _whole_key(returns, key, order, ret, halflife, horizon, warmup):
    w = Window.partitionBy(key).orderBy(order)
    pos = (F.row_number().over(w) - 1).cast("long")
    base = returns.select(
        key, order, F.col(ret).alias("_r"), pos.alias("_pos"), F.count(F.lit(1)).over(Window.partitionBy(key)).alias("_n")
    )
    scored = _with_mean(base, key, order, "_r", halflife, horizon, "mu")
    error = F.lag("mu", horizon).over(w) - F.sum("_r").over(w.rowsBetween(-(horizon - 1), 0))
    scored = scored.withColumn("_e", F.when(F.col("_pos") >= warmup + horizon, error))
    return scored.withColumn("sigma", F.stddev_samp("_e").over(_running(w)))


def _blocked(returns, key, order, ret, halflife, horizon, warmup, block):
    block = max(1, min(block, int(_BLOCK_HALFLIVES * halflife)))
    if "_pos" in returns.columns:
        base = returns.select(key, order, F.col(ret).alias("_r"), "_pos", "_n")
    else:
        base = index_rows(returns.select(key, order, F.col(ret).alias("_r")), [key], order)
    offset = (F.col("_pos") % block).cast("double")
    base = (
        base.withColumn("_blk", F.floor(F.col("_pos") / block))
        .withColumn("_i", offset)
        .withColumn("_w", F.pow(F.lit(2.0), (offset - (block - 1)) / halflife))
    )
    # State carried into a block: all earlier block totals that have not decayed to zero.
    reach = math.ceil(_GONE_HALFLIVES * halflife / block) + 1
    decay = 2.0 ** (-block / halflife)
    earlier = Window.partitionBy(key).orderBy("_blk").rowsBetween(-reach, -1)

    def fold(total):
        return F.aggregate(F.collect_list(total).over(earlier), F.lit(0.0), lambda acc, x: acc * decay + x)

    totals = base.groupBy(key, "_blk").agg(F.sum(F.col("_r") * F.col("_w")).alias("_tn"), F.sum("_w").alias("_tw"))
    carried = totals.select(key, "_blk", fold("_tn").alias("_cn"), fold("_tw").alias("_cw"))
    w = Window.partitionBy(key, "_blk").orderBy("_pos")
    local = base.withColumn("_ln", F.sum(F.col("_r") * F.col("_w")).over(_running(w))).withColumn(
        "_lw", F.sum("_w").over(_running(w))
    )
    back = F.pow(F.lit(2.0), ((block - 1) - F.col("_i")) / halflife)
    fade = F.pow(F.lit(2.0), -(F.col("_i") + 1) / halflife)
    mu = (F.col("_ln") * back + F.col("_cn") * fade) / (F.col("_lw") * back + F.col("_cw") * fade) * horizon
    scored = local.join(carried, [key, "_blk"]).select(key, order, "_r", "_pos", "_n", mu.alias("mu"))

    # The error sums and the rows both read this; stored, it is computed once.
    scored = durable(scored)
    frame, near = arrange(scored, [key], order, back=horizon, rows_per_block=max(block, horizon))
    error = F.lag("mu", horizon).over(near) - F.sum("_r").over(near.rowsBetween(-(horizon - 1), 0))
    errors = frame.withColumn("_e", F.when(F.col("_pos") >= warmup + horizon, error)).filter("_core").drop("_core")
    # Counts, means and centred squares of the blocks, merged around the key's own level: no square of a far value.
    sums = errors.groupBy(key, "_blk").agg(F.count("_e").alias("_bk"), F.avg("_e").alias("_bm"), (F.var_pop("_e") * F.count("_e")).alias("_bv"))
    sums = sums.withColumn("_c", F.coalesce(F.avg("_bm").over(Window.partitionBy(key)), F.lit(0.0))).withColumn("_d", F.coalesce(F.col("_bm") - F.col("_c"), F.lit(0.0)))
    prior = Window.partitionBy(key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = {"_ck": F.col("_bk"), "_cs": F.col("_bk") * F.col("_d"), "_cq": F.coalesce("_bv", F.lit(0.0)) + F.col("_bk") * F.col("_d") * F.col("_d")}
    sums = sums.select(key, "_blk", "_c", *[F.coalesce(F.sum(c).over(prior), F.lit(0)).alias(n) for n, c in carried.items()])
    joined = errors.join(sums, [key, "_blk"])
    running = _running(near)
    own = F.count("_e").over(running)
    joined = joined.withColumn("_lk", own).withColumn("_lm", F.avg("_e").over(running) - F.col("_c")).withColumn("_lv", F.var_pop("_e").over(running) * own)
    k = F.col("_ck") + F.col("_lk")
    mean = F.when(F.col("_ck") > 0, F.col("_cs") / F.col("_ck")).otherwise(0.0)
    before = F.when(F.col("_ck") > 0, F.col("_cq") - F.col("_cs") * mean).otherwise(0.0)
    gap = F.coalesce("_lm", F.lit(0.0)) - mean
    square = before + F.coalesce("_lv", F.lit(0.0)) + F.when(k > 0, gap * gap * F.col("_ck") * F.col("_lk") / k).otherwise(0.0)
    return joined.withColumn("sigma", F.when(k > 1, F.sqrt(F.greatest(square, F.lit(0.0)) / (k - 1))))


def ewma_means(
    returns: DataFrame, halflives: dict[str, float], key: str = "asset", order: str = "date", ret: str = "log_return", horizon: int = HORIZON_BARS, warmup: int = ERROR_WARMUP_BARS
) -> DataFrame:
    """``returns`` with the forecast mean of every named halflife as a column, where ``ewma_forecast`` has one.

    The columns share the panel's exchange, so neither copies of the panel nor joins of it grow with the settings.
    For panels ordered by date. Errors aren't scored here: deviations come from ``ewma_forecast``.
    """
    w = Window.partitionBy(key).orderBy(order)
    base = returns.withColumn("_pos", (F.row_number().over(w) - 1).cast("long")).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    for name, halflife in halflives.items():
        base = _with_mean(base, key, order, ret, halflife, horizon, name)
    need = warmup + horizon + MIN_ERROR_SAMPLES
    return base.filter((F.col("_pos") >= need - 1) | (F.col("_n") < need)).drop("_pos", "_n")


def ewma_forecast(
    returns: DataFrame,
    key: str = "asset",
    order: str = "date",
    ret: str = "log_return",
    halflife: float = HALFLIFE_BARS,
    horizon: int = HORIZON_BARS,
    warmup: int = ERROR_WARMUP_BARS,
    rows_per_block: int | str | None = AUTO,
    on_invalid: str = "raise",
):
    """H-day forecast mean and predictive deviation as of every bar with enough history.

    ``mu`` is the expanding weighted mean return times the horizon. ``sigma`` is the sample deviation
    of past forecast errors whose horizon is already complete, so nothing after the bar is used.
    """
    contracts.check_mode(on_invalid)
    if not math.isfinite(halflife) or halflife <= 0:
        raise ValueError(f"halflife must be finite and positive, got {halflife!r}")
    block = resolve_block(returns, order, rows_per_block)
    if block is None:
        scored = _whole_key(returns, key, order, ret, halflife, horizon, warmup)
    else:
        scored = _blocked(returns, key, order, ret, halflife, horizon, warmup, block)
    need = warmup + horizon + MIN_ERROR_SAMPLES
    short = F.col("_n") < need
    ready = F.col("_pos") >= need - 1
    # Equal errors up to float noise carry no information about dispersion.
    flat = ~(F.col("sigma") > 1e-14) | F.col("sigma").isNull()
    keep = ["mu", "sigma", (F.col("_pos") + 1).alias("n_bars")]
    if on_invalid == contracts.RAISE:
        sigma = (
            F.when(short, contracts.fail("history of ", F.col(key), " has ", F.col("_n"), f" bars, need {need}"))
            .when(flat, contracts.fail("returns of ", F.col(key), " are constant up to ", F.col(order)))
            .otherwise(F.col("sigma"))
        )
        out = scored.filter(ready | short).withColumn("sigma", sigma)
        return out.select(key, order, *keep)
    bad = scored.filter(short | (ready & flat))
    report = contracts.violation_report(
        bad, key, order, F.when(short, F.lit("history too short")).otherwise(F.lit("constant returns"))
    )
    good, report = contracts.quarantine(scored.filter(ready), key, report)
    return good.select(key, order, *keep), report


def latest_forecast(returns: DataFrame, key: str = "asset", order: str = "date", **params) -> DataFrame:
    """One forecast per key as of its newest bar."""
    from panelwright.operators.returns import latest_rows

    return latest_rows(ewma_forecast(returns, key, order, **params), key, order)
