"""Returns, realized volatility, positions and forward returns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright import contracts
from panelwright.defaults import HORIZON_BARS, TRADING_DAYS
from panelwright.operators.layout import AUTO, arrange, core_rows, index_rows, resolve_block
from panelwright.session import unite


def _bad_price(price: Column) -> Column:
    return contracts.not_finite(price) | (price <= 0)


def _screen_prices(prices: DataFrame, key: str, order: str, price: str) -> tuple[DataFrame, DataFrame]:
    bad = contracts.violation_report(
        prices.filter(_bad_price(F.col(price))), key, order, "price missing, non-finite or not positive"
    )
    lengths = prices.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"), F.min(order).alias(order))
    short = lengths.filter("_rows < 2").select(
        key,
        F.lit("fewer than 2 prices").alias("reason"),
        F.col("_rows").alias("n_bad"),
        F.array(F.col(order).cast("string")).alias("first_keys"),
    )
    return contracts.quarantine(prices, key, unite(bad, short))


def _return_column(key: str, order: str, price: str, w, strict: bool) -> Column:
    value, previous = F.col(price), F.lag(price).over(w)
    plain = F.log(value / previous)
    if not strict:
        return plain
    return (
        F.when(
            _bad_price(value), contracts.fail("price of ", F.col(key), " at ", F.col(order), " is ", value, ": must be finite and positive")
        )
        .when(
            F.col(order) == F.lag(order).over(w),
            contracts.fail("duplicate date ", F.col(order), " for ", F.col(key)),
        )
        .when(
            F.lag(order).over(w).isNull() & F.lead(order).over(w).isNull() & F.col("_first"),
            contracts.fail("need at least 2 prices for ", F.col(key)),
        )
        .otherwise(plain)
    )


def log_returns(
    prices: DataFrame,
    key: str = "asset",
    order: str = "date",
    price: str = "adj_close",
    rows_per_block: int | str | None = AUTO,
    on_invalid: str = "raise",
    keep_index: bool = False,
):
    """``ln(P_t / P_{t-1})`` per key; the first bar of each key is dropped.

    In the blocked layout ``keep_index`` keeps the row index (``_pos``, ``_n``), so that the next blocked
    operator need not rank the rows again.
    """
    contracts.check_mode(on_invalid)
    report = None
    panel = prices.select(key, order, price)
    if on_invalid == contracts.QUARANTINE:
        panel, report = _screen_prices(panel, key, order, price)
    frame, w = arrange(panel, [key], order, back=1, ahead=1, rows_per_block=rows_per_block)
    first = F.col("_pos") == 0 if "_pos" in frame.columns else F.lit(True)
    out = frame.withColumn("_first", first).withColumn(
        "log_return", _return_column(key, order, price, w, on_invalid == contracts.RAISE)
    )
    out = out.filter(F.col("log_return").isNotNull())
    if keep_index and "_pos" in out.columns:
        out = out.filter("_core").select(key, order, "log_return", (F.col("_pos") - 1).alias("_pos"), (F.col("_n") - 1).alias("_n"))
    else:
        out = core_rows(out).select(key, order, "log_return")
    return out if report is None else (out, report)


def realized_vol(
    returns: DataFrame,
    key: str = "asset",
    order: str = "date",
    ret: str = "log_return",
    window: int = HORIZON_BARS,
    rows_per_block: int | str | None = AUTO,
) -> DataFrame:
    """Annualized sample deviation over a trailing window; warm-up bars are dropped."""
    if window < 2:
        raise ValueError(f"window must be >= 2 for a sample deviation, got {window}")
    frame, w = arrange(returns.select(key, order, ret), [key], order, back=window - 1, rows_per_block=rows_per_block)
    trailing = w.rowsBetween(-(window - 1), 0)
    out = frame.select(
        "*",
        F.count(ret).over(trailing).alias("_seen"),
        (F.stddev_samp(ret).over(trailing) * math.sqrt(TRADING_DAYS)).alias("realized_vol"),
    ).filter(F.col("_seen") == window)
    return core_rows(out).select(key, order, "realized_vol")


def return_features(
    prices: DataFrame,
    key: str = "asset",
    order: str = "date",
    price: str = "adj_close",
    window: int = HORIZON_BARS,
    rows_per_block: int | str | None = AUTO,
) -> DataFrame:
    """Return and volatility together on one exchange and sort; rows inside either warm-up are dropped."""
    frame, w = arrange(prices.select(key, order, price), [key], order, back=window, ahead=1, rows_per_block=rows_per_block)
    first = F.col("_pos") == 0 if "_pos" in frame.columns else F.lit(True)
    frame = frame.withColumn("_first", first).withColumn("log_return", _return_column(key, order, price, w, True))
    trailing = w.rowsBetween(-(window - 1), 0)
    out = frame.select(
        "*",
        F.count("log_return").over(trailing).alias("_seen"),
        (F.stddev_samp("log_return").over(trailing) * math.sqrt(TRADING_DAYS)).alias("realized_vol"),
    ).filter(F.col("_seen") == window)
    return core_rows(out).select(key, order, "log_return", "realized_vol")


def forward_return(
    returns: DataFrame,
    key: str = "asset",
    order: str = "date",
    ret: str = "log_return",
    horizon: int = HORIZON_BARS,
    rows_per_block: int | str | None = AUTO,
) -> DataFrame:
    """Sum of the returns at ``t+1 .. t+horizon``; NULL while the horizon is incomplete."""
    frame, w = arrange(returns, [key], order, ahead=horizon, rows_per_block=rows_per_block)
    coming = w.rowsBetween(1, horizon)
    out = frame.withColumn(
        "realized_h", F.when(F.count(ret).over(coming) == horizon, F.sum(ret).over(coming))
    )
    return core_rows(out)


def bar_positions(df: DataFrame, key: str = "asset", order: str = "date", rows_per_block: int | str | None = AUTO) -> DataFrame:
    """0-based bar position within the key and the key's own history length."""
    if resolve_block(df, order, rows_per_block) is not None:
        return index_rows(df, [key], order, pos="pos", size="n_bars")
    w = Window.partitionBy(key)
    return df.withColumn("pos", (F.row_number().over(w.orderBy(order)) - 1).cast("long")).withColumn(
        "n_bars", F.count(F.lit(1)).over(w)
    )


def latest_rows(df: DataFrame, key: str = "asset", order: str = "date") -> DataFrame:
    """The newest row of every key, by map-side combined ``max_by`` rather than a per-key sort."""
    others = [c for c in df.columns if c not in (key, order)]
    newest = df.groupBy(key).agg(
        F.max(order).alias(order), F.max_by(F.struct(*others), order).alias("_row")
    )
    return newest.select(key, order, *[F.col(f"_row.{c}").alias(c) for c in others])


def latest_features(features: DataFrame, run_id, key: str = "asset", order: str = "date") -> DataFrame:
    """Entity-attribute-value rows ``(run_id, asset, name, value)`` of each key's newest features."""
    names = [c for c in features.columns if c not in (key, order)]
    newest = latest_rows(features, key, order)
    return newest.unpivot([key], names, "name", "value").select(
        F.lit(run_id).cast("long").alias("run_id"), key, "name", "value"
    )
