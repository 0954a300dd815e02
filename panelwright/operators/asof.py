"""Point-in-time joins: a value counts only from the day it became available."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright import contracts
from panelwright.operators.layout import order_bucket
from panelwright.session import unite


def business_days_after(day: Column, lag: Column) -> Column:
    """``day`` plus ``lag`` weekdays (no holidays); for lag >= 1 a weekend day counts as the Friday before."""
    weekday = F.weekday(day)
    anchor = F.least(weekday, F.lit(4))
    friday = F.date_sub(day, F.greatest(weekday - 4, F.lit(0)))
    step = anchor + lag
    shifted = F.date_add(friday, (F.floor(step / 5) * 7 + step % 5 - anchor).cast("int"))
    # Lag 0 keeps weekdays and rolls a weekend day forward to Monday.
    rolled = F.date_add(day, F.when(weekday > 4, 7 - weekday).otherwise(0).cast("int"))
    return F.when(lag >= 1, shifted).otherwise(rolled)


def release_lag(lags: dict[str, int], series: Column) -> Column:
    """Per-series lag as a literal map lookup: no join, no exchange. Unknown series give NULL."""
    pairs = [F.lit(v) for item in sorted(lags.items()) for v in item]
    return F.try_element_at(F.create_map(*pairs), series)


def available_date(
    macro: DataFrame, lags: dict[str, int], series: str = "series_id", obs: str = "obs_date", on_invalid: str = "raise"
):
    """Stamp each observation with the date it was released; a series without a lag is a violation."""
    contracts.check_mode(on_invalid)
    lag = release_lag(lags, F.col(series))
    if on_invalid == contracts.QUARANTINE:
        report = contracts.violation_report(macro.filter(lag.isNull()), series, obs, "unknown series")
        known = macro.filter(lag.isNotNull())
        return known.withColumn("available_date", business_days_after(F.col(obs), lag)), report
    lag = F.when(lag.isNull(), contracts.fail("unknown series ", F.col(series), type_="int")).otherwise(lag)
    return macro.withColumn("_lag", lag).withColumn("available_date", business_days_after(F.col(obs), F.col("_lag"))).drop("_lag")


def asof_join(
    dates: DataFrame,
    macro: DataFrame,
    date: str = "date",
    series: str = "series_id",
    available: str = "available_date",
    obs: str = "obs_date",
    value: str = "value",
    series_ids: list[str] | None = None,
    width: int | None = None,
) -> DataFrame:
    """``(series, date, value)``: the latest observation released on or before each date.

    Ties on the release date go to the newest observation. A matched NULL value stays NULL. Work is
    keyed by (series, time bucket): the newest observation of earlier buckets is carried in through
    a table with one row per bucket, so a long series is never sorted in one task.
    """
    wanted = dates.select(date).distinct()
    # Every date times every series is the result; a given list rides along as a literal.
    if series_ids is None:
        grid = wanted.crossJoin(macro.select(series).filter(F.col(series).isNotNull()).distinct())
    else:
        grid = wanted.withColumn(series, F.explode(F.array(*[F.lit(s) for s in series_ids])))
    match = F.struct(F.col(value).alias("value"))
    right = macro.select(
        F.col(series), F.col(available).alias("_ts"), F.lit(0).alias("_side"), F.col(obs).alias("_obs"), match.alias("_match")
    )
    left = grid.select(
        F.col(series),
        F.col(date).alias("_ts"),
        F.lit(1).alias("_side"),
        F.lit(None).cast(macro.schema[obs].dataType).alias("_obs"),
        F.lit(None).cast(right.schema["_match"].dataType).alias("_match"),
    )
    both = unite(left, right)
    both = both.withColumn("_bucket", order_bucket(both, "_ts", width))
    w = Window.partitionBy(series, "_bucket").orderBy("_ts", "_side", "_obs")
    local = both.withColumn(
        "_local", F.last("_match", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).filter(F.col("_side") == 1)
    ends = (
        both.groupBy(series, "_bucket")
        .agg(F.max_by("_match", F.when(F.col("_side") == 0, F.struct("_ts", "_obs"))).alias("_end"))
    )
    prior = Window.partitionBy(series).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(series, "_bucket", F.last("_end", ignorenulls=True).over(prior).alias("_carried"))
    return local.join(carried, [series, "_bucket"]).select(
        F.col(series), F.col("_ts").alias(date), F.coalesce("_local", "_carried")["value"].alias(value)
    )


def macro_wide(joined: DataFrame, series_ids: list[str], date: str = "date", series: str = "series_id", value: str = "value") -> DataFrame:
    """One column per series, in sorted order. The list is explicit, so pivoting costs no extra job."""
    names = sorted(series_ids)
    return joined.groupBy(date).pivot(series, names).agg(F.first(value)).select(date, *[F.col(f"`{n}`") for n in names])
