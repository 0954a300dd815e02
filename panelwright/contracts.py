"""Validation shared by the operators: raise inside the plan, or quarantine the offending keys.

``on_invalid="raise"`` puts ``raise_error`` into the expression itself, so it costs no extra job.
``on_invalid="quarantine"`` returns ``(good, report)`` where ``report`` is
``(key, reason, n_bad, first_keys)`` and every row of a reported key is left out of ``good``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.layout import order_bucket

RAISE = "raise"
QUARANTINE = "quarantine"
SHOWN_ROWS = 5


def check_mode(on_invalid: str) -> None:
    if on_invalid not in (RAISE, QUARANTINE):
        raise ValueError(f"on_invalid must be 'raise' or 'quarantine', got {on_invalid!r}")


def fail(*parts: Column | str, type_: str = "double") -> Column:
    """An expression that stops the job with a message when it is evaluated."""
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.raise_error(F.concat(*[F.coalesce(c, F.lit("NULL")) for c in columns])).cast(type_)


def not_finite(value: Column) -> Column:
    value = value.cast("double")
    return value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))


def first_rows(df: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    """The first ``k`` rows per key. Cut per (key, time bucket) first, so a hot key never meets in one task."""
    staged = df.withColumn("_bucket", order_bucket(df, order))
    near = Window.partitionBy(*keys, "_bucket").orderBy(order)
    staged = staged.withColumn("_rn", F.row_number().over(near)).filter(F.col("_rn") <= k)
    whole = Window.partitionBy(*keys).orderBy(order)
    return (
        staged.withColumn("_rn", F.row_number().over(whole)).filter(F.col("_rn") <= k).drop("_rn", "_bucket")
    )


def violation_report(bad_rows: DataFrame, key: str, order: str, reason: Column | str) -> DataFrame:
    """``(key, reason, n_bad, first_keys)`` over rows already known to be bad."""
    reason = F.lit(reason) if isinstance(reason, str) else reason
    rows = bad_rows.select(key, order, reason.alias("reason"))
    totals = rows.groupBy(key, "reason").agg(F.count(F.lit(1)).alias("n_bad"))
    shown = (
        first_rows(rows, [key, "reason"], order, SHOWN_ROWS)
        .groupBy(key, "reason")
        .agg(F.array_sort(F.collect_list(F.col(order).cast("string"))).alias("first_keys"))
    )
    return totals.join(shown, [key, "reason"]).select(key, "reason", "n_bad", "first_keys")


def quarantine(df: DataFrame, key: str, report: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.join(report.select(key).distinct(), key, "left_anti"), report
