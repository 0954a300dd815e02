"""Exact ranks and nearest-rank percentiles without sorting a group in one task.

Equal values are first collapsed to counts, which are then dealt over range partitions of (group, value): a group with
most rows is spread, and a thousand groups with ranges of their own are too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.scalars import correlation
from panelwright.operators.ranged import running_sums


def value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``(by, value, _c, _before, _total)``: count of each value, of all smaller ones in its group, and of the group."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    return running_sums(counts, by, [value], "_c")


def average_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``(by, value, name)`` with ties sharing their mean rank."""
    counted = value_counts(df, by, value)
    return counted.select(*by, value, (F.col("_before") + (F.col("_c") + 1) / 2).alias(name))


def spearman(df: DataFrame, by: list[str], x: str, y: str, name: str) -> DataFrame:
    """Rank correlation per group over its complete pairs; NULL below two points or when a side is constant."""
    pairs = df.select(*by, x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = pairs.join(average_ranks(pairs, by, x, "_rx"), [*by, x]).join(average_ranks(pairs, by, y, "_ry"), [*by, y])
    usable = (F.count(F.lit(1)) > 1) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return ranked.groupBy(*by).agg(F.when(usable, correlation("_rx", "_ry")).alias(name))


def nearest_rank(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """The element at position ``min(n-1, floor(q*n))`` of each sorted group, one column per quantile.

    NULL values are no samples: they don't count in ``n``, and a group of NULLs only has no row.
    """
    counted = value_counts(df.filter(F.col(value).isNotNull()), by, value)
    picks = []
    for name, q in quantiles.items():
        target = F.least(F.col("_total") - 1, F.floor(F.col("_total") * F.lit(float(q))))
        hit = (F.col("_before") <= target) & (target < F.col("_before") + F.col("_c"))
        picks.append(F.max(F.when(hit, F.col(value))).alias(name))
    return counted.groupBy(*by).agg(*picks, F.sum("_c").alias("n"))
