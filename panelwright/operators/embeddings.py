"""Collapse checks on embedding tables, from cross products added up per partition."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.defaults import EFFECTIVE_RANK_FLOOR, STD_MEDIAN_FLOOR

VARIANCE_TARGET = 1.0
_VARIANCE_EPS = 1e-4


def cross_products(df: DataFrame, vector: str, by: list[str] | None = None) -> DataFrame:
    """``(by, i, j, n, si, sj, sij)``: sums over rows for every pair of dimensions ``i <= j``, of the vectors less one of
    their group. Covariances don't change with that, and vectors far from zero lose no digits in the squares.

    Each partition multiplies its Arrow batches and emits one small matrix per group, so only
    dimension-by-dimension sums are shuffled, whatever the number of rows.
    """
    by = by or []
    df = df.select(*by, vector).filter(F.col(vector).isNotNull())
    least = F.min(vector).alias("_c")
    if by:
        own = df.groupBy(*by).agg(least).select("_c", *[F.col(b).alias(f"_g{k}") for k, b in enumerate(by)])
        df = df.join(own, reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_g{k}")) for k, b in enumerate(by)]))
    else:
        df = df.withColumn("_c", df.select(least).scalar())
    df = df.withColumn(vector, F.zip_with(vector, "_c", lambda x, c: x.cast("double") - c))
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def multiply(batches):
        totals: dict[tuple, list] = {}
        for batch in batches:
            groups = batch.groupby(by, sort=False) if by else [((), batch)]
            for group, rows in groups:
                x = np.stack(rows[vector].to_numpy()).astype(float)
                held = totals.setdefault(group if isinstance(group, tuple) else (group,), [0, 0.0, 0.0])
                held[0] += len(x)
                held[1] = held[1] + x.sum(axis=0)
                held[2] = held[2] + x.T @ x
        for group, (n, s, g) in totals.items():
            i, j = np.triu_indices(len(s))
            out = pd.DataFrame({"i": i, "j": j, "n": n, "si": s[i], "sj": s[j], "sij": g[i, j]})
            for name, value in zip(by, group):
                out[name] = value
            yield out[[*by, "i", "j", "n", "si", "sj", "sij"]]

    schema = "".join(f"{b} {types[b]}, " for b in by) + "i int, j int, n long, si double, sj double, sij double"
    parts = df.select(*by, vector).mapInPandas(multiply, schema)
    return parts.groupBy(*by, "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "sij")])


def _cov(ddof: int):
    return (F.col("sij") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - ddof)


def collapse_metrics(df: DataFrame, vector: str, by: list[str] | None = None) -> DataFrame:
    """Lower median of per-dimension deviations and the participation ratio of the covariance spectrum.

    The ratio is ``trace(C)^2 / |C|^2``, which needs no eigenvalues.
    """
    by = by or []
    cov = cross_products(df, vector, by).withColumn("_c", _cov(1))
    diagonal = F.col("i") == F.col("j")
    twice = F.when(diagonal, 1.0).otherwise(2.0)
    out = cov.groupBy(*by).agg(
        F.max("n").alias("n_rows"),
        F.count(F.when(diagonal, 1)).alias("dim"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN i = j THEN sqrt(greatest(_c, 0.0)) END)").alias("std_median"),
        F.sum(F.when(diagonal, F.col("_c")).otherwise(0.0)).alias("_trace"),
        F.sum(twice * F.col("_c") * F.col("_c")).alias("_square"),
    )
    rank = F.when(F.col("_square") > 0, F.col("_trace") * F.col("_trace") / F.col("_square")).otherwise(0.0)
    return out.filter("n_rows >= 2").withColumn("effective_rank", rank).drop("_trace", "_square")


def collapse_verdict(
    metrics: DataFrame, std_floor: float = STD_MEDIAN_FLOOR, rank_floor: float = EFFECTIVE_RANK_FLOOR
) -> DataFrame:
    """Worst member against both floors."""
    worst = metrics.agg(F.min("std_median").alias("std_median"), F.min("effective_rank").alias("effective_rank"))
    return worst.withColumn("passed", (F.col("std_median") >= std_floor) & (F.col("effective_rank") >= rank_floor))


def regularity_scores(df: DataFrame, vector: str, by: list[str] | None = None, target: float = VARIANCE_TARGET) -> DataFrame:
    """Variance hinge (divisor n) and off-diagonal covariance penalty (divisor n-1) of an embedding table."""
    by = by or []
    sums = cross_products(df, vector, by)
    diagonal = F.col("i") == F.col("j")
    hinge = F.when(diagonal, F.greatest(F.lit(0.0), F.lit(target) - F.sqrt(_cov(0) + _VARIANCE_EPS)))
    unbiased = (F.col("sij") - F.col("si") * F.col("sj") / F.col("n")) / F.greatest(F.col("n") - 1, F.lit(1))
    return sums.groupBy(*by).agg(
        F.avg(hinge).alias("variance_term"),
        (F.sum(F.when(~diagonal, 2.0 * unbiased * unbiased).otherwise(0.0)) / F.count(F.when(diagonal, 1))).alias("covariance_term"),
    )
