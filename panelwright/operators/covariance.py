"""Shrunk covariance of a joint panel, as partial cross products per block of dates and tile pair."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright import contracts
from panelwright.defaults import MIN_COV_ROWS, PSD_TOL, TRADING_DAYS
from panelwright.operators.layout import order_bucket

TILE_ASSETS = 512
TILE_DATES = 256


def pair_moments(
    panel: DataFrame,
    key: str = "asset",
    order: str = "date",
    ret: str = "log_return",
    tile_assets: int = TILE_ASSETS,
    tile_dates: int = TILE_DATES,
    centered: bool = True,
) -> DataFrame:
    """``(asset_i, asset_j, n, xy, x2y2)`` for ``asset_i <= asset_j`` over a common-date panel.

    Assets are hashed into tiles and dates cut into blocks; one task multiplies two tiles over one
    block (two matrix products) and the small results add up. Pairs are never formed row by row,
    and a task holds at most ``tile_dates`` x two tiles of values. A row is copied once per tile.
    """
    rows = panel.select(key, order, F.col(ret).cast("double").alias("_x"))
    if centered:
        means = rows.groupBy(key).agg(F.avg("_x").alias("_mean"))
        rows = rows.join(means, key).select(key, order, (F.col("_x") - F.col("_mean")).alias("_x"))
    tiles = panel.select(F.ceil(F.count_distinct(key) / tile_assets).alias("t")).scalar()
    rows = rows.withColumn("_tiles", F.greatest(tiles, F.lit(1))).withColumn(
        "_tile", F.pmod(F.xxhash64(key), F.col("_tiles"))
    )
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1)))
    rows = rows.select(
        key,
        order,
        "_x",
        "_tile",
        F.least("_tile", "_other").alias("_ti"),
        F.greatest("_tile", "_other").alias("_tj"),
        order_bucket(rows, order, tile_dates).alias("_dates"),
    )
    key_type = panel.schema[key].dataType.simpleString()

    def multiply(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        _, ti, tj = group
        days, row = np.unique(part[order].to_numpy(), return_inverse=True)
        names, column = np.unique(part[key].to_numpy(), return_inverse=True)
        tile_of = np.zeros(len(names), dtype="int64")
        tile_of[column] = part["_tile"].to_numpy()
        x = np.full((len(days), len(names)), np.nan)
        x[row, column] = part["_x"].to_numpy(float)
        left, right = names[tile_of == ti], names[tile_of == tj]
        a, b = x[:, tile_of == ti], x[:, tile_of == tj]
        i, j = np.meshgrid(left, right, indexing="ij")
        xy, x2y2 = a.T @ b, (a * a).T @ (b * b)
        i, j, xy, x2y2 = i.ravel(), j.ravel(), xy.ravel(), x2y2.ravel()
        if ti == tj:
            keep = i <= j
            i, j, xy, x2y2 = i[keep], j[keep], xy[keep], x2y2[keep]
        else:
            swap = i > j
            i, j = np.where(swap, j, i), np.where(swap, i, j)
        return pd.DataFrame({"asset_i": i, "asset_j": j, "n": len(days), "xy": xy, "x2y2": x2y2})

    parts = rows.groupBy("_dates", "_ti", "_tj").applyInPandas(
        multiply, f"asset_i {key_type}, asset_j {key_type}, n long, xy double, x2y2 double"
    )
    return parts.groupBy("asset_i", "asset_j").agg(
        F.sum("n").alias("n"), F.sum("xy").alias("xy"), F.sum("x2y2").alias("x2y2")
    )


def _both_triangles(pairs: DataFrame, *values: str) -> DataFrame:
    straight = F.struct(F.col("asset_i").alias("asset_i"), F.col("asset_j").alias("asset_j"))
    flipped = F.struct(F.col("asset_j").alias("asset_i"), F.col("asset_i").alias("asset_j"))
    sides = F.when(F.col("asset_i") == F.col("asset_j"), F.array(straight)).otherwise(F.array(straight, flipped))
    return pairs.select(F.explode(sides).alias("_p"), *values).select("_p.asset_i", "_p.asset_j", *values)


def empirical_cov(moments: DataFrame) -> DataFrame:
    """Sample covariance with divisor n, both triangles."""
    return _both_triangles(moments.select("asset_i", "asset_j", (F.col("xy") / F.col("n")).alias("cov")), "cov")


def shrinkage_stats(moments: DataFrame) -> DataFrame:
    """One row: size, sample length, target scale and shrinkage weight (Ledoit and Wolf 2004)."""
    s = F.col("xy") / F.col("n")
    twice = F.when(F.col("asset_i") == F.col("asset_j"), 1.0).otherwise(2.0)
    sums = moments.agg(
        F.sum(F.when(F.col("asset_i") == F.col("asset_j"), 1).otherwise(0)).alias("p"),
        F.max("n").alias("n"),
        F.sum(F.when(F.col("asset_i") == F.col("asset_j"), s).otherwise(0.0)).alias("trace"),
        F.sum(twice * s * s).alias("squares"),
        F.sum(twice * F.col("x2y2") / F.col("n")).alias("fourth"),
    )
    mu = F.col("trace") / F.col("p")
    delta = (F.col("squares") - mu * F.col("trace") * 2 + mu * mu * F.col("p")) / F.col("p")
    beta = (F.col("fourth") - F.col("squares")) / (F.col("p") * F.col("n"))
    sums = sums.withColumn("mu", mu).withColumn("_delta", delta).withColumn("_beta", beta)
    weight = F.when(F.least("_beta", "_delta") <= 0, 0.0).otherwise(F.least("_beta", "_delta") / F.col("_delta"))
    return sums.withColumn("shrinkage", weight).select("p", "n", "mu", "shrinkage")


def ledoit_wolf(moments: DataFrame, min_rows: int = MIN_COV_ROWS) -> DataFrame:
    """Annualized shrunk covariance ``(asset_i, asset_j, cov)``, both triangles.

    ``moments`` is read twice (statistics, then entries); pass a stored frame when it is large.
    """
    stats = shrinkage_stats(moments).select(F.struct("n", "mu", "shrinkage").alias("s")).scalar()
    joined = moments.withColumn("_s", stats)
    s = F.col("_s.shrinkage")
    entry = (F.lit(1.0) - s) * F.col("xy") / F.col("n") + F.when(
        F.col("asset_i") == F.col("asset_j"), s * F.col("_s.mu")
    ).otherwise(0.0)
    checked: Column = F.when(
        F.col("_s.n") < min_rows, contracts.fail("covariance needs ", F.lit(min_rows), " common rows, got ", F.col("_s.n"))
    ).otherwise(entry * TRADING_DAYS)
    return _both_triangles(joined.select("asset_i", "asset_j", checked.alias("cov")), "cov")


def psd_check(cov: DataFrame, by: list[str], tolerance: float = PSD_TOL) -> DataFrame:
    """Smallest eigenvalue of each matrix and whether it counts as positive semidefinite.

    One matrix is one group: its size is the square of the portfolio's asset count, whatever the
    length of the price history.
    """
    types = {f.name: f.dataType.simpleString() for f in cov.schema.fields}

    def smallest(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        matrix = rows.pivot(index="asset_i", columns="asset_j", values="cov").to_numpy(float)
        low = float(np.linalg.eigvalsh((matrix + matrix.T) / 2).min())
        return pd.DataFrame({**{b: [g] for b, g in zip(by, group)}, "n_assets": [len(matrix)], "min_eigenvalue": [low]})

    schema = ", ".join(f"{b} {types[b]}" for b in by) + ", n_assets long, min_eigenvalue double"
    return cov.groupBy(*by).applyInPandas(smallest, schema).withColumn("is_psd", F.col("min_eigenvalue") > -tolerance)
