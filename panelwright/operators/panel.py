"""Joint panels and feature matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.asof import asof_join, macro_wide
from panelwright.operators.fracdiff import fracdiff
from panelwright.operators.layout import AUTO, index_rows
from panelwright.operators.returns import return_features
from panelwright.session import unite

SEPARATOR = "_"


def feature_column(asset: str, feature: str) -> str:
    return f"{asset}{SEPARATOR}{feature}"


def common_dates(panel: DataFrame, n_assets: int | None = None, key: str = "asset", order: str = "date") -> DataFrame:
    """Dates on which every asset has a row: one map-side combined count, no N-way join."""
    counts = panel.groupBy(order).agg(F.count(F.lit(1)).alias("_seen"))
    wanted = F.lit(n_assets) if n_assets is not None else panel.select(F.count_distinct(key)).scalar()
    return counts.filter(F.col("_seen") == wanted).select(order)


def common_date_panel(panel: DataFrame, n_assets: int | None = None, key: str = "asset", order: str = "date") -> DataFrame:
    """Rows on the common dates. Returns must be computed before this, so gaps are never re-chained."""
    return panel.join(common_dates(panel, n_assets, key, order), order, "left_semi")


def panel_positions(panel: DataFrame, order: str = "date") -> DataFrame:
    """Add ``pos`` (0-based bar of the joint panel) and ``n_panel`` to a common-date panel."""
    index = index_rows(panel.select(order).distinct(), [], order, pos="pos", size="n_panel")
    return panel.join(index, order)


def covariance_window(returns: DataFrame, n_assets: int | None = None, key: str = "asset", order: str = "date") -> DataFrame:
    """First and last common bar, their number, and the overlap start (latest first bar of any asset)."""
    firsts = returns.groupBy(key).agg(F.min(order).alias("_first"))
    return common_dates(returns, n_assets, key, order).agg(
        F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("bars")
    ).withColumn("overlap_start", firsts.select(F.max("_first")).scalar())


def feature_panel(
    prices: DataFrame,
    n_assets: int | None = None,
    d_by_asset: dict[str, float] | None = None,
    threshold: float = 1e-5,
    key: str = "asset",
    order: str = "date",
    price: str = "adj_close",
    rows_per_block: int | str | None = AUTO,
) -> DataFrame:
    """Long feature rows per (asset, date) on the dates every asset has all its features.

    Fractional orders are an explicit input: they are chosen on training rows only.
    """
    features = return_features(prices, key, order, price, rows_per_block=rows_per_block)
    if d_by_asset:
        logs = prices.select(key, order, F.log(price).alias("log_price"))
        by_d: dict[float, list[str]] = {}
        for asset, d in d_by_asset.items():
            by_d.setdefault(d, []).append(asset)
        parts = [
            fracdiff(logs.filter(F.col(key).isin(assets)), d, threshold, key, order, "log_price", rows_per_block)
            for d, assets in sorted(by_d.items())
        ]
        features = features.join(unite(*parts), [key, order])
    return common_date_panel(features, n_assets, key, order)


def feature_matrix(
    prices: DataFrame,
    assets: list[str],
    macro: DataFrame | None = None,
    series_ids: list[str] | None = None,
    d_by_asset: dict[str, float] | None = None,
    threshold: float = 1e-5,
    key: str = "asset",
    order: str = "date",
) -> DataFrame:
    """Wide matrix: one ``ASSET_feature`` column per pair plus one column per macro series."""
    panel = feature_panel(prices, len(assets), d_by_asset, threshold, key, order)
    names = [c for c in panel.columns if c not in (key, order)]
    wide = panel.groupBy(order).pivot(key, assets).agg(*[F.first(n).alias(n) for n in names])
    wide = wide.select(order, *[F.col(f"`{feature_column(a, n)}`") for a in assets for n in names])
    if macro is None or not series_ids:
        return wide
    joined = asof_join(wide.select(order), macro, date=order, series_ids=series_ids)
    return wide.join(macro_wide(joined, series_ids, date=order), order, "left")


def split_matrix(matrix: DataFrame, assets: list[str], features: list[str], order: str = "date") -> DataFrame:
    """Back from the wide matrix to one row per (asset, date); macro columns repeat on every asset."""
    prefixed = {feature_column(a, f) for a in assets for f in features}
    shared = [c for c in matrix.columns if c != order and c not in prefixed]
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("asset"), *[F.col(f"`{feature_column(a, f)}`").alias(f) for f in features])
            for a in assets
        ]
    )
    return matrix.select(order, F.explode(rows).alias("_r"), *[F.col(f"`{c}`") for c in shared]).select(
        "_r.asset", order, *[f"_r.{f}" for f in features], *[F.col(f"`{c}`") for c in shared]
    )
