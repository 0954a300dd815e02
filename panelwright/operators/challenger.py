"""A regression challenger: an ensemble of ridge fits on standardized return windows.

Every fit is a sum of cross products, so all folds and all ensemble members come out of one pass over
the windows; only matrices of (context length + 2) squared are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright import contracts
from panelwright.defaults import SIGMA_FLOOR
from panelwright.session import durable

# Share of the training rows that each ensemble member draws, by a hash of the row.
MEMBER_PERCENT = 80
ROWS_PER_PART = 65_536
ROWS_PER_TASK = 524_288
WINDOWS_PER_BLOCK = 256


def fit_moments(
    rows: DataFrame, width: int, fits: dict[int, Column], features: str = "context", target: str = "realized_h",
    targets: dict[int, str] | None = None, stored: DataFrame | None = None,
) -> DataFrame:
    """``(fit, i, j, v, cx, cy)``: sums of products of ``[features - cx, target - cy, 1]`` over the rows of each fit.

    ``cx`` and ``cy`` are values met in the rows, so inputs far from zero lose no digits in the squares.

    ``fits`` maps a fit id to the condition its rows meet; a row is read once however many fits share
    it. Vectors cross into Python as plain columns, so a batch is a matrix without copying lists.
    ``targets`` names the target of fits that have another one. ``stored`` holds the same features and targets where
    ``rows`` should be read once only.
    """
    near = (rows if stored is None else stored).select(F.struct(F.min(F.col(features)[0]).cast("double").alias("x"), F.min(target).cast("double").alias("y"))).scalar()
    rows = rows.withColumn("_near", near)
    columns = [(F.col(features)[i] - F.col("_near.x")).alias(f"_x{i}") for i in range(width)]
    flags = [F.coalesce(condition, F.lit(False)).alias(f"_f{fit}") for fit, condition in fits.items()]
    size, ids = width + 2, list(fits)
    goals = {fit: (targets or {}).get(fit, target) for fit in ids}
    names = list(dict.fromkeys([target, *goals.values()]))
    own = {fit: [*range(width), width + names.index(goals[fit]), width + len(names)] for fit in ids}

    def multiply(batches):
        totals = {fit: np.zeros((size, size)) for fit in ids}
        for batch in batches:
            m = np.column_stack([batch.iloc[:, : width + len(names)].to_numpy(float), np.ones(len(batch))])
            for fit in ids:
                part = m[batch[f"_f{fit}"].to_numpy(bool)][:, own[fit]]
                totals[fit] += part.T @ part
        i, j = np.indices((size, size))
        for fit, gram in totals.items():
            yield pd.DataFrame({"fit": fit, "i": i.ravel(), "j": j.ravel(), "v": gram.ravel()})

    shifted = rows.select(*columns, *[(F.col(name) - F.col("_near.y")).alias(name) for name in names], *flags)
    parts = shifted.mapInPandas(multiply, "fit long, i int, j int, v double")
    sums = parts.groupBy("fit", "i", "j").agg(F.sum("v").alias("v"))
    return sums.withColumn("_near", near).select("fit", "i", "j", "v", F.col("_near.x").alias("cx"), F.col("_near.y").alias("cy"))


def solve_fits(moments: DataFrame, ridge: float, members: int, scaled: bool = True) -> DataFrame:
    """``(fold, member, mean, std, intercept, weights)``; a fit id is ``fold * (members + 1) + member + 1``.

    Slot 0 of a fold holds all its training rows: they give the scale inputs are standardized with.
    One fold's few small matrices are one group. The objective is mean squared error halved plus
    ``ridge / 2`` times the squared weights of the standardized inputs.
    """
    slots = members + 1

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        fold, out, grams = int(rows["fold"].iloc[0]), [], {}
        for fit, part in rows.groupby("fit"):
            size = int(part["i"].max()) + 1
            gram = np.zeros((size, size))
            gram[part["i"], part["j"]] = part["v"]
            grams[int(fit) % slots] = gram
        whole = grams[0]
        width = len(whole) - 2
        n = whole[-1, -1]
        mean = whole[:width, -1].sum() / (n * width)
        std = float(np.sqrt(max(np.trace(whole[:width, :width]) / (n * width) - mean**2, 0.0)))
        if not scaled:
            mean, std = 0.0, 1.0
        std = 1.0 if std < 1e-8 else std
        for slot, gram in sorted(grams.items()):
            if slot == 0:
                continue
            k = gram[-1, -1]
            x, y = gram[:width, -1] / k, gram[width, -1] / k
            xx = (gram[:width, :width] / k - np.outer(x, x)) / std**2
            xy = (gram[:width, width] / k - x * y) / std
            w = np.linalg.solve(xx + ridge * np.eye(width), xy)
            cx, cy = (float(rows[c].iloc[0]) for c in ("cx", "cy"))
            # The shifts fall out of the weights; mean and intercept take them back.
            out.append((fold, slot - 1, mean + (cx if scaled else 0.0), std, float(y + cy - ((x - mean + (0.0 if scaled else cx)) / std) @ w), w.tolist()))
        return pd.DataFrame(out, columns=["fold", "member", "mean", "std", "intercept", "weights"])

    keyed = moments.withColumn("fold", F.floor(F.col("fit") / slots))
    return keyed.groupBy("fold").applyInPandas(
        solve, "fold long, member long, mean double, std double, intercept double, weights array<double>"
    )


def fits_of(fold: int, role: Column, key: str, members: int, percent: int = MEMBER_PERCENT) -> dict[int, Column]:
    """Fit conditions of one fold: slot 0 takes all training rows, each member (also a single one) the
    ``percent`` of them that its hash draw keeps."""
    base, train = fold * (members + 1), role == "train"
    fits = {base: train}
    for m in range(members):
        drawn = F.pmod(F.xxhash64(F.col(key), F.col("pos"), F.lit(m)), F.lit(100)) < percent
        fits[base + m + 1] = train & drawn
    return fits


def linear_prediction(model: Column, vector: str = "context") -> Column:
    """A fitted model applied to a raw vector as a native column."""
    scaled = F.zip_with(vector, model["weights"], lambda x, w: (x - model["mean"]) / model["std"] * w)
    return F.aggregate(scaled, model["intercept"], lambda a, x: a + x)


def predict_members(rows: DataFrame, models: DataFrame, keep: list[str], fold: str = "fold") -> DataFrame:
    """``keep`` plus ``member`` and ``prediction``. The models, a few per fold, reach the rows as one array."""
    packed = models.select(F.collect_list(F.struct(*models.columns))).scalar()
    mine = F.filter("_models", lambda m: m["fold"] == F.col(fold))
    out = rows.withColumn("_models", packed).withColumn("_model", F.explode(mine))
    return out.select(*keep, F.col("_model.member").alias("member"), linear_prediction(F.col("_model")).alias("prediction"))


def predict_mean(rows: DataFrame, models: DataFrame, keep: list[str], fold: str = "fold") -> DataFrame:
    """``keep`` plus ``prediction``, the mean of the members, without a row per member; rows of folds without models go."""
    packed = models.select(F.collect_list(F.struct(*models.columns))).scalar()
    out = rows.withColumn("_models", packed).withColumn("_mine", F.filter("_models", lambda m: m["fold"] == F.col(fold))).filter(F.size("_mine") > 0)
    total = F.aggregate(F.transform("_mine", lambda m: linear_prediction(m)), F.lit(0.0), lambda a, x: a + x)
    return out.select(*keep, (total / F.size("_mine")).alias("prediction"))


def residual_variance(predictions: DataFrame, key: str = "asset", by: list[str] | None = None, assets: DataFrame | None = None) -> DataFrame:
    """Holdout variance of realized minus ensemble mean per asset; pooled where an asset has under two points.

    ``assets`` lists the (by, key) pairs that need one, by default those of the predictions: an asset
    too young to have a holdout is listed there and takes the pooled variance.
    """
    by = by or []
    rows = predictions if assets is None else predictions.filter("role = 'holdout'")
    held = lambda c: F.when(F.col("role") == "holdout", F.col(c))
    means = rows.groupBy(*by, key, "pos").agg(F.avg(held("prediction")).alias("_mu"), F.first(held("realized_h"), ignorenulls=True).alias("_y"))
    return variance_of_errors(means.select(*by, key, (F.col("_y") - F.col("_mu")).alias("_e")), key, by, assets)


def variance_of_errors(errors: DataFrame, key: str = "asset", by: list[str] | None = None, assets: DataFrame | None = None) -> DataFrame:
    """``residual_variance`` of errors ``(by, key, _e)``; rows with a NULL error only name their key."""
    by, floor = by or [], SIGMA_FLOOR**2
    # One pass; the pooled variance is put together from the moments of the assets, around their means.
    per_asset = durable(errors.groupBy(*by, key).agg(F.count("_e").alias("n_holdout"), F.avg("_e").alias("_m"), F.var_samp("_e").alias("_v"), F.var_pop("_e").alias("_vp")))
    seen = per_asset.filter("n_holdout > 0")
    n, total = F.col("n_holdout"), F.sum("n_holdout")
    middle = seen.groupBy(*by).agg((F.sum(n * F.col("_m")) / total).alias("_mean"))
    around = seen.join(middle, by) if by else seen.withColumn("_mean", middle.scalar())
    gap = F.col("_m") - F.col("_mean")
    square = F.when(total > 1, F.sum(n * (F.col("_vp") + gap * gap)) / (total - 1))
    pooled = around.groupBy(*by).agg(F.greatest(F.coalesce(square, F.lit(0.0)), F.lit(floor)).alias("_pooled"))
    per_asset = per_asset.select(*by, key, "n_holdout", "_v")
    assets = per_asset if assets is None else assets.select(*by, key).distinct().join(per_asset, [*by, key], "left")
    assets = assets.join(pooled, by, "left") if by else assets.withColumn("_pooled", pooled.scalar())
    own = F.when(F.col("n_holdout") >= 2, F.greatest("_v", F.lit(floor))).otherwise(
        F.coalesce("_pooled", contracts.fail("no holdout at all: no residual variance for ", F.col(key)))
    )
    return assets.select(*by, key, F.coalesce("n_holdout", F.lit(0)).alias("n_holdout"), own.alias("residual_var"))


def ensemble_forecast(
    predictions: DataFrame, residuals: DataFrame, key: str = "asset", order: str = "date", by: list[str] | None = None
) -> DataFrame:
    """Mean of the members, and a deviation made of residual variance plus member disagreement."""
    by = by or []
    combined = predictions.groupBy(*by, key, order).agg(
        F.avg("prediction").alias("mu"), F.coalesce(F.var_samp("prediction"), F.lit(0.0)).alias("_between")
    )
    total = F.col("residual_var") + F.col("_between")
    return combined.join(residuals.select(*by, key, "residual_var"), [*by, key]).select(
        *by, key, order, "mu", F.sqrt(F.greatest(total, F.lit(SIGMA_FLOOR**2))).alias("sigma")
    )


def _tasks(rows: DataFrame, n: int) -> int:
    """As many tasks as ``n`` rows ask for, so that what one holds doesn't grow with them."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_PER_TASK))


def _ranked(rows: DataFrame, by: Column, ties: list[str], n: int) -> DataFrame:
    """``rows`` with ``_rank``, the 0-based place among all ``n`` rows by a 64-bit hash.

    Hashes lie evenly over their range, so equal shares of it are parts of about ``ROWS_PER_PART`` rows: a row's
    place is that within its part and the sizes of the parts before, a table with one row per part.
    """
    parts = -(-n // ROWS_PER_PART)
    share = F.floor((by.cast("double") / 2.0**63 + 1) / 2 * parts)
    rows = rows.withColumn("_by", by).withColumn("_part", F.least(share, F.lit(max(parts - 1, 0))))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_k"))
    before = F.sum("_k").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = durable(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before")))
    local = F.row_number().over(Window.partitionBy("_part").orderBy("_by", *ties)) - 1
    placed = rows.repartition(_tasks(rows, n), "_part").withColumn("_local", local).join(sizes, "_part")
    return placed.withColumn("_rank", F.col("_before") + F.col("_local")).drop("_by", "_part", "_local", "_before")


def drawn_targets(train: DataFrame, n: int, seed: int = 0, key: str = "asset", target: str = "realized_h") -> DataFrame:
    """``(key, pos, _drawn)``: targets permuted over the rows; rows ranked by one hash are paired with targets ranked by another.

    ``train``, of ``n`` rows, is read several times. Only names and targets of rows move, no vectors.
    """
    rows = _ranked(train.select(key, "pos"), F.xxhash64(key, "pos", F.lit(seed)), [key, "pos"], n)
    targets = _ranked(train.select(key, "pos", target), F.xxhash64(key, "pos", F.lit(seed + 1_000_003)), [key, "pos"], n)
    rows, targets = (x.repartition(_tasks(train, n), "_rank") for x in (rows, targets.select("_rank", F.col(target).alias("_drawn"))))
    return rows.join(targets, "_rank").select(key, "pos", "_drawn")


def shuffled_targets(train: DataFrame, seed: int = 0, key: str = "asset", target: str = "realized_h") -> DataFrame:
    """Training windows ``(context, target, _drawn)``: beside its own target each has one of the permuted targets.

    Windows and drawn targets meet as arrays of up to ``WINDOWS_PER_BLOCK`` consecutive positions of a key.
    """
    n = train.count()

    def packed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        rows = rows.withColumn("_blk", F.floor(F.col("pos") / WINDOWS_PER_BLOCK)).repartition(_tasks(train, n), key, "_blk")
        return rows.groupBy(key, "_blk").agg(F.sort_array(F.collect_list(F.struct("pos", *columns))).alias(name))

    own = packed(train, "own", "context", target)
    blocks = own.join(packed(drawn_targets(train, n, seed, key, target), "other", "_drawn"), [key, "_blk"])
    pairs = blocks.select(F.inline(F.arrays_zip("own", "other")))
    return pairs.select("own.context", f"own.{target}", "other._drawn")


def shuffled_control(
    windows: DataFrame, width: int = 16, ridge: float = 0.1, seed: int = 0, target: str = "realized_h", key: str = "asset"
) -> DataFrame:
    """Holdout error of a fit on real pairs against one on permuted pairs: ``(real_mse, shuffled_mse)``.

    Both are fits of one fold over the same rows, which give the scale as well. The windows are made once and stored.
    """
    windows = durable(windows.filter("role IN ('train', 'holdout')").select(key, "pos", "role", "context", target))
    train = windows.filter("role = 'train'")
    pairs = shuffled_targets(train, seed, key, target)
    moments = fit_moments(pairs, width, {fit: F.lit(True) for fit in range(3)}, target=target, targets={2: "_drawn"}, stored=train)
    models = solve_fits(moments, ridge, members=2)
    held = windows.filter("role = 'holdout'").withColumn("fold", F.lit(0))
    scored = predict_members(held, models, [target])
    error = F.pow(F.col(target) - F.col("prediction"), 2)
    return scored.agg(
        F.avg(F.when(F.col("member") == 0, error)).alias("real_mse"), F.avg(F.when(F.col("member") == 1, error)).alias("shuffled_mse")
    )
