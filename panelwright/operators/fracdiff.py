"""Fixed-width fractional differencing and the search for the smallest stationary order."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright import contracts
from panelwright.defaults import ADF_PVALUE, FFD_THRESHOLD, MIN_ADF_SAMPLES
from panelwright.functions.scalars import correlation
from panelwright.functions.stationarity import adf_from_moments, default_max_lag, lag_design
from panelwright.operators.layout import AUTO, arrange, core_rows, index_rows, resolve_block

MAX_NATIVE_TERMS = 64
D_GRID = tuple(round(0.05 * i, 2) for i in range(21))


def ffd_weights(d: float, threshold: float = FFD_THRESHOLD) -> list[float]:
    """Weights of ``(1-B)^d`` in lag order, cut before the first one smaller than the threshold."""
    if not math.isfinite(threshold) or threshold <= 0:
        raise ValueError(f"threshold must be finite and positive, got {threshold!r}")
    if not math.isfinite(d) or d < 0:
        raise ValueError(f"d must be finite and not negative, got {d!r}")
    weights, lag = [1.0], 1
    while True:
        following = weights[-1] * (lag - 1 - d) / lag
        if abs(following) < threshold:
            return weights
        weights.append(following)
        lag += 1


def fracdiff(
    series: DataFrame,
    d: float,
    threshold: float = FFD_THRESHOLD,
    key: str = "asset",
    order: str = "date",
    value: str = "log_price",
    rows_per_block: int | str | None = AUTO,
    on_invalid: str = "raise",
):
    """``(key, date, fracdiff)``; rows without a full window are dropped.

    A value that is missing or not finite, and a key with fewer rows than the window, stop the job or, with
    ``on_invalid="quarantine"``, leave the key out and report it, whatever the window's length. Short
    windows are a sum of lags inside codegen; long ones (thousands of terms at small ``d``) are a
    convolution per key block with its halo.
    """
    contracts.check_mode(on_invalid)
    weights = ffd_weights(d, threshold)
    terms = len(weights)
    block = resolve_block(series, order, rows_per_block)
    block = None if block is None else max(block, terms)
    data = series.select(key, order, F.col(value).cast("double").alias("_x"))
    if block is None:
        data = data.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    else:
        data = index_rows(data, [key], order)
    short, wrong = F.col("_n") < terms, contracts.not_finite(F.col("_x"))
    report = None
    if on_invalid == contracts.RAISE:
        checked = F.when(wrong, contracts.fail("value of ", F.col(key), " at ", F.col(order), " is not finite")).when(
            short, contracts.fail(F.col(key), " has ", F.col("_n"), f" rows, the window needs {terms}")
        )
        data = data.withColumn("_x", checked.otherwise(F.col("_x")))
    else:
        reason = F.when(wrong, F.lit("value not finite")).otherwise(F.lit("fewer rows than the window"))
        report = contracts.violation_report(data.filter(wrong | short), key, order, reason)
        data, report = contracts.quarantine(data, key, report)
    frame, w = arrange(data, [key], order, back=terms - 1, rows_per_block=block)
    if terms <= MAX_NATIVE_TERMS:
        total = F.col("_x") * weights[0]
        for lag, weight in enumerate(weights[1:], start=1):
            total = total + F.lag("_x", lag).over(w) * weight
        out = core_rows(frame.withColumn("fracdiff", total).filter(F.col("fracdiff").isNotNull())).select(key, order, "fracdiff")
        return out if report is None else (out, report)
    kernel = np.asarray(weights)
    schema = f"{key} {series.schema[key].dataType.simpleString()}, {order} {series.schema[order].dataType.simpleString()}, fracdiff double"

    def convolve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        tail = rows.iloc[terms - 1 :]
        full = np.convolve(rows["_x"].to_numpy(float), kernel, "valid") if len(tail) else np.zeros(0)
        return tail[[key, order]].assign(fracdiff=full)[tail["_core"].to_numpy(bool)]

    groups = [key] + (["_blk"] if "_blk" in frame.columns else [])
    out = frame.groupBy(*groups).applyInPandas(convolve, schema)
    return out if report is None else (out, report)


def spectra(kernels: dict[float, np.ndarray], size: int) -> dict[float, np.ndarray]:
    return {d: np.fft.rfft(k, size) for d, k in kernels.items()}


def convolved(x: np.ndarray, kernels: dict[float, np.ndarray], known: dict[int, dict[float, np.ndarray]] | None = None) -> dict[float, np.ndarray]:
    """``np.convolve(x, kernel, "valid")`` for every kernel that fits, from one transform of each piece of ``x``.

    Overlap-save: pieces of a power-of-two size, each with the last ``widest - 1`` values before it, so the cost per
    value is the logarithm of the widest kernel instead of its length. ``known`` keeps kernel transforms by size.
    """
    fits = {d: k for d, k in kernels.items() if len(k) <= len(x)}
    if not fits:
        return {}
    known = {} if known is None else known
    widest = max(map(len, kernels.values()))
    size = 1 << int(max(min(4 * widest, len(x) + widest), 2) - 1).bit_length()
    if size not in known:
        known[size] = spectra(kernels, size)
    # Differencing at the mean keeps the transform's rounding small against the steps of the series.
    level = float(x.mean())
    step = size - widest + 1
    padded = np.concatenate([np.zeros(widest - 1), x - level, np.zeros(step)])
    parts: dict[float, list[np.ndarray]] = {d: [] for d in fits}
    for at in range(0, len(x), step):
        piece = np.fft.rfft(padded[at : at + size], size)
        for d in fits:
            parts[d].append(np.fft.irfft(piece * known[size][d], size)[widest - 1 :])
    return {d: np.concatenate(p)[len(fits[d]) - 1 : len(x)] + level * fits[d].sum() for d, p in parts.items()}


def min_d_search(
    series: DataFrame,
    d_grid: tuple[float, ...] = D_GRID,
    pvalue: float = ADF_PVALUE,
    threshold: float = FFD_THRESHOLD,
    key: str = "asset",
    order: str = "date",
    value: str = "log_price",
    rows_per_block: int | str | None = AUTO,
    on_invalid: str = "raise",
):
    """Smallest grid order whose differenced series passes the unit-root test, per key.

    Pass training rows only. Each key block yields the cross-product moments of its regression rows
    for every order, all from one transform of the block; the moments add up across blocks, and only that small sum
    reaches the task that chooses the lag and evaluates the test. No task needs a whole series in the blocked layout.
    """
    contracts.check_mode(on_invalid)
    kernels = {float(d): np.asarray(ffd_weights(float(d), threshold)) for d in sorted(d_grid)}
    widest = max(len(k) for k in kernels.values())
    data = series.select(key, order, F.col(value).cast("double").alias("_x"))
    data = data.withColumn(
        "_x",
        F.when(contracts.not_finite(F.col("_x")), contracts.fail("value of ", F.col(key), " at ", F.col(order), " is not finite")).otherwise(F.col("_x")),
    )
    indexed = index_rows(data, [key], order)
    block = resolve_block(series, order, rows_per_block)
    if block is None:
        frame = indexed.withColumn("_core", F.lit(True)).withColumn("_blk", F.lit(0).cast("long"))
    else:
        longest = indexed.agg(F.max("_n")).first()[0] or 0
        reach = widest + default_max_lag(max(longest, 1)) + 2
        frame, _ = arrange(indexed, [key], order, back=reach, rows_per_block=max(block, reach))
    key_type, known = series.schema[key].dataType.simpleString(), {}

    def moments(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_pos")
        x, pos = rows["_x"].to_numpy(float), rows["_pos"].to_numpy(int)
        core, n = rows["_core"].to_numpy(bool), int(rows["_n"].iloc[0])
        out, differenced = [], convolved(x, kernels, known)
        for d, kernel in kernels.items():
            terms = len(kernel)
            usable = n - terms + 1
            if usable < MIN_ADF_SAMPLES or len(x) < terms:
                continue
            z, at = differenced[d], pos[terms - 1 :] - (terms - 1)
            own, level = core[terms - 1 :], x[terms - 1 :]
            lags = default_max_lag(usable)
            design = lag_design(z, lags)
            chosen = design[own[lags + 1 :]]
            gram = chosen.T @ chosen
            head = own & (at <= lags)
            zo, lo = z[own], level[own]
            corr = [float(own.sum()), zo.sum(), lo.sum(), zo @ zo, lo @ lo, zo @ lo]
            cells = np.concatenate([gram.ravel(), corr, [float(len(chosen))]])
            kinds = np.concatenate([np.zeros(len(cells), int), np.ones(head.sum(), int)])
            slots = np.concatenate([np.arange(len(cells)), at[head]])
            values = np.concatenate([cells, z[head]])
            out.append(np.column_stack([np.full(len(values), d), kinds, slots, values]))
        cells = np.concatenate(out) if out else np.zeros((0, 4))
        name = np.full(len(cells), rows[key].iloc[0], dtype=object)
        return pd.DataFrame({key: name, "d": cells[:, 0], "kind": cells[:, 1].astype(int), "slot": cells[:, 2].astype(int), "v": cells[:, 3], "n": n})

    parts = frame.groupBy(key, "_blk").applyInPandas(moments, f"{key} {key_type}, d double, kind int, slot long, v double, n long")
    sums = parts.groupBy(key, "d", "n", "kind", "slot").agg(F.sum("v").alias("v"))

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        d, n = float(rows["d"].iloc[0]), int(rows["n"].iloc[0])
        terms = len(kernels[d])
        lags = default_max_lag(n - terms + 1)
        cells = rows[rows["kind"] == 0].sort_values("slot")["v"].to_numpy(float)
        head = rows[rows["kind"] == 1].sort_values("slot")["v"].to_numpy(float)
        width = lags + 3
        gram = cells[: width * width].reshape(width, width)
        k, sz, sl, zz, ll, zl = cells[width * width : width * width + 6]
        p = adf_from_moments(gram, int(cells[-1]), head, lags)
        scale = math.sqrt(max(zz - sz * sz / k, 0.0) * max(ll - sl * sl / k, 0.0))
        corr = (zl - sz * sl / k) / scale if scale > 0 else None
        return pd.DataFrame({key: [rows[key].iloc[0]], "d": [d], "window_len": [terms], "adf_pvalue": [p], "corr": [corr]})

    tested = sums.groupBy(key, "d").applyInPandas(
        decide, f"{key} {key_type}, d double, window_len long, adf_pvalue double, corr double"
    )
    passing = F.when(F.col("adf_pvalue") < pvalue, F.struct("d", "window_len", "adf_pvalue", "corr"))
    best = tested.groupBy(key).agg(F.min(passing).alias("_best"), F.count(F.lit(1)).alias("n_tested"))
    reason = F.when(F.col("n_tested").isNull(), F.lit("series too short for any order")).when(
        F.col("_best").isNull(), F.lit("no order reached stationarity")
    )
    keyed = data.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"), F.min(order).alias("_first")).join(best, key, "left")
    if on_invalid == contracts.RAISE:
        window = F.when(reason.isNotNull(), contracts.fail(F.col(key), ": ", reason, type_="long")).otherwise(F.col("_best.window_len"))
        return keyed.select(key, F.col("_best.d").alias("d"), window.alias("window_len"), "_best.adf_pvalue", "_best.corr")
    good = keyed.filter(reason.isNull()).select(key, "_best.d", "_best.window_len", "_best.adf_pvalue", "_best.corr")
    report = keyed.filter(reason.isNotNull()).select(
        key, reason.alias("reason"), F.col("_rows").alias("n_bad"), F.array(F.col("_first").cast("string")).alias("first_keys")
    )
    return good, report


def memory_retained(series: DataFrame, differenced: DataFrame, key: str = "asset", order: str = "date", value: str = "log_price") -> DataFrame:
    """Correlation of the differenced series with its level on the rows after warm-up."""
    return differenced.join(series.select(key, order, value), [key, order]).groupBy(key).agg(
        correlation("fracdiff", value).alias("memory"), F.count(F.lit(1)).alias("n_rows")
    )
