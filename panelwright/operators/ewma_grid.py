"""Exponentially weighted forecasts for a whole table of halflives in one pass over the panel.

The state of a forecaster is linear in the returns: two sums that fade by ``2^(-1/halflife)`` a bar. A task streams
its keys in order and carries these sums, the forecasts of the last ``horizon`` bars and the moments of the errors
as vectors with one slot per halflife, so a hundred settings cost one scan, one exchange and one sort, as one does.
Error moments are kept as mean and centred squares, so returns far from zero lose no digits.

Memory follows a stretch of ``ROWS`` bars times the slots, never a key's length. A timestamp-ordered key is still
one task here; ``ewma.ewma_forecast`` cuts such keys into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright import contracts
from panelwright.defaults import ERROR_WARMUP_BARS, HORIZON_BARS, MIN_ERROR_SAMPLES

ROWS = 512
SLOTS = 256  # halflives of one exchange copy of the panel
_EXPONENT = 256.0  # 2^256 and its square stay far inside the double range
_FLAT = 1e-14


class Forecaster:
    """Running state of one key, one slot per halflife."""

    def __init__(self, halflives: np.ndarray, horizon: int, warmup: int) -> None:
        self.h, self.horizon, self.warmup = halflives, horizon, warmup
        self.rows = max(1, min(ROWS, int(_EXPONENT * halflives.min())))
        n = len(halflives)
        self.pos = 0
        self.num, self.den = np.zeros(n), np.zeros(n)
        self.mus = np.zeros((0, n))
        self.rets = np.zeros(0)
        self.k, self.mean, self.square = 0, np.zeros(n), np.zeros(n)

    def step(self, r: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Forecast means of the next bars, and with ``every`` their deviations too (NaN where there is none)."""
        t = np.arange(1, len(r) + 1)[:, None]
        grow = np.exp2(t / self.h)
        num = (self.num + np.cumsum(r[:, None] * grow, 0)) / grow
        den = (self.den + np.cumsum(grow, 0)) / grow
        self.num, self.den = num[-1], den[-1]
        mu = num / den * self.horizon
        mus, rets = np.concatenate([self.mus, mu]), np.concatenate([self.rets, r])
        first = self.pos + len(r) - len(rets)  # bar at the head of both
        # The error at bar p compares the forecast made at p - horizon with the returns since.
        bars = np.arange(max(self.warmup, first) + self.horizon, self.pos + len(r))
        spread = np.full(mu.shape, np.nan) if every else None
        if len(bars):
            sums = np.lib.stride_tricks.sliding_window_view(rets, self.horizon).sum(1)
            errors = mus[bars - self.horizon - first] - sums[bars - self.horizon + 1 - first][:, None]
            if every:
                spread[bars - self.pos] = self._running(errors)
            self._merge(errors)
            if every and self.pos + len(r) > bars[-1] + 1:
                spread[bars[-1] + 1 - self.pos :] = self.deviation()
        self.pos += len(r)
        self.mus, self.rets = mus[-self.horizon :], rets[-self.horizon :]
        return mu, spread

    def _running(self, errors: np.ndarray) -> np.ndarray:
        """Sample deviation of all errors up to each new one."""
        n = np.arange(1, len(errors) + 1)[:, None]
        centre = self.mean if self.k else errors[0]
        shifted = errors - centre
        local = np.cumsum(shifted, 0) / n
        square = np.cumsum(shifted * shifted, 0) - n * local * local
        total = self.k + n
        square = self.square + square + (local * local * (self.k * n / total) if self.k else 0.0)
        return np.sqrt(np.maximum(square, 0.0) / np.where(total > 1, total - 1, np.nan))

    def _merge(self, errors: np.ndarray) -> None:
        n, mean = len(errors), errors.mean(0)
        square = ((errors - mean) ** 2).sum(0)
        gap, total = mean - self.mean, self.k + n
        self.square += square + gap * gap * (self.k * n / total)
        self.mean = self.mean + gap * (n / total)
        self.k = total

    def deviation(self) -> np.ndarray:
        return np.sqrt(self.square / (self.k - 1)) if self.k > 1 else np.full(len(self.h), np.nan)


def _stretches(batches: Iterator[pa.RecordBatch], key: int, part: int, order: int, ret: int) -> Iterator[tuple[tuple, np.ndarray, pa.Array]]:
    """``((key, part), returns, order values)`` of the runs of equal keys within each batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).dictionary_encode()
        codes = keys.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        parts = batch.column(part).to_numpy()
        cuts = np.flatnonzero((codes[1:] != codes[:-1]) | (parts[1:] != parts[:-1])) + 1
        values = batch.column(ret).to_numpy(zero_copy_only=False)
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            yield (batch.column(key)[a].as_py(), int(parts[a])), values[a:b], batch.column(order).slice(a, b - a)


def _columns(names: list[str], arrays: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(arrays, names)


def forecast_grid(
    returns: DataFrame,
    halflives: list[float],
    key: str = "asset",
    order: str = "date",
    ret: str = "log_return",
    horizon: int = HORIZON_BARS,
    warmup: int = ERROR_WARMUP_BARS,
    latest: bool = False,
    on_invalid: str = "raise",
):
    """``(key, order, halflife, mu, sigma, n_bars)`` for every halflife, at every bar with enough history or, with
    ``latest``, at each key's newest bar only.

    Equal to ``ewma_forecast`` at each halflife. ``halflives`` may hold thousands of values: blocks of 256 share one
    copy of the panel in the exchange. Repeated values count once; none gives no rows. Keys with too short a
    history or constant returns stop the job or, with ``"quarantine"``, leave it as ``(good, report)``.
    """
    contracts.check_mode(on_invalid)
    slots = np.array(sorted({float(h) for h in halflives}), float)
    if not np.isfinite(slots).all() or (slots <= 0).any():
        raise ValueError("halflives must be finite and positive")
    blocks = max(1, -(-len(slots) // SLOTS))
    kinds = {f.name: f.dataType.simpleString() for f in returns.schema.fields}
    rows = returns.select(F.col(key).alias("_key"), F.col(order).alias("_at"), F.col(ret).cast("double").alias("_r"))
    rows = rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))) if blocks > 1 else F.lit(0))
    laid = rows.repartition("_key", "_part").sortWithinPartitions("_key", "_part", "_at")
    need = warmup + horizon + MIN_ERROR_SAMPLES
    names = ["_key", "_at", "halflife", "mu", "sigma", "n_bars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, last = None, None, None
        key_type = at_type = None

        def rows_of(at: pa.Array, first: int, mu: np.ndarray, sigma: np.ndarray) -> pa.RecordBatch:
            n, many = mu.shape
            bars = np.repeat(np.arange(first + 1, first + n + 1), many)
            made = [pa.array([now[0]] * (n * many), key_type), at.take(pa.array(np.repeat(np.arange(n), many))), pa.array(np.tile(state.h, n))]
            made += [pa.array(mu.ravel()), pa.array(sigma.ravel(), mask=np.isnan(sigma.ravel())), pa.array(bars, pa.int64())]
            return _columns(names, made)

        def closing() -> Iterator[pa.RecordBatch]:
            if state is not None and len(state.h) and (latest or state.pos < need):
                yield rows_of(last, state.pos - 1, state.mus[-1:], state.deviation()[None])

        for own, r, at in _stretches(batches, 0, 3, 1, 2):
            if own != now:
                yield from closing()
                now, state = own, Forecaster(slots[own[1] * SLOTS : (own[1] + 1) * SLOTS], horizon, warmup) if len(slots) else None
            if state is None:
                continue
            key_type, at_type = pa.array([own[0]]).type if own[0] is not None else pa.null(), at.type
            for a in range(0, len(r), state.rows):
                part, first = r[a : a + state.rows], state.pos
                mu, sigma = state.step(part, not latest)
                if not latest and state.pos >= need:
                    skip = max(0, need - 1 - first)
                    yield rows_of(at.slice(a + skip, len(part) - skip), first + skip, mu[skip:], sigma[skip:])
            last = at.slice(len(at) - 1, 1)
        yield from closing()

    schema = f"_key {kinds[key]}, _at {kinds[order]}, halflife double, mu double, sigma double, n_bars bigint"
    found = laid.mapInArrow(run, schema).select(F.col("_key").alias(key), F.col("_at").alias(order), *names[2:])
    short = F.col("n_bars") < need
    flat = ~(F.col("sigma") > _FLAT) | F.col("sigma").isNull() | F.isnan("sigma")
    if on_invalid == contracts.RAISE:
        sigma = (
            F.when(short, contracts.fail("history of ", F.col(key), " has ", F.col("n_bars"), f" bars, need {need}"))
            .when(flat, contracts.fail("returns of ", F.col(key), " are constant up to ", F.col(order)))
            .otherwise(F.col("sigma"))
        )
        return found.withColumn("sigma", sigma)
    bad = found.filter(short | flat)
    report = contracts.violation_report(bad, key, order, F.when(short, F.lit("history too short")).otherwise(F.lit("constant returns")))
    return contracts.quarantine(found.filter(~short), key, report)
