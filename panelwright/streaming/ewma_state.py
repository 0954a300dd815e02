"""Incremental exponentially weighted forecasts over a stream of bars."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelwright.defaults import HALFLIFE_BARS, HORIZON_BARS
from panelwright.operators.layout import AUTO, index_rows
from panelwright.operators.returns import log_returns, latest_rows
from panelwright.session import durable, release, stored_mark, unite
from panelwright.sources.panel_store import store_exists

STATE_SCHEMA = "asset string, num double, den double, n long, last_date date, last_price double"


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE_SCHEMA)


def advance(
    state: DataFrame, bars: DataFrame, halflife: float = HALFLIFE_BARS, rows_per_block: int | str | None = AUTO
) -> tuple[DataFrame, DataFrame]:
    """Fold a batch of bars ``(asset, date, adj_close)`` into the state: ``(new state, late keys)``.

    The weighted sums are associative, so the batch is reduced with map-side combining and then
    merged with the old state; no key is walked row by row. A key with a bar at or before its newest
    one was revised: it keeps its state and is listed for a batch recompute.
    """
    old = state.select("asset", F.col("last_date").alias("_d"), F.col("last_price").alias("_p"))
    tagged = bars.select("asset", "date", "adj_close").join(old, "asset", "left")
    late = tagged.filter(F.col("date") <= F.col("_d")).select("asset").distinct()
    fresh = tagged.select("asset", "date", "adj_close").join(late, "asset", "left_anti")
    anchors = old.filter(F.col("_d").isNotNull()).join(fresh.select("asset").distinct(), "asset", "left_semi")
    panel = unite(fresh, anchors.select("asset", F.col("_d").alias("date"), F.col("_p").alias("adj_close")))
    newest = latest_rows(panel)
    counted = panel.groupBy("asset").agg(F.count(F.lit(1)).alias("_k"))
    returns = log_returns(panel.join(counted.filter("_k > 1"), "asset", "left_semi"), rows_per_block=rows_per_block)
    placed = index_rows(returns, ["asset"], "date")
    weight = F.pow(F.lit(2.0), -(F.col("_n") - 1 - F.col("_pos")) / halflife)
    batch = placed.groupBy("asset").agg(
        F.sum(F.col("log_return") * weight).alias("_num"), F.sum(weight).alias("_den"), F.max("_n").alias("_k")
    )
    merged = (
        state.join(batch, "asset", "full")
        .join(newest.select("asset", F.col("date").alias("_date"), F.col("adj_close").alias("_price")), "asset", "full")
    )
    k = F.coalesce("_k", F.lit(0))
    fade = F.pow(F.lit(2.0), -k / halflife)
    return (
        merged.select(
            "asset",
            (F.coalesce("num", F.lit(0.0)) * fade + F.coalesce("_num", F.lit(0.0))).alias("num"),
            (F.coalesce("den", F.lit(0.0)) * fade + F.coalesce("_den", F.lit(0.0))).alias("den"),
            (F.coalesce("n", F.lit(0)) + k).cast("long").alias("n"),
            F.coalesce("_date", "last_date").alias("last_date"),
            F.coalesce("_price", "last_price").alias("last_price"),
        ),
        late,
    )


def state_forecast(state: DataFrame, horizon: int = HORIZON_BARS) -> DataFrame:
    return state.filter("n > 0").select("asset", "last_date", "n", (F.col("num") / F.col("den") * horizon).alias("mu"))


def foreach_batch(path: str, halflife: float = HALFLIFE_BARS, on_late: Callable[[DataFrame, int], None] | None = None):
    """A ``foreachBatch`` function keeping one state snapshot per batch under ``path``.

    Batch ``b`` reads the snapshot before it and overwrites its own, so a replayed batch gives the
    same state. ``on_late`` gets the keys to recompute. Snapshots before the one just read are deleted: only the
    newest batch can be replayed.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = stored_mark()
        earlier = next((b for b in range(batch_id - 1, -1, -1) if store_exists(spark, f"{path}/batch={b}/_SUCCESS")), None)
        state = empty_state(spark) if earlier is None else spark.read.schema(STATE_SCHEMA).parquet(f"{path}/batch={earlier}")
        updated, late = advance(state, durable(batch), halflife)
        updated.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if on_late is not None:
            on_late(late, batch_id)
        if earlier:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={earlier - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        release(spark, mark)

    return run


def faded_sums(x: np.ndarray, halflife: float, start: float) -> np.ndarray:
    """``s_i = s_(i-1) * 2^(-1 / halflife) + x_i`` from ``s_0 = start``, by cumulative sums over spans that stay in range."""
    span, out = max(1, int(512 * halflife)), np.empty(len(x))
    for at in range(0, len(x), span):
        part = x[at : at + span]
        if span == 1:
            out[at] = start * 2.0 ** (-1.0 / halflife) + part[0]
        else:
            steps = np.arange(1, len(part) + 1) / halflife
            out[at : at + span] = (start + np.cumsum(part * np.exp2(steps))) * np.exp2(-steps)
        start = out[min(at + span, len(x)) - 1]
    return out


def stateful_forecast(stream: DataFrame, halflife: float = HALFLIFE_BARS, horizon: int = HORIZON_BARS) -> DataFrame:
    """The same forecast emitted for every arriving return, with Spark keeping the state per key.

    Takes ``(asset, date, log_return)``. A return at or before the newest one of earlier batches, and a second one
    for a date, is emitted as ``recompute`` and does not touch the state. A key's rows of a batch are put in
    order as a whole, so the result doesn't depend on how they arrive in chunks; for keys that dominate a batch use
    :func:`foreach_batch`, which combines before it shuffles by key.
    """

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        num, den, n, last = state.get if state.exists else (0.0, 0.0, 0, -(10**9))
        rows = pd.concat(list(chunks)).sort_values(["date", "log_return"], kind="stable")
        days = (pd.to_datetime(rows["date"]) - pd.Timestamp("1970-01-01")).dt.days.to_numpy()
        fresh = (days > last) & np.concatenate([[True], days[1:] != days[:-1]])
        r = rows["log_return"].to_numpy(float)[fresh]
        nums, dens = faded_sums(r, halflife, num), faded_sums(np.ones(len(r)), halflife, den)
        mu = np.full(len(rows), np.nan)
        mu[fresh] = nums / dens * horizon
        yield pd.DataFrame({"asset": key[0], "date": rows["date"].to_numpy(), "n": n + np.cumsum(fresh), "mu": mu, "status": np.where(fresh, "ok", "recompute")})
        if len(r):
            num, den, n, last = float(nums[-1]), float(dens[-1]), n + len(r), int(days[fresh][-1])
        state.update((num, den, n, last))

    return stream.groupBy("asset").applyInPandasWithState(
        step,
        "asset string, date date, n long, mu double, status string",
        "num double, den double, n long, last long",
        "append",
        GroupStateTimeout.NoTimeout,
    )
