"""Continuous price ingest: keyed upsert, revision detection and change-driven recompute."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelwright.defaults import OVERLAP_DAYS
from panelwright.operators.ingest import overlap_mismatches
from panelwright.session import durable, release, stored_mark, unite
from panelwright.sources.panel_store import PARTITION, rewrite_years, store_exists
from panelwright.sources.versioned import Snapshot, Store

INTERVAL = "5 minutes"


def moved_keys(before: DataFrame, after: DataFrame, key: str = "asset") -> DataFrame:
    """Keys whose ``(max_date, max_fetched)`` marks differ or were unknown before."""
    old = before.select(key, F.col("max_date").alias("_d"), F.col("max_fetched").alias("_f"))
    same = (F.col("max_date") == F.col("_d")) & (F.col("max_fetched") == F.col("_f"))
    return after.join(old, key, "left").filter(~F.coalesce(same, F.lit(False))).select(key)


def key_marks(prices: DataFrame, key: str = "asset") -> DataFrame:
    return prices.groupBy(key).agg(F.max("date").alias("max_date"), F.max("fetched_at").alias("max_fetched"))


def foreach_batch(
    path: str,
    full_history: Callable[[DataFrame], DataFrame] | None = None,
    recompute: Callable[[DataFrame, int], None] | None = None,
    key: str = "asset",
    order: str = "date",
):
    """A ``foreachBatch`` function merging each batch into the stored panel.

    Keys whose overlap disagrees with the store are refreshed from ``full_history(keys)``. Writes are
    keyed upserts of whole years, so replaying a batch changes nothing. ``recompute`` gets the batch's
    keys whose marks moved, once the store holds the batch. What a batch stored on the way is deleted at its end.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, mark = batch.sparkSession, stored_mark()
        chosen = batch.groupBy(key, order).agg(
            F.max_by(F.struct(*[c for c in batch.columns if c not in (key, order)]), "fetched_at").alias("_r")
        ).select(key, order, "_r.*").select(*batch.columns)
        chosen = durable(chosen)  # read by the revision check, the marks and the write
        before = None
        if store_exists(spark, path):
            stored = spark.read.parquet(path).drop(PARTITION)
            mine = stored.join(chosen.select(key).distinct(), key, "left_semi")
            before = key_marks(mine, key)
            if full_history is not None:
                revised = overlap_mismatches(mine, chosen, OVERLAP_DAYS, key=key, order=order).select(key).distinct()
                history = full_history(revised).select(*batch.columns)
                fresh = chosen.join(history.select(key, order), [key, order], "left_anti")
                chosen = durable(unite(fresh, history))
        moved = None
        if recompute is not None:
            # The marks of the old store are read before it is rewritten.
            after = key_marks(chosen, key)
            moved = durable(after.select(key) if before is None else moved_keys(before, after, key))
        rewrite_years(spark, path, chosen, [key, order], order)
        if moved is not None:
            recompute(moved, batch_id)
        release(spark, mark)

    return run


def foreach_batch_versioned(
    store: Store,
    table: str = "prices",
    stream: str = "prices",
    full_history: Callable[[DataFrame], DataFrame] | None = None,
    recompute: Callable[[DataFrame, int, Snapshot], None] | None = None,
    compact_after: int = 16,
):
    """A ``foreachBatch`` function that commits each batch to a versioned store as one version.

    Only the batch's own rows are written. The overlap check opens the files that can hold the last days of the
    batch's keys, found through the store's marks, instead of their history. A replayed batch is not written again;
    ``recompute`` gets the keys whose marks differ between the version before the batch and the batch's own, and that
    snapshot, so it sees exactly the data the gate judged, on a replay too.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        mark, done = stored_mark(), store.batch(stream, batch_id)
        if done is None:
            before = store.snapshot(table)
            key, order = before.table["keys"]
            others = [c for c in batch.columns if c not in (key, order)]
            chosen = batch.groupBy(key, order).agg(F.max_by(F.struct(*others), "fetched_at").alias("_r"))
            chosen = durable(chosen.select(key, order, "_r.*").select(*batch.columns))
            keys = chosen.select(key).distinct()
            oldest = before.marks().join(keys, key, "left_semi").agg(F.min("max_date")).first()[0] if full_history is not None else None
            if oldest is not None:
                recent = before.read(low=oldest - timedelta(days=OVERLAP_DAYS)).join(keys, key, "left_semi")
                revised = overlap_mismatches(recent, chosen, OVERLAP_DAYS, key=key, order=order).select(key).distinct()
                history = full_history(revised).select(*batch.columns)
                fresh = chosen.join(history.select(key, order), [key, order], "left_anti")
                chosen = durable(unite(fresh, history))
            store.commit({table: chosen}, batch=(stream, batch_id), unique=True)
            done = store.batch(stream, batch_id)
        if recompute is not None:
            before, after = store.snapshot(table, done["parent"]), store.snapshot(table, done["version"])
            recompute(moved_keys(before.marks(), after.marks(), before.table["keys"][0]), batch_id, after)
        release(batch.sparkSession, mark)
        store.compact(table, compact_after)

    return run


def start(stream: DataFrame, handler, checkpoint: str, always_on: bool = True) -> StreamingQuery:
    """Run every five minutes, or once over everything available."""
    writer = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=INTERVAL) if always_on else writer.trigger(availableNow=True)
    return writer.start()
