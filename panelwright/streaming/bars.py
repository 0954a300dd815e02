"""Event-time bars from ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tick_bars(
    ticks: DataFrame, width: str = "1 hour", delay: str = "10 minutes", key: str = "event_type", stamp: str = "ts", value: str = "value"
) -> DataFrame:
    """Open, high, low, close and tick count per key and tumbling window.

    On a stream, windows close when the watermark passes and later ticks for them are dropped; on a
    static frame the same plan is a plain aggregation. Partial aggregation keeps a hot key cheap.
    """
    source = ticks.withWatermark(stamp, delay) if ticks.isStreaming else ticks
    return (
        source.groupBy(F.col(key).alias("asset"), F.window(stamp, width).alias("_w"))
        .agg(
            F.min_by(value, stamp).alias("open"),
            F.max(value).alias("high"),
            F.min(value).alias("low"),
            F.max_by(value, stamp).alias("close"),
            F.count(F.lit(1)).alias("n_ticks"),
        )
        .select("asset", F.col("_w.start").alias("bar_start"), "open", "high", "low", "close", "n_ticks")
    )
