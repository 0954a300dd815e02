"""Dealing the rows of very frequent keys over several parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARES = 4096


def hot_parts(rows: DataFrame, key: str, rows_per_part: int | None = None) -> DataFrame:
    """``key, parts`` of the keys holding more than 1/4096 of all rows, to be joined by broadcast.

    There can't be more than 4,096 such keys, whatever the input, which is what makes the broadcast safe. Without
    ``rows_per_part`` a part holds about 1/4096 of all rows.
    """
    total = rows.count()
    least = max(total / HOT_SHARES, rows_per_part or 1)
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > least)
    return sizes.select(key, F.ceil(F.col("rows") / (rows_per_part or least)).cast("int").alias("parts"))
