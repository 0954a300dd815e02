"""Running sums over sorted groups of any size, by range partitions.

Rows are dealt over range partitions of (group, value), whose bounds Spark samples from the rows themselves, so they
follow groups with ranges of their own and split a group that holds most rows. Inside a partition the running sum of
each group is local; what lies in earlier partitions comes from a table with one row per group and partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.session import durable


def _changes(columns: list[pa.Array], last: tuple | None) -> np.ndarray:
    """Rows where a group begins; the first one only if it differs from ``last``."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        codes = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    new[0] = last is None or last != tuple(c[0].as_py() for c in columns)
    return new


def dealt(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows over range partitions of (by, order), each sorted."""
    return rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)


def running_sums(rows: DataFrame, by: list[str], order: list[str], amount: str) -> DataFrame:
    """``rows`` with ``_before long``, the sum of the whole-number ``amount`` over the rows of the same group that sort
    earlier, and ``_total long``, over the group. Rows equal in ``order`` should be collapsed before: their order
    among each other is not defined, and they stay in one partition. NULL groups are groups, NULL values sort first.
    """
    names = rows.columns
    held = by if by else ["_all"]
    staged = rows if by else rows.withColumn("_all", F.lit(0))
    laid = dealt(staged, held, order)
    schema = laid.select("*", F.lit(0).cast("int").alias("_part"), F.lit(0).cast("long").alias("_local")).schema
    groups, at = [laid.columns.index(b) for b in held], laid.columns.index(amount)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carried = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(g) for g in groups]
            sizes = batch.column(at).to_numpy().astype(np.int64)
            starts = _changes(columns, last)
            before = np.cumsum(sizes) - sizes
            first = np.flatnonzero(starts)
            # What came before each row's group in this batch; the first group may have begun in an earlier one.
            heads = np.concatenate([[0 if starts[0] else -carried], before[first[first > 0]]])
            sums = before - np.repeat(heads, np.diff(np.concatenate([[0], first[first > 0], [len(sizes)]])))
            last, carried = tuple(c[batch.num_rows - 1].as_py() for c in columns), int(sums[-1] + sizes[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(sizes), part, np.int32)), pa.array(sums)], schema=to_arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    to_arrow = to_arrow_schema(schema)
    # Stored, since the parts must be the same for the sums and for the rows.
    stored = durable(laid.mapInArrow(local, schema))
    parts = stored.groupBy(*held, "_part").agg(F.sum(amount).alias("_sum"))
    earlier = Window.partitionBy(*held).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *[F.col(b).alias(f"_g{i}") for i, b in enumerate(held)],
        F.col("_part").alias("_p"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_sum").over(Window.partitionBy(*held)).alias("_total"),
    )
    match = F.col("_part") == F.col("_p")
    for i, b in enumerate(held):
        match = match & F.col(b).eqNullSafe(F.col(f"_g{i}"))
    joined = stored.join(offsets, match)
    return joined.select(*names, (F.col("_offset") + F.col("_local")).alias("_before"), "_total")
