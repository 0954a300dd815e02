"""How a long panel is spread over tasks for ordered (window) work.

Two layouts give the same results:

* **whole key** - one window partition per key. Used when the order column is a DATE: ``(key, date)``
  is unique, so a key holds at most 366 rows per calendar year however large the table is.
* **blocked** - a key is cut into blocks of ``rows_per_block`` consecutive rows, each with copies of
  the few neighbouring rows its frames reach (halo). Used for timestamp-ordered panels, where one key
  may hold any share of the table. Running totals cross blocks through a small per-block table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.operators.ranged import running_sums
from panelwright.session import durable, unite

AUTO = "auto"
DEFAULT_ROWS_PER_BLOCK = 65_536
ROWS_PER_BUCKET = 1_000_000
BUCKET_DAYS = 512
BUCKET_SECONDS = 86_400
BYTES_PER_TASK = 2 << 20  # of stored, compressed input


def is_date(df: DataFrame, order: str) -> bool:
    return isinstance(df.schema[order].dataType, T.DateType)


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to tasks by key, as many tasks as the files behind the frame ask for.

    A number of shuffle partitions that a session fixes gives every task more rows as the input grows. Here a task's
    share of the input, and so what its sorts and windows hold, stays the same. Frames without files are left as they are.
    """
    spark, size = df.sparkSession, 0
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        size += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    if not size:
        return df
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-size // BYTES_PER_TASK)), *keys)


def order_number(df: DataFrame, order: str) -> Column:
    """The order column as a number that never decreases with it: days, seconds or the number itself."""
    kind, column = df.schema[order].dataType, F.col(order)
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_seconds(column)
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("SECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), column)
    if isinstance(kind, T.NumericType):
        return column
    raise TypeError(f"order column {order!r} must be a date, timestamp or number, got {kind.simpleString()}")


def order_bucket(df: DataFrame, order: str, width: int | None = None) -> Column:
    """A coarse, order-preserving bucket: ``width`` days for dates, seconds for timestamps, units for numbers."""
    default = BUCKET_DAYS if is_date(df, order) else BUCKET_SECONDS
    return F.floor(order_number(df, order) / F.lit(width or default))


def resolve_block(df: DataFrame, order: str, rows_per_block: int | str | None) -> int | None:
    if rows_per_block == AUTO:
        return None if is_date(df, order) else DEFAULT_ROWS_PER_BLOCK
    return None if rows_per_block is None else int(rows_per_block)


def index_rows(
    df: DataFrame, keys: list[str], order: str, pos: str = "_pos", size: str = "_n", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Add the 0-based position of each row within its key and the key's length.

    Keys of up to ``rows_per_bucket`` rows are ranked in one piece. Rows of longer keys are dealt over range
    partitions whose bounds are sampled from them, with a hash of the row behind the order column, so neither a burst
    nor rows of one instant stay together; positions are sums of what came before (``ranged``). ``keys=[]`` ranks the
    whole frame the same way. Which keys are long is counted first: of N rows at most ``N / rows_per_bucket``.
    """
    one = Window.partitionBy(*keys)
    ranked = lambda rows: rows.withColumn(pos, (F.row_number().over(one.orderBy(order)) - 1).cast("long")).withColumn(size, F.count(F.lit(1)).over(one))
    if not keys:
        return _dealt(df, keys, order, pos, size) if df.count() > rows_per_bucket else ranked(df)
    long_keys = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all")).filter(F.col("_all") > rows_per_bucket).select(*keys)
    if long_keys.isEmpty():
        return ranked(df)
    long_keys = durable(long_keys)
    long_rows = df.join(long_keys, keys, "left_semi").select(*df.columns)
    return unite(ranked(df.join(long_keys, keys, "left_anti").select(*df.columns)), _dealt(long_rows, keys, order, pos, size))


def _dealt(df: DataFrame, keys: list[str], order: str, pos: str, size: str) -> DataFrame:
    ties = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    rows = df.withColumn("_one", F.lit(1).cast("long")).withColumn("_tie", F.xxhash64(*ties))
    return running_sums(rows, keys, [order, "_tie"], "_one").select(*df.columns, F.col("_before").alias(pos), F.col("_total").alias(size))


def arrange(
    df: DataFrame,
    keys: list[str],
    order: str,
    back: int = 0,
    ahead: int = 0,
    rows_per_block: int | str | None = AUTO,
) -> tuple[DataFrame, WindowSpec]:
    """Lay the panel out for frames reaching ``back`` rows behind and ``ahead`` rows in front.

    Returns the frame with a ``_core`` flag (drop the other rows when done) and the window to use.
    """
    block = resolve_block(df, order, rows_per_block)
    if block is None:
        return df.withColumn("_core", F.lit(True)), Window.partitionBy(*keys).orderBy(order)
    indexed = df if "_pos" in df.columns else index_rows(df, keys, order)
    pos = F.col("_pos")
    first = F.greatest(F.lit(0), F.floor((pos - ahead) / block))
    last = F.least(F.floor((pos + back) / block), F.floor((F.col("_n") - 1) / block))
    spread = indexed.withColumn("_blk", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    spread = spread.withColumn("_core", F.floor(pos / block) == F.col("_blk"))
    return spread, Window.partitionBy(*keys, "_blk").orderBy("_pos")


def core_rows(df: DataFrame) -> DataFrame:
    """Drop halo copies and the layout columns."""
    return df.filter(F.col("_core")).drop("_core", "_blk", "_pos", "_n")


def fresh(df: DataFrame) -> DataFrame:
    """New column identities, so two frames derived from one another can be cogrouped."""
    return df.select(*[F.col(f"`{c}`").alias(c) for c in df.columns])
