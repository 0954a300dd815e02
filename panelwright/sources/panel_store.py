"""Reading, shaping and storing panels as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICE_SCHEMA = T.StructType(
    [
        T.StructField("asset", T.StringType()),
        T.StructField("date", T.DateType()),
        *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "adj_close")],
        T.StructField("volume", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("fetched_at", T.TimestampType()),
    ]
)
MACRO_SCHEMA = T.StructType(
    [
        T.StructField("series_id", T.StringType()),
        T.StructField("obs_date", T.DateType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("available_date", T.DateType()),
        T.StructField("ingested_at", T.TimestampType()),
    ]
)
RAW_COLUMNS = ("Open", "High", "Low", "Close", "Volume")
PARTITION = "year"


def slice_panel(
    panel: DataFrame, keys: list[str] | None = None, start: str | None = None, end: str | None = None, key: str = "asset", order: str = "date"
) -> DataFrame:
    """Rows of the given keys with ``start <= date < end``; both filters reach the Parquet scan."""
    if keys is not None:
        panel = panel.filter(F.col(key).isin(keys))
    if start is not None:
        panel = panel.filter(F.col(order) >= F.lit(start).cast("date"))
    if end is not None:
        panel = panel.filter(F.col(order) < F.lit(end).cast("date"))
    return panel


def read_panel(
    spark: SparkSession, path: str, keys: list[str] | None = None, start: str | None = None, end: str | None = None, schema: T.StructType | None = None
) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return slice_panel(reader.parquet(path), keys, start, end)


def normalize_bars(raw: DataFrame, key: str = "asset", stamp: str = "Date") -> DataFrame:
    """Raw provider bars to the stored shape. Any other column set is schema drift and fails at once."""
    got, wanted = set(raw.columns) - {key, stamp}, set(RAW_COLUMNS)
    if got != wanted:
        raise ValueError(f"raw bar columns drifted: expected {sorted(wanted)}, got {sorted(got)}")
    close = F.col("Close").cast("double")
    return raw.select(
        key,
        F.to_date(F.col(stamp)).alias("date"),
        F.col("Open").cast("double").alias("open"),
        F.col("High").cast("double").alias("high"),
        F.col("Low").cast("double").alias("low"),
        close.alias("close"),
        close.alias("adj_close"),
        F.col("Volume").cast("long").alias("volume"),
    )


def write_panel(panel: DataFrame, path: str, key: str = "asset", order: str = "date", mode: str = "overwrite") -> None:
    """Store partitioned by year and sorted by (key, date) inside files, so key and date filters skip data.

    Rows are spread by (year, key): a year is written by many tasks, and each key's year by one.
    """
    staged = panel.withColumn(PARTITION, F.year(order))
    (
        staged.repartition(PARTITION, key)
        .sortWithinPartitions(PARTITION, key, order)
        .write.mode(mode)
        .partitionBy(PARTITION)
        .parquet(path)
    )


def store_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def rewrite_years(spark: SparkSession, path: str, updates: DataFrame, keys: list[str], order: str = "date") -> None:
    """Keyed upsert into a stored panel, rewriting only the years the updates touch.

    The list of years is the only thing the driver sees; it is bounded by the calendar. The job
    commits the new partitions together, so a failed attempt leaves the old ones in place.
    """
    from panelwright.operators.ingest import upsert

    if not store_exists(spark, path):
        write_panel(updates, path, keys[0], order)
        return
    staged = updates.withColumn(PARTITION, F.year(order))
    years = [r[0] for r in staged.select(PARTITION).distinct().collect()]
    if not years:
        return
    stored = spark.read.parquet(path).filter(F.col(PARTITION).isin(years))
    merged = upsert(stored, staged, [*keys, PARTITION])
    (
        merged.repartition(PARTITION, keys[0])
        .sortWithinPartitions(PARTITION, keys[0], order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(PARTITION)
        .parquet(path)
    )
