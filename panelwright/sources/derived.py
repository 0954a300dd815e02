"""Panels and ledgers derived from the benchmark tables by aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.defaults import STAGES
from panelwright.operators.layout import by_key


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _bars(lines: DataFrame, asset) -> DataFrame:
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")  # exact sums whatever the order
    return lines.groupBy(asset.alias("asset"), F.col("l_shipdate").cast("date").alias("date")).agg(
        F.min(unit).alias("low"),
        F.max(unit).alias("high"),
        (F.sum(cents).cast("double") / 100.0 / F.sum("l_quantity")).alias("adj_close"),
        F.sum("l_quantity").cast("long").alias("volume"),
    )


def prices(spark: SparkSession, folder: str) -> DataFrame:
    """Six assets, long history: mean unit price per day of each return flag and line status."""
    return _bars(table(spark, folder, "lineitem"), F.concat("l_returnflag", "l_linestatus"))


def supplier_prices(spark: SparkSession, folder: str) -> DataFrame:
    """One asset per supplier: the number of assets grows with the data.

    A supplier has hardly two lines a day, so lines go to the tasks of their asset at once: the bars and all windows
    over them need no other exchange.
    """
    lines = table(spark, folder, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("asset"), "l_shipdate", "l_quantity", "l_extendedprice"
    )
    return _bars(by_key(lines, "asset"), F.col("asset"))


def brand_prices(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return _bars(lines, F.col("p_brand"))


def macro(spark: SparkSession, folder: str) -> DataFrame:
    """Mean order value per priority and day; the 13th is a missing observation."""
    mean = F.avg("o_totalprice")
    day = F.col("o_orderdate").cast("date")
    return (
        table(spark, folder, "orders")
        .groupBy(F.col("o_orderpriority").alias("series_id"), day.alias("obs_date"))
        .agg(mean.alias("value"))
        .withColumn("value", F.when(F.dayofmonth("obs_date") != 13, F.col("value")))
    )


MACRO_SERIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
MACRO_LAGS = {"1-URGENT": 1, "2-HIGH": 1, "3-MEDIUM": 1, "4-NOT SPECIFIED": 1, "5-LOW": 3}


def runs(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "P", "skipped").otherwise("error")
    third = F.col("o_orderkey") % 3
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_custkey").alias("config_id"),
        status.alias("status"),
        F.when(third == 0, "schedule").when(third == 1, "manual").otherwise("startup").alias("trig"),
        F.col("o_orderdate").alias("started_at"),
    )


def target_weights(spark: SparkSession, folder: str) -> DataFrame:
    held = table(spark, folder, "lineitem").groupBy(
        F.col("l_orderkey").alias("run_id"), F.concat("l_returnflag", "l_linestatus").alias("asset")
    ).agg(F.sum("l_quantity").alias("_q"))
    totals = held.groupBy("run_id").agg(F.sum("_q").alias("_t"))
    return held.join(totals, "run_id").select("run_id", "asset", (F.col("_q") / F.col("_t")).alias("weight"))


def configs(spark: SparkSession, folder: str) -> DataFrame:
    """One recipe per customer."""
    c = table(spark, folder, "customer")
    return c.select(
        F.col("c_custkey").alias("config_id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 5 == 0, "fracdiff_macro").otherwise("basic").alias("feature_set"),
        F.when(F.col("c_custkey") % 11 == 0, "unheard").otherwise("ewma").alias("forecaster"),
        (F.col("c_nationkey") % 7).cast("long").alias("scenario_id"),
        F.when(F.col("c_custkey") % 2 == 0, "min_variance").otherwise("mvu").alias("optimizer"),
        (F.col("c_custkey") == 7).alias("is_central"),
        F.to_timestamp_ntz(F.lit("1997-06-01 00:00:00")).alias("updated_at"),
    )


def recipes(spark: SparkSession, folder: str) -> DataFrame:
    """One recipe per customer with its own halflife; every eleventh names a forecaster nobody registered."""
    c = table(spark, folder, "customer")
    halflife = F.lit(21.0) + (F.col("c_custkey") % 200) * 0.75
    return c.select(
        F.col("c_custkey").cast("long").alias("config_id"),
        F.when(F.col("c_custkey") % 5 == 0, "fracdiff_macro").otherwise("basic").alias("feature_set"),
        F.when(F.col("c_custkey") % 11 == 0, "unheard").otherwise("ewma").alias("forecaster"),
        (F.col("c_nationkey") % 7 + 1).cast("long").alias("scenario_id"),
        F.when(F.col("c_custkey") % 2 == 0, "min_variance").otherwise("mvu").alias("optimizer"),
        F.to_json(F.struct(F.struct(halflife.alias("halflife")).alias("forecaster"))).alias("params_json"),
    )


def run_stages(spark: SparkSession, folder: str) -> DataFrame:
    """A stage per distinct line of an order; the seventh line is a stage no run requires."""
    names = F.array(*[F.lit(s) for s in (*STAGES, "notify")])
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("_l")).agg(
        F.max("l_discount").alias("_d"), F.sum("l_quantity").alias("_q"), F.min("l_shipdate").alias("_s"), F.max("l_shipdate").alias("_e")
    )
    ready = F.date_format("_s", "yyyy-MM-dd")
    marks = F.concat(
        F.lit('{"data_max_date": "'), F.when(F.col("_q") > 10, "2001-11-04").otherwise(ready), F.lit('", "data_fetched_at": "'),
        F.when(F.col("_q") > 20, "2001-11-05").otherwise(ready), F.lit('"}'),
    )
    goal = F.concat(F.lit('{"objective": {"form": "'), F.when(F.col("_q") > 25, "utility").otherwise("variance"), F.lit('"}}'))
    detail = (
        F.when(F.col("_q") <= 3, "{broken")
        .when(F.col("_l") == 1, marks)
        .when(F.col("_l") == 6, goal)
    )
    return lines.select(
        "run_id",
        F.element_at(names, F.col("_l").cast("int")).alias("stage"),
        F.when(F.col("_d") < 0.09, "ok").otherwise("error").alias("status"),
        F.date_format("_s", "yyyy-MM-dd HH:mm:ss").alias("started_at"),
        F.when(F.col("_q") > 4, F.date_format("_e", "yyyy-MM-dd HH:mm:ss")).otherwise("unknown").alias("finished_at"),
        detail.alias("detail_json"),
    )
