"""From raw documents to encoded ones, stage by stage; each stage is one operator over all its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import decontaminate, line_dedup, near_dup, pieces, quality
from panelwright.session import durable, shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts."""
    return quality.classify(docs, _table(spark, sf_dir, "labels")).where("predicted = 1").select(*docs.columns)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many pages of their source repeat; ``n_chars`` follows the text."""
    cut = line_dedup.dedup_lines(docs).drop("n_lines", "n_removed")
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (one row, if it is repeated)."""
    groups = durable(near_dup.near_duplicates(docs))
    stay = groups.where("kept").select(F.col("doc_id").alias("stay_id"), F.lit(True).alias("stays")).distinct()
    kept = docs.join(stay, F.col("doc_id").eqNullSafe(F.col("stay_id")), "left_semi")
    # Kept ids are unique unless rows are repeated; only then is one of the equal rows picked.
    repeated = groups.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    named, unnamed = kept.where("doc_id IS NOT NULL"), kept.where("doc_id IS NULL")
    return named.dropDuplicates(["doc_id"]).unionByName(unnamed)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    judged = decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    return judged.where("NOT contaminated").select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document, decoded again to show that nothing is lost."""
    coded = pieces.encode(docs, decoded="decoded")
    return coded.withColumn("lossless", F.col("decoded").eqNullSafe(F.col("text"))).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("line dedup", without_boilerplate),
    ("near-duplicates", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("sentencepiece", encoded),
]

# Trained weights, min-hash banding and seeded sampling have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is stored in the shared folder and read again, so a lost executor never repeats a stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-{uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
