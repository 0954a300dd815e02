"""Session settings and durable cut points."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
UNION_CONF = "spark.sql.unionOutputPartitioning"
_stored: list[str] = []


def build_session(app: str = "panelwright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join splitting, Arrow transfer and UTC timestamps."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        UNION_CONF: "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def unite(first: DataFrame, *others: DataFrame, fill: bool = False) -> DataFrame:
    """Union by name with a known Spark 4.1 fault kept out.

    That version lets a union claim the partitioning of its children. When adaptive execution then
    replaces a child's shuffle, rows of one key can sit in several partitions while a window or an
    aggregate above skips its exchange. The setting is switched off before the plan can run.
    """
    first.sparkSession.conf.set(UNION_CONF, "false")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=fill), others, first)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is configured and all tasks share this machine.

    On a cluster without the setting each executor would write to its own disk and the read-back would miss
    rows, so that is refused.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if configured:
        return configured
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share: this session runs on {master}")
    if not hasattr(shared_folder, "local"):
        shared_folder.local = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return shared_folder.local


def durable(df: DataFrame, rows_per_file: int = 0) -> DataFrame:
    """Store a frame that is read several times and continue from the stored copy.

    It is written once as a table in the shared folder, so neither a second reader nor a lost executor
    repeats the work behind it. (A Dataset checkpoint would compute the frame twice.)

    ``rows_per_file`` is for rows of megabytes: Parquet looks at a page's size every 100 rows only, so writers and
    readers otherwise hold all rows of a task at once. 0: no limit.
    """
    spark = df.sparkSession
    path = stored_folder(spark)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_folder(spark: SparkSession) -> str:
    """A new folder in the shared one that ``release`` deletes with the stored frames."""
    path = f"{shared_folder(spark)}/panelwright-{uuid.uuid4().hex}"
    _stored.append(path)
    return path


def stored_mark() -> int:
    """A point in the list of stored frames, to release only what is stored after it."""
    return len(_stored)


def release(spark: SparkSession, mark: int = 0) -> int:
    """Delete the frames that ``durable`` stored since ``mark``, once nothing reads them any more; returns how many."""
    gone = _stored[mark:]
    del _stored[mark:]
    for path in gone:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(gone)
