"""Session, checkpoint and scratch-folder helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after its rows were counted against this bound.
BROADCAST_ROWS = 500_000
# A global (unpartitioned) window is used only below this checked row count.
SINGLE_TASK_ROWS = 100_000

# Spark sends up to 10,000 rows or its default of bytes to a Python worker at once.
BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4194304b"


def get_spark(app: str = "seqlab", cores: str | None = None) -> SparkSession:
    """Local session for tests and benches; a cluster brings its own."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local-mode session without the setting gets a temporary folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="spark-seqlab-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def pin(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so later branches agree on the
    rows and a lost executor only re-reads files."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/seqlab-scratch/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the shared folder; unlike those of a checkpoint, its readers fetch the columns they use."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Send lists to Python in batches of BATCH_BYTES, so that a worker's memory does not grow with a partition.

    A session that has its own limit keeps it.
    """
    if spark.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def open_fs(uri: str):
    """A pyarrow file system and the path in it, for any shared store pyarrow knows; Hadoop's names of S3 are S3."""
    from pyarrow import fs

    scheme, _, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)


def fits(df: DataFrame, rows: int) -> bool:
    """True when ``df`` has at most ``rows`` rows (a distributed count)."""
    return df.count() <= rows


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def small_table(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """Evaluate a class-sized table once and hint it for broadcast.

    The rows are counted while they are fetched; a table above the bound is
    checkpointed instead and left to the optimizer without a hint.
    """
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        return pin(df)
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input of few file splits.

    A large input has more splits than cores and is left as it is, so this
    shuffles only what a handful of tasks could read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
