"""Sinks: extracted-trace Parquet, aligned text, reports, caches, resumable ingest."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlab import fixed_values as V
from seqlab import runtime
from seqlab.operators import labels

EXTRACTED_COLUMNS = [
    "sha256", "family_avclass", "family_cape", "family_consensus", "primary_class", "secondary_classes",
    "api_sequence", "num_processes", "sequence_length", "source_volume",
]

FILE_FOLDERS = 256


def write_extracted(rows: DataFrame, path: str, mode: str = "append") -> None:
    """The 10-column trace Parquet (snappy); arrays become joined text."""
    out = rows.select(
        *[F.col(c).cast("string").alias(c) for c in EXTRACTED_COLUMNS[:5]],
        F.array_join("secondary_classes", ",").alias("secondary_classes"),
        F.array_join("api_sequence", " ").alias("api_sequence"),
        *[F.col(c).cast("int").alias(c) for c in EXTRACTED_COLUMNS[7:]],
    )
    out.write.mode(mode).option("compression", "snappy").parquet(path)


def write_aligned_text(
    spark: SparkSession, extracted: str, sequences: str, labels: str, drop_trojan: bool = False,
) -> int:
    """Sequence and label files with matching lines; returns the row count.

    Both files are written from one checkpointed frame, so their partitions
    and row order agree.
    """
    rows = spark.read.parquet(extracted).where(F.col("primary_class").isNotNull() & (F.col("primary_class") != ""))
    if drop_trojan:
        rows = rows.where(F.col("primary_class") != V.TROJAN)
    pinned = runtime.pin(rows.select("api_sequence", "primary_class"))
    pinned.select(F.col("api_sequence").alias("value")).write.mode("errorifexists").text(sequences)
    pinned.select(F.col("primary_class").alias("value")).write.mode("errorifexists").text(labels)
    return pinned.count()


def write_text_files(rows: DataFrame, path: str, folders: int = FILE_FOLDERS) -> int:
    """Each row's ``text`` as a file named ``fname``, below ``path`` in folders by the name's checksum; returns the file count.

    A null text is an empty line. Tasks write the files themselves, so nothing is renamed by the driver, and a repeated
    task writes the same files again. Names are distinct and hold no slash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = runtime.open_fs(path)
        made, n = set(), 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folder = f"{base}/{zlib.crc32(name.encode()) % folders:03d}"
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                with fs.open_output_stream(f"{folder}/{name}") as out:
                    out.write(f"{text or ''}\n".encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return runtime.spread(rows).select("fname", "text").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def write_reports(rows: DataFrame, path: str) -> None:
    """Add (hash, response) rows as one save; readers see the last save of a hash.

    A save is appended, so readers never meet a half-replaced store.
    """
    stamp = datetime.now(timezone.utc)
    rows.select(
        "hash", "response", F.lit(stamp).alias("saved_at"), F.lit(uuid.uuid4().hex).alias("batch")
    ).write.mode("append").parquet(path)


def write_label_report(labelled: DataFrame, path: str, key: str = "hash") -> None:
    """samples/, dropped_hashes/ and stats/ as JSON."""
    kept = labels.kept(labelled)
    kept.write.mode("overwrite").json(f"{path}/samples")
    labels.dropped(labelled, key).write.mode("overwrite").json(f"{path}/dropped_hashes")
    spread = kept.groupBy("label").agg(F.count("*").alias("n"))
    family_distribution = F.map_from_entries(F.collect_list(F.struct("label", "n")))  # one entry per class
    totals = labels.label_totals(labelled).select("total_labeled", "total_dropped").first()
    stats = spread.agg(family_distribution.alias("family_distribution")).select(
        F.lit(totals["total_labeled"]).alias("total_labeled"), F.lit(totals["total_dropped"]).alias("total_dropped"),
        "family_distribution",
    )
    stats.write.mode("overwrite").json(f"{path}/stats")


def reuse_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], use_cache: bool = True) -> DataFrame:
    """The stored table when its job had finished, else build, store and read it."""
    if use_cache and finished(spark, path):
        return spark.read.parquet(path)
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def finished(spark: SparkSession, path: str) -> bool:
    """True when the job that wrote ``path`` left its success mark there."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def append_new(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Append the rows whose key is not stored yet; returns the stored table.

    Keys are compared with nulls equal. Of several new rows of a key one is kept.
    """
    spark = rows.sparkSession
    rows = rows.dropDuplicates([key])
    try:
        done = spark.read.parquet(path).select(F.col(key).alias("_done"))
        fresh = rows.join(done, F.col(key).eqNullSafe(F.col("_done")), "left_anti")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        fresh = rows
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path)
