"""Report files to parsed rows as they arrive.

Tasks list the folders and log the paths that are not logged yet, below the
checkpoint. The stream's source is that log, a handful of list files, so
neither the driver nor the source holds a path of a report; tasks read the
reports. A batch is written under its number: one that is repeated after a
failure replaces itself. Files that give no calls are kept beside the others
under their status, and the counters of a batch are observed while it is
written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqlab import runtime
from seqlab.functions.cleaning import bare_name
from seqlab.operators import traces

FOUND_COLUMNS = "path string, folder boolean, length long, modified long"
LIST_COLUMNS = "path string, length long, modified long"
ROW_COLUMNS = "path string, fname string, sequence array<string>, num_processes int, sequence_length int, batch int, status string"
STATES = ("ok", "empty", "unparsed", "too_long")
# a file is one value of one row, so longer ones are named but not read
LONGEST_FILE = 1 << 30
READ_BYTES = 4 << 20  # of file content that a task sends on at once
LISTED_ROWS = 10_000  # of folder entries
# files named in a list file at least, where there are cores for more of them, and at most
LEAST_LIST, LONGEST_LIST = 50, 2000
# Spark looks every file of a batch up again, one in a task unless told otherwise
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LISTING_TASKS = 4  # for each core


def few_listing_tasks(spark: SparkSession) -> None:
    """Let the session look files up in few tasks, unless it has a bound of its own; the source lists in the session of its reader."""
    if spark.conf.get(LISTING) == "10000":
        spark.conf.set(LISTING, str(LISTING_TASKS * spark.sparkContext.defaultParallelism))


@dataclass
class TraceFiles:
    """Report files below ``path`` (a folder, a file or a pattern of them), to be read by ``ingest_traces``."""

    spark: SparkSession
    path: str
    name: Callable[[Column], Column] = bare_name
    files_per_batch: int | None = None
    longest: int = LONGEST_FILE
    remembered: str = "36500d"


def stream_trace_files(
    spark: SparkSession, path: str, name: Callable[[Column], Column] = bare_name, files_per_batch: int | None = None,
    longest: int = LONGEST_FILE, remembered: str = "36500d",
) -> TraceFiles:
    """The files below ``path``: one JSON document each, invalid UTF-8 replaced; ``name`` takes the report's name from the path.

    Files older than ``remembered`` before the newest one of earlier runs are skipped when they turn up. A path is read
    once, so move whole files in. Files of no bytes give no row, as in Spark's own file scans.
    """
    few_listing_tasks(spark)
    return TraceFiles(spark, path, name, files_per_batch, longest, remembered)


def _place(path: str):
    """A pyarrow file system and the path in it of a path as Hadoop writes it."""
    short = path.startswith("file:/") and not path.startswith("file://")
    return runtime.open_fs(path[len("file:"):] if short else path)


def _left_out(name: str) -> bool:
    """Names that Spark's file scans leave out."""
    out = name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")
    return out and not name.startswith(("_common_metadata", "_metadata"))


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs as files

    schema = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("length", pa.int64()), ("modified", pa.int64())])
    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, place = _place(path)
            infos = fs.get_file_info(files.FileSelector(place))
            for at in range(0, len(infos), LISTED_ROWS):
                rows = [
                    {"path": f"{path.rstrip('/')}/{i.base_name}", "folder": not i.is_file, "length": i.size or 0, "modified": (i.mtime_ns or 0) // 1_000_000}
                    for i in infos[at : at + LISTED_ROWS]
                    if i.type in (files.FileType.File, files.FileType.Directory) and not _left_out(i.base_name)
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


def list_files(spark: SparkSession, path: str) -> list[DataFrame]:
    """(path, folder, length, modified) of everything below ``path``, a table for each level; tasks list the folders.

    Only the matches of ``path`` itself are looked up by the driver.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    if not found:
        raise FileNotFoundError(path)
    rows = [(s.getPath().toString(), s.isDirectory(), s.getLen(), s.getModificationTime()) for s in found]
    levels = [spark.createDataFrame(rows, FOUND_COLUMNS)]
    while True:
        folders = levels[-1].where("folder").select("path")
        n = folders.count()
        if not n:
            return levels
        dealt = folders.repartition(min(n, LISTING_TASKS * spark.sparkContext.defaultParallelism))
        levels.append(runtime.stored(dealt.mapInArrow(_list_folders, FOUND_COLUMNS), "level"))


def log_new_files(files: TraceFiles, log: str) -> None:
    """Append the files below ``files.path`` that ``log`` does not name yet; a list file names at most ``files_per_batch``, in order of age."""
    spark = files.spark
    found = reduce(DataFrame.unionByName, list_files(spark, files.path)).where("NOT folder").select("path", "length", "modified")
    known = _stored(spark, log, LIST_COLUMNS)
    newest = known.agg(F.max("modified")).first()[0]
    if newest is not None:
        span = spark._jvm.org.apache.spark.network.util.JavaUtils.timeStringAsMs(files.remembered)
        found = found.where(F.col("modified") >= newest - span).join(known, "path", "left_anti")
    new = runtime.stored(found, "new-files")
    n = new.count()
    if n and files.files_per_batch:  # written by one task, as the source takes list files in the order of their writing
        new.repartition(1).sortWithinPartitions("modified", "path").write.option("maxRecordsPerFile", files.files_per_batch).mode("append").parquet(log)
    elif n:
        cores = spark.sparkContext.defaultParallelism
        new.repartition(max(-(-n // LONGEST_LIST), min(LISTING_TASKS * cores, -(-n // LEAST_LIST)))).write.mode("append").parquet(log)


def _read_files(longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("too_long", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, rows, held = {}, [], 0
        for batch in batches:
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                content = None
                if length <= longest:
                    folder, _, name = path.rpartition("/")
                    if folder not in places:
                        places[folder] = _place(folder or "/")
                    fs, place = places[folder]
                    with fs.open_input_stream(f"{place.rstrip('/')}/{name}") as file:
                        content = file.read()
                rows.append({"path": path, "content": content, "too_long": content is None})
                held += len(content or b"") + len(path)
                if held >= READ_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read_new_files(files: TraceFiles, log: str) -> DataFrame:
    """(path, fname, text, too_long) of the files that ``log`` names, as a stream; files above ``longest`` are not opened."""
    reader = files.spark.readStream.schema(LIST_COLUMNS).option("maxFileAge", "36500d")
    if files.files_per_batch:
        reader = reader.option("maxFilesPerTrigger", 1)
    named = reader.parquet(log).where("length > 0").select("path", "length")
    read = named.mapInArrow(_read_files(files.longest), "path string, content binary, too_long boolean")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return read.select("path", files.name(F.col("path")).alias("fname"), text.alias("text"), "too_long")


def ingest_traces(files: TraceFiles, store: str, checkpoint: str) -> StreamingQuery:
    """Parse the files into ``store``; ends when all files that were there at its start are stored.

    The list of files that are known is kept below ``checkpoint``; a checkpoint of the time when Spark's source held
    that list does not count, its files are read again (``ingested`` still gives each name once).
    """
    log = f"{checkpoint}/listed"
    folder = files.spark._jvm.org.apache.hadoop.fs.Path(log)
    folder.getFileSystem(files.spark._jsc.hadoopConfiguration()).mkdirs(folder)
    log_new_files(files, log)
    parsed = traces.parse_traces(read_new_files(files, log)).drop("text")
    rows = parsed.withColumn("status", F.when(F.col("too_long"), "too_long").otherwise(F.col("status"))).drop("too_long")
    counters = [F.count_if(F.col("status") == s).alias(s) for s in STATES]

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation()
        counted = batch.observe(seen, F.count(F.lit(1)).alias("files"), *counters, F.sum("sequence_length").alias("calls"))
        counted.write.mode("overwrite").partitionBy("status").parquet(f"{store}/rows/batch={number}")
        found = seen.get
        line = [(*[found[c] for c in ("files", *STATES)], found["calls"] or 0)]
        schema = ", ".join(f"{c} long" for c in ("files", *STATES, "calls"))
        batch.sparkSession.createDataFrame(line, schema).coalesce(1).write.mode("overwrite").parquet(f"{store}/counts/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def ingested(spark: SparkSession, store: str) -> DataFrame:
    """The stored rows, one of each ``fname``: the first to arrive, by batch and path. An unused store is empty.

    A report that first came broken and later came whole is its whole form: rows with calls go before all others.
    """
    rows = _stored(spark, f"{store}/rows", ROW_COLUMNS)
    order = Window.partitionBy("fname").orderBy(F.col("status") != "ok", "batch", "path")
    return rows.withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_at")


def ingest_counts(spark: SparkSession, store: str) -> DataFrame:
    """(batch, files, ok, empty, unparsed, too_long, calls): the counters of every batch."""
    names = ("files", *STATES, "calls")
    schema = ", ".join(f"{c} long" for c in names)
    return _stored(spark, f"{store}/counts", f"{schema}, batch int").select("batch", *names)
