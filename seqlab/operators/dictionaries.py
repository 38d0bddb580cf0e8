"""Lookups for array columns in which the rows never move.

Rows are stored once with the number of the partition that wrote them. Only the distinct keys of each partition are
shuffled to the table that resolves them, and come back as one dictionary file per partition, which the tasks that
read the partition's rows look up. A key of a third of all calls is one row per partition, and no side needs to fit
into memory as a whole: a dictionary holds what one partition's rows name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from seqlab import runtime

# values of lists, and bytes of a batch, that are worked on at once; a longer row is worked on alone
PIECE_VALUES = 1 << 19
PIECE_BYTES = 8 << 20

KeysOf = Callable[[pa.RecordBatch], pa.Array]
Apply = Callable[[pa.RecordBatch, pa.Table], list[pa.Array]]


@dataclass
class Staged:
    """Stored rows; ``part`` is the column with the number of the partition that wrote them."""

    rows: DataFrame
    part: str


def stage(rows: DataFrame) -> Staged:
    """Write ``rows`` once below the shared folder."""
    spark = rows.sparkSession
    runtime.small_batches(spark)
    part = "_part"
    while part in rows.columns:
        part += "_"
    marked = runtime.spread(rows).withColumn(part, F.spark_partition_id())
    path = runtime.scratch_path(spark, "staged")
    marked.write.parquet(path)
    return Staged(spark.read.schema(marked.schema).parquet(path), part)


def distinct_keys(staged: Staged, columns: list[str], keys: KeysOf, kind: str) -> DataFrame:
    """(part, key): the distinct non-null keys of every partition; ``keys`` sees ``columns`` only."""
    part = staged.part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, number in by_part(batch, part):
                found = keys(piece).unique().drop_null()
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(found), pa.int32()), found], ["part", "key"])

    return staged.rows.select(*columns, part).mapInArrow(run, f"part int, key {kind}").distinct()


def by_part(batch: pa.RecordBatch, part: str) -> Iterator[tuple[pa.RecordBatch, int]]:
    """The batch cut where the part changes, and into pieces of at most PIECE_BYTES or one row."""
    import numpy as np

    numbers = batch.column(part).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        left = [(a, b)] if b > a else []
        while left:
            low, high = left.pop()
            piece = batch.slice(low, high - low)
            if high - low > 1 and piece.nbytes > PIECE_BYTES:
                left += [((low + high) // 2, high), (low, (low + high) // 2)]
            else:
                yield piece, int(numbers[a])


def looked_up(staged: Staged, dictionary: DataFrame, apply: Apply, added: StructType, dropped: tuple[str, ...] = ()) -> DataFrame:
    """Add (or replace) the columns ``added``, which ``apply`` makes of a batch and its partition's dictionary, and leave out ``dropped``.

    ``dictionary`` has the columns part, key and values; keys are distinct within a part.
    """
    folder = runtime.scratch_path(dictionary.sparkSession, "dictionaries")
    dictionary.repartition("part").write.partitionBy("part").parquet(folder)
    empty = to_arrow_schema(dictionary.drop("part").schema).empty_table()
    names = {*added.names, *dropped}
    kept = [f for f in staged.rows.schema if f.name != staged.part and f.name not in names]
    schema = StructType([*kept, *added.fields])
    part = staged.part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, loaded = to_arrow_schema(schema), (None, None)
        for batch in batches:
            for piece, number in by_part(batch, part):
                if loaded[0] != number:
                    loaded = (number, read_parts(folder, f"part={number}", empty))
                new = apply(piece, loaded[1])
                columns = [piece.column(f.name) for f in kept] + new
                columns = [c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, target)]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    return staged.rows.mapInArrow(run, schema)


def read_parts(folder: str, name: str, empty: pa.Table) -> pa.Table:
    """The Parquet files of a folder below ``folder`` as one table; ``empty`` where it is missing."""
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    fs, base = runtime.open_fs(folder)
    listed = fs.get_file_info(pafs.FileSelector(f"{base}/{name}", allow_not_found=True))
    files = [f.path for f in listed if f.is_file and f.base_name.endswith(".parquet")]
    tables = [pq.ParquetFile(fs.open_input_file(f)).read(empty.column_names) for f in files]
    return pa.concat_tables(tables).cast(empty.schema) if tables else empty


def row_pieces(lists: pa.Array, most: int | None = None) -> Iterator[tuple[int, int]]:
    """(first row, rows) of pieces of a list column that hold at most ``most`` values, or one row."""
    import numpy as np

    most = most or PIECE_VALUES
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield start, stop - start
        start = stop


def flat(lists: pa.Array, kind: pa.DataType) -> tuple[pa.Array, pa.Array]:
    """(offsets, values) of a list column, without what null rows and slices hide."""
    lists = lists.cast(pa.list_(kind))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int64())
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(sizes)]).cast(pa.int32())
    return offsets, lists.flatten()


def replaced(lists: pa.Array, offsets: pa.Array, values: pa.Array) -> pa.Array:
    """A list column of new values with the old lengths and nulls."""
    return pa.ListArray.from_arrays(offsets, values, mask=lists.is_null() if lists.null_count else None)


# ---- a dictionary in shards, for streams ------------------------------------------------

SHARD_BYTES = 32 << 20
SHARDS_HELD = 4


@dataclass
class Shards:
    """A (key string, value int) table in files by the checksum of the key, each of about SHARD_BYTES; tasks hold SHARDS_HELD."""

    folder: str
    n: int

    @classmethod
    def write(cls, table: DataFrame, shard_bytes: int = SHARD_BYTES) -> "Shards":
        size = table.agg(F.sum(F.octet_length("key") + F.lit(16))).first()[0] or 0
        n = max(1, -(-size // shard_bytes))
        folder = runtime.scratch_path(table.sparkSession, "shards")
        shard = F.crc32(F.col("key").cast("binary")) % n
        table.withColumn("shard", shard).repartition("shard").write.partitionBy("shard").parquet(folder)
        return cls(folder, n)

    def reader(self) -> Callable[[pa.Array], pa.Array]:
        """Values of string keys, null for unknown ones."""
        import zlib

        held: dict[int, pa.Table] = {}
        empty = pa.schema([("key", pa.string()), ("value", pa.int32())]).empty_table()

        def table(no: int) -> pa.Table:
            if no not in held:
                if len(held) >= SHARDS_HELD:
                    held.pop(next(iter(held)))
                held[no] = read_parts(self.folder, f"shard={no}", empty)
            return held[no]

        def values(keys: pa.Array) -> pa.Array:
            encoded = keys.dictionary_encode()
            distinct = encoded.dictionary
            of = [0] * len(distinct) if self.n == 1 else [zlib.crc32(k.encode()) % self.n for k in distinct.to_pylist()]
            found = [None] * len(distinct)
            for no in sorted(set(of)):
                at = [i for i, s in enumerate(of) if s == no]
                part = table(no)
                own = pc.take(part.column("value"), pc.index_in(distinct.take(pa.array(at)), value_set=part.column("key")))
                for i, v in zip(at, own.to_pylist()):
                    found[i] = v
            return pa.array(found, pa.int32()).take(encoded.indices)

        return values
