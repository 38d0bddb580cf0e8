"""Helpers the operators of this subpackage share: files in the shared folder, joins that survive
a hot key, connected components over links."""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlab.runtime import pin, scratch_path, shuffle_width

# A key with more than 1/HOT_SHARE of all rows is salted; there are at most HOT_SHARE such keys.
HOT_SHARE = 1000
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back: cuts lineage, keeps column pruning."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    released(spark)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    return pin(df)


def released(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def open_fs(uri: str):
    """A pyarrow file system and the path in it, for any shared store pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def hot_keys(sizes: DataFrame, key: str, size: str) -> DataFrame:
    """At most HOT_SHARE keys that hold more than 1/HOT_SHARE of all rows, from (key, size) rows."""
    total = sizes.agg(F.sum(size).alias("t")).first()["t"] or 0
    least = max(1000, total // HOT_SHARE)
    found = sizes.where(F.col(size) > least).select(key).limit(HOT_SHARE + 1).collect()
    return sizes.sparkSession.createDataFrame(found, sizes.select(key).schema)


def salted_join(facts: DataFrame, dim: DataFrame, key: str, size: str, row_id: Column, how: str = "left") -> DataFrame:
    """Join ``dim`` (one row per key; ``size`` = the key's rows in ``facts``) to ``facts``.

    Rows of a hot key are dealt over SALTS tasks and that key's one row of ``dim`` is repeated as often.
    Only the hot keys (HOT_SHARE at most, by their definition) are broadcast. ``size`` is dropped.
    """
    hot = F.broadcast(hot_keys(dim, key, size).withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(row_id), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    left = facts.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = dim.join(hot, key, "left").withColumn("_salt", F.explode(salts)).drop("_hot", size)
    return left.join(right, [key, "_salt"], how).drop("_salt")


def local_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its part) for every node of these edges that isn't its own smallest."""
    if not len(u):
        return u, v
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _forest_part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reduce the edges of a partition to spanning stars, holding at most a few batches at a time."""
    u = v = np.zeros(0, np.int64)
    for f in frames:
        u, v = local_forest(np.concatenate([u, f["u"].to_numpy()]), np.concatenate([v, f["v"].to_numpy()]))
    yield pd.DataFrame({"u": u, "v": v})


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) with component = the smallest node reachable, for nodes in edges (u, v).

    Alternates large-star and small-star steps: every step keeps the connectivity and moves
    neighbours to smaller nodes, until each part is one star. A node with many neighbours is dealt
    over SALTS groups by neighbour, and minima are pre-aggregated. Empty edges give no rows.
    """
    same = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    e = checkpointed(same.mapInPandas(_forest_part, "u long, v long").distinct())

    def star(e: DataFrame, large: bool) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
        both = down.unionByName(down.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else down
        both = both.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
        part = both.groupBy("a", "s").agg(F.min("b").alias("m"))
        least = part.groupBy("a").agg(F.min("m").alias("m")).select("a", F.least("a", "m").alias("m"))
        linked = both.join(part.select("a", "s").join(least, "a"), ["a", "s"])
        if large:
            out = linked.where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v"))
        else:
            to = F.explode(F.array("a", "b"))
            out = linked.select(to.alias("u"), F.col("m").alias("v"))
        return out.where("u <> v").distinct()

    def mark(e: DataFrame) -> tuple:
        wide = [F.sum(F.col(c).cast("decimal(38,0)")) for c in ("u", "v")]
        return tuple(e.agg(F.count(F.lit(1)), *wide).first())

    before = mark(e)
    for _ in range(rounds):
        if not before[0]:
            break
        e = checkpointed(star(star(e, True), False))
        after = mark(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("links did not settle; raise rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def block_pairs(blocks: DataFrame, columns: list[str], near: Column | None = None) -> DataFrame:
    """Every unordered pair of packed blocks (``block`` long and ``columns``), itself included, once.

    The pair list is built from block numbers, and both sides are fetched by a join on the number;
    ``near`` may drop pairs by columns a_*/b_* of the small block descriptions. Work is one row per pair
    of blocks, so it grows with the square of their number, as a full comparison does.
    """
    small = [c for c in columns if not c.startswith("data")]
    ids = checkpointed(blocks.select("block", *small))
    n = ids.count()
    if not n:
        n = 1
    span = ids.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    a = span.where("block <= _to").select(F.col("block").alias("a"), F.col("_to").alias("b"), *[F.col(c).alias(f"a_{c}") for c in small])
    b = ids.select(F.col("block").alias("b"), *[F.col(c).alias(f"b_{c}") for c in small])
    pairs = a.join(b, "b")
    if near is not None:
        pairs = pairs.where(near)
    return fetch_pairs(pairs, blocks, [c for c in columns if c.startswith("data")])


def fetch_pairs(pairs: DataFrame, blocks: DataFrame, data: list[str]) -> DataFrame:
    """Add the packed ``data`` columns of both blocks to (a, b) pairs."""
    side = lambda s: blocks.select(F.col("block").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in data])
    return pairs.join(side("a"), "a").join(side("b"), "b")


def width_for(spark: SparkSession, n: int) -> int:
    return max(1, min(n, max(shuffle_width(spark), spark.sparkContext.defaultParallelism * 4)))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Number stored rows 0..n-1 from per-partition counts (packed blocks: few rows a partition)."""
    ids = df.withColumn("_m", F.monotonically_increasing_id())
    kept = stored(ids, "numbered")
    parts = kept.groupBy(F.shiftright("_m", 33).alias("_p")).count().orderBy("_p").collect()  # one row per partition
    starts, at = [], 0
    for r in parts:
        starts.append((r["_p"], at))
        at += r["count"]
    off = df.sparkSession.createDataFrame(starts or [(0, 0)], "_p long, _o long")
    return kept.withColumn("_p", F.shiftright("_m", 33)).join(F.broadcast(off), "_p").withColumn(
        name, F.col("_o") + F.col("_m") - F.shiftleft(F.col("_p"), 33)
    ).drop("_p", "_m", "_o")


def ceil_div(a: int, b: int) -> int:
    return math.ceil(a / b)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def packed_blocks(df: DataFrame, order: list[Column], rows: int, name: str, schema: str, pack) -> DataFrame:
    """Cut ``df``, sorted by ``order``, into blocks of ``rows`` rows; ``pack`` turns each into one row.

    ``schema`` starts with ``block long``. A block is filled across partitions, so its size does not
    depend on how the rows were dealt.
    """
    ranged = numbered(df.repartitionByRange(*order).sortWithinPartitions(*order), "_no")
    cut = ranged.withColumn("block", F.expr(f"_no div {rows}")).drop("_no")
    made = cut.groupBy("block").applyInPandas(lambda key, f: pack(key[0], f), schema)
    return stored(made, name)


def second_moments(df: DataFrame, column: str = "x") -> dict[int, np.ndarray]:
    """Sum of outer products of the packed float64 vectors, by dimension. d*d numbers reach the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for f in frames:
            for d, part in f.groupby("dim"):
                x = unpacked(part[column], d)
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, s in sums.items():
            i, j = np.indices(s.shape)
            yield pd.DataFrame({"dim": d, "i": i.ravel(), "j": j.ravel(), "v": s.ravel()})

    found: dict[int, np.ndarray] = {}
    parts = df.select("dim", column).mapInPandas(run, "dim int, i int, j int, v double")
    for r in parts.groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).collect():
        found.setdefault(r["dim"], np.zeros((r["dim"], r["dim"])))[r["i"], r["j"]] = r["v"]
    return found


def principal_axes(moments: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Orthonormal axes by falling share of the squared length, as columns."""
    return {d: np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy() for d, m in moments.items()}


def unpacked(column: pd.Series, dim: int, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(-1, dim)


def vector_rows(vectors: DataFrame, whole: bool = False) -> DataFrame:
    """(vec_id, dim, x) for usable vectors: x packs the float64 components (``whole``: floor(64 x)).

    A vector that is null, empty or holds a null or non-finite component is left out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids, dims, data = [], [], []
            for i, e in zip(f["vec_id"], f["embedding"]):
                x = None if e is None else np.array(e, np.float64)
                if x is None or not x.size or not np.isfinite(x).all():
                    continue
                ids.append(int(i))
                dims.append(x.size)
                data.append((np.floor(64 * x) if whole else x).tobytes())
            yield pd.DataFrame({"vec_id": pd.Series(ids, dtype="int64"), "dim": pd.Series(dims, dtype="int32"), "x": data})

    with_id = vectors.where("vec_id IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return with_id.mapInPandas(run, "vec_id long, dim int, x binary")
