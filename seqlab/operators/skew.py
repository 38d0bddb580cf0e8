"""Ordered and lookup operations that stay balanced when one key holds a
large share of all rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlab import runtime


def quantile_bucket(df: DataFrame, value: Column, buckets: int | None = None) -> Column:
    """A bucket number that never decreases with ``value`` and holds about
    1/buckets of the rows. Only the cut points come to the driver."""
    buckets = min(buckets or runtime.shuffle_width(df.sparkSession), 256)
    if buckets < 2:
        return F.lit(0)
    shares = [i / buckets for i in range(1, buckets)]
    cuts = df.agg(F.percentile_approx(value, shares, 1000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))

    def choose(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value < F.lit(cuts[mid]), choose(low, mid)).otherwise(choose(mid + 1, high))

    return choose(0, len(cuts))


def prefix_sums(
    df: DataFrame, keys: list[str], order_by: list[Column], bucket: Column, values: Mapping[str, Column],
) -> DataFrame:
    """Add, per key, the sum of each value over all earlier rows.

    ``bucket`` must not decrease along the order. Rows are shuffled by
    (key, bucket), so a hot key is spread over its buckets; the totals of
    earlier buckets come from a pre-aggregated table. The input is evaluated
    once, into a checkpoint that both readings of it share.
    """
    staged = df.withColumn("_bucket", bucket)
    for name, value in values.items():
        staged = staged.withColumn(f"_v_{name}", value)
    staged = runtime.pin(staged)
    per_bucket = staged.groupBy(*keys, "_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys, "_bucket", *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in values]
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    ranked = staged.select(
        "*", *[F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)).alias(f"_i_{n}") for n in values]
    )
    joined = ranked.join(offsets, [*keys, "_bucket"])
    return joined.select(
        *[c for c in df.columns], *[(F.col(f"_i_{n}") + F.col(f"_o_{n}")).alias(n) for n in values]
    )


def number_within(df: DataFrame, keys: list[str], order_by: list[Column], bucket: Column, name: str = "pos") -> DataFrame:
    """1-based row number per key; see ``prefix_sums``. Keys must not be null."""
    out = prefix_sums(df, keys, order_by, bucket, {name: F.lit(1)})
    return out.withColumn(name, (F.col(name) + 1).cast("long"))


def rank_rows(df: DataFrame, order_by: list[str | Column], name: str, first: int = 0) -> DataFrame:
    """Number all rows of ``df`` by a total order, starting at ``first``.

    Small inputs (counted) use one window. Larger ones are range-sorted, and
    each partition's numbers start after the rows of the partitions before it.
    """
    pinned = runtime.pin(df)
    if runtime.fits(pinned, runtime.SINGLE_TASK_ROWS):
        number = F.row_number().over(Window.orderBy(*order_by)) + F.lit(first - 1)
        return pinned.withColumn(name, number.cast("int"))
    return _rank_ranges(pinned, order_by, name, first)


def _rank_ranges(df: DataFrame, order_by: list[str | Column], name: str, first: int) -> DataFrame:
    ranged = runtime.pin(
        df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
        .withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").count().select(
        "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")
    )
    inside = F.col("_at") - F.shiftleft("_part", 33)
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(name, (inside + F.col("_before") + F.lit(first)).cast("int"))
        .drop("_part", "_at", "_before")
    )


HOT_KEYS = 1000


def lookup_join(
    facts: DataFrame, dim: DataFrame, on: list[str], how: str = "left",
    max_broadcast_rows: int = runtime.BROADCAST_ROWS, hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Join a lookup table with one row per key.

    The table is broadcast after its rows were counted. A larger one is joined
    by shuffle, except for the ``hot_keys`` most common keys of the facts:
    their few table rows are broadcast. No other key can hold more than
    1/hot_keys of the facts, so the shuffle stays balanced.
    """
    if runtime.fits(dim, max_broadcast_rows):
        return facts.join(F.broadcast(dim), on, how)
    common = facts.groupBy(*on).count().orderBy(F.desc("count"), *on).limit(hot_keys).select(*on)
    hot = runtime.small_table(common, hot_keys)
    hot_rows = facts.join(hot, on, "left_semi").join(F.broadcast(dim.join(hot, on, "left_semi")), on, how)
    return hot_rows.unionByName(facts.join(hot, on, "left_anti").join(dim, on, how))
