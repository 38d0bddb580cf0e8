"""Distributions, length statistics and before/after accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlab import fixed_values as V
from seqlab import runtime
from seqlab.operators.vocabulary import unknown_ratio


def label_distribution(samples: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, rank), most common first, ties by name."""
    counts = samples.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), label)))  # one row per class


def split_distribution(samples: DataFrame, label: str = "label") -> DataFrame:
    """(label, train, test) from rows with a ``split`` column."""
    return samples.groupBy(label).agg(
        F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test")
    )


def exact_percentiles(values: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """One row: p<share> columns with linear interpolation.

    ``percentile`` keeps one counter per distinct value, so it runs on value
    counts; lengths have few distinct values.
    """
    counts = values.groupBy(column).agg(F.count("*").alias("_n"))
    picked = counts.agg(F.percentile(F.col(column), shares, F.col("_n")).alias("p"))
    return picked.select(*[F.get("p", F.lit(i)).alias(f"p{round(100 * s)}") for i, s in enumerate(shares)])


def length_statistics(samples: DataFrame, length: Column | None = None) -> DataFrame:
    """One row: n, mean, median, p25, p50, p75, p90, p99 of sequence lengths."""
    size = F.size("sequence") if length is None else length
    counts = samples.groupBy(size.alias("len")).agg(F.count("*").alias("c"))
    shares = [0.25, 0.5, 0.75, 0.9, 0.99]
    row = counts.agg(
        F.sum("c").alias("n"), (F.sum(F.col("len") * F.col("c")) / F.sum("c")).alias("mean"),
        F.percentile("len", shares, F.col("c")).alias("p"),
    )
    return row.select(
        "n", "mean", F.get("p", F.lit(1)).alias("median"),
        *[F.get("p", F.lit(i)).alias(f"p{round(100 * s)}") for i, s in enumerate(shares)],
    )


def length_histogram(samples: DataFrame, bins: int = 50, length: Column | None = None) -> DataFrame:
    """(bin, low, high, n): equal-width bins over the data range, the last one
    closed. Empty bins are included."""
    size = F.size("sequence") if length is None else length
    counts = runtime.pin(samples.groupBy(size.cast("double").alias("len")).agg(F.count("*").alias("c")))
    bounds = counts.agg(F.min("len").alias("lo"), F.max("len").alias("hi")).first()
    if bounds["lo"] is None:
        return counts.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    lo, hi = bounds["lo"], bounds["hi"]
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    at = F.least(F.floor((F.col("len") - lo) / width), F.lit(bins - 1)).cast("int")
    filled = counts.groupBy(at.alias("bin")).agg(F.sum("c").alias("n"))
    edges = counts.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return edges.join(filled, "bin", "left").select(
        "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("low"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("high"), F.coalesce("n", F.lit(0)).alias("n"),
    )


def removed_by_filter(samples: DataFrame, keep: Column, by: list[str]) -> DataFrame:
    """(by.., before, after, removed) in one pass."""
    return samples.groupBy(*by).agg(
        F.count("*").alias("before"), F.count_if(keep).alias("after"), F.count_if(~keep).alias("removed")
    )


def removed_trojans(samples: DataFrame, by: list[str]) -> DataFrame:
    return removed_by_filter(samples, F.col("label") != V.TROJAN, by)


def domain_shift(train: DataFrame, external: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row per dataset: UNK ratio, mean and median length, rows, vocabulary size."""
    size = vocab.count()
    rows = None
    for name, samples in (("train", train), ("external", external)):
        unk = unknown_ratio(samples, vocab).first()
        lengths = length_statistics(samples).withColumn("dataset", F.lit(name)).select(
            "dataset", "n", "mean", "median", F.lit(unk["unk_ratio"]).alias("unk_ratio"), F.lit(size).cast("long").alias("vocab_size")
        )
        rows = lengths if rows is None else rows.unionByName(lengths)
    return rows
