"""Operators on call tables, one row per call: (sample_id, pos, token).

Used when calls were recorded one per row and a sample may be too long for
one array. Positions are cut into blocks; a block also sees the few rows next
to its edges, so no group is larger than a block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlab import fixed_values as V
from seqlab.operators.skew import number_within, prefix_sums, quantile_bucket

BLOCK = 4096


def number_calls(calls: DataFrame, order_by: list[Column], first_order: Column, keys: list[str] | None = None) -> DataFrame:
    """Add ``pos`` (1-based) per sample. ``first_order`` is the numeric leading
    order key, used to spread long samples."""
    return number_within(calls, keys or ["sample_id"], order_by, quantile_bucket(calls, first_order), "pos")


def _home(block: int) -> Column:
    return F.floor((F.col("pos") - 1) / block).cast("long")


def in_blocks(calls: DataFrame, before: int = 0, after: int = 0, block: int = BLOCK) -> DataFrame:
    """Give every row its block, and lend rows near an edge to the neighbour.

    Rows with ``_block = _home`` are the originals.
    """
    at = F.pmod(F.col("pos") - 1, F.lit(block))
    home = _home(block)
    targets = F.array_compact(
        F.array(
            home,
            F.when(at >= block - before, home + 1),
            F.when((at < after) & (home > 0), home - 1),
        )
    )
    return calls.withColumn("_home", home).withColumn("_block", F.explode(targets))


def _in_block() -> Window:
    return Window.partitionBy("sample_id", "_block").orderBy("pos")


def collapse_runs(calls: DataFrame, max_repeats: int = V.MAX_CONSECUTIVE_DUPLICATES, block: int = BLOCK) -> DataFrame:
    """At most the first ``max_repeats`` calls of a run; positions renumbered."""
    block = max(block, max_repeats)
    w = _in_block()
    same = [F.lag("token", back).over(w) == F.col("token") for back in range(1, max_repeats + 1)]
    repeated = F.coalesce(reduce(lambda p, q: p & q, same), F.lit(False))
    kept = (
        in_blocks(calls, before=max_repeats, block=block)
        .withColumn("_repeated", repeated)
        .where((F.col("_block") == F.col("_home")) & ~F.col("_repeated"))
        .drop("_repeated", "_block")
    )
    out = prefix_sums(kept, ["sample_id"], [F.col("pos")], F.col("_home"), {"_before": F.lit(1)})
    return out.withColumn("pos", (F.col("_before") + 1).cast("long")).drop("_before", "_home")


def consecutive_pairs(calls: DataFrame, block: int = BLOCK) -> DataFrame:
    """(sample_id, pos, token, next_token) for every call that has a successor."""
    return (
        in_blocks(calls, after=1, block=block)
        .withColumn("next_token", F.lead("token").over(_in_block()))
        .where((F.col("_block") == F.col("_home")) & F.col("next_token").isNotNull())
        .drop("_block", "_home")
    )


def transition_shares(calls: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per sample, the share of each token-to-token transition."""
    counts = consecutive_pairs(calls, block).groupBy("sample_id", "token", "next_token").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("sample_id"))  # distinct transitions, not calls
    return counts.select("sample_id", "token", "next_token", "n", (F.col("n") / total).alias("share"))


def as_sequences(calls: DataFrame, max_calls: int) -> DataFrame:
    """Call rows to array samples of the first ``max_calls`` calls.

    ``max_calls`` is the sequence cap the sample form is defined with; whole
    samples of any length stay in the call form.
    """
    return (
        calls.where(F.col("pos") <= max_calls)
        .groupBy("sample_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("_c"))
        .select("sample_id", F.col("_c.token").alias("sequence"))
    )
