"""Probability-row expressions: argmax, gate, blend, review flag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqlab import fixed_values as V
from seqlab.functions.arrays import let, total


def argmax(probs: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def normalise(row: Column) -> Column:
    return let(row, lambda r: let(total(r), lambda s: F.transform(r, lambda x: F.try_divide(x, s))))


def softmax(scores: Column) -> Column:
    return normalise(
        let(scores, lambda s: let(F.array_max(s), lambda m: F.transform(s, lambda x: F.exp(x - m))))
    )


def trusted(first: Column, threshold: float) -> Column:
    """True when the first scorer is used alone."""
    return F.array_max(first) >= F.lit(threshold)


def gate(
    first: Column, second: Column, first_weights: Column, second_weights: Column,
    threshold: float = V.GATE_THRESHOLD,
) -> Column:
    """First scorer alone when its best probability reaches the threshold,
    else the per-class weighted blend of both, renormalised."""
    blend = F.zip_with(
        F.zip_with(first, first_weights, lambda p, w: p * w),
        F.zip_with(second, second_weights, lambda p, w: p * w),
        lambda x, y: x + y,
    )
    return F.when(trusted(first, threshold), first).otherwise(normalise(blend))


def needs_review(*probs: Column, threshold: float = V.REVIEW_THRESHOLD) -> Column:
    """True when every scorer's best probability is strictly below the threshold."""
    flag = F.lit(True)
    for p in probs:
        flag = flag & (F.array_max(p) < F.lit(threshold))
    return flag
