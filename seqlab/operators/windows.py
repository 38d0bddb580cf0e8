"""Sliding windows over encoded samples and aggregation of window scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from seqlab import fixed_values as V
from seqlab.functions.encoding import windows
from seqlab.functions.scoring import normalise


def sliding_windows(samples: DataFrame, width: int, stride: int | None = None, column: str = "encoded") -> DataFrame:
    """One row per window: (.., window_no, window)."""
    return samples.select(
        *[c for c in samples.columns if c != column],
        F.posexplode(windows(F.col(column), width, stride, V.PAD_INDEX)).alias("window_no", "window"),
    )


def aggregate_windows(scored: DataFrame, n_classes: int, how: str = "mean", column: str = "probs") -> DataFrame:
    """One probability row per sample from its window rows.

    ``mean`` averages each class; ``max`` takes the best window per class and
    renormalises (a zero row stays zero). One aggregate per class, so a sample
    with very many windows is combined map-side.
    """
    if how not in ("mean", "max"):
        raise ValueError(f"unknown aggregator: {how!r}")
    pick = F.avg if how == "mean" else F.max
    aggs = [pick(F.get(F.col(column), F.lit(c))).alias(f"_p{c}") for c in range(n_classes)]
    rows = scored.groupBy("sample_id").agg(*aggs)
    probs = F.array(*[F.col(f"_p{c}") for c in range(n_classes)])
    if how == "max":
        probs = F.transform(normalise(probs), lambda x: F.coalesce(x, F.lit(0.0)))
    return rows.select("sample_id", probs.alias(column))


def score_windows(windowed: DataFrame, make_predict: Callable, width: int, batch_size: int = 256) -> DataFrame:
    """Apply a user's batch model (numpy batch in, numpy batch out) to the windows."""
    predict = predict_batch_udf(
        make_predict, return_type=ArrayType(DoubleType()), batch_size=batch_size, input_tensor_shapes=[[width]]
    )
    return windowed.withColumn("probs", predict("window"))
