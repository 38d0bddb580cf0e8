"""The scoring steps on streams of raw texts.

Parsing, cleaning, encoding and padding are row-local, so they run on a stream
as they do on a table and need no watermark. Full scoring runs the batch plan
on every micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqlab import fixed_values as V
from seqlab.functions import cleaning
from seqlab.functions.encoding import pad
from seqlab.plans.scoring import ModelSet, score_texts


def prepare_texts(
    texts: DataFrame, encode: Callable[[DataFrame, str], DataFrame], width: int, text: str = "text",
) -> DataFrame:
    """(sample_id, text) to (sample_id, sequence, encoded, padded); batch or stream."""
    parsed = texts.withColumn("sequence", cleaning.parse_text(F.col(text))).where(cleaning.long_enough(F.col("sequence")))
    cleaned = parsed.withColumn("sequence", cleaning.external(F.col("sequence"))).drop(text)
    coded = encode(cleaned, "encoded")
    return coded.withColumn("padded", pad(F.col("encoded"), width))


def stream_texts(spark, path: str, schema: str = "sample_id string, text string", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def score_stream(
    texts: DataFrame, models: ModelSet, output: str, checkpoint: str, threshold: float = V.GATE_THRESHOLD_SHIFTED,
) -> StreamingQuery:
    """Score every micro-batch and write it under its batch number, so a
    repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        score_texts(batch, models, threshold).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
