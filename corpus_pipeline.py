"""The corpus pipeline: stages over documents, each written and read again by the next.

Low-quality documents go, one document of each near-duplicate group stays, passages that an earlier document has
are cut out, personal data is replaced, and what is left is packed into sequences. A stage works on all rows the
one before kept and, but for the last, returns the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqlab.llm import mixture_packing, pii_surrogates, quality_network, simhash_tiles, suffix_radix
from seqlab.llm.common import stored, table

KEY = "corpus-surrogates"  # a deployment sets its own secret
# Rows and bytes of the batches Python tasks get: whole texts, so far fewer rows than Spark's default of 10,000.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20
# Entries of a packing worker's token caches. A smaller cache takes more CPU, never other ids.
CACHE = 50_000


def small_batches(spark: SparkSession) -> None:
    """Bound the batches of texts, unless the session has bounds of its own."""
    names = {"maxRecordsPerBatch": ("10000", BATCH_ROWS), "maxBytesPerBatch": (None, BATCH_BYTES)}
    for name, (default, value) in names.items():
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key, None) in (None, default, "-1", str((1 << 63) - 1), str((1 << 31) - 1)):
            spark.conf.set(key, str(value))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality_network.kept(docs, table(spark, sf_dir, "labels"), quality_network.fold("doc_id") % 5 != 0)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash_tiles.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return suffix_radix.without_repeats(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pii_surrogates.replaced(docs, KEY).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mixture_packing.pack(docs, mixture_packing.public_vocabulary(), cache=CACHE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("PII", personal_data),
    ("packing", packing),
]
# Trained scores, links and token ids have no SQL; tests hold each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for no, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if no < len(STAGES) - 1:
            docs = stored(docs, "pipeline")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
