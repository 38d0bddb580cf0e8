"""Vocabularies, encoding and cross-source spelling resolution."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from seqlab import fixed_values as V
from seqlab import runtime
from seqlab.functions.arrays import ratio
from seqlab.functions.encoding import spelling_candidates
from seqlab.operators import dictionaries
from seqlab.operators.skew import lookup_join, rank_rows


def reserved_rows(like: DataFrame) -> DataFrame:
    spark = like.sparkSession
    return spark.createDataFrame(
        [(V.PAD_TOKEN, V.PAD_INDEX), (V.UNK_TOKEN, V.UNK_INDEX)], "token string, idx int"
    )


def _drop_reserved(tokens: DataFrame) -> DataFrame:
    return tokens.where(~F.col("token").isin(V.PAD_TOKEN, V.UNK_TOKEN))


def build_vocabulary(samples: DataFrame) -> DataFrame:
    """(token, idx): distinct tokens in code-point order from index 2."""
    tokens = _drop_reserved(samples.select(F.explode(F.array_distinct("sequence")).alias("token")).distinct())
    return reserved_rows(samples).unionByName(rank_rows(tokens, ["token"], "idx", 2))


def build_frequency_vocabulary(samples: DataFrame, order: str = "sample_id") -> DataFrame:
    """(token, idx): most frequent first, ties by first occurrence."""
    calls = samples.select(F.col(order).alias("_ord"), F.posexplode("sequence").alias("pos", "token"))
    counted = _drop_reserved(
        calls.groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct("_ord", "pos")).alias("seen"))
    )
    ranked = rank_rows(counted, [F.desc("n"), F.asc("seen")], "idx", 2).select("token", "idx")
    return reserved_rows(samples).unionByName(ranked)


def _tokens(column: str) -> dictionaries.KeysOf:
    return lambda batch: dictionaries.flat(batch.column(column), pa.string())[1]


def _rewriter(values: dict[str, str], sequence: str = "sequence"):
    """Replace the tokens of ``sequence``: one list column per value column (name: "idx" or "resolved")."""

    def apply(batch: pa.RecordBatch, known: pa.Table) -> list[pa.Array]:
        lists = batch.column(sequence)
        offsets, tokens = dictionaries.flat(lists, pa.string())
        at = pc.index_in(tokens, value_set=known.column("key"))
        out = []
        for kind in values.values():
            new = pc.take(known.column(kind), at)
            new = new.combine_chunks() if isinstance(new, pa.ChunkedArray) else new
            new = pc.fill_null(new, V.UNK_INDEX) if kind == "idx" else pc.coalesce(new.cast(pa.string()), tokens)
            out.append(dictionaries.replaced(lists, offsets, new))
        return out

    return apply


def _looked_up(staged: dictionaries.Staged, found: DataFrame, values: dict[str, str]) -> DataFrame:
    """``values``: output column to value column of ``found`` (part, key, ..)."""
    kinds = {"idx": IntegerType(), "resolved": StringType()}
    added = StructType([StructField(name, ArrayType(kinds[kind])) for name, kind in values.items()])
    return dictionaries.looked_up(staged, found.select("part", "key", *values.values()), _rewriter(values), added)


def encode_sequences(samples: DataFrame, vocab: DataFrame, output: str = "encoded") -> DataFrame:
    """Token arrays to index arrays; unknown tokens become 1, a null array stays null.

    Rows stay where they are: each partition's distinct tokens are joined with the vocabulary, whatever its size,
    and come back as the partition's dictionary.
    """
    return encode_staged(dictionaries.stage(samples), vocab, output)


def encode_staged(
    staged: dictionaries.Staged, vocab: DataFrame, output: str = "encoded", matrix: Callable[[pa.Array], pa.StructArray] | None = None,
) -> DataFrame:
    """``encode_sequences`` of rows that are stored already. With ``matrix`` its vectors of the sequences are added as
    ``features`` and the sequences left out, so that they cross to Python once and do not come back."""
    keys = dictionaries.distinct_keys(staged, ["sequence"], _tokens("sequence"), "string")
    found = keys.join(vocab.select(F.col("token").alias("key"), "idx"), "key")
    from pyspark.ml.linalg import VectorUDT

    if matrix is None:
        return _looked_up(staged, found, {output: "idx"})
    coded = _rewriter({output: "idx"})
    added = StructType([StructField(output, ArrayType(IntegerType())), StructField("features", VectorUDT())])
    both = lambda batch, known: [*coded(batch, known), matrix(batch.column("sequence"))]
    return dictionaries.looked_up(staged, found.select("part", "key", "idx"), both, added, ("sequence",))


def row_encoder(vocab: DataFrame, shard_bytes: int = dictionaries.SHARD_BYTES) -> Callable[[DataFrame, str], DataFrame]:
    """(rows, output column) -> encoded rows, for streams and tables alike, at any size of the vocabulary.

    The vocabulary is written once in shards by the token's checksum; a task reads the shards its tokens fall in.
    """
    shards = dictionaries.Shards.write(vocab.select(F.col("token").alias("key"), F.col("idx").alias("value")), shard_bytes)

    def encode(samples: DataFrame, output: str) -> DataFrame:
        readers = []

        @F.arrow_udf("array<int>")
        def coded(sequences: pa.Array, sizes: pa.Array) -> pa.Array:
            if not readers:
                readers.append(shards.reader())
            offsets, tokens = dictionaries.flat(sequences, pa.string())
            return dictionaries.replaced(sequences, offsets, pc.fill_null(readers[0](tokens), V.UNK_INDEX))

        # naming the sequence a second time keeps the step that computes it a projection of its own, and filters
        # on the result must stay above the function, next to its inputs
        return samples.withColumn(output, coded.asNondeterministic()(F.col("sequence"), F.coalesce(F.size("sequence"), F.lit(0))))

    return encode


def unknown_ratio(samples: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row: total tokens, unknown tokens and their ratio over the set.

    Counts are aggregated per token before the vocabulary is joined.
    """
    counts = samples.select(F.explode("sequence").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    known = lookup_join(counts, vocab, ["token"])
    return known.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("idx").isNull(), F.col("n"))), F.lit(0)).alias("unknown"),
    ).select("total", "unknown", ratio(F.col("unknown"), F.col("total")).alias("unk_ratio"))


def resolve_spellings(tokens: DataFrame, vocab: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(token, resolved) for distinct tokens: the first candidate spelling that
    is in the vocabulary, or the token itself."""
    distinct = tokens.select("token").distinct()
    tried = distinct.select(
        "token", F.posexplode(spelling_candidates(F.col("token"), aliases)).alias("rank", "candidate")
    ).where(F.col("candidate").isNotNull())
    entries = vocab.select(F.col("token").alias("candidate"), F.lit(True).alias("known"))
    hits = lookup_join(tried, entries, ["candidate"])
    best = hits.groupBy("token").agg(F.min(F.when(F.col("known"), F.struct("rank", "candidate"))).alias("best"))
    return best.select("token", F.coalesce(F.col("best.candidate"), F.col("token")).alias("resolved"))


def spellings_of(tokens: DataFrame, vocab: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(token, resolved, idx) for the distinct tokens."""
    resolved = resolve_spellings(tokens, vocab, aliases)
    entries = vocab.select(F.col("token").alias("resolved"), "idx")
    return lookup_join(resolved, entries, ["resolved"]).withColumn(
        "idx", F.coalesce("idx", F.lit(V.UNK_INDEX))
    )


def spelling_table(samples: DataFrame, vocab: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(token, resolved, idx) for every token of ``samples``."""
    return spellings_of(samples.select(F.explode(F.array_distinct("sequence")).alias("token")), vocab, aliases)


def rewrite_sequences(samples: DataFrame, table: DataFrame) -> DataFrame:
    """Replace every token by its resolved spelling in ``table`` (token, resolved); others stay as they are."""
    staged = dictionaries.stage(samples)
    keys = dictionaries.distinct_keys(staged, ["sequence"], _tokens("sequence"), "string")
    changed = table.where("token <> resolved").select(F.col("token").alias("key"), "resolved")
    return _looked_up(staged, keys.join(changed, "key"), {"sequence": "resolved"})


def _spelled(samples: DataFrame, vocab: DataFrame, aliases: dict[str, str] | None) -> tuple[dictionaries.Staged, DataFrame]:
    """Staged rows and (part, key, resolved, idx) of their distinct tokens."""
    staged = dictionaries.stage(samples)
    keys = runtime.pin(dictionaries.distinct_keys(staged, ["sequence"], _tokens("sequence"), "string"))
    table = spellings_of(keys.select(F.col("key").alias("token")), vocab, aliases)
    return staged, keys.join(table.withColumnRenamed("token", "key"), "key")


def normalise_sequences(samples: DataFrame, vocab: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Rewrite spellings so that more tokens hit the vocabulary. Runs are not
    collapsed again."""
    staged, found = _spelled(samples, vocab, aliases)
    return _looked_up(staged, found.where("key <> resolved"), {"sequence": "resolved"})


def normalise_and_encode(samples: DataFrame, vocab: DataFrame, output: str = "encoded", aliases: dict[str, str] | None = None) -> DataFrame:
    """Rewritten sequences and their indices from one dictionary per partition."""
    return _looked_up(*_spelled(samples, vocab, aliases), {"sequence": "resolved", output: "idx"})


def vocabulary_size(samples: DataFrame) -> DataFrame:
    tokens = _drop_reserved(samples.select(F.explode(F.array_distinct("sequence")).alias("token")))
    return tokens.agg((F.count_distinct("token") + 2).alias("vocab_size"))
