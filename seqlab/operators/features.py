"""Feature operators: n-gram shares, statistics, category and transition shares.

Counts are taken inside each row (sorted runs), so the statistics, category
and transition features need no shuffle at all. The n-gram vocabulary is the
only step that aggregates over the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlab import fixed_values as V
from seqlab import runtime
from seqlab.functions.arrays import indices, let, ngrams, pairs, ratio, run_counts, total, vector_cells
from seqlab.functions.labels import CategoryOf, missing_table
from seqlab.operators import engineered_rows, ngram_counts

STATISTIC_NAMES = (
    ["log_seq_length", "log_unique_count", "unique_ratio"]
    + [f"top{k}_freq_ratio" for k in range(1, V.TOP_K_FREQUENCIES + 1)]
    + ["shannon_entropy"]
)
CATEGORY_NAMES = [f"cat_{c}" for c in V.CATEGORIES]
TRANSITION_NAMES = [f"bigram_{a}_{b}" for a in V.CATEGORIES for b in V.CATEGORIES]


# ---- counts ----------------------------------------------------------------
def token_counts(samples: DataFrame) -> DataFrame:
    """(sample_id, token, n)."""
    return samples.select("sample_id", F.inline(run_counts(F.col("sequence")))).withColumnRenamed("item", "token")


# ---- n-gram shares -----------------------------------------------------------
def words(seq: Column, min_len: int = 2) -> Column:
    """Lowercased word tokens of at least ``min_len`` characters."""
    tail = r"\w+" if min_len == 2 else r"\w{" + str(min_len - 1) + ",}"
    return F.regexp_extract_all(F.lower(F.array_join(seq, " ")), F.lit(rf"(?U)\b\w{tail}\b"), F.lit(0))


def row_ngrams(seq: Column, ngram_range: tuple[int, int] = V.TF_NGRAM_RANGE, min_len: int = 2) -> Column:
    return ngrams(words(seq, min_len), *ngram_range)


def top_ngrams(
    samples: DataFrame, max_features: int = V.TF_MAX_FEATURES,
    ngram_range: tuple[int, int] = V.TF_NGRAM_RANGE, min_len: int = 2,
) -> DataFrame:
    """(ngram, n) of the most frequent n-grams; ties by n-gram. Only n-grams that can be among them are shuffled."""
    return ngram_counts.top_ngrams(samples, max_features, ngram_range, min_len)


def ngram_vocabulary(
    samples: DataFrame, max_features: int = V.TF_MAX_FEATURES,
    ngram_range: tuple[int, int] = V.TF_NGRAM_RANGE, min_len: int = 2,
) -> DataFrame:
    """(ngram, col_idx): top n-grams in alphabetical column order."""
    top = top_ngrams(samples, max_features, ngram_range, min_len)  # at most max_features rows
    return top.select("ngram", (F.row_number().over(Window.orderBy("ngram")) - 1).alias("col_idx"))


def ngram_shares(
    samples: DataFrame, vocab: DataFrame, ngram_range: tuple[int, int] = V.TF_NGRAM_RANGE, min_len: int = 2,
) -> DataFrame:
    """(sample_id, ngram, col_idx, value): kept counts over all kept counts of
    the sample. Rows without kept n-grams are absent (all zero).

    The exploded form of ``ngram_vectors``: counted in the row, nothing is shuffled.
    ``vocab`` is bounded by its ``max_features``, so it is broadcast.
    """
    vectors = ngram_vectors(samples.select("sample_id", "sequence"), vocab, ngram_range, min_len, "_tf")
    cells = vectors.select("sample_id", F.inline(vector_cells(F.col("_tf"))))
    names = F.broadcast(vocab.select("ngram", F.col("col_idx").alias("i")))
    return cells.join(names, "i").select("sample_id", "ngram", F.col("i").alias("col_idx"), F.col("x").alias("value"))


def ngram_vectors(
    samples: DataFrame, vocab: DataFrame, ngram_range: tuple[int, int] = V.TF_NGRAM_RANGE,
    min_len: int = 2, output: str = "tf",
) -> DataFrame:
    """Sparse L1-normalised n-gram vector per row, without a shuffle."""
    runtime.small_batches(samples.sparkSession)
    names = [r["ngram"] for r in vocab.orderBy("col_idx").collect()]  # at most max_features
    return samples.withColumn(output, ngram_counts.share_vectors(names, ngram_range, min_len)("sequence"))


# ---- statistics ------------------------------------------------------------
def _statistics(counts: Column, top_k: int, log_dampen: bool) -> Column:
    sizes = F.transform(counts, lambda c: c["n"].cast("double"))
    ordered = F.sort_array(sizes, asc=False)
    filled = F.concat(F.slice(ordered, 1, top_k), F.array_repeat(F.lit(0.0), top_k))

    def build(n: Column) -> Column:
        share = (lambda c: F.log2(c + 1) / F.log2(n + 1)) if log_dampen else (lambda c: c / n)
        spread = F.aggregate(sizes, F.lit(0.0), lambda acc, c: acc + c * F.log2(c))
        unique = F.size(counts)
        head = F.array(F.log2(n + 1), F.log2(unique + F.lit(1.0)), unique / n)
        return F.concat(
            head, F.transform(F.slice(filled, 1, top_k), share), F.array(F.log2(n) - spread / n + F.lit(0.0))
        )

    return F.when(F.size(counts) == 0, F.array_repeat(F.lit(0.0), 4 + top_k)).otherwise(let(total(sizes), build))


def statistics(seq: Column, top_k: int = V.TOP_K_FREQUENCIES, log_dampen: bool = False) -> Column:
    """[log2(n+1), log2(u+1), u/n, top-k shares, entropy]; zeros for an empty row."""
    return let(run_counts(seq), lambda c: _statistics(c, top_k, log_dampen))


# ---- category and transition shares ---------------------------------------
def _weight(n: Column, log_dampen: bool) -> Column:
    return F.log2(n + F.lit(1.0)) if log_dampen else n.cast("double")


def _slot(name: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(c) for c in V.CATEGORIES]), name) - 1).cast("int")


def _slots_of(category: CategoryOf) -> engineered_rows.SlotsOf | None:
    """``_slot`` of the category of tokens in Python, where the category has that form."""
    names_of = getattr(category, "in_python", None)
    slots = {c: i for i, c in enumerate(V.CATEGORIES)}
    return names_of and (lambda tokens: [slots.get(c, -1) for c in names_of(tokens)])


def _slot_shares(entries: Column, n_slots: int) -> Column:
    """Weight per slot over all weight, for ``array<struct<slot, w>>``: entries
    are sorted by slot and summed run by run."""

    def measure(e: Column) -> Column:
        starts = F.filter(
            indices(F.size(e)), lambda i: (i == 0) | (F.get(e, i)["slot"] != F.get(e, i - F.lit(1))["slot"])
        )

        def run_sum(i: Column, after: Column) -> Column:
            return F.aggregate(F.sequence(i, after - 1), F.lit(0.0), lambda acc, k: acc + F.get(e, k)["w"])

        sums = let(
            starts,
            lambda b: F.transform(
                b, lambda i, j: F.struct(F.get(e, i)["slot"], run_sum(i, F.coalesce(F.get(b, j + 1), F.size(e))))
            ),
        )
        whole = total(F.transform(e, lambda x: x["w"]))
        return let(
            F.struct(F.map_from_entries(sums).alias("sums"), whole.alias("whole")),
            lambda m: F.transform(
                F.sequence(F.lit(0), F.lit(n_slots - 1)),
                lambda s: ratio(F.coalesce(F.try_element_at(m["sums"], s), F.lit(0.0)), m["whole"]),
            ),
        )

    return let(F.sort_array(entries), measure)


def _category_shares(counts: Column, log_dampen: bool, category: CategoryOf) -> Column:
    entries = F.transform(
        counts, lambda x: F.struct(_slot(category(x["item"])).alias("slot"), _weight(x["n"], log_dampen).alias("w"))
    )
    return _slot_shares(entries, len(V.CATEGORIES))


def category_shares(seq: Column, log_dampen: bool = False, category: CategoryOf = missing_table) -> Column:
    """Share of each category. The category is looked up once per distinct token."""
    return let(run_counts(seq), lambda c: _category_shares(c, log_dampen, category))


def transition_shares(seq: Column, log_dampen: bool = False, category: CategoryOf = missing_table) -> Column:
    """Share of each category-to-category step, over distinct token bigrams."""
    k = len(V.CATEGORIES)
    entries = let(
        run_counts(pairs(seq)),
        lambda c: F.transform(
            c,
            lambda x: F.struct(
                (_slot(category(x["item"]["a"])) * k + _slot(category(x["item"]["b"]))).alias("slot"),
                _weight(x["n"], log_dampen).alias("w"),
            ),
        ),
    )
    return _slot_shares(entries, k * k)


# ---- assembly ----------------------------------------------------------------
def named_features(samples: DataFrame, values: Column, names: list[str]) -> DataFrame:
    """Long form (sample_id, feature, value) of a dense feature array."""
    return samples.select("sample_id", F.posexplode(values).alias("_i", "value")).select(
        "sample_id", F.get(F.array(*[F.lit(n) for n in names]), F.col("_i")).alias("feature"), "value"
    )


def engineered(seq: Column, log_dampen: bool = False, category: CategoryOf = missing_table, drop_length: bool = False) -> Column:
    """The 81 engineered values: statistics, categories, transitions."""

    def from_counts(c: Column) -> Column:
        stats = _statistics(c, V.TOP_K_FREQUENCIES, log_dampen)
        if drop_length:
            stats = F.slice(stats, 2, len(STATISTIC_NAMES) - 1)
        return F.concat(stats, _category_shares(c, log_dampen, category))

    return F.concat(let(run_counts(seq), from_counts), transition_shares(seq, log_dampen, category))


def engineered_features(samples: DataFrame, log_dampen: bool = False, category: CategoryOf = missing_table) -> DataFrame:
    """Add ``features``: the 81 engineered columns as one vector."""
    runtime.small_batches(samples.sparkSession)
    vectors = engineered_rows.engineered_vectors(len(V.CATEGORIES), V.TOP_K_FREQUENCIES, log_dampen, _slots_of(category))
    return samples.withColumn("features", vectors("sequence", lambda x: _slot(category(x))))


def feature_matrix(
    samples: DataFrame, vocab: DataFrame, log_dampen: bool = False, category: CategoryOf = missing_table,
    ngram_range: tuple[int, int] = V.TF_NGRAM_RANGE, drop_length: bool = False,
) -> DataFrame:
    """Add ``features``: n-gram shares followed by the engineered columns (sparse)."""
    runtime.small_batches(samples.sparkSession)
    rows = _matrix_rows(vocab, log_dampen, ngram_range, drop_length)
    return samples.withColumn("features", engineered_rows.matrix_vectors(rows, _slots_of(category))("sequence", lambda x: _slot(category(x))))


def _matrix_rows(vocab: DataFrame, log_dampen: bool, ngram_range: tuple[int, int], drop_length: bool):
    names = [r["ngram"] for r in vocab.orderBy("col_idx").collect()]  # at most max_features
    return engineered_rows.matrix_rows(names, ngram_range, 2, len(V.CATEGORIES), V.TOP_K_FREQUENCIES, log_dampen, drop_length)


def matrix_in_python(
    vocab: DataFrame, log_dampen: bool = False, category: CategoryOf = missing_table, ngram_range: tuple[int, int] = V.TF_NGRAM_RANGE,
) -> Callable[[pa.Array], pa.StructArray] | None:
    """The vectors of ``feature_matrix`` as a function of token lists, for steps that hold them anyway; None where the category has no Python form."""
    slots_of = _slots_of(category)
    if slots_of is None:
        return None
    rows = _matrix_rows(vocab, log_dampen, ngram_range, False)
    return lambda sequences: rows(sequences, slots_of)


def short_trace_features(samples: DataFrame, vocab: DataFrame, category: CategoryOf = missing_table) -> DataFrame:
    """Variant for short traces: 1-2-grams, undampened, no length column."""
    return feature_matrix(samples, vocab, False, category, V.SHORT_TF_NGRAM_RANGE, drop_length=True)


def feature_names(vocab: DataFrame, drop_length: bool = False) -> DataFrame:
    """(col_idx, name) of the feature matrix columns, in order."""
    tail = (STATISTIC_NAMES[1:] if drop_length else STATISTIC_NAMES) + CATEGORY_NAMES + TRANSITION_NAMES
    width = vocab.count()  # bounded by max_features
    engineered_names = vocab.sparkSession.createDataFrame(
        [(width + i, n) for i, n in enumerate(tail)], "col_idx int, name string"
    )
    return vocab.select("col_idx", F.col("ngram").alias("name")).unionByName(engineered_names)
