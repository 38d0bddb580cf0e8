"""Statistics, category and transition shares of token lists, some rows at a time.

Tokens are numbered in their sorted order, so a row's counts come from one sort of (row, number), and weights are
added in the order of ``features.statistics``, ``category_shares`` and ``transition_shares``. Categories that have a
Python form are found once per distinct token of some rows; others come from Spark, once per distinct token of a row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from seqlab.operators import ngram_counts
from seqlab.operators.dictionaries import row_pieces


# Category slots of tokens, -1 for none; or (token, slot) of each row's distinct tokens.
SlotsOf = Callable[[list[str | None]], list[int]]


def _log2(x: np.ndarray) -> np.ndarray:
    return np.log(x) / np.log(2.0)


def _numbered(sizes: np.ndarray, coded: pa.DictionaryArray, distinct: list[str], named: pa.Array | SlotsOf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each token, its number, category by number, -1 for none); a null token is number 0."""
    rank = np.empty(len(coded.dictionary) + 1, np.int64)
    rank[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(1, len(rank))
    rank[-1] = 0
    codes = rank[coded.indices.fill_null(len(rank) - 1).to_numpy(zero_copy_only=False)]
    if callable(named):
        slots = np.empty(len(rank), np.int64)
        slots[rank] = named([*distinct, None])
        return np.repeat(np.arange(len(sizes)), sizes), codes, slots
    entries = named.flatten()
    at = pc.index_in(entries.field("token"), value_set=coded.dictionary).fill_null(len(rank) - 1)
    slots = np.full(len(rank), -1, np.int64)
    slots[rank[at.to_numpy(zero_copy_only=False)]] = entries.field("slot").fill_null(-1).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(sizes)), sizes), codes, slots


def _shares(row: np.ndarray, slot: np.ndarray, times: np.ndarray, weigh, n_rows: int, n_slots: int) -> np.ndarray:
    """Weight per slot over all weight of the row; what lies in no slot counts in the whole only.

    Weights are added by row, slot and size: one sort of numbers that hold all three, or of three columns where they don't fit.
    """
    low, mid = int(times.max(initial=0)).bit_length(), n_slots.bit_length()
    cell = (row << mid) | (slot + 1)
    if n_rows.bit_length() + mid + low < 63:
        packed = np.sort((cell << low) | times)
        cell, times = packed >> low, packed & ((1 << low) - 1)
    else:
        order = np.lexsort((times, cell))
        cell, times = cell[order], times[order]
    weight = weigh(times.astype(np.float64))
    row, slot = cell >> mid, (cell & ((1 << mid) - 1)) - 1
    whole = np.bincount(row, weights=weight, minlength=n_rows)
    there = slot >= 0
    sums = np.bincount(row[there] * n_slots + slot[there], weights=weight[there], minlength=n_rows * n_slots)
    return sums.reshape(n_rows, n_slots) / np.where(whole == 0, 1.0, whole)[:, None]


def row_values(lists: pa.Array, named: pa.Array | SlotsOf, n_categories: int, top_k: int, log_dampen: bool, tokens: ngram_counts.Coded | None = None) -> np.ndarray:
    """The statistics, category and transition values of every row; zeros for an empty or null one. ``tokens`` are the lists' ``coded_tokens``."""
    n_rows = len(lists)
    row, code, slots = _numbered(*(tokens or ngram_counts.coded_tokens(lists)), named)
    kinds = len(slots)
    weigh = (lambda c: _log2(c + 1.0)) if log_dampen else (lambda c: c)

    key, times = np.unique(row * kinds + code, return_counts=True)
    of, token, n = key // kinds, key % kinds, times.astype(np.float64)
    size = np.bincount(row, minlength=n_rows).astype(np.float64)
    unique = np.bincount(of, minlength=n_rows).astype(np.float64)
    some = np.where(size == 0, 1.0, size)
    spread = np.bincount(of, weights=n * _log2(n), minlength=n_rows)
    bits = int(times.max(initial=0)).bit_length()
    most = (1 << bits) - 1
    falling = most - (np.sort((of << bits) | (most - times)) & most)
    place = np.arange(len(of)) - np.searchsorted(of, of)
    first = place < top_k
    top = np.zeros((n_rows, top_k))
    best, best_row = falling[first].astype(np.float64), of[first]
    top[best_row, place[first]] = _log2(best + 1.0) / _log2(size[best_row] + 1.0) if log_dampen else best / size[best_row]
    entropy = np.where(size == 0, 0.0, _log2(some) - spread / some + 0.0)
    stats = np.column_stack([_log2(size + 1.0), _log2(unique + 1.0), unique / some, top, entropy])

    # a pair lies inside of a row
    inside = row[:-1] == row[1:]
    step, pairs = np.unique((row[:-1][inside] * kinds + code[:-1][inside]) * kinds + code[1:][inside], return_counts=True)
    before, after = slots[step // kinds % kinds], slots[step % kinds]
    pair = np.where((before >= 0) & (after >= 0), before * n_categories + after, -1)
    steps = _shares(step // kinds // kinds, pair, pairs, weigh, n_rows, n_categories**2)
    return np.column_stack([stats, _shares(of, slots[token], times, weigh, n_rows, n_categories), steps])


def dense_vectors(values: np.ndarray) -> pa.StructArray:
    """Rows as stored ML vectors."""
    n, width = values.shape
    offsets = pa.array((np.arange(n + 1) * width).astype(np.int32))
    empty = pa.array([None] * n, pa.list_(pa.int32()))
    return pa.StructArray.from_arrays(
        [pa.array(np.ones(n, np.int8)), pa.nulls(n, pa.int32()), empty, pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))],
        names=["type", "size", "indices", "values"],
    )


def engineered_vectors(n_categories: int, top_k: int, log_dampen: bool, slots_of: SlotsOf | None = None):
    """Function of a token list column and the category slot of a token to the vector of ``features.engineered``."""
    from pyspark.ml.linalg import VectorUDT

    @F.arrow_udf(VectorUDT())
    def vectors(sequences: pa.Array, named: pa.Array) -> pa.Array:
        width = 4 + top_k + n_categories + n_categories**2
        parts = [row_values(sequences.slice(a, n), slots_of or named.slice(a, n), n_categories, top_k, log_dampen) for a, n in row_pieces(sequences)]
        values = np.concatenate(parts) if parts else np.zeros((0, width))
        return dense_vectors(values)

    return lambda column, slot: vectors.asNondeterministic()(F.col(column), _named(column, slot, slots_of))


def _named(column: str, slot, slots_of: SlotsOf | None) -> Column:
    """What the rows' tokens are in; with ``slots_of`` only a second use of the column, which keeps its making a projection of its own."""
    if slots_of:
        return F.coalesce(F.size(column), F.lit(0))
    return F.transform(F.array_distinct(column), lambda x: F.struct(x.alias("token"), slot(x).alias("slot")))


def matrix_rows(
    names: list[str], ngram_range: tuple[int, int], min_len: int, n_categories: int, top_k: int, log_dampen: bool, drop_length: bool,
) -> Callable[[pa.Array, pa.Array | SlotsOf], pa.StructArray]:
    """Function of token lists and their categories to the sparse vectors of ``matrix_vectors``."""
    first = 1 if drop_length else 0
    width = len(names) + 4 + top_k + n_categories + n_categories**2 - first
    known = []

    def rows(sequences: pa.Array, named: pa.Array | SlotsOf) -> pa.StructArray:
        if not known:  # made by the worker
            known.append(ngram_counts.ShareCells(names, ngram_range, min_len))
        parts = []
        for start, n in row_pieces(sequences):
            piece = sequences.slice(start, n)
            tokens = ngram_counts.coded_tokens(piece)
            row, col, x = known[0].cells(piece, tokens)
            values = row_values(piece, named if callable(named) else named.slice(start, n), n_categories, top_k, log_dampen, tokens)[:, first:]
            at, place = np.nonzero(values)
            row, col = np.concatenate([row, at]), np.concatenate([col, len(names) + place])
            order = np.argsort(row, kind="stable")
            parts.append((start + row[order], col[order], np.concatenate([x, values[at, place]])[order]))
        return ngram_counts.sparse_vectors(parts, len(sequences), width)

    return rows


def matrix_vectors(rows: Callable, slots_of: SlotsOf | None = None):
    """As ``engineered_vectors``, after the shares of n-grams: one sparse vector, and each list is sent once; ``rows`` is of ``matrix_rows``."""
    from pyspark.ml.linalg import VectorUDT

    @F.arrow_udf(VectorUDT())
    def vectors(sequences: pa.Array, named: pa.Array) -> pa.Array:
        return rows(sequences, slots_of or named)

    return lambda column, slot: vectors.asNondeterministic()(F.col(column), _named(column, slot, slots_of))
