"""N-gram counts on word numbers, a batch of rows at a time, and the most frequent n-grams by threshold pruning.

Words are found once per distinct token of a batch and get numbers; pairs and triples of words are pairs and triples
of numbers. The most frequent n-grams are exact, though few n-grams are ever shuffled: every n-gram adds to one of
BUCKETS hashed totals, and a total bounds each of its n-grams from above. The n-grams of the largest totals are
counted exactly, their n-th count bounds the n-th of all from below, and only totals that reach it are counted as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab import runtime
from seqlab.operators.dictionaries import flat, row_pieces

BUCKETS = 1 << 20
SLICES = 64
FAN = 32  # partial totals that one task adds up
WORD_BITS = 21  # three numbers fit a long
FEW_WORDS = 8
HELD_TOKENS = 500_000  # whose words a worker remembers
MERGED = 200_000  # distinct n-grams of a task that are merged before they are sent
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_pattern(min_len: int) -> re.Pattern:
    return re.compile(rf"\b\w{{{min_len},}}\b")


Coded = tuple[np.ndarray, pa.DictionaryArray, list[str]]


def coded_tokens(lists: pa.Array) -> Coded:
    """(tokens of each row, all tokens by their place among the distinct ones, these)."""
    offsets, tokens = flat(lists, pa.string())
    coded = tokens.dictionary_encode()
    # by way of numpy, which makes strings many times faster than ``to_pylist``
    return np.diff(offsets.to_numpy()), coded, coded.dictionary.to_numpy(zero_copy_only=False).tolist()


def spread_words(sizes: np.ndarray, coded: pa.DictionaryArray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every word, where the words of the distinct tokens, and of a null token after them, are ``count`` each in a row."""
    first = np.cumsum(count) - count
    token = coded.indices.fill_null(len(count) - 1).to_numpy(zero_copy_only=False)
    n, row = count[token], np.repeat(np.arange(len(sizes)), sizes)
    at, rows, most = np.repeat(first[token], n), np.repeat(row, n), int(n.max(initial=0))
    if most <= FEW_WORDS:
        starts = np.cumsum(n) - n
        for k in range(1, most):
            at[starts[n > k] + k] += k
    else:
        at += np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return rows, at


def batch_words(lists: pa.Array, pattern: re.Pattern) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(row of each word, its number, the distinct words) of token lists; tokens are words apart, as if joined by spaces."""
    sizes, coded, distinct = coded_tokens(lists)
    found = [pattern.findall(t.lower()) for t in distinct] + [[]]  # the last for null tokens
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for f in found for w in f], np.int64)
    if len(number) >= 1 << WORD_BITS:
        raise ValueError("more distinct words in a batch than numbers; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    rows, at = spread_words(sizes, coded, np.array([len(f) for f in found]))
    return rows, ids[at], list(number)


def grams(rows: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every ``size``-gram inside a row; the key packs the words' numbers."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = ids[:n].copy()
    for k in range(1, size):
        key = (key << WORD_BITS) | ids[k: k + n]
    inside = rows[:n] == rows[size - 1:]
    return rows[:n][inside], key[inside]


def unpacked(keys: np.ndarray, size: int) -> list[np.ndarray]:
    mask = (1 << WORD_BITS) - 1
    return [(keys >> (WORD_BITS * (size - 1 - k))) & mask for k in range(size)]


def gram_buckets(keys: np.ndarray, size: int, hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each n-gram, by the hashes of its words alone."""
    h = np.full(len(keys), size, np.uint64)
    for part in unpacked(keys, size):
        h = (h ^ hashes[part]) * _MIX
        h ^= h >> np.uint64(29)
    return (h % np.uint64(buckets)).astype(np.int64)


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashes that do not depend on the batch or the process."""
    import hashlib

    data = b"".join(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest() for w in words)
    return np.frombuffer(data, np.uint64)


def _batches(batches: Iterator[pa.RecordBatch], pattern: re.Pattern, low: int, high: int):
    """(size, row, key, words, hashes) of every batch, some rows at a time."""
    for b in batches:
        for start, count in row_pieces(b.column(0)):
            rows, ids, words = batch_words(b.column(0).slice(start, count), pattern)
            hashes = word_hashes(words)
            for size in range(low, high + 1):
                row, key = grams(rows, ids, size)
                yield size, row, key, words, hashes


def bucket_totals(samples: DataFrame, ngram_range: tuple[int, int], min_len: int) -> np.ndarray:
    """Occurrences by bucket. Partial totals are added in groups of FAN; BUCKETS numbers reach the driver."""
    pattern, (low, high), buckets = word_pattern(min_len), ngram_range, BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(buckets, np.int64), False
        for size, _, key, _, hashes in _batches(batches, pattern, low, high):
            if len(key):
                distinct, n = np.unique(key, return_counts=True)
                np.add.at(total, gram_buckets(distinct, size, hashes, buckets), n)
                some = True
        if some:
            parts = [x.tobytes() for x in total.reshape(SLICES, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array(parts, pa.binary())], ["slice", "data"])

    def added(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.int64) for x in f["data"]], axis=0)
        return pd.DataFrame({"slice": [key[0]], "part": [int(f["part"].min())], "data": [total.tobytes()]})

    schema = "slice int, part long, data binary"
    parts = samples.select("sequence").mapInArrow(run, "slice int, data binary").withColumn("part", F.spark_partition_id().cast("long"))
    parts = runtime.pin(parts.select("slice", "part", "data"))
    left = parts.agg(F.max("part") + 1).first()[0] or 0
    while left > 1:
        left = -(-left // FAN)
        dealt = parts.withColumn("part", F.pmod("part", F.lit(left)))
        parts = runtime.pin(dealt.groupBy("slice", "part").applyInPandas(added, schema))
    total = np.zeros((SLICES, BUCKETS // SLICES), np.int64)
    for r in parts.collect():  # one row per slice
        total[r["slice"]] += np.frombuffer(r["data"], np.int64)
    return total.ravel()


def exact_counts(samples: DataFrame, chosen: np.ndarray, ngram_range: tuple[int, int], min_len: int) -> DataFrame:
    """(ngram, n) of all n-grams in the chosen buckets (a bit per bucket)."""
    pattern, (low, high) = word_pattern(min_len), ngram_range
    shared = samples.sparkSession.sparkContext.broadcast(np.packbits(chosen))  # a bit per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shared.value).astype(bool)
        held: dict[str, int] = {}

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["ngram", "n"])
            held.clear()
            return out

        for size, _, key, words, hashes in _batches(batches, pattern, low, high):
            if not len(key):
                continue
            distinct, n = np.unique(key, return_counts=True)
            hit = wanted[gram_buckets(distinct, size, hashes, len(wanted))]
            names = zip(*[p.tolist() for p in unpacked(distinct[hit], size)])
            for parts, count in zip(names, n[hit].tolist()):
                gram = " ".join([words[p] for p in parts])
                held[gram] = held.get(gram, 0) + count
            if len(held) >= MERGED:
                yield sent()
        if held:
            yield sent()

    found = samples.select("sequence").mapInArrow(run, "ngram string, n long")
    return found.groupBy("ngram").agg(F.sum("n").alias("n"))


def top_ngrams(samples: DataFrame, n: int, ngram_range: tuple[int, int], min_len: int) -> DataFrame:
    """(ngram, n) of the ``n`` most frequent n-grams, ties by n-gram; exact."""
    best = lambda df: df.orderBy(F.desc("n"), "ngram").limit(n)
    if n < 1:
        return samples.sparkSession.createDataFrame([], "ngram string, n long")
    runtime.small_batches(samples.sparkSession)
    dealt = runtime.spread(samples)
    totals = bucket_totals(dealt, ngram_range, min_len)
    present = np.sort(totals[totals > 0])[::-1]
    cut = int(present[min(2 * n, len(present)) - 1]) if len(present) else 1
    counted = runtime.pin(exact_counts(dealt, totals >= cut, ngram_range, min_len))
    nth = best(counted).agg(F.min("n").alias("low"), F.count("*").alias("k")).first()
    low = nth["low"] if nth["k"] == n else 1
    rest = (totals < cut) & (totals >= low) & (totals > 0)
    if rest.any():
        counted = counted.unionByName(runtime.pin(exact_counts(dealt, rest, ngram_range, min_len)))
    return best(counted)


class ShareCells:
    """The shares of the kept n-grams ``names`` among those a row has."""

    def __init__(self, names: list[str], ngram_range: tuple[int, int], min_len: int):
        self.pattern, self.sizes, self.width = word_pattern(min_len), range(ngram_range[0], ngram_range[1] + 1), len(names)
        # numbers of the words of kept n-grams, and (keys, columns) of the n-grams by size
        self.kept: dict[str, int] = {}
        by_size: dict[int, list[tuple[int, int]]] = {}
        for col, gram in enumerate(names):
            parts = gram.split(" ")
            key = 0
            for p in parts:
                key = (key << WORD_BITS) | self.kept.setdefault(p, len(self.kept) + 1)  # 0 is any other word
            by_size.setdefault(len(parts), []).append((key, col))
        self.tables = {size: tuple(map(np.array, zip(*sorted(pairs)))) for size, pairs in by_size.items()}
        self.held: dict[str, tuple[int, ...]] = {}

    def _words(self, token: str) -> tuple[int, ...]:
        """The numbers of a token's words."""
        numbers = self.held.get(token)
        if numbers is None:
            if len(self.held) >= HELD_TOKENS:
                self.held.clear()
            numbers = self.held[token] = tuple([self.kept.get(w, 0) for w in self.pattern.findall(token.lower())])
        return numbers

    def cells(self, sequences: pa.Array, tokens: Coded | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, share) of the kept n-grams, in order; ``tokens`` are the ``coded_tokens`` of ``sequences``."""
        sizes, coded, distinct = tokens or coded_tokens(sequences)
        words = [*map(self._words, distinct), ()]  # the last for null tokens
        rows, at = spread_words(sizes, coded, np.array([len(w) for w in words]))
        ids = np.array([x for w in words for x in w], np.int64)[at]
        found = [np.zeros(0, np.int64)]
        for size in self.sizes:
            if size not in self.tables:
                continue
            keys, cols = self.tables[size]
            n = max(0, len(ids) - size + 1)
            known = ids[:n] != 0
            for k in range(1, size):
                known &= ids[k: k + n] != 0
            known &= rows[:n] == rows[size - 1:]
            some = np.flatnonzero(known)
            row, key = rows[some], ids[some]
            for k in range(1, size):
                key = (key << WORD_BITS) | ids[some + k]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[at] == key
            found.append(row[hit] * self.width + cols[at[hit]])
        cell, n = np.unique(np.concatenate(found), return_counts=True)
        row = cell // max(1, self.width)
        return row, cell % max(1, self.width), n / np.bincount(row, weights=n, minlength=len(sequences))[row]


def sparse_vectors(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n_rows: int, width: int) -> pa.StructArray:
    """Rows as stored sparse ML vectors, from parts of (row, column, value) in order."""
    joined = lambda i, kind: np.concatenate([np.zeros(0, kind), *[p[i] for p in parts]]).astype(kind)
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(joined(0, np.int64), minlength=n_rows))]).astype(np.int32))
    of = lambda values: pa.ListArray.from_arrays(offsets, pa.array(values))
    return pa.StructArray.from_arrays(
        [
            pa.array(np.zeros(n_rows, np.int8)), pa.array(np.full(n_rows, width, np.int32)),
            of(joined(1, np.int32)), of(joined(2, np.float64)),
        ],
        names=["type", "size", "indices", "values"],
    )


def share_vectors(names: list[str], ngram_range: tuple[int, int], min_len: int):
    """Column function: token lists to sparse vectors of the shares of the kept n-grams ``names`` among those a row has."""
    from pyspark.ml.linalg import VectorUDT

    @F.arrow_udf(VectorUDT())
    def shares(sequences: pa.Array, sizes: pa.Array) -> pa.Array:
        known, parts = ShareCells(names, ngram_range, min_len), []
        for start, n in row_pieces(sequences):
            row, col, x = known.cells(sequences.slice(start, n))
            parts.append((start + row, col, x))
        return sparse_vectors(parts, len(sequences), len(names))

    # naming the sequence a second time keeps the step that computes it a projection of its own
    return lambda column: shares.asNondeterministic()(F.col(column), F.coalesce(F.size(column), F.lit(0)))
