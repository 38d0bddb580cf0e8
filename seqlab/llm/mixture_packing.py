"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens. Each window (sequence) is one round: every queue's credit grows by its
target share of the window, it gives the whole tokens of its credit, and the rest stays as its deficit for
the next window. The shares are the queues' shares of all tokens, so all queues end together. Credits are
rounded on the running sum over the queues in name order; so after w windows the queues up to the i-th have
given floor(w * size * P_i / T) tokens (P_i: tokens of those queues, T: of all). That closed form is the
whole state: each partition knows every deficit at its first token without hearing from the others, every
window but the last is full, and a queue's share of a window is off by less than one token. Sources too
small to give LEAST tokens to each window share one queue.

A queue's order is the order its documents were read in: by partition, then by position. Only the token
totals of (source, partition) are gathered; token ids are written once to the shared folder and never
shuffled beside that.

Defined cases: null texts are empty and hold the end id alone; a null source is a queue of its own;
repeated rows are packed once per row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import stored
from seqlab.llm.word_ids import END, loaded
from seqlab.operators.skew import prefix_sums

SIZE = 4096
# tokens a source must give to each window to have a queue of its own
FEW = 64  # windows of a document that are cut one by one
LEAST = 16
# (source, partition) rows that are broadcast with their offsets; more are joined by shuffle
BROADCAST_RUNS = 100_000


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenized(docs: DataFrame, vocabulary: str, end: int = END, cache: int | None = None) -> DataFrame:
    """(doc_id, source, part, start, n, ids): start counts the source's tokens before it in its partition.

    ``cache``: entries of the tokenizer's caches, which a task then leaves empty: Python workers are used again by later stages.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if cache is None:
            yield from encoded(frames)
            return
        words = loaded(vocabulary)
        words.bound(cache, cache)
        try:
            yield from encoded(frames)
        finally:
            words.bound()

    def encoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, part = loaded(vocabulary), TaskContext.get().partitionId()
        given: dict[str, int] = {}
        width = np.dtype(words.kind).itemsize
        for f in frames:
            for at in range(0, len(f), 256):
                g = f.iloc[at: at + 256]
                ids = [x + np.array([end], words.kind).tobytes() for x in words.packed(list(g["text"]))]
                n = [len(x) // width for x in ids]
                start = []
                for s, k in zip(g["source"], n):
                    start.append(given.get(s, 0))
                    given[s] = start[-1] + k
                yield pd.DataFrame({"doc_id": g["doc_id"].astype("Int64"), "source": g["source"], "part": part, "start": start, "n": n, "ids": ids})

    text = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source"), "text")
    return text.mapInPandas(run, "doc_id long, source string, part int, start long, n long, ids binary")


def given_by(windows: np.ndarray, upto: int, total: int, size: int) -> np.ndarray:
    """Tokens that queues holding ``upto`` of ``total`` tokens together have given before each window."""
    if size * int(windows.max(initial=0)) * max(upto, 1) < 1 << 62:
        given = windows * (size * upto) // total
    else:
        given = np.array([min(size * int(w) * upto // total, upto) for w in windows], np.int64)
    return np.minimum(given, upto)


def pieces(start: int, n: int, below: int, own: int, total: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut tokens [start, start + n) of a queue: (first token, length, window, offset in the window).

    ``below``: tokens of the queues before it, ``own``: its own, ``total``: of all queues. A queue gives at
    least one token to a window, so rounding moves a token by two windows at most.
    """
    first, last = max(0, start * total // (own * size) - 2), (start + n) * total // (own * size) + 4
    if last - first <= FEW:
        return few_pieces(start, n, below, own, total, size, first, last)
    w = np.arange(first, last)
    low = given_by(w, below, total, size)
    taken = given_by(w, below + own, total, size) - low
    a, b = np.maximum(taken[:-1], start), np.minimum(taken[1:], start + n)
    keep = b > a
    offset = low[1:] - low[:-1] + a - taken[:-1]
    return a[keep], (b - a)[keep], w[:-1][keep], offset[keep]


def few_pieces(start: int, n: int, below: int, own: int, total: int, size: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``pieces`` among the windows [first, last) one by one: for few windows, arrays cost more than their work."""
    upto, end, out = below + own, start + n, []
    low = min(size * first * below // total, below)
    taken = min(size * first * upto // total, upto) - low
    for w in range(first, last - 1):
        next_low = min(size * (w + 1) * below // total, below)
        next_taken = min(size * (w + 1) * upto // total, upto) - next_low
        a, b = max(taken, start), min(next_taken, end)
        if b > a:
            out.append((a, b - a, w, next_low - low + a - taken))
        low, taken = next_low, next_taken
    return tuple(np.array(out, np.int64).reshape(-1, 4).T)


def queue_table(totals: DataFrame, size: int = SIZE, least: int = LEAST) -> tuple[dict[str, tuple[str, int, int]], tuple[str, int, int], int]:
    """Queue, tokens below it and its own tokens by source; the same for all other sources; all tokens.

    A source that would give fewer than ``least`` tokens to a window shares one common queue with its like,
    so there are at most size / least own queues, whatever the number of sources.
    """
    total = totals.agg(F.sum("own").alias("t")).first()["t"] or 0
    large = {r["source"]: r["own"] for r in totals.where(F.col("own") >= max(1, -(-least * total // size))).collect()}
    rest = total - sum(large.values())
    own = dict(sorted(large.items()))
    common = ""
    if rest * size >= total or not own:
        own = {common: rest} | {f"={k}": v for k, v in own.items()}
        name = {k: f"={k}" for k in large}
    else:  # less than one token a window: they ride in the longest queue
        common = max(own, key=lambda k: (own[k], k))
        own[common] += rest
        name = {k: k for k in large}
    below, at = {}, 0
    for k, v in own.items():
        below[k], at = at, at + v
    return {k: (q, below[q], own[q]) for k, q in name.items()}, (common, below[common], own[common]), total


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = END, cache: int | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece of a document."""
    return packed_pieces(docs, vocabulary, size, end, with_ids=False, cache=cache)


def packed_pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = END, with_ids: bool = True, cache: int | None = None) -> DataFrame:
    """``pack``, with the piece's token ids as an array too."""
    kept = stored(tokenized(docs, vocabulary, end, cache), "token-ids")
    runs = kept.groupBy("source", "part").agg(F.sum("n").alias("run"))
    named, other, total = queue_table(kept.groupBy("source").agg(F.sum("n").alias("own")), size)
    known = kept.sparkSession.createDataFrame(
        [(k, *v) for k, v in named.items()], "source string, queue string, below long, own long"
    )  # size / LEAST rows at most
    runs = runs.join(F.broadcast(known), "source", "left").select(
        "source", "part", "run", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in zip(("queue", "below", "own"), other)]
    )
    # the order of a queue's runs: any fixed one; small sources are spread over its groups
    group = F.pmod(F.xxhash64("source"), F.lit(256))
    runs = stored(prefix_sums(runs, ["queue"], [F.col("source"), F.col("part")], group, {"queue_start": F.col("run")}), "runs")
    runs = runs.select("source", "part", "queue_start", "below", "own")
    if runs.count() <= BROADCAST_RUNS:
        runs = F.broadcast(runs)
    width = {np.uint16: 2, np.uint32: 4}[loaded(vocabulary).kind]

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def made(f: pd.DataFrame) -> pd.DataFrame:
        docs, parts, crc, cuts = [], [], [], []
        for doc, start, n, below, own, ids in zip(f["doc_id"].astype("Int64"), f["queue_start"] + f["start"], f["n"], f["below"], f["own"], f["ids"]):
            ids = np.frombuffer(ids, f"<u{width}").astype("<u4")
            a, k, w, off = pieces(int(start), int(n), int(below), int(own), total, size)
            a = a - start
            own_cuts = [ids[x: x + y] for x, y in zip(a.tolist(), k.tolist())]
            docs += [doc] * len(a)
            crc += [zlib.crc32(x) for x in own_cuts]
            parts.append((a, k, np.full(len(a), n), w, off))
            cuts += own_cuts if with_ids else []
        a, k, n, w, off = (np.concatenate(x) for x in zip(*parts))
        out = {"doc_id": pd.array(docs, "Int64"), "start": a, "length": k, "ids_crc32": crc, "doc_tokens": n, "sequence_id": w, "offset": off}
        return pd.DataFrame(out | ({"ids": cuts} if with_ids else {}))[names]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 512):
                yield made(f.iloc[at: at + 512])

    schema = ", ".join(f"{c} {'array<long>' if c == 'ids' else 'long'}" for c in names)
    return kept.join(runs, ["source", "part"]).select("doc_id", "start", "n", "queue_start", "below", "own", "ids").mapInPandas(run, schema)
