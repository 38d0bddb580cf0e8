"""Exact top-k search by integer inner product over norm-sorted candidates.

Candidates are packed into blocks by falling length. Every block of queries first meets the block of the
longest candidates, which gives each query a score its k-th best cannot fall below. It then meets the
other blocks: by Cauchy-Schwarz a product is at most the product of the lengths, so a query leaves a
block at the first candidate that is too short; for the rest, partial sums over the leading axes (the
singular vectors of all candidates) plus the product of the suffix lengths must reach that score. What
is left is scored in whole numbers. A query that has not yet met k candidates keeps every candidate.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part; vectors
of different lengths are not compared; rows with equal vec_id are the query's own and each other's rows
count once per row; ties go to the smaller vec_id; no queries or no candidates give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlab.llm.common import checkpointed, packed_blocks, principal_axes, second_moments, stored, vector_rows

K = 20
TILE = 4096
QUERY_TILE = 1024
LEADING = 16
_SCHEMA = "block long, dim int, longest double, data_id binary, data binary"


def best_of(q: np.ndarray, c: np.ndarray, qi: np.ndarray, ci: np.ndarray, axes: np.ndarray, least: np.ndarray, k: int, leading: int = LEADING):
    """(query row, candidate row, score) of up to k best candidates with score >= least, by query."""
    rq, rc = q @ axes, c @ axes
    nq, nc = np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1))
    lead = min(leading, q.shape[1])
    tail = lambda r: np.sqrt(np.maximum(0, (r[:, lead:] ** 2).sum(1)))
    tq, tc = tail(rq), tail(rc)
    out = []
    for i in range(len(q)):
        slack = 1e-6 * (1 + nq[i] * nc[0])
        # candidates fall in length: the first that is too short ends the block for this query
        reach = len(c) if np.isneginf(least[i]) else int(np.searchsorted(-(nq[i] * nc), -(least[i] - slack), "right"))
        near = np.flatnonzero(rc[:reach, :lead] @ rq[i, :lead] + tc[:reach] * tq[i] >= least[i] - slack)
        score = (c[near] @ q[i]).astype(np.int64)  # whole numbers below 2**53: exact
        keep = (score >= least[i]) & (ci[near] != qi[i])
        near, score = near[keep], score[keep]
        order = np.lexsort((ci[near], -score))[:k]
        out.append((np.full(len(order), i), near[order], score[order]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def _pack(block: int, f: pd.DataFrame) -> pd.DataFrame:
    """One row per vector dimension in the block (one, as a rule)."""
    rows = []
    for d, p in f.groupby("dim"):
        p = p.sort_values(["n2", "vec_id"], ascending=[False, True])
        rows.append({"block": block, "dim": d, "longest": float(np.sqrt(p["n2"].max())), "data_id": p["vec_id"].to_numpy(np.int64).tobytes(), "data": b"".join(p["x"])})
    return pd.DataFrame(rows)


def top_k(vectors: DataFrame, queries: Column, k: int = K, tile: int = TILE, query_tile: int = QUERY_TILE, leading: int = LEADING) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest integer inner products floor(64 x) . floor(64 y)."""
    rows = vector_rows(vectors, whole=True)

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(n2=[float(np.square(np.frombuffer(x, np.float64)).sum()) for x in f["x"]])

    rows = stored(rows.mapInPandas(measured, "vec_id long, dim int, x binary, n2 double"), "whole-vectors")
    axes = principal_axes(second_moments(rows))
    order = [F.col("dim"), F.desc("n2"), F.col("vec_id")]
    cand = packed_blocks(rows, order, tile, "candidates", _SCHEMA, _pack)
    asked = packed_blocks(rows.where(queries), order, query_tile, "queries", _SCHEMA, _pack)
    first = cand.groupBy("dim").agg(F.min("block").alias("block"))

    def scored(least_of):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for r in f.to_dict("records"):
                    d = int(r["dim"])
                    q, c = (np.frombuffer(r[x], np.float64).reshape(-1, d) for x in ("q_data", "data"))
                    qi, ci = (np.frombuffer(r[x], np.int64) for x in ("q_data_id", "data_id"))
                    i, j, s = best_of(q, c, qi, ci, axes[d], least_of(r, len(q)), k, leading)
                    yield pd.DataFrame({"q_block": r["q_block"], "dim": d, "at": i, "query_id": qi[i], "vec_id": ci[j], "score": s})

        return run

    out = "q_block long, dim int, at long, query_id long, vec_id long, score long"
    q = asked.select(F.col("block").alias("q_block"), "dim", F.col("longest").alias("q_longest"), F.col("data_id").alias("q_data_id"), F.col("data").alias("q_data"))
    head = q.join(cand.join(first, ["dim", "block"], "left_semi"), "dim")
    opened = checkpointed(head.mapInPandas(scored(lambda r, n: np.full(n, -np.inf)), out))
    kth = (
        opened.groupBy("q_block", "dim", "at").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s"))
        .groupBy("q_block", "dim").agg(F.sort_array(F.collect_list(F.struct("at", F.when(F.col("n") >= k, F.col("s")).alias("s")))).alias("kth"))
    )

    def least(r: dict, n: int) -> np.ndarray:
        v = np.full(n, -np.inf)
        for x in r["kth"] if r["kth"] is not None else []:
            if x["s"] is not None:
                v[x["at"]] = x["s"]
        return v

    # block numbers and lengths are paired first; a pair too short for every query of the block is not fetched
    names = asked.select(F.col("block").alias("q_block"), "dim", "longest").join(kth, ["q_block", "dim"], "left").withColumn(
        "low", F.when((F.size("kth") > 0) & F.forall("kth", lambda x: x["s"].isNotNull()), F.array_min(F.transform("kth", lambda x: x["s"])))
    )
    small = cand.select("block", "dim", F.col("longest").alias("c_longest")).join(first, ["dim", "block"], "left_anti")
    # queries that met no candidate in the first block are not in kth, and then nothing may be cut
    full = F.coalesce(F.col("q_len") == F.size("kth"), F.lit(False))
    names = names.join(asked.select(F.col("block").alias("q_block"), "dim", (F.octet_length("data_id") / 8).alias("q_len")), ["q_block", "dim"])
    pairs = names.join(small, "dim").where(
        F.col("low").isNull() | ~full | (F.col("longest") * F.col("c_longest") * (1 + 1e-9) >= F.col("low"))
    ).select("q_block", "dim", "block", "kth")
    rest = pairs.join(q, ["q_block", "dim"]).join(cand, ["dim", "block"]).mapInPandas(scored(least), out)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        opened.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
