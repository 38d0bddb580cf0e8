"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are scaled to length 1, rotated onto the principal axes of all vectors and packed into tiles by
their first coordinate. For a pair of tiles the products of the leading coordinates are accumulated
first; by Cauchy-Schwarz the rest is at most the product of the suffix norms, so a pair whose sum cannot
reach the threshold stops there, and whole tile pairs stop at their ranges. Pairs that reach the end are
decided by the cosine of the original vectors in double precision.

Equal vectors are compared once, as a class. A tile pair emits link counts and a spanning forest of its
links, never its pairs. The comparison is exact, so its work grows with the square of the number of
distinct vectors.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component, and vectors of
different lengths, link with nothing. Repeated rows link with each other. A row without vec_id is
returned with nulls and links with nothing. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import (
    block_pairs, checkpointed, components, local_forest, packed_blocks, principal_axes, salted_join, second_moments,
    vector_rows,
)

THRESHOLD = 0.95
TILE = 4096
LEADING = 16
SLACK = 1e-5  # above the rounding of the float32 bound


def linked_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, leading: int = LEADING) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) with cosine(a[i], b[j]) >= threshold."""
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    ra, rb = (a / na[:, None]) @ axes, (b / nb[:, None]) @ axes
    dim = a.shape[1]
    cuts = [k for k in (leading, 2 * leading) if k < dim] or [dim]
    rest = lambda r, k: np.sqrt(np.maximum(0, (r[:, k:] ** 2).sum(1)))
    left = lambda r: np.hstack([r[:, : cuts[0]], rest(r, cuts[0])[:, None]]).astype(np.float32)
    la, lb = left(ra), left(rb).T.copy()
    out = []
    for at in range(0, len(a), 512):
        i, j = np.nonzero(la[at: at + 512] @ lb >= threshold - SLACK)
        i += at
        for part in range(0, len(i), 1 << 17):
            x, y = i[part: part + (1 << 17)], j[part: part + (1 << 17)]
            for k in cuts[1:]:
                bound = np.einsum("ij,ij->i", ra[x, :k], rb[y, :k]) + rest(ra, k)[x] * rest(rb, k)[y]
                keep = bound >= threshold - SLACK
                x, y = x[keep], y[keep]
            keep = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y]) >= threshold
            out.append((x[keep], y[keep]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the key of their vector, and one row per distinct non-zero vector."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[np.array([any(x) for x in f["x"]], bool)]
            yield f.assign(key=[hashlib.sha256(x).digest() for x in f["x"]])

    # adding 0.0 first makes both zeros one, so that equal vectors have equal bytes
    keyed = checkpointed(rows.mapInPandas(_plus_zero, rows.schema).mapInPandas(run, "vec_id long, dim int, x binary, key binary"))
    one = keyed.groupBy("key").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.min("dim").alias("dim"), F.min("x").alias("x")
    )
    return keyed.select("vec_id", "key"), checkpointed(one)


def _plus_zero(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield f.assign(x=[(np.frombuffer(x, np.float64) + 0.0).tobytes() for x in f["x"]])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, leading: int = LEADING) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding)."""
    member, one = _classes(vector_rows(vectors))
    axes = principal_axes(second_moments(one))

    def first_axis(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            c = [float(np.frombuffer(x, np.float64) @ axes[d][:, 0]) for d, x in zip(f["dim"], f["x"])]
            n = [float(np.linalg.norm(np.frombuffer(x, np.float64))) for x in f["x"]]
            yield f.assign(c=np.array(c) / np.array(n) if c else [])

    def pack(block: int, f: pd.DataFrame) -> pd.DataFrame:
        c = f["c"].to_numpy()
        side = float(np.sqrt(np.maximum(0, 1 - c * c)).max())
        by = f.groupby("dim", sort=True)
        return pd.DataFrame({
            "block": [block], "lo": [float(c.min())], "hi": [float(c.max())], "side": [side],
            "data_dim": [np.array([d for d, _ in by], np.int64).tobytes()],
            "data_len": [np.array([len(p) for _, p in by], np.int64).tobytes()],
            "data_id": [np.concatenate([p["id"] for _, p in by]).astype(np.int64).tobytes()],
            "data_n": [np.concatenate([p["n"] for _, p in by]).astype(np.int64).tobytes()],
            "data": [b"".join(b"".join(p["x"]) for _, p in by)],
        })

    names = ["lo", "hi", "side", "data_dim", "data_len", "data_id", "data_n", "data"]
    blocks = packed_blocks(
        one.mapInPandas(first_axis, "key binary, id long, n long, dim int, x binary, c double"), [F.col("dim"), F.col("c"), F.col("id")],
        tile, "vectors", "block long, lo double, hi double, side double, data_dim binary, data_len binary, data_id binary, data_n binary, data binary", pack,
    )
    most = F.greatest(*[F.col(f"a_{x}") * F.col(f"b_{y}") for x in ("lo", "hi") for y in ("lo", "hi")])
    pairs = block_pairs(blocks, names, most + F.col("a_side") * F.col("b_side") >= threshold - SLACK)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.to_dict("records"):
                yield _compared(r, axes, threshold, leading)

    found = checkpointed(pairs.mapInPandas(run, "edge boolean, u long, v long"))
    comps = components(found.where("edge").select("u", "v"))
    counts = found.where("NOT edge").groupBy(F.col("u").alias("cid")).agg(F.sum("v").alias("more"))
    named = (
        one.select("key", "id", "n").join(counts, F.col("id") == F.col("cid"), "left").join(comps, F.col("id") == F.col("node"), "left")
        .select("key", F.col("n").alias("_n"), (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    usable = salted_join(member, checkpointed(named), "key", "_n", F.col("vec_id")).groupBy("vec_id").agg(
        F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")
    )
    return vectors.select("vec_id").join(usable, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"),
    )


def _compared(r: dict, axes: dict, threshold: float, leading: int) -> pd.DataFrame:
    def parts(s: str) -> dict:
        dims, lens = np.frombuffer(r[f"{s}_data_dim"], np.int64), np.frombuffer(r[f"{s}_data_len"], np.int64)
        ids, ns = np.frombuffer(r[f"{s}_data_id"], np.int64), np.frombuffer(r[f"{s}_data_n"], np.int64)
        out, row, at = {}, 0, 0
        for d, n in zip(dims, lens):
            x = np.frombuffer(r[f"{s}_data"], np.float64, n * d, at * 8).reshape(n, d)
            out[int(d)] = (ids[row: row + n], ns[row: row + n], x)
            row, at = row + n, at + n * d
        return out

    a, b = parts("a"), parts("b")
    rows = []
    for d in a.keys() & b.keys():
        (ia, ca, xa), (ib, cb, xb) = a[d], b[d]
        x, y = linked_pairs(xa, xb, axes[d], threshold, leading)
        if r["a"] == r["b"]:
            x, y = x[x < y], y[x < y]
        for ids, own, other, count in ((ia, x, y, cb), (ib, y, x, ca)):
            total = np.bincount(own, weights=count[other], minlength=len(ids)).astype(np.int64)
            hit = np.flatnonzero(total)
            rows.append(pd.DataFrame({"edge": False, "u": ids[hit], "v": total[hit]}))
        u, v = local_forest(ia[x], ib[y])
        rows.append(pd.DataFrame({"edge": True, "u": u, "v": v}))
    return pd.concat(rows) if rows else pd.DataFrame({"edge": np.zeros(0, bool), "u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
