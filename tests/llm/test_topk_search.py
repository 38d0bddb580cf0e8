import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlab.llm import topk_search as op


@pytest.mark.parametrize("tile,k", [(8, 3), (4096, 20)])
def test_against_brute_force(vectors, rng, tile, k):
    x = rng.normal(size=(90, 12)) * rng.lognormal(size=(90, 1))
    x[40:60] = x[3]  # ties
    rows = [list(r) for r in x] + [None, [None] * 12, [float("nan")] * 12, [0.0] * 12, [1.0, 2.0], [3.0, 1.0]]
    got = {}
    found = op.top_k(vectors(rows), F.col("vec_id") % 10 == 0, k=k, tile=tile, query_tile=4, leading=5)
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    v = {i: np.floor(64 * np.array(r, np.float32).astype(float)).astype(int) for i, r in enumerate(rows) if r is not None and None not in r and np.isfinite(r).all()}
    want = {}
    for q in v:
        if q % 10 == 0:
            s = sorted((-int(v[q] @ v[c]), c) for c in v if c != q and len(v[c]) == len(v[q]))[:k]
            want[q] = [(n + 1, c, -t) for n, (t, c) in enumerate(s)]
    assert {q: sorted(r) for q, r in got.items()} == want


def test_no_queries_and_no_rows(vectors):
    assert op.top_k(vectors([]), F.lit(True)).count() == 0
    assert op.top_k(vectors([[1.0], [2.0]]), F.lit(False)).count() == 0
