import numpy as np
import pytest

from seqlab.llm import embedding_tiles as op


def brute(arrays, threshold=0.95):
    x = {i: np.array(a, np.float32).astype(float) for i, a in arrays if a is not None and None not in a and len(a)}
    x = {i: a for i, a in x.items() if np.isfinite(a).all() and a.any()}
    links = {i: [] for i, _ in arrays}
    for i, a in x.items():
        for j, b in x.items():
            if i != j and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links[i].append(j)
    comp = {i: i for i in links}
    for _ in links:
        for i in links:
            for j in links[i]:
                comp[i] = comp[j] = min(comp[i], comp[j])
    return {i: (len(links[i]), comp[i], comp[i] == i) for i in links}


@pytest.mark.parametrize("tile", [7, 4096])
def test_against_brute_force(vectors, rng, tile):
    centre = rng.normal(size=(6, 24))
    rows = [c + rng.normal(size=24) * s for c in centre for s in (0.02, 0.1, 0.2, 0.25, 0.3, 0.0, 0.0)]
    rows += [3 * rows[0], [0.0] * 24, [-0.0] * 24, None, [None] + [1.0] * 23, [float("nan")] * 24, [float("inf")] * 24, [], [1.0, 2.0], [2.0, 4.0], [0.0, 1.0]]
    rows += list(rng.normal(size=(20, 24)))
    rows = [None if r is None else list(r) for r in rows]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in op.near_duplicates(vectors(rows), tile=tile, leading=4).collect()}
    assert got == brute(list(enumerate(rows)))


def test_linked_pairs_reach_the_threshold_exactly(rng):
    a = rng.normal(size=(300, 64))
    b = np.vstack([a[:150] + rng.normal(size=(150, 64)) * np.linspace(0, 0.6, 150)[:, None], rng.normal(size=(50, 64))])
    axes = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    cos = a @ b.T / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
    x, y = op.linked_pairs(a, b, axes, 0.95)
    assert set(zip(x, y)) == set(map(tuple, np.argwhere(cos >= 0.95)))


def test_empty_and_repeated_ids(vectors, spark):
    assert op.near_duplicates(vectors([])).count() == 0
    rows = [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [1.0, 0.0]), (6, [0.0, 1.0])]
    got = op.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in got) == [(0, 0, 0), (5, 1, 5), (5, 1, 5), (6, 0, 6)]
