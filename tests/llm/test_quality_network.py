import numpy as np
from pyspark.sql import functions as F

from seqlab.llm import quality_network as op


def test_vectors_match_a_plain_count(docs):
    texts = ["b a b C.", "a", None, "", "x y z " * 40, "a b a"] * 3
    got = op.word_vectors(docs(texts).repartition(4))
    places, signs = op.index_vectors()
    total, count = np.zeros((op.BUCKETS, op.DIM)), np.zeros(op.BUCKETS)
    for t in texts:
        ids = [op.bucket_of(u) for w in (t or "").split() for u in op.units_of(w)]
        for i, own in enumerate(ids):
            count[own] += 1
            for j in range(max(0, i - op.WINDOW), min(len(ids), i + op.WINDOW + 1)):
                if j != i:
                    total[own, places[ids[j]]] += signs[ids[j]]
    share = count / count.sum()
    v = total - share[:, None] * total.sum(0)
    n = np.sqrt((v * v).sum(1))
    v = v / np.where(n > 0, n, 1)[:, None] * (op.SMOOTH / (op.SMOOTH + share))[:, None]
    assert np.allclose(got, v, atol=1e-6)


def test_learns_and_stays_calibrated(spark, docs, rng):
    words = [f"w{i}" for i in range(40)]
    good = lambda: " ".join(rng.choice(words, 30))
    bad = lambda: " ".join(w + "##" for w in rng.choice(words, 30))
    kind = rng.random(400) < 0.8
    df = docs([good() if k else bad() for k in kind] + [None, ""])
    labels = spark.createDataFrame([(i, int(k)) for i, k in enumerate(kind)] + [(3, None), (999, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in op.scored(df, labels, F.col("doc_id") % 4 != 0).collect()}
    assert len(got) == 402 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    held = [i for i in range(400) if i % 4 == 0]
    assert np.mean([got[i]["predicted"] == kind[i] for i in held]) > 0.97


def test_without_usable_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in op.scored(docs(["a", None]), none, F.lit(True)).collect()} == {0.5}
    one = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    assert {r["score"] for r in op.scored(docs(["a", "b"]), one, F.lit(True)).collect()} == {1.0}
    assert op.scored(docs([]), none, F.lit(True)).count() == 0
