import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlab.llm import language_id as L
from seqlab.llm.queries import QUERIES


def plain_buckets(text):
    """Subword buckets one at a time."""
    word = "".join(c if c.isalpha() else "\0" for c in f"\0{(text or '').lower()}\0")
    out = []
    for size in range(1, L.GRAMS + 1):
        for i in range(len(word) - size + 1):
            g = word[i:i + size]
            if "\0" in (g[1:-1] if size > 2 else "") or not g.strip("\0"):
                continue
            h = 0
            for n, c in enumerate(g, 1):
                h = (h + ord(c if c != "\0" else "\0") + n) * 2654435761 % 2**32
                h ^= h >> 15
            out.append(h * 2654435761 % 2**32 >> 16)
    return sorted(out)


@pytest.mark.parametrize("text", [None, "", "a", "Ab c", "été 12 x!", "Straße ΑΒΓ 漢字", "..", "\0x\0", "a" * 70, "one two " * 40_000])
def test_buckets_against_one_at_a_time(text):
    ids, n = L.bucket_counts(text)
    want = plain_buckets((text or "")[:4000])
    if text is None or len(text) <= 4000:
        assert np.repeat(ids, n.astype(int)).tolist() == want
    else:  # a piece's edge loses and repeats nothing
        assert n.sum() == 40_000 * (3 + 4 + 3 + 2) * 2


def test_scores_are_the_softmax_of_the_mean(monkeypatch):
    monkeypatch.setattr(L, "CHARS", 64)
    r = np.random.default_rng(1)
    m = L.Model(["a", "b", "c"])
    m.weights, m.bias, m.temperature, m.bar = r.normal(size=(L.BUCKETS, 3)).astype(np.float32), np.array([0.1, 0.2, -0.3]), 0.7, 0.6
    texts = ["Some words here", None, "12 34", "x", "long " * 300, "Some words here"]
    best, score, accepted = m.scores(texts)
    for t, b, s, ok in zip(texts, best, score, accepted):
        if t is None or not any(c.isalpha() for c in t):
            assert (b, s, ok) == (-1, 0, False)
            continue
        z = m.weights[plain_buckets(t)].mean(0, dtype=np.float64) + m.bias
        p = np.exp(z / 0.7) / np.exp(z / 0.7).sum()
        assert b == p.argmax() and abs(s - p.max()) < 1e-5 and ok == (p.max() >= 0.6)


def test_held_out_accuracy_and_contract(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").toPandas().set_index("doc_id")
    got = QUERIES["op11_language_id"](spark, sf).toPandas()
    assert len(got) == len(docs) and got["score"].between(0, 1).all()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    held = got[got["held_out"]]
    right = held["lang_pred"].to_numpy() == docs.loc[held["doc_id"], "lang"].to_numpy()
    assert right.mean() >= 0.97
    sure = held["accepted"].to_numpy()
    assert sure.mean() >= 0.8 and right[sure].mean() >= 0.98


def test_other_scripts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.trained(docs, F.col("doc_id") % 5 != 0)
    assert not model.scores(["漢字文章 " * 20, "Ελληνικό κείμενο χωρίς άλλα"])[2].any()


def test_defined_cases(docs, spark):
    learn = F.col("doc_id") % 5 != 0
    texts = [None, "", "12 34 !!", (None, "plain words of the text"), "the words", "the words"] + [f"words and more of them {i}" for i in range(20)]
    got = L.identified(docs(texts), learn).toPandas()
    assert len(got) == len(texts)
    und = got[got["lang_pred"] == "und"]
    assert sorted(und["doc_id"]) == [0, 1, 2] and (und["score"] == 0).all() and not und["accepted"].any()
    assert (got[got["lang_pred"] != "und"]["lang_pred"] == "en").all() and (got[got["lang_pred"] == "en"]["score"] == 1).all()
    assert L.identified(docs([]), learn).count() == 0
    nothing = L.identified(docs(texts).withColumn("lang", F.lit(None).cast("string")), learn).toPandas()
    assert set(nothing["lang_pred"]) == {"und"} and (nothing["score"] == 0).all()


def test_rates():
    assert L.rates({"a": 10, "b": 1000, "c": 4000}, 610) == {"a": 1.0, "b": 0.3, "c": 0.075}
    assert L.rates({}, 5) == {} and L.rates({"a": 3}, 5) == {"a": 1.0}
