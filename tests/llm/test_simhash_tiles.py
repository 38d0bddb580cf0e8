import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from seqlab.llm import simhash_tiles as op
from seqlab.llm.common import components


def brute(texts):
    fps = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in sh) for b in range(64)]
        fps[i] = sum(1 << b for b in range(64) if 2 * ones[b] > len(sh))
    comp = {i: i for i in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if bin(fps[a] ^ fps[b]).count("1") <= 2:
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return {i: (fps[i], comp[i]) for i in fps}


def test_against_brute_force(docs):
    r = random.Random(3)
    words = [f"W{i}é" for i in range(60)]
    base = [" ".join(r.choice(words) for _ in range(r.choice([0, 1, 2, 3, 40, 300]))) for _ in range(25)]
    texts = base + [b.replace(" ", "\t\n") for b in base[:10]] + [b + " tail" for b in base[5:15]] + [None, "", "  \x0b", "a b c"]
    got = {x["doc_id"]: (x["fp"] % 2**64, x["component_id"]) for x in op.near_duplicates(docs(texts), tile=8).collect()}
    assert got == brute(list(enumerate(texts)))


def test_close_pairs_misses_nothing(rng):
    a = rng.integers(0, 2**63, 300, dtype=np.uint64)
    b = np.concatenate([a[:100] ^ np.uint64(5), a[100:200] ^ np.uint64(1 << 40), rng.integers(0, 2**63, 50, dtype=np.uint64)])
    x, y = op.close_pairs(a, b, 2, False)
    want = np.argwhere(np.bitwise_count(a[:, None] ^ b[None]) <= 2)
    assert sorted(zip(x, y)) == sorted(map(tuple, want))


def test_edges(docs, spark):
    assert op.near_duplicates(docs([("x", "y")][:0])).count() == 0
    rows = op.near_duplicates(docs([(None, "only here"), (4, "a b"), (4, "a b"), (2, "A  b")])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in rows) == [(-1, None), (2, 2), (4, 2), (4, 2)]
    kept = op.keep_one(docs([(4, "a b"), (2, "A b"), (9, "other text")]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 9] and "component" in kept.columns


def test_components_of_a_long_chain(spark):
    edges = spark.range(0, 300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).repartition(7)
    hub = spark.range(1000, 3000).select(F.lit(5000).cast("long").alias("u"), F.col("id").alias("v"))
    got = {r["node"]: r["component"] for r in components(edges.union(hub)).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and all(got[i] == 1000 for i in [*range(1001, 3000), 5000])


def replaced_words(r, words, share):
    out = list(words)
    for at in r.sample(range(len(out)), max(1, round(share * len(out)))):
        out[at] = f"new{r.randrange(10**6)}"
    return out


def test_keep_one_takes_near_copies_and_leaves_clean_texts(docs):
    r = random.Random(5)
    base = [[f"w{r.randrange(5000)}" for _ in range(r.randrange(100, 400))] for _ in range(120)]
    near = [replaced_words(r, w, 0.01) for w in base[:60]]
    far = [replaced_words(r, w, 0.15) for w in base[60:]]
    sets = [op.shingle_set([x.encode() for x in w], 5) for w in base + near + far]
    jaccard = lambda i: len(sets[i] & sets[i + 120]) / len(sets[i] | sets[i + 120])
    got = {x["doc_id"] for x in op.keep_one(docs([" ".join(w) for w in base + near + far]), tile=50).collect()}
    assert got == {*range(120)} | {i + 120 for i in range(120) if jaccard(i) < 0.8}
    assert sum(jaccard(i) >= 0.8 for i in range(60)) > 50


def test_recall_of_the_radius_at_the_least_similarity():
    r = random.Random(8)
    missed = tried = 0
    for _ in range(1500):
        words = [f"w{r.randrange(10**5)}".encode() for _ in range(r.randrange(100, 600))]
        other = [x.encode() if isinstance(x, str) else x for x in replaced_words(r, words, 0.023)]
        a, b = op.shingle_set(words, 5), op.shingle_set(other, 5)
        if 0.8 <= len(a & b) / len(a | b) < 0.83:
            x, y = (np.array(op.wide_simhash(op.shingle_hashes(w, 5)), np.int64).view(np.uint64) for w in (words, other))
            tried += 1
            missed += int(np.bitwise_count(x ^ y).sum()) > op.WIDE_RADIUS
    assert tried > 200 and missed <= 0.01 * tried, (missed, tried)


def test_keep_one_on_repeated_and_missing_ids(docs):
    a, b, c = "one two three four five six", "seven eight nine ten", "eleven twelve"
    kept = op.keep_one(docs([(4, a), (4, a), (None, a), (4, b), (None, c), (None, c)])).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept) == sorted([(4, a), (4, b), (-1, c)])
    twins = op.keep_one(docs([(4, a), (4, a), (4, a)])).collect()
    assert [r["doc_id"] for r in twins] == [4]


def test_hashed_shingles_are_the_distinct_shingles():
    r = random.Random(2)
    for n in (0, 1, 4, 5, 6, 300):
        words = [f"w{r.randrange(8)}".encode() for _ in range(n)]
        assert len(op.shingle_hashes(words, 5)) == len(op.shingle_set(words, 5))
    a, b = [[f"w{i}".encode() for i in x] for x in (range(100), range(50, 150))]
    x, y = (set(op.shingle_hashes(w, 5)[:, 0].tolist()) for w in (a, b))
    assert len(x & y) == len(op.shingle_set(a, 5) & op.shingle_set(b, 5)) == 46


def test_keep_one_on_unlike_lengths_and_clashing_names(docs, spark):
    """Sizes around the least similarity, a long text, and columns named as inner ones."""
    r = random.Random(3)
    words = [f"w{r.randrange(10**5)}" for _ in range(130_000)]
    texts = [" ".join(words[:n]) for n in (104, 100, 84, 80, 60, 20, 5, 4, 1, 0)] + [" ".join(words), " ".join(words[:-40])]
    df = docs(texts).withColumnsRenamed({"component": "_row", "id": "tile"})
    got = op.keep_one(df, tile=3)
    assert got.columns == df.columns and {x["_row"] for x in got.collect()} == {"u"}
    assert sorted(x["doc_id"] for x in got.collect()) == [0, 4, 5, 6, 7, 8, 9, 10]
    assert op.keep_one(docs([])).count() == 0
