"""Ordered and lookup operators on data where one key dominates."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from seqlab import runtime
from seqlab.operators import calls, skew


def hot_rows(n=2000):
    rng = random.Random(5)
    return [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 40)}", rng.randint(0, 300), i, rng.randint(1, 9)) for i in range(n)]


def test_number_within_and_prefix_sums(spark):
    data = hot_rows()
    df = spark.createDataFrame(data, "k string, ts long, id long, x long").repartition(5)
    want, seen = {}, defaultdict(lambda: [0, 0])
    for k, ts, i, x in sorted(data, key=lambda r: (r[1], r[2])):
        want[i] = (seen[k][0] + 1, seen[k][1])
        seen[k][0] += 1
        seen[k][1] += x
    bucket = skew.quantile_bucket(df, F.col("ts"), 16)
    numbered = skew.number_within(df, ["k"], [F.col("ts"), F.col("id")], bucket)
    sums = skew.prefix_sums(df, ["k"], [F.col("ts"), F.col("id")], bucket, {"before": F.col("x")})
    assert {r["id"]: r["pos"] for r in numbered.collect()} == {i: w[0] for i, w in want.items()}
    assert {r["id"]: r["before"] for r in sums.collect()} == {i: w[1] for i, w in want.items()}
    # the dominant key is spread over many groups
    groups = df.where("k = 'hot'").groupBy(bucket.alias("b")).count()
    assert groups.count() >= 12 and groups.agg(F.max("count")).first()[0] < 0.2 * len(data)


def test_rank_rows_both_ways(spark):
    words = sorted({f"w{random.Random(i).randint(0, 10**6)}" for i in range(500)})
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(7)
    small = {r["w"]: r["r"] for r in skew.rank_rows(df, ["w"], "r", 2).collect()}
    large = {r["w"]: r["r"] for r in skew._rank_ranges(runtime.pin(df), ["w"], "r", 2).collect()}
    assert small == large == {w: i + 2 for i, w in enumerate(words)}
    down = {r["w"]: r["r"] for r in skew._rank_ranges(runtime.pin(df), [F.desc("w")], "r", 0).collect()}
    assert down == {w: i for i, w in enumerate(reversed(words))}


def test_lookup_join_paths_agree(spark):
    facts = spark.createDataFrame([(str(i), "a" if i % 3 else f"t{i % 17}") for i in range(300)] + [("n", None)], "sample_id string, token string")
    dim = spark.createDataFrame([("a", 1), *[(f"t{i}", i) for i in range(0, 17, 2)]], "token string, idx int")
    for how in ("left", "inner"):
        a = sorted(facts.join(dim, "token", how).select("sample_id", "token", "idx").collect(), key=str)
        for rows, hot in ((10**6, 1000), (0, 2), (0, 0)):
            b = skew.lookup_join(facts, dim, ["token"], how, max_broadcast_rows=rows, hot_keys=hot)
            assert sorted(b.select("sample_id", "token", "idx").collect(), key=str) == a


def long_calls(spark):
    rng = random.Random(9)
    rows = {"a": [rng.choice("xy") for _ in range(137)], "b": ["z"] * 40, "c": ["q"], "d": list("ppppqqqqqqqp")}
    data = [(k, i + 1, t) for k, s in rows.items() for i, t in enumerate(s)]
    return rows, spark.createDataFrame(data, "sample_id string, pos long, token string").repartition(6)


def test_collapse_and_pairs_across_blocks(spark):
    rows, df = long_calls(spark)
    for k in (1, 2, 5):
        for block in (5, 7, 4096):
            got = defaultdict(list)
            for r in calls.collapse_runs(df, k, block).orderBy("sample_id", "pos").collect():
                got[r["sample_id"]].append((r["pos"], r["token"]))
            for name, s in rows.items():
                want, prev, n = [], None, 0
                for t in s:
                    n = n + 1 if t == prev else 1
                    prev = t
                    if n <= k:
                        want.append(t)
                assert got[name] == [(i + 1, t) for i, t in enumerate(want)], (name, k, block)
    for block in (2, 3, 4096):
        got = {(r["sample_id"], r["pos"]): (r["token"], r["next_token"]) for r in calls.consecutive_pairs(df, block).collect()}
        assert got == {(n, i + 1): (s[i], s[i + 1]) for n, s in rows.items() for i in range(len(s) - 1)}


def test_transition_shares_sum_to_one(spark):
    _, df = long_calls(spark)
    sums = calls.transition_shares(df, 6).groupBy("sample_id").agg(F.sum("share").alias("s")).collect()
    assert {r["sample_id"] for r in sums} == {"a", "b", "d"} and all(abs(r["s"] - 1) < 1e-9 for r in sums)


def test_as_sequences(spark):
    rows, df = long_calls(spark)
    got = {r["sample_id"]: list(r["sequence"]) for r in calls.as_sequences(df, 50).collect()}
    assert got == {k: s[:50] for k, s in rows.items()}
