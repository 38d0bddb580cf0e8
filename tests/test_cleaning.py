import random

import pytest
from pyspark.sql import functions as F

from seqlab.functions import cleaning as c


def runs(*pairs):
    return [t for t, n in pairs for _ in range(n)]


def collapse(seq, k):
    out, prev, n = [], None, 0
    for t in seq:
        n = n + 1 if t == prev else 1
        prev = t
        if n <= k:
            out.append(t)
    return out


def test_remove_sandbox_tokens(one):
    assert one(["__exception__", "a", "__anomaly__", "b", "__other__"], c.remove_sandbox_tokens) == ["a", "b"]


@pytest.mark.parametrize("seq", [runs(("a", 7), ("b", 3), ("a", 8)), ["a", "b"] * 4, [], ["a"]])
def test_collapse_runs(one, seq):
    assert one(seq, c.collapse_runs) == collapse(seq, 5)


def test_collapse_random(seqs):
    rng = random.Random(7)
    rows = [[rng.choice("ab") for _ in range(rng.randint(0, 40))] for _ in range(60)]
    for k in (1, 2, 5):
        got = {r["sample_id"]: r["v"] for r in seqs(rows).select("sample_id", c.collapse_runs(F.col("sequence"), k).alias("v")).collect()}
        assert all(got[str(i)] == collapse(s, k) for i, s in enumerate(rows))


def test_drop_repeats(one):
    assert one(list("aabcccbba"), c.drop_repeats) == list("abcba")


def test_clean_joins_runs(one):
    seq = runs(("a", 7)) + ["__x", "a"] + runs(("b", 3), ("a", 8))
    assert one(seq, c.clean) == runs(("a", 5), ("b", 3), ("a", 5))


def test_short_trace(one):
    assert one(runs(*[(f"api_{i}", 5) for i in range(200)]), c.short_trace) == [f"api_{i}" for i in range(100)]
    assert one(["a", "__exception__", "b", "__anomaly__", "c"], c.short_trace) == ["a", "b", "c"]


def test_external_lowercases_first(one):
    assert one(["NtClose", "ntclose", "__Anomaly__"], lambda s: c.external(s, 1)) == ["ntclose"]


def test_parse_text(spark):
    rows = spark.createDataFrame([(" NtClose,\nNtOpenFile  a\tb ",), ("a b",), ("",)], "t string")
    got = [(r["v"], r["ok"]) for r in rows.select(c.parse_text(F.col("t")).alias("v"), c.long_enough(c.parse_text(F.col("t"))).alias("ok")).collect()]
    assert got == [(["NtClose", "NtOpenFile", "a", "b"], True), (["a", "b"], False), ([], False)]


def test_report_names(spark):
    row = spark.createDataFrame([("dir/abc.json",)], "p string")
    r = row.select(c.bare_name(F.col("p")).alias("f"), c.hash_of_report(c.bare_name(F.col("p"))).alias("h")).first()
    assert (r["f"], r["h"]) == ("abc.json", "abc")
