import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqlab import fixed_values as V
from seqlab.functions.arrays import vector_cells
from seqlab.functions.labels import category_from, short_feature_name
from seqlab.operators import features as ft
from seqlab.sources import readers

TABLE = {"ntcreatefile": "filesystem", "ntreadfile": "filesystem", "regopenkeyexa": "registry", "connect": "network"}


def cat(token):
    return TABLE.get(token, "other")


def py_stats(seq, top_k, damp):
    if not seq:
        return [0.0] * (4 + top_k)
    n, counts = len(seq), Counter(seq)
    top = sorted(counts.values(), reverse=True)[:top_k]
    share = [math.log2(c + 1) / math.log2(n + 1) if damp else c / n for c in top]
    return [math.log2(n + 1), math.log2(len(counts) + 1), len(counts) / n, *share, *[0.0] * (top_k - len(top)),
            -sum(c / n * math.log2(c / n) for c in counts.values())]


def py_slots(items, names, damp):
    out, whole = dict.fromkeys(names, 0.0), 0.0
    for key, c in items:
        w = math.log2(c + 1) if damp else c
        out[key] += w
        whole += w
    return [out[n] / whole if whole else 0.0 for n in names]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    pool = [*TABLE, "ntclose", "sleep", "x"]
    return [[], ["ntcreatefile"], ["ntcreatefile", "ntreadfile", "regopenkeyexa", "connect"]] + [
        [rng.choice(pool) for _ in range(rng.randint(1, 60))] for _ in range(30)
    ]


def values(samples, column):
    return {r["sample_id"]: r["v"] for r in samples.select("sample_id", column.alias("v")).collect()}


def test_statistics_golden(one):
    got = one(list("aabc"), lambda s: ft.statistics(s, top_k=3))
    assert got == pytest.approx([math.log2(5), 2.0, 0.75, 0.5, 0.25, 0.25, 1.5])


@pytest.mark.parametrize("damp", [False, True])
def test_against_loops(seqs, rows, damp):
    samples, of = seqs(rows), category_from(TABLE)
    stats = values(samples, ft.statistics(F.col("sequence"), log_dampen=damp))
    cats = values(samples, ft.category_shares(F.col("sequence"), damp, of))
    steps = values(samples, ft.transition_shares(F.col("sequence"), damp, of))
    pair_names = [(a, b) for a in V.CATEGORIES for b in V.CATEGORIES]
    for i, s in enumerate(rows):
        k = str(i)
        assert stats[k] == pytest.approx(py_stats(s, 5, damp), abs=1e-9)
        assert cats[k] == pytest.approx(py_slots([(cat(t), c) for t, c in Counter(s).items()], V.CATEGORIES, damp), abs=1e-9)
        bigrams = Counter(zip(s, s[1:]))
        assert steps[k] == pytest.approx(py_slots([((cat(a), cat(b)), c) for (a, b), c in bigrams.items()], pair_names, damp), abs=1e-9)
        assert not s or sum(cats[k]) == pytest.approx(1.0)
        assert len(s) < 2 or sum(steps[k]) == pytest.approx(1.0)


def test_categories_of_a_table(one):
    seq, of = ["ntcreatefile", "ntreadfile", "regopenkeyexa", "connect"], category_from(TABLE)
    got = dict(zip(V.CATEGORIES, one(seq, lambda s: ft.category_shares(s, category=of))))
    assert got == {**dict.fromkeys(V.CATEGORIES, 0.0), "filesystem": 0.5, "registry": 0.25, "network": 0.25}
    steps = dict(zip(ft.TRANSITION_NAMES, one(seq, lambda s: ft.transition_shares(s, category=of))))
    assert {k: round(x, 6) for k, x in steps.items() if x} == {
        "bigram_filesystem_filesystem": 0.333333, "bigram_filesystem_registry": 0.333333, "bigram_registry_network": 0.333333
    }
    assert one(["ntcreatefile"], lambda s: ft.transition_shares(s, category=of)) == [0.0] * 64
    assert one(["unheard"], lambda s: ft.category_shares(s, category=of))[-1] == 1.0
    with pytest.raises(ValueError, match="table"):
        one(seq, ft.category_shares)


def test_read_name_table(spark, tmp_path):
    path = tmp_path / "names.csv"
    path.write_text("call,category\n connect , network\nregopenkeyexa,registry\n,x\ny,\n")
    assert readers.read_name_table(spark, str(path)) == {"connect": "network", "regopenkeyexa": "registry"}
    with pytest.raises(ValueError, match="more than 1"):
        readers.read_name_table(spark, str(path), 1)


def test_words_follow_word_pattern(one):
    assert one(["NtClose", "a", "foo-bar", "x_1"], ft.words) == ["ntclose", "foo", "bar", "x_1"]
    assert one(["aa", "bb", "cc"], lambda s: ft.row_ngrams(s, (1, 3))) == ["aa", "bb", "cc", "aa bb", "bb cc", "aa bb cc"]
    assert one(["aa"], lambda s: ft.row_ngrams(s, (1, 3))) == ["aa"]
    assert one([], lambda s: ft.row_ngrams(s, (1, 3))) == []


def test_ngram_shares_and_matrix(seqs):
    samples = seqs([["aa", "bb", "aa"], ["bb", "cc"], ["zz"], []])
    vocab = ft.ngram_vocabulary(samples, 3, (1, 1))
    assert {r["ngram"]: r["col_idx"] for r in vocab.collect()} == {"aa": 0, "bb": 1, "cc": 2}
    shares = {(r["sample_id"], r["ngram"]): r["value"] for r in ft.ngram_shares(samples, vocab, (1, 1)).collect()}
    assert shares == {("0", "aa"): 2 / 3, ("0", "bb"): 1 / 3, ("1", "bb"): 0.5, ("1", "cc"): 0.5}
    of = category_from(TABLE)
    full = ft.feature_matrix(samples, vocab, category=of, ngram_range=(1, 1))
    assert {r["features"].size for r in full.collect()} == {3 + 9 + 8 + 64}
    assert {r["features"].size for r in ft.short_trace_features(samples, vocab, of).collect()} == {3 + 80}
    assert {r["features"].size for r in ft.engineered_features(samples, category=of).collect()} == {81}
    cells = full.where("sample_id = '0'").select(F.inline(vector_cells(F.col("features")))).where("i < 3").collect()
    assert {r["i"]: r["x"] for r in cells} == {0: 2 / 3, 1: 1 / 3} or {r["i"]: r["x"] for r in cells} == {0: 2 / 3, 1: 1 / 3, 2: 0.0}
    names = ft.feature_names(vocab).orderBy("col_idx").collect()
    assert len(names) == 84 and [r["name"] for r in names[:4]] == ["aa", "bb", "cc", "log_seq_length"]


def test_short_names(spark):
    want = {"bigram_filesystem_registry": "bi:filesystem>registry", "cat_network": "cat_network", "a" * 36: "a" * 33 + "..", "a" * 35: "a" * 35}
    rows = spark.createDataFrame([(n,) for n in want], "n string")
    assert {r["n"]: r["s"] for r in rows.select("n", short_feature_name(F.col("n")).alias("s")).collect()} == want


def plain_ngrams(seq, low, high):
    import re

    words = re.findall(r"\b\w{2,}\b", " ".join(t for t in seq or [] if t is not None).lower())
    return [" ".join(words[i:i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("n", [1, 7, 60, 100_000])
def test_top_ngrams_by_threshold_are_exact(spark, monkeypatch, n):
    """Few buckets, so that totals mix n-grams; many ties; null, empty and repeated rows; tokens of several words."""
    from collections import Counter

    from seqlab.operators import ngram_counts

    monkeypatch.setattr(ngram_counts, "BUCKETS", 512)
    rng = random.Random(4)
    tokens = [f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(4000)] + ["a-b cd", "É_x", "z", None, "Ab"] * 20
    rows = [(str(i), [rng.choice(tokens) for _ in range(rng.randint(0, 40))]) for i in range(120)] + [("n", None), ("e", []), ("r", ["aa", "bb"]), ("r", ["aa", "bb"])]
    samples = spark.createDataFrame(rows, "sample_id string, sequence array<string>").repartition(9)
    counts = Counter(g for _, seq in rows for g in plain_ngrams(seq, 1, 3))
    want = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0].encode()))[:n]
    got = [(r["ngram"], r["n"]) for r in ft.top_ngrams(samples, n).collect()]
    assert sorted(got, key=lambda kv: (-kv[1], kv[0].encode())) == want
    vocab = spark.createDataFrame([(g, i) for i, (g, _) in enumerate(sorted(want))], "ngram string, col_idx int")
    names = sorted(g for g, _ in want)
    if n <= 60:
        for r in ft.ngram_vectors(samples, vocab).collect():
            own = Counter(g for g in plain_ngrams(r["sequence"], 1, 3) if g in set(names))
            total = sum(own.values())
            assert {names[i]: round(v, 12) for i, v in zip(r["tf"].indices, r["tf"].values)} == {g: round(c / total, 12) for g, c in own.items()}
    assert ft.top_ngrams(samples.limit(0), n).count() == 0


@pytest.mark.parametrize("damp", [False, True])
def test_engineered_vectors_are_the_columns_values(spark, monkeypatch, rows, damp):
    """Rows a few at a time give the values of the Column form; a null token is a value of its own."""
    import pyarrow as pa

    from seqlab.operators import dictionaries, engineered_rows

    lists = [*rows, None, ["connect"] * 90, [None, "connect", "connect", "sleep"], ["b", None]]
    samples = spark.createDataFrame([(str(i), s) for i, s in enumerate(lists)], "sample_id string, sequence array<string>").coalesce(1)
    of = category_from(TABLE)
    want = values(samples, ft.engineered(F.col("sequence"), damp, of))
    got = {r["sample_id"]: r["features"].toArray().tolist() for r in ft.engineered_features(samples, damp, of).collect()}
    named = pa.array([[{"token": t, "slot": V.CATEGORIES.index(cat(t))} for t in dict.fromkeys(s or [])] for s in lists])
    monkeypatch.setattr(dictionaries, "PIECE_VALUES", 7)
    pieces = list(dictionaries.row_pieces(pa.array(lists)))
    assert len(pieces) > 20 and [a for a, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
    part = [x.tolist() for a, n in pieces for x in engineered_rows.row_values(pa.array(lists).slice(a, n), named.slice(a, n), 8, 5, damp)]
    for i, s in enumerate(lists):
        assert got[str(i)] == pytest.approx(want[str(i)], abs=1e-12)
        assert part[i] == pytest.approx(want[str(i)], abs=1e-12)
        assert want[str(i)][:9] == pytest.approx(py_stats(s, 5, damp), abs=1e-9)


def test_ngram_batches_are_worked_on_in_pieces(spark, monkeypatch):
    """Many rows in one batch: arrays follow the piece, and counts and shares stay the same."""
    import re

    import pyarrow as pa

    from seqlab.operators import dictionaries, ngram_counts

    monkeypatch.setattr(dictionaries, "PIECE_VALUES", 50)
    lists = pa.array([[f"w{i * j % 13}x" for j in range(9)] for i in range(100)])
    batch = pa.RecordBatch.from_arrays([lists], ["sequence"])
    seen = [len(key) for _, _, key, _, _ in ngram_counts._batches([batch], ngram_counts.word_pattern(2), 1, 2)]
    assert max(seen) <= 50 and sum(seen) == 100 * (9 + 8)
    assert re.fullmatch(ngram_counts.word_pattern(2), "w0x")


def test_dictionary_batches_are_cut_by_bytes(monkeypatch):
    import pyarrow as pa

    from seqlab.operators import dictionaries

    monkeypatch.setattr(dictionaries, "PIECE_BYTES", 400)
    batch = pa.RecordBatch.from_arrays([pa.array([["abc"] * (i % 30) for i in range(90)]), pa.array([1] * 40 + [2] * 50, pa.int32())], ["s", "p"])
    pieces = list(dictionaries.by_part(batch, "p"))
    assert pa.Table.from_batches([p for p, _ in pieces]).equals(pa.Table.from_batches([batch]))
    assert all(p.nbytes <= 400 or p.num_rows == 1 for p, _ in pieces) and len(pieces) > 10
