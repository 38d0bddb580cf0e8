import random

from pyspark.sql import functions as F

from seqlab.functions.encoding import decode_codes, encode_literal, one_hot, pad, windows
from seqlab.operators import dictionaries
from seqlab.operators import vocabulary as v
from seqlab.operators.windows import aggregate_windows, sliding_windows

VOCAB = {"<PAD>": 0, "<UNK>": 1, "ntclose": 2, "ntopen": 3}


def table(spark, vocab):
    return spark.createDataFrame(list(vocab.items()), "token string, idx int")


def loop_windows(seq, width, step):
    n = len(seq)
    if n <= width:
        return [seq + [0] * (width - n)]
    out, start = [], 0
    while start < n:
        part = seq[start:start + width]
        out.append(part + [0] * (width - len(part)))
        if start + width >= n:
            break
        start += step
    return out


def test_build_vocabulary(spark, seqs):
    rows = v.build_vocabulary(seqs([["b", "a"], ["c", "b"]])).collect()
    assert {r["token"]: r["idx"] for r in rows} == {"<PAD>": 0, "<UNK>": 1, "a": 2, "b": 3, "c": 4}


def test_frequency_vocabulary(seqs):
    rows = v.build_frequency_vocabulary(seqs([["z", "q", "q"], ["y", "z"]])).collect()
    assert {r["token"]: r["idx"] for r in rows} == {"<PAD>": 0, "<UNK>": 1, "z": 2, "q": 3, "y": 4}


def test_encode_all_ways(spark, seqs):
    rows = [["ntclose", "ntopen", "ntclose"], ["ntclose", "unknownapi"], [], ["<PAD>"]]
    samples = seqs(rows)
    expected = {"0": [2, 3, 2], "1": [2, 1], "2": [], "3": [0]}
    for out in (
        v.encode_sequences(samples, table(spark, VOCAB)),
        v.row_encoder(table(spark, VOCAB))(samples, "encoded"),
        v.row_encoder(table(spark, VOCAB), shard_bytes=30)(samples, "encoded"),
        samples.withColumn("encoded", encode_literal(F.col("sequence"), VOCAB)),
    ):
        assert {r["sample_id"]: list(r["encoded"]) for r in out.collect()} == expected


def test_dictionaries_come_back_to_their_rows(spark):
    """Null and empty sequences, equal ids, repeated rows and clashing column names, however the rows are dealt."""
    rows = [("x", ["a", "zz"]), ("x", ["b"]), ("y", None), ("z", []), (None, ["b", None]), ("x", ["b"]), ("n", [None])]
    samples = spark.createDataFrame([(*r, 1, 2, "k") for r in rows], "sample_id string, sequence array<string>, idx int, _part int, key string")
    vocab = table(spark, {"<PAD>": 0, "<UNK>": 1, "a": 2, "b": 3})
    spelled = spark.createDataFrame([("a", "b"), ("b", "b"), ("zz", "a")], "token string, resolved string")
    key = lambda r: (str(r[0]), str(r[1]))
    want = sorted([("x", [2, 1]), ("x", [3]), ("x", [3]), ("y", None), ("z", []), (None, [3, 1]), ("n", [1])], key=key)
    respelled = sorted([("x", ["b", "a"]), ("x", ["b"]), ("x", ["b"]), ("y", None), ("z", []), (None, ["b", None]), ("n", [None])], key=key)
    for n in (1, 3, 20):
        dealt = samples.repartition(n)
        got = v.encode_sequences(dealt, vocab)
        assert got.columns == [*samples.columns, "encoded"]
        assert sorted(((r["sample_id"], r["encoded"]) for r in got.collect()), key=key) == want
        got = v.rewrite_sequences(dealt, spelled).collect()
        assert sorted(((r["sample_id"], r["sequence"]) for r in got), key=key) == respelled
    none = samples.limit(0)
    assert v.encode_sequences(none, vocab).count() == 0 and v.normalise_sequences(none, vocab).count() == 0


def test_streamed_batches_read_the_shards_they_need(spark, tmp_path, seqs):
    names = [f"t{i}" for i in range(300)]
    encode = v.row_encoder(v.build_vocabulary(seqs([names])), shard_bytes=500)
    seqs([names[i:i + 40] + ["new"] for i in range(0, 300, 7)]).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sample_id string, sequence array<string>, label string").parquet(str(tmp_path / "in"))
    query = encode(stream, "encoded").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
    query.option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    order = {t: i + 2 for i, t in enumerate(sorted(names))}
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 43 and all(list(r["encoded"]) == [order.get(t, 1) for t in r["sequence"]] for r in rows)


def test_pad(one):
    fixed = lambda xs: F.array(*[F.lit(x) for x in xs])
    assert one([], lambda _: pad(fixed([1, 2, 3]), 5)) == [1, 2, 3, 0, 0]
    assert one([], lambda _: pad(fixed(range(1, 8)), 4)) == [1, 2, 3, 4]


def test_unknown_ratio(spark, seqs):
    vocab = table(spark, {"<PAD>": 0, "<UNK>": 1, "a": 2})
    for rows, want in (([["a"]], 0.0), ([["x"]], 1.0), ([["a", "x"]], 0.5), ([[]], 0.0)):
        assert v.unknown_ratio(seqs(rows), vocab).first()["unk_ratio"] == want


def test_windows_match_loop(spark):
    cases = [(n, w, s) for n in range(0, 30) for w in (1, 3, 4, 7) for s in (1, 2, 4, 9)]
    for w, s in {(w, s) for _, w, s in cases}:
        rows = spark.createDataFrame([(n, list(range(2, n + 2))) for n in range(0, 30)], "n int, e array<int>")
        got = {r["n"]: [list(x) for x in r["x"]] for r in rows.select("n", windows(F.col("e"), w, s).alias("x")).collect()}
        for n in range(0, 30):
            assert got[n] == loop_windows(list(range(2, n + 2)), w, s), (n, w, s)
    assert [len(loop_windows(list(range(n)), 4, 2)) for n in (0, 3, 4, 5, 9)] == [1, 1, 1, 2, 4]


def test_window_rows_and_aggregation(spark):
    rows = spark.createDataFrame([("a", [0.2, 0.8]), ("a", [0.6, 0.4]), ("b", [0.0, 0.0])], "sample_id string, probs array<double>")
    mean = {r["sample_id"]: r["probs"] for r in aggregate_windows(rows, 2).collect()}
    best = {r["sample_id"]: r["probs"] for r in aggregate_windows(rows, 2, "max").collect()}
    assert mean["a"] == [0.4, 0.6000000000000001]
    assert [round(x, 6) for x in best["a"]] == [round(0.6 / 1.4, 6), round(0.8 / 1.4, 6)] and best["b"] == [0.0, 0.0]
    enc = spark.createDataFrame([("a", [1, 2, 3, 4, 5])], "sample_id string, encoded array<int>")
    assert [list(r["window"]) for r in sliding_windows(enc, 4, 2).orderBy("window_no").collect()] == [[1, 2, 3, 4], [3, 4, 5, 0]]
    try:
        aggregate_windows(rows, 2, "median")
        raise AssertionError("must fail")
    except ValueError:
        pass


def test_decode_and_one_hot(one):
    codes = F.array(F.lit(0), F.lit(5), F.lit(2), F.lit(-1))
    assert one([], lambda _: decode_codes(codes, {0: "NtOpenThread", 2: "recv"})) == ["NtOpenThread", "5", "recv", "-1"]
    assert one([], lambda _: decode_codes(codes, None)) == ["0", "5", "2", "-1"]
    assert one([], lambda _: one_hot(F.lit(1), 3)) == [0, 1, 0]


def python_spelling(tok, vocab, aliases):
    tried = [tok, aliases.get(tok), tok[:-9] if tok.endswith("forcaller") else None, tok + "w", tok + "a"]
    for suffix in ("ex2", "ex"):
        if tok.endswith(suffix):
            stem = tok[: -len(suffix)]
            tried += [stem, stem + "w", stem + "a"]
    return next((t for t in tried if t is not None and t in vocab), tok)


def test_spellings(spark, seqs):
    from seqlab.fixed_values import CALL_ALIASES

    vocab = {"ntclose": 2, "process32nextw": 3, "ldrgetprocedureaddress": 4, "ntsetinformationprocess": 5, "getusernamea": 6, "ntdelayexecution": 7, "regopenkeyw": 8}
    tokens = ["closehandle", "process32next", "ldrgetprocedureaddressforcaller", "ntsetinformationprocessex", "getusername", "getusernameex",
              "sleepex", "sleep", "regopenkeyex2", "nothing", "ntclose", "readfile", "ex", "forcaller", "getusernameex2"]
    table_ = spark.createDataFrame(list(vocab.items()), "token string, idx int")
    got = {r["token"]: r["resolved"] for r in v.resolve_spellings(seqs([tokens]).select(F.explode("sequence").alias("token")), table_).collect()}
    assert got == {t: python_spelling(t, vocab, CALL_ALIASES) for t in tokens}
    out = v.normalise_sequences(seqs([tokens, [], ["sleep", "sleep"]]), table_)
    rows = {r["sample_id"]: list(r["sequence"]) for r in out.collect()}
    both = v.normalise_and_encode(seqs([tokens, [], ["sleep", "sleep"]]), table_).collect()
    assert {r["sample_id"]: list(r["sequence"]) for r in both} == rows
    assert all(list(r["encoded"]) == [vocab.get(t, 1) for t in r["sequence"]] for r in both)
    assert rows == {"0": [got[t] for t in tokens], "1": [], "2": ["ntdelayexecution"] * 2}


def test_random_encoding_paths_agree(spark, seqs):
    rng = random.Random(3)
    rows = [[f"t{rng.randint(0, 50)}" for _ in range(rng.randint(0, 30))] for _ in range(40)]
    vocab = v.build_vocabulary(seqs(rows[:20]))
    samples = seqs(rows)
    a = {r["sample_id"]: list(r["encoded"]) for r in v.encode_sequences(samples, vocab).collect()}
    b = {r["sample_id"]: list(r["encoded"]) for r in v.row_encoder(vocab)(samples, "encoded").collect()}
    assert a == b and all(len(a[str(i)]) == len(s) for i, s in enumerate(rows))


def test_batches_to_python_are_bounded_by_bytes(spark):
    """A partition of long rows reaches Python in several batches; a session's own limit stays."""
    import pyarrow as pa

    from seqlab import runtime

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    rows = spark.range(300, numPartitions=1).select(F.array_repeat(F.repeat(F.lit("a"), 100), 1000).alias("sequence"))
    samples = rows.withColumn("sample_id", F.lit("x"))
    spark.conf.unset(runtime.BATCH_SETTING)
    dictionaries.stage(samples)
    seen = [r["n"] for r in rows.mapInArrow(sizes, "n long").collect()]
    assert len(seen) > 3 and max(seen) < 6 << 20
    spark.conf.set(runtime.BATCH_SETTING, "9m")
    dictionaries.stage(samples)
    assert spark.conf.get(runtime.BATCH_SETTING) == "9m"
    spark.conf.unset(runtime.BATCH_SETTING)
