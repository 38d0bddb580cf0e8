import random
import time

import pytest
from pyspark.sql import functions as F

from seqlab.functions import cleaning
from seqlab.operators import markov
from seqlab.operators import vocabulary as v
from seqlab.streaming import evolving


@pytest.fixture(scope="module")
def setting(spark):
    rng = random.Random(11)
    seqs = {}
    for i in range(12):
        seq = []
        while len(seq) < rng.choice([1, 2, 9, 40]):
            seq += [rng.choice(["NtOpen", "NtClose", "send", "__probe", "recv", "odd%d" % i])] * rng.choice([1, 1, 2, 9])
        seqs[f"s{i}"] = seq
    seqs["long"] = [rng.choice(["send", "recv"]) for _ in range(3000)]
    samples = spark.createDataFrame(list(seqs.items()), "sample_id string, sequence array<string>")
    cleaned = samples.withColumn("sequence", cleaning.external(F.col("sequence")))
    vocab = v.build_vocabulary(cleaned.where("sample_id <> 's3'")).cache()
    encoded = v.encode_sequences(cleaned, vocab).withColumn("y", F.crc32(F.col("sample_id").cast("binary")) % 3)
    size = vocab.count()
    model = markov.train_transitions(encoded.where("sample_id not in ('s4', 's5')"), 3, size)
    batch = {r["sample_id"]: list(r["probs"]) for r in markov.score_padded(encoded, model, size).collect()}
    return seqs, v.row_encoder(vocab), model, size, batch


def _follow(spark, base, setting, **options):
    _, encode, model, size, _ = setting
    calls = spark.readStream.schema("sample_id string, pos long, token string").parquet(f"{base}/calls")
    evolving.store_steps(evolving.follow_calls(calls, encode, **options), f"{base}/steps", f"{base}/log-a").awaitTermination()
    evolving.score_steps(spark, f"{base}/steps", model, size, f"{base}/scores", f"{base}/log-b").awaitTermination()
    return {r["sample_id"]: r for r in evolving.latest_scores(spark, f"{base}/scores").collect()}


def test_scores_after_the_last_call_are_the_batch_scores(spark, setting, tmp_path):
    seqs, *_, batch = setting
    rows = [(s, i, t) for s, seq in seqs.items() for i, t in enumerate(seq)]
    early = [r for r in rows if r[1] < 7]
    # the second wave repeats some calls and has rows without an id, a position or a token
    late = [r for r in rows if r[1] >= 5] + [(None, 1, "x"), ("s1", None, "x"), ("s1", 99, None)]
    seen = []
    for wave in (early, late):
        random.Random(1).shuffle(wave)
        spark.createDataFrame(wave, "sample_id string, pos long, token string").repartition(3).write.mode("append").parquet(f"{tmp_path}/calls")
        seen.append(_follow(spark, tmp_path, setting))
    assert {s: r["calls"] for s, r in seen[0].items()} == {s: min(7, len(q)) for s, q in seqs.items()}
    assert {s: r["calls"] for s, r in seen[1].items()} == {s: len(q) for s, q in seqs.items()}
    for s, r in seen[1].items():
        assert list(r["probs"]) == pytest.approx(batch[s], abs=1e-9) and r["probs"][r["y_pred"]] == max(r["probs"])


def test_an_idle_sample_is_forgotten(spark, setting, tmp_path):
    _, encode, *_ = setting
    schema = "sample_id string, pos long, token string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/calls")
    put([("q", 0, "send"), ("q", 1, "recv")])
    calls = spark.readStream.schema(schema).parquet(f"{tmp_path}/calls")
    running = evolving.store_steps(evolving.follow_calls(calls, encode, idle_ms=1), f"{tmp_path}/steps", f"{tmp_path}/log", "1 second")
    try:
        def wait(n):
            end = time.time() + 60
            while time.time() < end:
                rows = spark.read.schema(evolving.STEP_COLUMNS).parquet(f"{tmp_path}/steps") if (tmp_path / "steps" / "_spark_metadata" / "0").exists() else None
                if rows is not None and rows.where("a = -1").agg(F.sum("n")).first()[0] == n:
                    return
                time.sleep(1)
            raise AssertionError("the calls did not come")

        wait(2)
        time.sleep(5)  # a trigger without calls clears q, so that its position 0 is new
        put([("q", 0, "send")])
        wait(3)
    finally:
        running.stop()


def test_an_unused_store_is_empty(spark, tmp_path):
    assert evolving.latest_scores(spark, f"{tmp_path}/nothing").count() == 0
