import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqlab.llm import mixture_packing, pii_surrogates, quality_network, simhash_tiles
from test_mixture_packing import check
from test_suffix_radix import brute as brute_repeats


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A small corpus with junk, copies, shared passages, personal data, nulls and empty texts."""
    r = random.Random(6)
    path = tmp_path_factory.mktemp("corpus")
    word = lambda: "".join(r.choice(["an", "the", "ti", "on", "re", "ou", "er"]) for _ in range(r.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(40)
    rows = []
    for i in range(160):
        t = text(r.randrange(30, 120))
        if i % 4 == 0:
            t = " ".join(w + r.choice(["%%%", "###", "$$$"]) for w in t.split())
        elif i % 5 == 0:
            t = f"{t} {passage} {text(20)} mail me.{i}@mail.example.com {text(12)} {passage}"
        elif i % 7 == 0:
            t = rows[i - 1][1] if i % 2 else f"{rows[i - 1][1]} {word()}"
        rows.append((i, t))
    rows += [(300, None), (301, ""), (302, rows[1][1])]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def rows_of(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_every_stage_against_a_plain_version(spark, sf, tmp_path):
    docs, done = spark.read.parquet(f"{sf}/documents.parquet"), {}
    before = rows_of(docs)
    for no, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{no}")
        if no < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        docs, previous = spark.read.parquet(f"{tmp_path}/{no}"), docs
        if name == "packing":
            check(docs.collect(), [(i, x["text"]) for i, x in before.items()], 4096)
            continue
        after = rows_of(docs)
        texts = [(i, x["text"]) for i, x in before.items()]
        if name == "quality classifier":
            scores = quality_network.scored(previous, spark.read.parquet(f"{sf}/labels.parquet"), quality_network.fold("doc_id") % 5 != 0)
            keep = {x["doc_id"] for x in scores.where("predicted = 1").collect()}
            assert after == {i: x for i, x in before.items() if i in keep}
            clean = {i for i in before if i < 160 and i % 4 and i % 7}
            assert len(clean - keep) <= 2 and len({*range(0, 160, 4)} & keep) <= 2
        elif name == "SimHash near-dedup":
            assert after == one_of_each(before)  # five words, similarity 0.8
            assert len(after) < len(before)
        elif name == "suffix-array dedup":
            want = {i: kept.decode("utf-8", "ignore") for i, _, _, _, kept in brute_repeats(texts, 50)}
            assert {i: x["text"] for i, x in after.items()} == want
            assert all(x["n_chars"] == len(x["text"]) and x["source"] == before[i]["source"] for i, x in after.items())
        elif name == "PII":
            assert all(re.sub(r"\S+@\S+", "@", x["text"]) == re.sub(r"\S+@\S+", "@", before[i]["text"]) for i, x in after.items())
            assert not any(".example.com" in x["text"] for x in after.values())
            assert after.keys() == before.keys() and sum("@m" in x["text"] for x in after.values()) > 5
        before = after
    assert corpus_pipeline.run(spark, sf).select(F.sum("length").alias("n")).first()["n"] == docs.select(F.sum("length").alias("n")).first()["n"]


def one_of_each(rows):
    """Rows that stay: the smallest id of each group of texts linked by a similarity of 0.8 of their five-word shingles."""
    sets = {i: simhash_tiles.shingle_set((x["text"] or "").encode().lower().split(), 5) for i, x in rows.items()}
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and group[a] != group[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    return {i: rows[i] for i, g in group.items() if g == i}


def test_near_duplicates_by_five_words_and_similarity(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = rows_of(docs)
    kept = one_of_each(before)
    assert rows_of(corpus_pipeline.near_duplicates(spark, docs, sf)) == kept
    assert 14 not in kept and 13 in kept  # one word more than its neighbour
