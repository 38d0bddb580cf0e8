"""Columns of the user that are named as inner ones are left alone."""

from pyspark.sql import functions as F

from seqlab.llm import gated_lm, pii_surrogates, suffix_radix

TEXTS = ["write to ann.lee@mail.example.com today, " + "the same long passage of words again and again", "x " + "the same long passage of words again and again", None, ""]


def clashing(docs):
    return docs(TEXTS * 3).withColumn("extra", F.lit(7)).withColumn("_new", F.lit("n")).withColumn("_row", F.lit(1)).withColumn("block", F.lit(2.5))


def test_suffix_radix(docs):
    df = clashing(docs)
    plain = {r["doc_id"]: r["text"] for r in suffix_radix.without_repeats(docs(TEXTS * 3)).collect()}
    got = suffix_radix.without_repeats(df).collect()
    assert {r["doc_id"]: r["text"] for r in got} == plain and {(r["extra"], r["_new"], r["block"]) for r in got} == {(7, "n", 2.5)}
    assert suffix_radix.repeats(df).count() == 12


def test_surrogates(docs):
    got = pii_surrogates.replaced(clashing(docs), "key")
    assert got.columns == [*clashing(docs).columns, "n_replaced"]
    rows = got.collect()
    assert len(rows) == 12 and {(r["extra"], r["_new"], r["_row"]) for r in rows} == {(7, "n", 1)}
    assert sum(r["n_replaced"] for r in rows) == 3 and not any("ann.lee" in (r["text"] or "") for r in rows)


def test_language_model(docs):
    assert gated_lm.scored(clashing(docs)).count() == 12
