import random

import pytest
from pyspark.sql import functions as F

from seqlab import fixed_values as V
from seqlab.operators import distributions as dist
from seqlab.operators import splits


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(1)
    rows = [(f"s{i}", [str(rng.randint(0, 5)) for _ in range(rng.randint(0, 90))], rng.choices("abcd", [60, 25, 10, 5])[0]) for i in range(800)]
    return spark.createDataFrame(rows, "sample_id string, sequence array<string>, label string")


def as_map(df, column):
    return {r["sample_id"]: r[column] for r in df.collect()}


def test_split_is_exact_and_reproducible(spark, samples):
    first = as_map(splits.stratified_split(samples), "split")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    again = as_map(splits.stratified_split(samples.repartition(11)), "split")
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert first == again and len(first) == 800
    assert first != as_map(splits.stratified_split(samples, seed=7), "split")
    labels = as_map(samples, "label")
    for c in "abcd":
        n = sum(x == c for x in labels.values())
        test = sum(first[k] == "test" for k, x in labels.items() if x == c)
        assert test == int(n * 0.2 + 0.5)


def test_rows_without_a_label_are_a_class(spark):
    rows = spark.createDataFrame([(str(i), None if i < 10 else "a") for i in range(30)], "sample_id string, label string")
    folds = splits.stratified_folds(rows, 2).groupBy("label", "fold").count().collect()
    assert sorted((str(r["label"]), r["fold"], r["count"]) for r in folds) == [("None", 0, 5), ("None", 1, 5), ("a", 0, 10), ("a", 1, 10)]
    parts = splits.stratified_split(rows, 0.2).where("split = 'test'").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in parts} == {None: 2, "a": 4} and splits.add_class_weight(rows).count() == 30


@pytest.mark.parametrize("few", [10_000, 2])
def test_cuts_by_digits_are_those_of_a_ranking(spark, monkeypatch, few):
    """One class with most rows, tiny classes, null labels; digits refined until few rows are left; folds too."""
    import hashlib

    monkeypatch.setattr(splits, "CUT_ROWS", few)
    monkeypatch.setattr(splits, "DIGITS", 1)
    rows = [(f"s{i}", "big" if i % 10 else ("a", "b", None)[i // 10 % 3], i) for i in range(900)] + [("solo", "one", 0)]
    df = spark.createDataFrame(rows, "sample_id string, label string, _rank int")
    digest = lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest()
    test, fold = set(), {}
    for c in ("big", "a", "b", None, "one"):
        ids = sorted((i for i, y, _ in rows if y == c), key=lambda i: (digest(i), i))
        test |= set(ids[:int(len(ids) * 0.2 + 0.5)])
        fold |= {i: r % 3 for r, i in enumerate(ids)}
    got = splits.stratified_split(df)
    assert got.columns == [*df.columns, "split"]
    assert {r["sample_id"] for r in got.where("split = 'test'").collect()} == test and got.count() == len(rows)
    assert as_map(splits.stratified_folds(df.repartition(7)), "fold") == fold


def test_rows_without_an_id_are_kept(spark):
    df = spark.createDataFrame([(None if i % 3 == 0 else f"s{i}", "a", i) for i in range(60)], "sample_id string, label string, n int")
    for out in (splits.stratified_split(df), splits.stratified_folds(df, 3)):
        assert sorted(r["n"] for r in out.collect()) == list(range(60))
    assert splits.stratified_split(df.limit(0)).count() == 0 and splits.stratified_folds(df.limit(0)).count() == 0


def test_folds_are_even(samples):
    rows = splits.stratified_folds(samples, 3).groupBy("label", "fold").count().collect()
    for c in "abcd":
        sizes = [r["count"] for r in rows if r["label"] == c]
        assert len(sizes) == 3 and max(sizes) - min(sizes) <= 1


def test_augment(spark):
    calls = [f"c{i}" for i in range(100)]
    df = spark.createDataFrame([("a", calls[:50], list(range(50))), ("b", calls[:10], list(range(10)))], "sample_id string, sequence array<string>, encoded array<int>")
    assert splits.augment(df, 2, 20).count() == 4
    many = spark.createDataFrame([(str(i), calls, list(range(100))) for i in range(50)], "sample_id string, sequence array<string>, encoded array<int>")
    rows = splits.augment(many, 2, 20, 80).where("copy_no > 0").collect()
    assert len(rows) == 100 and len({len(r["sequence"]) for r in rows}) > 20
    for r in rows:
        assert 20 <= len(r["sequence"]) <= 80 and list(r["sequence"]) == calls[: len(r["sequence"])]
        assert list(r["encoded"]) == list(range(len(r["sequence"])))
    short = spark.createDataFrame([("a", [], []), ("b", calls[:5], list(range(5)))], "sample_id string, sequence array<string>, encoded array<int>")
    assert splits.augment(short, 2, 5).count() == 2
    old = {(r["sample_id"], r["copy_no"]): len(r["sequence"]) for r in splits.augment(many).collect()}
    assert old == {(r["sample_id"], r["copy_no"]): len(r["sequence"]) for r in splits.augment(many.repartition(9)).collect()}


def test_class_weights(spark):
    df = spark.createDataFrame([(y,) for y in [0] * 4 + [1] * 2 + [2]], "label int")
    w = {r["label"]: r["weight"] for r in splits.class_weights(df).collect()}
    assert w == {0: 7 / 12, 1: 7 / 6, 2: 7 / 3}
    even = spark.createDataFrame([(y,) for y in [0, 1, 2]], "label int")
    assert {r["weight"] for r in splits.class_weights(even).collect()} == {1.0}


def test_class_filters_and_index(samples):
    classes = splits.class_dimension(samples)
    assert [(r["class_idx"], r["class_name"]) for r in classes.orderBy("class_idx").collect()] == list(enumerate("abcd"))
    assert splits.known_classes_only(samples, classes.where("class_name < 'c'")).select("label").distinct().count() == 2
    assert splits.large_classes_only(samples, 100).select("label").distinct().count() == 2
    assert splits.index_labels(samples, classes).where("y = 0 and label <> 'a'").count() == 0
    with pytest.raises(Exception, match="unseen label"):
        splits.index_labels(samples, classes.where("class_name < 'c'")).collect()
    assert splits.labels_outside(samples, list("abcd")).count() == 0
    assert V.TROJAN not in as_map(splits.without_label(samples, "a"), "label").values()


def test_distributions(spark, samples):
    rows = samples.select(F.size("sequence").alias("n")).toPandas()["n"]
    got = dist.length_statistics(samples).first()
    assert got["n"] == 800 and got["mean"] == pytest.approx(rows.mean())
    for q, name in ((0.25, "p25"), (0.5, "median"), (0.9, "p90"), (0.99, "p99")):
        assert got[name] == pytest.approx(rows.quantile(q))
    import numpy as np

    want = np.histogram(rows, bins=50)[0].tolist()
    assert [r["n"] for r in dist.length_histogram(samples).orderBy("bin").collect()] == want
    top = dist.label_distribution(samples).orderBy("rank").collect()
    assert [r["n"] for r in top] == sorted((r["n"] for r in top), reverse=True)
    flat = spark.createDataFrame([(["a"],)] * 3, "sequence array<string>")
    assert sum(r["n"] for r in dist.length_histogram(flat).collect()) == 3
    pct = dist.exact_percentiles(samples.select(F.size("sequence").alias("n")), "n", [0.25, 0.75]).first()
    assert (pct["p25"], pct["p75"]) == (rows.quantile(0.25), rows.quantile(0.75))
