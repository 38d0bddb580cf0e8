import random

import pytest
from pyspark.sql import functions as F

from seqlab.functions.scoring import argmax, needs_review, softmax
from seqlab.operators import ensemble as ens
from seqlab.operators import metrics as m


@pytest.fixture(scope="module")
def preds(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        p = [round(rng.random(), 1) + 0.05 for _ in range(4)]
        p = [x / sum(p) for x in p]
        rows.append((str(i), rng.choice([0, 0, 0, 1, 2]), p.index(max(p)), p, rng.choice(["f", None]), rng.choice([["c1", "c3"], [], None])))
    df = spark.createDataFrame(rows, "sample_id string, y_true int, y_pred int, probs array<double>, family string, secondary_classes array<string>")
    return rows, df, m.class_table(spark, ["c0", "c1", "c2", "c3", "c4"])


def f1_of(rows, c):
    tp = sum(r[1] == c == r[2] for r in rows)
    n = sum(r[1] == c for r in rows) + sum(r[2] == c for r in rows)
    return 2 * tp / n if n else 0.0


def test_per_class_and_averages(preds):
    rows, df, classes = preds
    table = m.per_class(df, classes)
    got = {r["class_idx"]: r for r in table.collect()}
    assert len(got) == 5 and got[4]["support"] == 0 and got[4]["f1"] == 0.0
    for c in range(5):
        assert got[c]["f1"] == pytest.approx(f1_of(rows, c))
        assert got[c]["support"] == sum(r[1] == c for r in rows)
    avg = m.f1_averages(table).first()
    present = sorted({r[1] for r in rows} | {r[2] for r in rows})
    assert avg["macro_f1"] == pytest.approx(sum(f1_of(rows, c) for c in present) / len(present))
    assert avg["macro_f1_all_classes"] == pytest.approx(sum(f1_of(rows, c) for c in range(5)) / 5)
    assert avg["accuracy"] == pytest.approx(sum(r[1] == r[2] for r in rows) / 400)
    assert m.accuracy(df).first()["accuracy"] == pytest.approx(avg["accuracy"])


def test_confusion(preds):
    rows, df, classes = preds
    cells = m.confusion_matrix(df, classes).collect()
    assert len(cells) == 25 and sum(r["n"] for r in cells) == 400
    for t in range(3):
        assert sum(r["row_share"] for r in cells if r["y_true"] == t) == pytest.approx(1.0)
    assert all(r["row_share"] == 0 for r in cells if r["y_true"] == 4)


def test_auc_counts_pairs(preds):
    rows, df, _ = preds
    got = {r["class_idx"]: r["auc"] for r in m.roc_auc(df, 4).collect()}
    for c in range(3):
        pos, neg = [r[3][c] for r in rows if r[1] == c], [r[3][c] for r in rows if r[1] != c]
        wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
        assert got[c] == pytest.approx(wins / (len(pos) * len(neg)))
    assert got[3] is None
    both = m.roc_auc_averages(m.roc_auc(df, 4)).first()
    assert both["roc_auc_macro"] is None and both["roc_auc_weighted"] is None
    assert m.roc_auc_averages(m.roc_auc(df, 3)).first()["roc_auc_macro"] == pytest.approx(sum(got[c] for c in range(3)) / 3)


def test_roc_points_end_at_one(preds):
    _, df, _ = preds
    last = m.roc_points(df, 3).groupBy("class_idx").agg(F.max("fpr").alias("f"), F.max("tpr").alias("t")).collect()
    assert all((r["f"], r["t"]) == (1.0, 1.0) for r in last)


def test_secondary_hits(preds):
    rows, df, classes = preds
    wrong = [r for r in rows if r[1] != r[2]]
    hit = [r for r in wrong if r[5] and f"c{r[2]}" in r[5]]
    got = m.secondary_hit_rate(df, classes).first()
    assert (got["n_wrong"], got["n_secondary_hit"]) == (len(wrong), len(hit))
    assert got["primary_or_secondary_hit_rate"] == pytest.approx((400 - len(wrong) + len(hit)) / 400)
    fam = {r["family"]: r for r in m.secondary_hits_by_family(df, classes).collect()}
    assert set(fam) == {"f", "<unknown>"} and sum(r["n"] for r in fam.values()) == 400
    none = m.secondary_hit_rate(df.where("y_true = y_pred"), classes).first()
    assert none["secondary_hit_rate_over_wrong"] is None


def test_error_destinations(preds):
    rows, df, classes = preds
    got = m.error_destinations(df, classes, 1).collect()
    for r in got:
        t = int(r["true_class"][1:])
        counts = {c: sum(x[1] == t and x[2] == c for x in rows) for c in range(4) if c != t}
        assert r["n"] == max(counts.values()) and r["total"] == sum(x[1] == t for x in rows)
    assert {r["y_true"]: r["correct"] for r in m.class_totals(df).collect()} == {t: sum(x[1] == t == x[2] for x in rows) for t in range(3)}


def test_gaps(spark):
    scores = spark.createDataFrame([("a", "home", 0.8), ("a", "far", 0.2), ("b", "home", 0.0), ("b", "far", 0.1)], "model string, dataset string, macro_f1 double")
    got = {r["model"]: (r["gap"], r["drop_pct"]) for r in m.generalisation_gap(scores, "home").collect()}
    assert got["a"] == pytest.approx((0.6, 75.0)) and got["b"] == (-0.1, None)
    v = spark.createDataFrame([("x", 0.5), ("y", 0.5), ("z", 0.5), ("w", 0.5)], "dataset string, macro_f1 double")
    f = spark.createDataFrame([("x", 0.4), ("y", 0.6), ("z", 0.5)], "dataset string, macro_f1 double")
    assert {r["dataset"]: r["direction"] for r in m.compare_variants(v, f).collect()} == {"x": "BETTER", "y": "WORSE", "z": "SAME", "w": "N/A"}


def test_ensemble(spark):
    f1 = lambda xs: spark.createDataFrame([(i, f"c{i}", x) for i, x in enumerate(xs)], "class_idx int, class_name string, f1 double")
    weights = ens.ensemble_weights(f1([0.6, 0.0]), f1([0.2, 0.0]))
    assert {r["class_idx"]: (round(r["w_first"], 9), round(r["w_second"], 9)) for r in weights.collect()} == {0: (0.75, 0.25), 1: (0.5, 0.5)}
    rows = spark.createDataFrame(
        [("sure", [0.9, 0.1], [0.1, 0.9]), ("edge", [0.5, 0.5], [0.0, 1.0]), ("low", [0.4, 0.35], [0.1, 0.9])], "sample_id string, p_first array<double>, p_second array<double>"
    )
    out = {r["sample_id"]: r for r in ens.blend(rows, *ens.weight_arrays(weights), 0.5).collect()}
    assert list(out["sure"]["probs"]) == [0.9, 0.1] and out["sure"]["y_pred"] == 0 and not out["edge"]["blended"]
    mix = [0.4 * 0.75 + 0.1 * 0.25, 0.35 * 0.5 + 0.9 * 0.5]
    assert list(out["low"]["probs"]) == pytest.approx([x / sum(mix) for x in mix]) and out["low"]["blended"]
    stats = ens.gate_statistics(ens.blend(rows, *ens.weight_arrays(weights), 0.5)).first()
    assert (stats["n"], stats["n_blended"]) == (3, 1)


def test_scoring_expressions(one):
    arr = lambda xs: F.array(*[F.lit(x) for x in xs])
    assert one([], lambda _: argmax(arr([0.1, 0.5, 0.5]))) == 1
    assert one([], lambda _: softmax(arr([-1000.0, -1000.0]))) == [0.5, 0.5]
    assert one([], lambda _: needs_review(arr([0.39, 0.1]), arr([0.2]), arr([0.3])))
    assert not one([], lambda _: needs_review(arr([0.40, 0.1]), arr([0.2]), arr([0.3])))
