"""Evaluation of predictions: (sample_id, y_true, y_pred[, probs]).

Predictions are reduced to per-class counts first; everything after that works
on class-sized tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlab import runtime
from seqlab.functions.arrays import ratio
from seqlab.operators.skew import prefix_sums, quantile_bucket


def class_table(spark, names: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), "class_idx int, class_name string")


def confusion_counts(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Non-zero confusion cells (by.., y_true, y_pred, n)."""
    return preds.groupBy(*(by or []), "y_true", "y_pred").agg(F.count("*").alias("n"))


def confusion_matrix(preds: DataFrame, classes: DataFrame) -> DataFrame:
    """The full k x k matrix, with zeros and row shares."""
    k = classes.agg(F.array_sort(F.collect_list("class_idx")).alias("c"))  # class dimension
    grid = k.select(F.explode("c").alias("y_true"), "c").select("y_true", F.explode("c").alias("y_pred"))
    full = grid.join(confusion_counts(preds), ["y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = ratio(F.col("n"), F.sum("n").over(Window.partitionBy("y_true")))
    return full.select("y_true", "y_pred", F.col("n").cast("long").alias("n"), share.alias("row_share"))


def accuracy(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    hit = F.avg((F.col("y_true") == F.col("y_pred")).cast("int"))
    return preds.groupBy(*(by or [])).agg(hit.alias("accuracy"))


def per_class(preds: DataFrame, classes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1, support and predicted count for every class."""
    by = by or []
    cells = confusion_counts(preds, by)
    # each cell adds to its true class and to its predicted class
    sides = cells.select(
        *by,
        F.inline(
            F.array(
                F.struct(F.col("y_true").alias("class_idx"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
                F.struct(F.col("y_pred").alias("class_idx"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
            )
        ),
        F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("_hit"),
    )
    counts = sides.groupBy(*by, "class_idx").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
        (F.sum("_hit") / 2).cast("long").alias("hits"),
    )
    if by:
        groups = cells.select(*by).distinct()
        names = classes.select(F.collect_list(F.struct("class_idx", "class_name")).alias("_all")).first()["_all"]
        every = F.array(
            *[F.struct(F.lit(r["class_idx"]).alias("class_idx"), F.lit(r["class_name"]).alias("class_name")) for r in names]
        )
        frame = groups.select(*by, F.inline(every))
    else:
        frame = classes
    full = frame.join(counts, [*by, "class_idx"], "left").fillna(0, ["support", "predicted", "hits"])
    precision, recall = ratio(F.col("hits"), F.col("predicted")), ratio(F.col("hits"), F.col("support"))
    f1 = ratio(2 * F.col("hits"), F.col("support") + F.col("predicted"))
    return full.select(
        *by, "class_idx", "class_name", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
        "support", "predicted", "hits",
    )


def f1_averages(per_class_rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, macro F1 over the classes that occur (true or predicted), the
    plain average over all classes, and the support-weighted F1."""
    present = (F.col("support") + F.col("predicted")) > 0
    return per_class_rows.groupBy(*(by or [])).agg(
        ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.coalesce(F.avg(F.when(present, F.col("f1"))), F.lit(0.0)).alias("macro_f1"),
        F.avg("f1").alias("macro_f1_all_classes"),
        ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )


def summary(preds: DataFrame, classes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """accuracy, macro_f1, weighted_f1 per group: the model comparison rows."""
    return f1_averages(per_class(preds, classes, by), by)


def restricted(preds: DataFrame, present: DataFrame, classes: DataFrame) -> DataFrame:
    """Per-class report over the classes that occur in ``present`` labels."""
    return per_class(preds, classes).join(
        runtime.small_table(present.select(F.col("y_true").alias("class_idx")).distinct()), "class_idx", "left_semi"
    )


# ---- ROC -------------------------------------------------------------------
def _score_counts(preds: DataFrame, n_classes: int, by: list[str]) -> DataFrame:
    """(by.., class_idx, score, pos, neg): equal scores of a class counted together."""
    scores = F.array(
        *[
            F.struct(
                F.lit(c).alias("class_idx"), F.get("probs", F.lit(c)).alias("score"),
                (F.col("y_true") == c).cast("long").alias("hit"),
            )
            for c in range(n_classes)
        ]
    )
    return preds.select(*by, F.inline(scores)).groupBy(*by, "class_idx", "score").agg(
        F.sum("hit").alias("pos"), F.sum(1 - F.col("hit")).alias("neg")
    )


def _cumulated(preds: DataFrame, n_classes: int, descending: bool, by: list[str]) -> DataFrame:
    counts = _score_counts(preds, n_classes, by)
    order = -F.col("score") if descending else F.col("score")
    flat = preds.select(F.explode("probs").alias("score"))
    bucket = quantile_bucket(flat, order)
    return prefix_sums(counts, [*by, "class_idx"], [order], bucket, {"pos_before": F.col("pos"), "neg_before": F.col("neg")})


def roc_auc(preds: DataFrame, n_classes: int, by: list[str] | None = None) -> DataFrame:
    """(by.., class_idx, support, auc) one-vs-rest per group; null without both outcomes.

    Counts of pairs ranked right, ties one half. Scores are cumulated in
    bounded score ranges, never in one window per class. A range holds a fixed
    share of the scores of all groups together, so of a hot group no more.
    Groups must not be null.
    """
    keys = [*(by or []), "class_idx"]
    ranked = _cumulated(preds, n_classes, False, by or [])
    sums = ranked.groupBy(*keys).agg(
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)).alias("_wins"),
        F.sum("pos").alias("support"), F.sum("neg").alias("_neg"),
    )
    return sums.select(
        *keys, "support", F.try_divide("_wins", F.col("support").cast("double") * F.col("_neg")).alias("auc")
    )


def roc_auc_averages(auc: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Macro and support-weighted AUC per group; null when any class has none."""
    complete = F.count("auc") == F.count("*")
    weighted = F.try_divide(F.sum(F.col("auc") * F.col("support")), F.sum("support").cast("double"))
    return auc.groupBy(*(by or [])).agg(
        F.when(complete, F.avg("auc")).alias("roc_auc_macro"), F.when(complete, weighted).alias("roc_auc_weighted")
    )


def comparison(preds: DataFrame, classes: DataFrame, by: list[str]) -> DataFrame:
    """``summary`` with the AUC averages: one row per group, such as (dataset, model)."""
    auc = roc_auc_averages(roc_auc(preds, classes.count(), by), by)
    return summary(preds, classes, by).join(runtime.small_table(auc), by, "left")


def roc_points(preds: DataFrame, n_classes: int) -> DataFrame:
    """(class_idx, threshold, fpr, tpr) at every distinct score."""
    ranked = _cumulated(preds, n_classes, True, [])
    totals = runtime.small_table(ranked.groupBy("class_idx").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n")))
    return ranked.join(totals, "class_idx").select(
        "class_idx", F.col("score").alias("threshold"),
        ratio(F.col("neg_before") + F.col("neg"), F.col("_n")).alias("fpr"),
        ratio(F.col("pos_before") + F.col("pos"), F.col("_p")).alias("tpr"),
    )


# ---- error analysis ----------------------------------------------------------
def _secondary_flags(preds: DataFrame, classes: DataFrame) -> DataFrame:
    names = classes.select(F.col("class_idx").alias("y_pred"), F.col("class_name").alias("_name"))
    secondary = F.coalesce("secondary_classes", F.array().cast("array<string>"))
    wrong = F.col("y_true") != F.col("y_pred")
    return preds.join(runtime.small_table(names), "y_pred", "left").select(
        F.coalesce("family", F.lit("<unknown>")).alias("family"),
        wrong.alias("wrong"), (F.size(secondary) > 0).alias("defined"),
        (wrong & F.coalesce(F.array_contains(secondary, F.col("_name")), F.lit(False))).alias("hit"),
    )


def secondary_hit_rate(preds: DataFrame, classes: DataFrame) -> DataFrame:
    """How often a wrong prediction is one of the sample's secondary classes."""
    counted = _secondary_flags(preds, classes).agg(
        F.count("*").alias("n_total"), F.count_if(~F.col("wrong")).alias("n_correct_primary"),
        F.count_if("wrong").alias("n_wrong"),
        F.count_if(F.col("wrong") & F.col("defined")).alias("n_wrong_with_secondary_defined"),
        F.count_if(F.col("wrong") & ~F.col("defined")).alias("n_wrong_no_secondary_defined"),
        F.count_if("hit").alias("n_secondary_hit"),
    )
    hits = F.col("n_secondary_hit")
    return counted.select(
        "*",
        F.try_divide(hits, "n_wrong").alias("secondary_hit_rate_over_wrong"),
        F.try_divide(hits, "n_wrong_with_secondary_defined").alias("secondary_hit_rate_over_eligible"),
        F.try_divide(F.col("n_correct_primary") + hits, "n_total").alias("primary_or_secondary_hit_rate"),
    )


def secondary_hits_by_family(preds: DataFrame, classes: DataFrame) -> DataFrame:
    return _secondary_flags(preds, classes).groupBy("family").agg(
        F.count("*").alias("n"), F.count_if("wrong").alias("wrong"), F.count_if("defined").alias("secondary_defined"),
        F.count_if("hit").alias("secondary_hit"), F.count_if(~F.col("wrong")).alias("primary_hit"),
    )


def error_destinations(preds: DataFrame, classes: DataFrame, top: int | None = None) -> DataFrame:
    """Per true class: total, correct and where its errors go, ranked.

    A class without errors has one row with neither a destination nor a rank.
    """
    errors = confusion_counts(preds).where("y_true <> y_pred").select("y_true", "y_pred", "n")
    rows = class_totals(preds).join(errors, "y_true", "left")
    t = classes.select(F.col("class_idx").alias("y_true"), F.col("class_name").alias("true_class"))
    p = classes.select(F.col("class_idx").alias("y_pred"), F.col("class_name").alias("pred_class"))
    named = rows.join(t, "y_true").join(p, "y_pred", "left")
    rank = F.when(F.col("n").isNotNull(), F.row_number().over(Window.partitionBy("true_class").orderBy(F.desc("n"), "pred_class")))
    ranked = named.select("true_class", "total", "correct", "pred_class", "n", rank.alias("rank"))
    return ranked if top is None else ranked.where(F.col("rank").isNull() | (F.col("rank") <= top))


def class_totals(preds: DataFrame) -> DataFrame:
    """(y_true, total, correct) for classes with support."""
    return preds.groupBy("y_true").agg(
        F.count("*").alias("total"), F.count_if(F.col("y_true") == F.col("y_pred")).alias("correct")
    )


# ---- comparisons -------------------------------------------------------------
def generalisation_gap(scores: DataFrame, inside: str, column: str = "macro_f1") -> DataFrame:
    """(model, dataset, f1_in, f1_out, gap, drop_pct) against the home dataset."""
    home = scores.where(F.col("dataset") == inside).select("model", F.col(column).alias("f1_in"))
    away = scores.where(F.col("dataset") != inside).select("model", "dataset", F.col(column).alias("f1_out"))
    gap = F.col("f1_in") - F.col("f1_out")
    return away.join(home, "model").select(
        "model", "dataset", "f1_in", "f1_out", gap.alias("gap"),
        F.when(F.col("f1_in") > 0, F.lit(100) * gap / F.col("f1_in")).alias("drop_pct"),
    )


def class_gap(inside: DataFrame, outside: DataFrame) -> DataFrame:
    """Per class: outside F1 minus inside F1."""
    a = inside.select("class_name", F.col("f1").alias("f1_in"))
    b = outside.select("class_name", F.col("f1").alias("f1_out"))
    return a.join(b, "class_name", "left").select(
        "class_name", "f1_in", F.coalesce("f1_out", F.lit(0.0)).alias("f1_out"),
        (F.coalesce("f1_out", F.lit(0.0)) - F.col("f1_in")).alias("delta"),
    )


def compare_variants(variant: DataFrame, full: DataFrame, column: str = "macro_f1") -> DataFrame:
    """(dataset, variant_f1, full_f1, delta, direction)."""
    a = variant.select("dataset", F.col(column).alias("variant_f1"))
    b = full.select("dataset", F.col(column).alias("full_f1"))
    delta: Column = F.col("variant_f1") - F.col("full_f1")
    way = F.when(delta > 0, "BETTER").when(delta < 0, "WORSE").when(delta == 0, "SAME").otherwise("N/A")
    return a.join(b, "dataset", "left").select("dataset", "variant_f1", "full_f1", delta.alias("delta"), way.alias("direction"))
