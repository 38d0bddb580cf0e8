"""Evaluation and ensemble queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlab.catalog.registry import EMBED, PRED_ORDERS, query, r6, sql_r6
from seqlab.functions.scoring import argmax, needs_review
from seqlab.operators import ensemble as ens
from seqlab.operators import metrics as m
from seqlab.sources import adapters as src

CLS5 = "cls AS (SELECT unnest(range(5)) AS class_idx)"
CLS10 = "cls AS (SELECT unnest(range(10)) AS class_idx)"


def _classes(spark, k):
    return m.class_table(spark, [f"c{i}" for i in range(k)])


def _pc_sql(source: str, by: str = "") -> str:
    """Per-class counts and scores of ``source(y_true, y_pred)``."""
    b, j = (f"{by}, ", f"{by}, ") if by else ("", "")
    frame = f"(SELECT DISTINCT {by} FROM {source}) CROSS JOIN cls" if by else "cls"
    return f"""sup AS (SELECT {b}y_true AS class_idx, count(*) AS support FROM {source} GROUP BY ALL),
prd AS (SELECT {b}y_pred AS class_idx, count(*) AS predicted FROM {source} GROUP BY ALL),
hit AS (SELECT {b}y_true AS class_idx, count(*) AS hits FROM {source} WHERE y_true = y_pred GROUP BY ALL),
pc0 AS (SELECT {j}class_idx, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(hits, 0) AS hits
  FROM {frame} LEFT JOIN sup USING ({j}class_idx) LEFT JOIN prd USING ({j}class_idx) LEFT JOIN hit USING ({j}class_idx)),
pc AS (SELECT *, 'c' || class_idx AS class_name, CASE WHEN predicted = 0 THEN 0.0 ELSE hits / predicted::double END AS precision,
  CASE WHEN support = 0 THEN 0.0 ELSE hits / support::double END AS recall,
  CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2.0 * hits / (support + predicted)::double END AS f1 FROM pc0)"""


def _averages(by: str = "") -> str:
    b = f"{by}, " if by else ""
    tail = f"GROUP BY {by}" if by else ""
    return f"""SELECT {b}{sql_r6('sum(hits) / sum(support)::double')} AS accuracy,
  {sql_r6('coalesce(avg(f1) FILTER (WHERE support + predicted > 0), 0.0)')} AS macro_f1, {sql_r6('avg(f1)')} AS macro_f1_all_classes,
  {sql_r6('sum(f1 * support) / sum(support)::double')} AS weighted_f1 FROM pc {tail}"""


def _round(df, *columns):
    for c in columns:
        df = df.withColumn(c, r6(c))
    return df


@query("G1_accuracy", f"WITH {PRED_ORDERS} SELECT dataset, {sql_r6('avg(cast(y_true = y_pred AS int))')} AS accuracy FROM po GROUP BY 1")
def g1(spark, d):
    return _round(m.accuracy(src.order_predictions(spark, d), ["dataset"]), "accuracy")


@query("G2_per_class", f"""WITH {PRED_ORDERS}, {CLS5}, {_pc_sql('po')}
SELECT class_idx, class_name, {sql_r6('precision')} AS precision, {sql_r6('recall')} AS recall, {sql_r6('f1')} AS f1, support, predicted, hits FROM pc""")
def g2(spark, d):
    return _round(m.per_class(src.order_predictions(spark, d), _classes(spark, 5)), "precision", "recall", "f1")


@query("G3_f1_averages", f"WITH {EMBED}, {CLS10.replace('10', '12')}, {_pc_sql('pe')} {_averages()}")
def g3(spark, d):
    out = m.f1_averages(m.per_class(src.embed_predictions(spark, d), _classes(spark, 12)))
    return _round(out, *out.columns)


@query("G14_model_comparison", f"""WITH {EMBED}, {CLS10}, two AS (SELECT 'first' AS model, y_true, y_pred FROM pe
  UNION ALL SELECT 'second', y_true, list_position(p_second, list_max(p_second)) - 1 FROM pe), {_pc_sql('two', 'model')} {_averages('model')}""")
def g14(spark, d):
    rows = src.embed_predictions(spark, d)
    both = rows.select(F.lit("first").alias("model"), "y_true", "y_pred").unionByName(
        rows.select(F.lit("second").alias("model"), "y_true", argmax(F.col("p_second")).alias("y_pred"))
    )
    return _round(m.summary(both, _classes(spark, 10), ["model"]), "accuracy", "macro_f1", "macro_f1_all_classes", "weighted_f1")


_CM = """cm AS (SELECT a.class_idx AS y_true, b.class_idx AS y_pred, count(p.y_true) AS n FROM cls a CROSS JOIN cls b
  LEFT JOIN {s} p ON p.y_true = a.class_idx AND p.y_pred = b.class_idx GROUP BY ALL)"""


@query("G4_confusion_matrix", f"WITH {EMBED}, {CLS10}, {_CM.format(s='pe')} SELECT y_true, y_pred, n FROM cm")
def g4(spark, d):
    return m.confusion_matrix(src.embed_predictions(spark, d), _classes(spark, 10)).select("y_true", "y_pred", "n")


@query("G5_confusion_row_shares", f"""WITH {PRED_ORDERS}, {CLS5.replace('5', '6')}, {_CM.format(s='po')}
SELECT y_true, y_pred, {sql_r6('coalesce(n / nullif(sum(n) OVER (PARTITION BY y_true), 0)::double, 0.0)')} AS row_share FROM cm""")
def g5(spark, d):
    out = m.confusion_matrix(src.order_predictions(spark, d), _classes(spark, 6))
    return out.select("y_true", "y_pred", r6("row_share").alias("row_share"))


_AUC = f"""WITH {EMBED}, x AS (SELECT unnest(range(10)) AS class_idx, unnest(probs) AS p, y_true FROM pe),
g AS (SELECT class_idx, p, count(*) FILTER (WHERE y_true = class_idx) AS pos, count(*) FILTER (WHERE y_true <> class_idx) AS neg FROM x GROUP BY ALL),
c AS (SELECT *, sum(neg) OVER (PARTITION BY class_idx ORDER BY p) - neg AS below FROM g),
auc AS (SELECT class_idx, sum(pos)::bigint AS support, sum(pos * (below + neg / 2.0)) / nullif(sum(pos)::double * sum(neg), 0) AS auc FROM c GROUP BY 1)"""


@query("G6_roc_auc", f"{_AUC} SELECT class_idx, support, {sql_r6('auc')} AS auc FROM auc")
def g6(spark, d):
    return _round(m.roc_auc(src.embed_predictions(spark, d), 10), "auc")


@query("G6_roc_auc_averages", f"""{_AUC} SELECT CASE WHEN count(auc) = count(*) THEN {sql_r6('avg(auc)')} END AS roc_auc_macro,
  CASE WHEN count(auc) = count(*) THEN {sql_r6('sum(auc * support) / sum(support)')} END AS roc_auc_weighted FROM auc""")
def g6a(spark, d):
    return _round(m.roc_auc_averages(m.roc_auc(src.embed_predictions(spark, d), 10)), "roc_auc_macro", "roc_auc_weighted")


# two models on two datasets, one of them with two thirds of the rows
_GROUPED = f"""WITH {EMBED}, {CLS10}, gp AS (SELECT 'first' AS model, CASE WHEN vec_id % 3 = 0 THEN 'b' ELSE 'a' END AS dataset, y_true, y_pred, probs FROM pe
  UNION ALL SELECT 'second', CASE WHEN vec_id % 3 = 0 THEN 'b' ELSE 'a' END, y_true, list_position(p_second, list_max(p_second)) - 1, p_second FROM pe),
x AS (SELECT dataset, model, unnest(range(10)) AS class_idx, unnest(probs) AS p, y_true FROM gp),
g AS (SELECT dataset, model, class_idx, p, count(*) FILTER (WHERE y_true = class_idx) AS pos, count(*) FILTER (WHERE y_true <> class_idx) AS neg FROM x GROUP BY ALL),
c AS (SELECT *, sum(neg) OVER (PARTITION BY dataset, model, class_idx ORDER BY p) - neg AS below FROM g),
auc AS (SELECT dataset, model, class_idx, sum(pos)::bigint AS support, sum(pos * (below + neg / 2.0)) / nullif(sum(pos)::double * sum(neg), 0) AS auc FROM c GROUP BY ALL)"""


def _grouped_predictions(spark, d):
    rows = src.embed_predictions(spark, d).withColumn("dataset", F.when(F.col("sample_id").cast("long") % 3 == 0, "b").otherwise("a"))
    first = rows.select("dataset", F.lit("first").alias("model"), "y_true", "y_pred", "probs")
    return first.unionByName(rows.select("dataset", F.lit("second").alias("model"), "y_true", argmax(F.col("p_second")).alias("y_pred"), F.col("p_second").alias("probs")))


@query("G6_roc_auc_by_model", f"{_GROUPED} SELECT dataset, model, class_idx, support, {sql_r6('auc')} AS auc FROM auc")
def g6_groups(spark, d):
    return _round(m.roc_auc(_grouped_predictions(spark, d), 10, ["dataset", "model"]), "auc")


@query("G14_model_comparison_auc", f"""{_GROUPED}, {_pc_sql('gp', 'dataset, model')}, sm AS ({_averages('dataset, model')}),
av AS (SELECT dataset, model, CASE WHEN count(auc) = count(*) THEN {sql_r6('avg(auc)')} END AS roc_auc_macro,
  CASE WHEN count(auc) = count(*) THEN {sql_r6('sum(auc * support) / sum(support)')} END AS roc_auc_weighted FROM auc GROUP BY ALL) SELECT * FROM sm JOIN av USING (dataset, model)""")
def g14_auc(spark, d):
    rows = m.comparison(_grouped_predictions(spark, d), _classes(spark, 10), ["dataset", "model"])
    return _round(rows, "accuracy", "macro_f1", "macro_f1_all_classes", "weighted_f1", "roc_auc_macro", "roc_auc_weighted")


@query("G14_model_confusion", f"{_GROUPED} SELECT dataset, model, y_true, y_pred, count(*) AS n FROM gp GROUP BY ALL")
def g14_confusion(spark, d):
    return m.confusion_counts(_grouped_predictions(spark, d), ["dataset", "model"])


@query("G7_roc_points", f"""WITH {EMBED}, x AS (SELECT unnest(range(10)) AS class_idx, unnest(probs) AS p, y_true FROM pe),
g AS (SELECT class_idx, p, count(*) FILTER (WHERE y_true = class_idx) AS pos, count(*) FILTER (WHERE y_true <> class_idx) AS neg FROM x GROUP BY ALL),
c AS (SELECT class_idx, p, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY class_idx) AS tpos, sum(neg) OVER (PARTITION BY class_idx) AS tneg
  FROM g WINDOW w AS (PARTITION BY class_idx ORDER BY p DESC))
SELECT class_idx, {sql_r6('p')} AS threshold, {sql_r6('coalesce(fp / nullif(tneg, 0)::double, 0.0)')} AS fpr, {sql_r6('coalesce(tp / nullif(tpos, 0)::double, 0.0)')} AS tpr FROM c""")
def g7(spark, d):
    return _round(m.roc_points(src.embed_predictions(spark, d), 10), "threshold", "fpr", "tpr")


def _family_predictions(spark, d):
    names = F.array(*[F.lit(f"c{i}") for i in range(5)])
    k = F.col("sample_id")
    secondary = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(
        F.array(F.get(names, (k % 5).cast("int")), F.get(names, ((k + 2) % 5).cast("int")))
    )
    rows = src.order_predictions(spark, d)
    return rows.withColumn("secondary_classes", F.when(k % 7 != 0, secondary)).withColumn(
        "family", F.when(k % 11 != 0, F.concat(F.lit("f"), (k % 4).cast("string")))
    )


_SECONDARY = f"""WITH {PRED_ORDERS}, s AS (SELECT coalesce(CASE WHEN sample_id % 11 <> 0 THEN 'f' || (sample_id % 4) END, '<unknown>') AS family,
  y_true <> y_pred AS wrong, sample_id % 3 <> 0 AND sample_id % 7 <> 0 AS defined, y_pred IN (sample_id % 5, (sample_id + 2) % 5) AS inside FROM po),
f AS (SELECT *, wrong AND defined AND inside AS hit FROM s)"""


@query("G8_secondary_hit_rate", f"""{_SECONDARY}, a AS (SELECT count(*) AS n_total, count(*) FILTER (WHERE NOT wrong) AS n_correct_primary,
  count(*) FILTER (WHERE wrong) AS n_wrong, count(*) FILTER (WHERE wrong AND defined) AS n_wrong_with_secondary_defined,
  count(*) FILTER (WHERE wrong AND NOT defined) AS n_wrong_no_secondary_defined, count(*) FILTER (WHERE hit) AS n_secondary_hit FROM f)
SELECT *, {sql_r6('n_secondary_hit / n_wrong::double')} AS secondary_hit_rate_over_wrong,
  {sql_r6('n_secondary_hit / n_wrong_with_secondary_defined::double')} AS secondary_hit_rate_over_eligible,
  {sql_r6('(n_correct_primary + n_secondary_hit) / n_total::double')} AS primary_or_secondary_hit_rate FROM a""")
def g8(spark, d):
    out = m.secondary_hit_rate(_family_predictions(spark, d), _classes(spark, 5))
    return _round(out, *[c for c in out.columns if c.endswith(("wrong", "eligible", "hit_rate")) and "rate" in c])


@query("G8_secondary_hits_by_family", f"""{_SECONDARY} SELECT family, count(*) AS n, count(*) FILTER (WHERE wrong) AS wrong,
  count(*) FILTER (WHERE defined) AS secondary_defined, count(*) FILTER (WHERE hit) AS secondary_hit, count(*) FILTER (WHERE NOT wrong) AS primary_hit FROM f GROUP BY 1""")
def g8f(spark, d):
    return m.secondary_hits_by_family(_family_predictions(spark, d), _classes(spark, 5))


_ERRORS = f"""WITH {PRED_ORDERS}, c AS (SELECT y_true, y_pred, count(*) AS n FROM po GROUP BY ALL),
e AS (SELECT *, sum(n) OVER (PARTITION BY y_true)::bigint AS total, coalesce(sum(n) FILTER (WHERE y_true = y_pred) OVER (PARTITION BY y_true), 0)::bigint AS correct FROM c),
r AS (SELECT 'c' || y_true AS true_class, total, correct, 'c' || y_pred AS pred_class, n,
  row_number() OVER (PARTITION BY y_true ORDER BY n DESC, y_pred) AS rank FROM e WHERE y_true <> y_pred)"""
# y_pred of class c0 set right: a class without errors keeps its row
_PERFECT = _ERRORS.replace("FROM po GROUP", "FROM (SELECT y_true, CASE WHEN y_true = 0 THEN 0 ELSE y_pred END AS y_pred FROM po) GROUP")


@query("G9_error_destinations", f"{_ERRORS} SELECT * FROM r")
def g9(spark, d):
    return m.error_destinations(src.order_predictions(spark, d), _classes(spark, 5))


@query("G9_class_without_errors", f"{_PERFECT} SELECT * FROM r UNION ALL SELECT DISTINCT 'c' || y_true, total, correct, NULL, NULL, NULL FROM e WHERE total = correct")
def g9_perfect(spark, d):
    preds = src.order_predictions(spark, d).withColumn("y_pred", F.when(F.col("y_true") == 0, 0).otherwise(F.col("y_pred")))
    return m.error_destinations(preds, _classes(spark, 5))


@query("K5_top_errors", f"{_ERRORS} SELECT * FROM r WHERE rank <= 3")
def k5(spark, d):
    return m.error_destinations(src.order_predictions(spark, d), _classes(spark, 5), 3)


_BY_STATUS = f"WITH {PRED_ORDERS}, {CLS5}, {_pc_sql('po', 'dataset')}, s AS ({_averages('dataset')})"


def _scores(spark, d):
    return m.summary(src.order_predictions(spark, d), _classes(spark, 5), ["dataset"])


@query("G10_generalisation_gap", f"""{_BY_STATUS.replace('round(', '(').replace(', 6) + 0.0', ')')}, h AS (SELECT macro_f1 FROM s WHERE dataset = 'O')
SELECT 'm' AS model, dataset, {sql_r6('h.macro_f1')} AS f1_in, {sql_r6('s.macro_f1')} AS f1_out, {sql_r6('h.macro_f1 - s.macro_f1')} AS gap,
  {sql_r6('100 * (h.macro_f1 - s.macro_f1) / h.macro_f1')} AS drop_pct FROM s CROSS JOIN h WHERE dataset <> 'O'""")
def g10(spark, d):
    gap = m.generalisation_gap(_scores(spark, d).withColumn("model", F.lit("m")), "O")
    return _round(gap, "f1_in", "f1_out", "gap", "drop_pct")


@query("G11_class_gap", f"""WITH {PRED_ORDERS}, {CLS5}, {_pc_sql('po', 'dataset')}
SELECT a.class_name, {sql_r6('a.f1')} AS f1_in, {sql_r6('b.f1')} AS f1_out, {sql_r6('b.f1 - a.f1')} AS delta
FROM pc a JOIN pc b USING (class_idx) WHERE a.dataset = 'O' AND b.dataset = 'F'""")
def g11(spark, d):
    rows = m.per_class(src.order_predictions(spark, d), _classes(spark, 5), ["dataset"])
    out = m.class_gap(rows.where("dataset = 'O'"), rows.where("dataset = 'F'"))
    return _round(out, "f1_in", "f1_out", "delta")


@query("G12_compare_variants", f"""WITH {PRED_ORDERS}, {CLS5}, v AS (SELECT dataset, y_true, cast((y_pred + sample_id) % 5 AS int) AS y_pred FROM po),
both_ AS (SELECT dataset || '|a' AS k, y_true, y_pred FROM v UNION ALL SELECT dataset || '|b', y_true, y_pred FROM po), {_pc_sql('both_', 'k')},
s AS (SELECT k, avg(f1) FILTER (WHERE support + predicted > 0) AS f FROM pc GROUP BY 1)
SELECT split_part(a.k, '|', 1) AS dataset, {sql_r6('a.f')} AS variant_f1, {sql_r6('b.f')} AS full_f1, {sql_r6('a.f - b.f')} AS delta,
  CASE WHEN a.f > b.f THEN 'BETTER' WHEN a.f < b.f THEN 'WORSE' ELSE 'SAME' END AS direction
FROM s a JOIN s b ON split_part(a.k, '|', 1) = split_part(b.k, '|', 1) WHERE a.k LIKE '%|a' AND b.k LIKE '%|b'""")
def g12(spark, d):
    rows = src.order_predictions(spark, d)
    other = rows.withColumn("y_pred", F.pmod(F.col("y_pred") + F.col("sample_id"), F.lit(5)).cast("int"))
    out = m.compare_variants(m.summary(other, _classes(spark, 5), ["dataset"]), _scores(spark, d))
    return _round(out, "variant_f1", "full_f1", "delta")


@query("G15_restricted_report", f"""WITH {PRED_ORDERS}, {CLS5}, x AS (SELECT * FROM po WHERE y_true IN (0, 2)), {_pc_sql('x')}
SELECT class_idx, class_name, {sql_r6('precision')} AS precision, {sql_r6('recall')} AS recall, {sql_r6('f1')} AS f1, support FROM pc WHERE class_idx IN (0, 2)""")
def g15(spark, d):
    rows = src.order_predictions(spark, d).where("y_true IN (0, 2)")
    out = m.restricted(rows, rows, _classes(spark, 5))
    return _round(out, "precision", "recall", "f1").select("class_idx", "class_name", "precision", "recall", "f1", "support")


@query("K6_best_configuration", f"{_BY_STATUS} SELECT arg_max(dataset, macro_f1) AS best, max(macro_f1) AS macro_f1 FROM s")
def k6(spark, d):
    return _scores(spark, d).agg(F.max_by("dataset", "macro_f1").alias("best"), r6(F.max("macro_f1")).alias("macro_f1"))


# ---- ensemble --------------------------------------------------------------------
@query("K4_argmax", f"WITH {EMBED} SELECT sample_id, list_position(p_second, list_max(p_second)) - 1 AS y FROM pe")
def k4(spark, d):
    return src.embed_predictions(spark, d).select("sample_id", argmax(F.col("p_second")).alias("y"))


_WEIGHTS = f"""{EMBED}, {CLS10}, two AS (SELECT 'a' AS model, y_true, y_pred FROM pe
  UNION ALL SELECT 'b', y_true, list_position(p_second, list_max(p_second)) - 1 FROM pe), {_pc_sql('two', 'model')},
wt AS (SELECT a.class_idx, a.class_name, CASE WHEN a.f1 + b.f1 > 0 THEN a.f1 / (a.f1 + b.f1) ELSE 0.5 END AS w_first,
  CASE WHEN a.f1 + b.f1 > 0 THEN b.f1 / (a.f1 + b.f1) ELSE 0.5 END AS w_second
  FROM pc a JOIN pc b USING (class_idx) WHERE a.model = 'a' AND b.model = 'b')"""


def _weights(spark, d):
    rows, classes = src.embed_predictions(spark, d), _classes(spark, 10)
    second = rows.withColumn("y_pred", argmax(F.col("p_second")))
    return ens.ensemble_weights(m.per_class(rows, classes), m.per_class(second, classes))


@query("M4_ensemble_weights", f"WITH {_WEIGHTS} SELECT class_idx, class_name, {sql_r6('w_first')} AS w_first, {sql_r6('w_second')} AS w_second FROM wt")
def m4(spark, d):
    return _round(_weights(spark, d), "w_first", "w_second")


def _blended_sql(t: float) -> str:
    return f"""{_WEIGHTS}, cells AS (SELECT sample_id, list_max(probs) AS top, unnest(range(10)) AS class_idx, unnest(probs) AS p, unnest(p_second) AS q FROM pe),
mix AS (SELECT sample_id, top, class_idx, p, p * w_first + q * w_second AS b FROM cells JOIN wt USING (class_idx)),
bl AS (SELECT sample_id, top, class_idx, CASE WHEN top >= {t} THEN p ELSE b / sum(b) OVER (PARTITION BY sample_id) END AS prob FROM mix)"""


def _blended(spark, d, t):
    rows = src.embed_predictions(spark, d).withColumnRenamed("probs", "p_first").drop("y_pred")
    return ens.blend(rows, *ens.weight_arrays(_weights(spark, d)), t)


@query("M5_confidence_gate", f"WITH {_blended_sql(0.15)} SELECT sample_id, class_idx, {sql_r6('prob')} AS prob, top < 0.15 AS blended FROM bl")
def m5(spark, d):
    out = _blended(spark, d, 0.15).select("sample_id", "blended", F.posexplode("probs").alias("class_idx", "prob"))
    return _round(out, "prob")


@query("M6_blended_prediction", f"""WITH {_blended_sql(0.15)} SELECT sample_id, arg_max(class_idx, (prob, -class_idx)) AS y_pred,
  {sql_r6('max(prob)')} AS confidence FROM bl GROUP BY 1""")
def m6(spark, d):
    return _blended(spark, d, 0.15).select("sample_id", "y_pred", r6(F.array_max("probs")).alias("confidence"))


_GATE_SQL = "SELECT {t} AS threshold, count(*) AS n, count(*) FILTER (WHERE list_max(probs) < {t}) AS n_blended, {r} AS blended_pct FROM pe"


def _gate_sql(t: float) -> str:
    return _GATE_SQL.format(t=t, r=sql_r6(f"100.0 * count(*) FILTER (WHERE list_max(probs) < {t}) / count(*)"))


@query("M7_gate_statistics", f"WITH {EMBED} {_gate_sql(0.15)}")
def m7(spark, d):
    out = ens.gate_statistics(_blended(spark, d, 0.15))
    return _round(out, "blended_pct").withColumn("threshold", F.lit(0.15))


@query("M8_gate_by_dataset", f"WITH {EMBED} {_gate_sql(0.12)} UNION ALL {_gate_sql(0.18)}")
def m8(spark, d):
    low, high = [
        _round(ens.gate_statistics(_blended(spark, d, t)), "blended_pct").withColumn("threshold", F.lit(t)) for t in (0.12, 0.18)
    ]
    return low.unionByName(high)


@query("M9_needs_review", f"""WITH {_blended_sql(0.15)}, mx AS (SELECT sample_id, max(prob) AS b FROM bl GROUP BY 1)
SELECT sample_id, list_max(probs) < 0.16 AND list_max(p_second) < 0.16 AND b < 0.16 AS review FROM pe JOIN mx USING (sample_id)""")
def m9(spark, d):
    flag = needs_review(F.col("p_first"), F.col("p_second"), F.col("probs"), threshold=0.16)
    return _blended(spark, d, 0.15).select("sample_id", flag.alias("review"))


@query("J10_join_back", f"""WITH {EMBED} SELECT vec_id, y_true, y_pred, source FROM pe JOIN documents ON doc_id = vec_id""")
def j10(spark, d):
    docs = src.table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "source")
    return src.embed_predictions(spark, d).select("vec_id", "y_true", "y_pred").join(docs, "vec_id")
