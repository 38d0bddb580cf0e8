"""Vocabularies, encoding, spellings, padding and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlab import fixed_values as V
from seqlab import runtime
from seqlab.catalog.registry import DOCS, EMBED, RAW, joined, query, r6, sql_calls, sql_joined, sql_r6
from seqlab.functions.encoding import pad
from seqlab.functions.scoring import argmax
from seqlab.operators import vocabulary as v
from seqlab.operators import windows as w
from seqlab.plans.preparation import prepare_external
from seqlab.sources import adapters as src

# train = even documents, external = odd documents
VOCAB = DOCS + """, trn AS (SELECT * FROM docs WHERE doc_id % 2 = 0), ext AS (SELECT * FROM docs WHERE doc_id % 2 = 1),
vocab AS (SELECT '<PAD>' AS token, 0 AS idx UNION ALL SELECT '<UNK>', 1 UNION ALL
  SELECT token, row_number() OVER (ORDER BY token) + 1 FROM (SELECT DISTINCT unnest(seq) AS token FROM trn))"""
ENCODED = VOCAB + f""", ecalls AS ({sql_calls('ext', 'sample_id, label')}),
enc AS (SELECT sample_id, label, pos, coalesce(idx, 1) AS idx FROM ecalls LEFT JOIN vocab USING (token)),
encoded AS (SELECT e.sample_id, e.label, coalesce(a.enc, []) AS enc FROM ext e LEFT JOIN (
  SELECT sample_id, list(idx ORDER BY pos) AS enc FROM enc GROUP BY 1) a USING (sample_id))"""


def _parts(spark, d):
    docs = src.doc_samples(spark, d)
    return docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")


def _encoded(spark, d):
    train, external = _parts(spark, d)
    vocab = runtime.pin(v.build_vocabulary(train))
    return v.encode_sequences(external, vocab)


def candidates_sql(tokens: str) -> str:
    """All candidate spellings of ``tokens(token)`` with their rank."""
    alias = ", ".join(f"('{a}', '{b}')" for a, b in V.CALL_ALIASES.items())
    return f"""alias(token, target) AS (VALUES {alias}),
cand AS (
  SELECT token, 0 AS r, token AS c FROM {tokens} UNION ALL
  SELECT token, 1, target FROM {tokens} JOIN alias USING (token) UNION ALL
  SELECT token, 2, left(token, length(token) - 9) FROM {tokens} WHERE token LIKE '%forcaller' UNION ALL
  SELECT token, 3, token || 'w' FROM {tokens} UNION ALL SELECT token, 4, token || 'a' FROM {tokens} UNION ALL
  SELECT token, 5 + k, left(token, length(token) - 3) || s FROM {tokens}, (VALUES (0, ''), (1, 'w'), (2, 'a')) x(k, s) WHERE token LIKE '%ex2' UNION ALL
  SELECT token, 8 + k, left(token, length(token) - 2) || s FROM {tokens}, (VALUES (0, ''), (1, 'w'), (2, 'a')) x(k, s) WHERE token LIKE '%ex'),
resolved AS (SELECT t.token, coalesce(b.c, t.token) AS resolved FROM {tokens} t LEFT JOIN (
  SELECT cand.token, arg_min(c, r) AS c FROM cand JOIN vocab ON vocab.token = c GROUP BY 1) b USING (token))"""


@query("E0_build_vocabulary", f"WITH {VOCAB} SELECT token, idx FROM vocab")
def e0(spark, d):
    return v.build_vocabulary(_parts(spark, d)[0])


@query("E0b_frequency_vocabulary", f"""WITH {DOCS}, calls AS ({sql_calls('docs', 'doc_id')})
SELECT '<PAD>' AS token, 0 AS idx UNION ALL SELECT '<UNK>', 1 UNION ALL
SELECT token, row_number() OVER (ORDER BY n DESC, d, p) + 1 FROM (
  SELECT token, count(*) AS n, min(doc_id) AS d, arg_min(pos, (doc_id, pos)) AS p FROM calls GROUP BY 1)""")
def e0b(spark, d):
    return v.build_frequency_vocabulary(src.doc_samples(spark, d), "doc_id")


@query("E1_encode", f"WITH {ENCODED} SELECT sample_id, {sql_joined('enc')} AS enc FROM encoded")
def e1(spark, d):
    return _encoded(spark, d).select("sample_id", joined("encoded").alias("enc"))


@query("E2_pad", f"""WITH {ENCODED} SELECT sample_id, array_to_string((enc || [0 FOR x IN range(300)])[1:300], ' ') AS padded FROM encoded""")
def e2(spark, d):
    return _encoded(spark, d).select("sample_id", joined(pad(F.col("encoded"), 300)).alias("padded"))


@query("E3_unknown_ratio", f"""WITH {VOCAB}, c AS ({sql_calls('ext')})
SELECT count(*) AS total, count(*) FILTER (WHERE idx IS NULL) AS unknown,
  {sql_r6('count(*) FILTER (WHERE idx IS NULL) / count(*)::double')} AS unk_ratio FROM c LEFT JOIN vocab USING (token)""")
def e3(spark, d):
    train, external = _parts(spark, d)
    out = v.unknown_ratio(external, runtime.pin(v.build_vocabulary(train)))
    return out.withColumn("unk_ratio", r6("unk_ratio"))


@query("E4_unknown_encoded", f"""WITH {ENCODED} SELECT label, count(idx) AS total, count(*) FILTER (WHERE idx = 1) AS unknown,
  {sql_r6('100.0 * count(*) FILTER (WHERE idx = 1) / count(idx)')} AS unknown_pct FROM enc GROUP BY 1""")
def e4(spark, d):
    from seqlab.functions.encoding import unknown_count

    sums = _encoded(spark, d).groupBy("label").agg(
        F.sum(F.size("encoded")).alias("total"), F.sum(unknown_count(F.col("encoded"))).alias("unknown")
    )
    return sums.where("total > 0").select("label", "total", "unknown", r6(F.lit(100.0) * F.col("unknown") / F.col("total")).alias("unknown_pct"))


@query("N1_resolve_spellings", f"""WITH {VOCAB}, toks AS (SELECT DISTINCT unnest(seq) AS token FROM ext), {candidates_sql('toks')}
SELECT token, resolved, coalesce(idx, 1) AS idx FROM resolved LEFT JOIN (SELECT token AS resolved, idx FROM vocab) USING (resolved)""")
def n1(spark, d):
    train, external = _parts(spark, d)
    return v.spelling_table(external, runtime.pin(v.build_vocabulary(train))).select("token", "resolved", "idx")


@query("N2_normalise_sequences", f"""WITH {VOCAB}, toks AS (SELECT DISTINCT unnest(seq) AS token FROM ext), {candidates_sql('toks')},
c AS ({sql_calls('ext')}), a AS (SELECT sample_id, string_agg(resolved, ' ' ORDER BY pos) AS seq FROM c JOIN resolved USING (token) GROUP BY 1)
SELECT e.sample_id, coalesce(a.seq, '') AS seq FROM ext e LEFT JOIN a USING (sample_id)""")
def n2(spark, d):
    train, external = _parts(spark, d)
    out = v.normalise_sequences(external, runtime.pin(v.build_vocabulary(train)))
    return out.select("sample_id", joined("sequence").alias("seq"))


@query("P14_prepare_external", f"""WITH {RAW}, trn AS (SELECT * FROM docs WHERE doc_id % 2 = 0), ext AS (SELECT * FROM raw WHERE doc_id % 2 = 1),
vocab AS (SELECT '<PAD>' AS token, 0 AS idx UNION ALL SELECT '<UNK>', 1 UNION ALL
  SELECT token, row_number() OVER (ORDER BY token) + 1 FROM (SELECT DISTINCT unnest(seq) AS token FROM trn)),
c0 AS ({sql_calls('ext')}),
c1 AS (SELECT sample_id, pos, token, {' AND '.join(f'coalesce(lag(token, {i}) OVER w = token, false)' for i in range(1, 6))} AS rep
  FROM c0 WHERE NOT starts_with(token, '__') WINDOW w AS (PARTITION BY sample_id ORDER BY pos)),
c AS (SELECT * FROM c1 WHERE NOT rep), toks AS (SELECT DISTINCT token FROM c), {candidates_sql('toks')},
a AS (SELECT sample_id, string_agg(resolved, ' ' ORDER BY pos) AS seq, string_agg(cast(coalesce(idx, 1) AS varchar), ' ' ORDER BY pos) AS enc
  FROM c JOIN resolved USING (token) LEFT JOIN (SELECT token AS resolved, idx FROM vocab) USING (resolved) GROUP BY 1)
SELECT e.sample_id, coalesce(a.seq, '') AS seq, coalesce(a.enc, '') AS enc FROM ext e LEFT JOIN a USING (sample_id)""")
def p14(spark, d):
    train = src.doc_samples(spark, d).where("doc_id % 2 = 0")
    external = src.raw_doc_samples(spark, d).where("doc_id % 2 = 1")
    out = prepare_external(external, runtime.pin(v.build_vocabulary(train)), normalise=True)
    return out.select("sample_id", joined("sequence").alias("seq"), joined("encoded").alias("enc"))


WINDOWS = f"""WITH {ENCODED}, starts AS (SELECT sample_id, enc, len(enc) AS n, unnest(CASE WHEN len(enc) <= 200 THEN [0]
  ELSE [i * 120 FOR i IN range(len(enc)) IF i * 120 < len(enc) AND (i = 0 OR (i - 1) * 120 + 200 < len(enc))] END) AS s FROM encoded),
win AS (SELECT sample_id, s // 120 AS window_no, (enc[s + 1:s + 200] || [0 FOR x IN range(200)])[1:200] AS w FROM starts)"""


def _windows(spark, d):
    return w.sliding_windows(_encoded(spark, d).select("sample_id", "encoded"), 200, 120)


@query("W1_sliding_windows", f"{WINDOWS} SELECT sample_id, window_no, array_to_string(w, ' ') AS win FROM win")
def w1(spark, d):
    return _windows(spark, d).select("sample_id", "window_no", joined("window").alias("win"))


def _aggregate_sql(how: str) -> str:
    pick = "avg" if how == "mean" else "max"
    norm = "p" if how == "mean" else "p / sum(p) OVER (PARTITION BY g)"
    return f"""WITH {EMBED}, c AS (SELECT vec_id // 4 AS g, unnest(range(10)) AS class_idx, unnest(probs) AS p FROM pe),
a AS (SELECT g, class_idx, {pick}(p) AS p FROM c GROUP BY ALL), n AS (SELECT g, class_idx, {norm} AS p FROM a),
s AS (SELECT g, arg_max(class_idx, (p, -class_idx)) AS y_pred FROM n GROUP BY 1)
SELECT cast(g AS varchar) AS sample_id, class_idx, {sql_r6('p')} AS prob, y_pred FROM n JOIN s USING (g)"""


def _aggregate(spark, d, how):
    rows = src.embed_predictions(spark, d).withColumn("sample_id", F.floor(F.col("vec_id") / 4).cast("string"))
    out = w.aggregate_windows(rows, 10, how).withColumn("y_pred", argmax(F.col("probs")))
    return out.select("sample_id", "y_pred", F.posexplode("probs").alias("class_idx", "prob")).withColumn("prob", r6("prob"))


@query("W2_aggregate_mean", _aggregate_sql("mean"))
def w2_mean(spark, d):
    return _aggregate(spark, d, "mean")


@query("W2_aggregate_max", _aggregate_sql("max"))
def w2_max(spark, d):
    return _aggregate(spark, d, "max")


@query("W3_score_windows", f"""{WINDOWS} SELECT sample_id, window_no, {sql_r6('len([x FOR x IN w IF x = 0]) / 200.0')} AS p0,
  {sql_r6('len([x FOR x IN w IF x = 1]) / 200.0')} AS p1, {sql_r6('len([x FOR x IN w IF x > 1]) / 200.0')} AS p2 FROM win""")
def w3(spark, d):
    def share_model():
        import numpy as np

        def predict(batch: np.ndarray) -> np.ndarray:
            padding, unknown = (batch == 0).mean(axis=1), (batch == 1).mean(axis=1)
            return np.stack([padding, unknown, 1.0 - padding - unknown], axis=1)

        return predict

    scored = w.score_windows(_windows(spark, d), share_model, 200)
    return scored.select("sample_id", "window_no", *[r6(F.get("probs", F.lit(i))).alias(f"p{i}") for i in range(3)])


@query("A8_vocabulary_size", f"WITH {DOCS} SELECT count(DISTINCT token) + 2 AS vocab_size FROM (SELECT unnest(seq) AS token FROM docs)")
def a8(spark, d):
    return v.vocabulary_size(src.doc_samples(spark, d))
