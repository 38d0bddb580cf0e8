"""Trained scorers, model suites, attribution and streaming."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqlab import fixed_values as V
from seqlab import runtime
from seqlab.catalog.metrics import _averages, _pc_sql
from seqlab.catalog.registry import DOCS, PAGES, joined, query, r6, sql_calls, sql_r6
from seqlab.operators import explain, features, forest_paths, markov, metrics, splits, trees
from seqlab.operators import vocabulary as v
from seqlab.plans import preparation, scoring
from seqlab.sources import adapters as src
from seqlab.streaming import evolving
from seqlab.streaming import scoring as stream

N_LANGS = 4
FOREST = {"n_estimators": 10, "max_depth": 5}


def _prepared(spark, d):
    docs = src.doc_samples(spark, d).select("sample_id", "sequence", "label")
    return preparation.prepare_primary(docs)


def _engineered(spark, d):
    docs = src.doc_samples(spark, d).select("sample_id", "sequence", "label")
    classes = runtime.pin(splits.class_dimension(docs))
    split = splits.stratified_split(splits.index_labels(docs, classes))
    rows = features.engineered_features(split, True, src.LETTERS).drop("sequence")
    return runtime.pin(rows), classes


def _models(spark, d):
    train, test, vocab = _prepared(spark, d)
    return scoring.train_models(train, test, vocab, category=src.LETTERS, **FOREST), test


# test rows of the stratified split, by class
_TEST_ROWS = f"{DOCS}, sz AS (SELECT label, round(count(*) * 0.2) AS n FROM docs GROUP BY 1)"


_FACTS = f"WITH {_TEST_ROWS} SELECT cast(sum(n) AS bigint) AS n, cast(sum(n) AS bigint) AS n_valid, true AS beats_majority FROM sz"


def _facts(scored, by=()):
    """Rows, rows whose probabilities are a distribution that names the predicted class, and whether accuracy beats the largest class."""
    largest = F.max(F.struct("k", "y")).over(Window.partitionBy(*by))["k"]
    sizes = scored.groupBy(*by, "y").agg(F.count("*").alias("k"), F.count_if(F.col("y") == F.col("y_pred")).alias("hits"), F.count_if(_valid()).alias("valid"))
    return sizes.withColumn("largest", largest).groupBy(*by).agg(
        F.sum("k").alias("n"), F.sum("valid").alias("n_valid"), (F.sum("hits") > F.max("largest")).alias("beats_majority")
    )


def _valid():
    total = F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)
    return (F.abs(total - 1) < 1e-6) & (F.array_min("probs") >= 0) & (F.get("probs", F.col("y_pred").cast("int")) == F.array_max("probs"))


@query("M1_forest_scores", _FACTS)
def m1(spark, d):
    rows, _ = _engineered(spark, d)
    model = trees.train_forest(rows.where("split = 'train'"), **FOREST)
    return _facts(trees.score(model, rows.where("split = 'test'")))


@query("M1_random_search", f"SELECT unnest(range({V.CV_DRAWS}))::int AS draw, true AS is_score")
def m1_search(spark, d):
    rows, _ = _engineered(spark, d)
    found = trees.search_forest(rows.where("split = 'train'"))
    return spark.createDataFrame(
        [(i, 0 < float(x) <= 1) for i, x in enumerate(found.avgMetrics)], "draw int, is_score boolean"
    )


@query("M1_boosted_scores", f"WITH {_TEST_ROWS} SELECT cast(sum(n) AS bigint) AS n, true AS beats_majority FROM sz")
def m1_boosted(spark, d):
    rows, _ = _engineered(spark, d)
    model = trees.train_boosted(rows.where("split = 'train'"), rounds=3, depth=3)
    scored = trees.score(model, rows.where("split = 'test'"))
    sizes = scored.groupBy("y").agg(F.count("*").alias("k"), F.count_if(F.col("y") == F.col("y_pred")).alias("hits"))
    return sizes.agg(F.sum("k").alias("n"), (F.sum("hits") > F.max("k")).alias("beats_majority"))


def _markov(width: int) -> str:
    """The transition model of ``width`` tokens on the pages, and its test rows up to the scores ``ex``."""
    return f"""{PAGES}, trn AS (SELECT *, page_id % 4 AS y FROM pg WHERE page_id % 3 <> 0), tst AS (SELECT * FROM pg WHERE page_id % 3 = 0),
vocab AS (SELECT token, row_number() OVER (ORDER BY token) + 1 AS idx FROM (SELECT DISTINCT unnest(seq) AS token FROM trn)),
sz AS (SELECT count(*) + 2 AS v FROM vocab),
tc AS (SELECT y, sample_id, pos, coalesce(idx, 1) AS idx FROM ({sql_calls('trn', 'y, sample_id')}) LEFT JOIN vocab USING (token) WHERE pos <= {width}),
tp AS (SELECT y, idx AS a, lead(idx) OVER (PARTITION BY sample_id ORDER BY pos) AS b FROM tc),
tn AS (SELECT a, b, y, count(*) AS n FROM tp WHERE b IS NOT NULL GROUP BY ALL),
ab AS (SELECT DISTINCT a, b FROM tn), aa AS (SELECT DISTINCT a FROM tn), cls AS (SELECT unnest(range(4)) AS y),
gain AS (SELECT ab.a, ab.b, cls.y, ln(coalesce(n, 0) + 1.0) AS g FROM ab CROSS JOIN cls LEFT JOIN tn ON tn.a = ab.a AND tn.b = ab.b AND tn.y = cls.y),
base AS (SELECT aa.a, cls.y, ln(1.0 / (coalesce(sum(n), 0) + v)) AS s FROM aa CROSS JOIN cls CROSS JOIN sz LEFT JOIN tn ON tn.a = aa.a AND tn.y = cls.y GROUP BY aa.a, cls.y, v),
xc AS (SELECT sample_id, pos, coalesce(idx, 1) AS idx FROM ({sql_calls('tst')}) LEFT JOIN vocab USING (token) WHERE pos <= {width}),
xp AS (SELECT sample_id, idx AS a, lead(idx) OVER (PARTITION BY sample_id ORDER BY pos) AS b FROM xc),
sc AS (SELECT sample_id, cls.y, sum(coalesce(s, -ln(v)) + coalesce(g, 0)) AS score FROM xp CROSS JOIN cls CROSS JOIN sz
  LEFT JOIN gain ON gain.a = xp.a AND gain.b = xp.b AND gain.y = cls.y LEFT JOIN base ON base.a = xp.a AND base.y = cls.y WHERE xp.b IS NOT NULL GROUP BY ALL),
al AS (SELECT t.sample_id, cls.y, coalesce(score, 0.0) AS score FROM tst t CROSS JOIN cls LEFT JOIN sc ON sc.sample_id = t.sample_id AND sc.y = cls.y),
ex AS (SELECT sample_id, y, exp(score - max(score) OVER (PARTITION BY sample_id)) AS e FROM al)"""


_MARKOV = _markov(1_000_000_000)  # whole pages
# windows of 40 tokens every 20 over the whole page, each scored alone, averaged by sample
_SLIDING = f"""{_MARKOV}, xa AS (SELECT sample_id, pos, idx AS a, lead(idx) OVER (PARTITION BY sample_id ORDER BY pos) AS b
  FROM (SELECT sample_id, pos, coalesce(idx, 1) AS idx FROM ({sql_calls('tst')}) LEFT JOIN vocab USING (token))),
wn AS (SELECT sample_id, page_id % 4 AS truth, unnest(range(CASE WHEN len(seq) <= 40 THEN 1 ELSE cast(ceil((len(seq) - 40) / 20.0) AS int) + 1 END)) AS w FROM tst),
ws AS (SELECT wn.sample_id, truth, w, cls.y, sum(CASE WHEN xa.b IS NULL THEN 0 ELSE coalesce(s, -ln(v)) + coalesce(g, 0) END) AS score
  FROM wn CROSS JOIN cls CROSS JOIN sz LEFT JOIN xa ON xa.sample_id = wn.sample_id AND pos > w * 20 AND pos < w * 20 + 40 AND xa.b IS NOT NULL
  LEFT JOIN gain ON gain.a = xa.a AND gain.b = xa.b AND gain.y = cls.y LEFT JOIN base ON base.a = xa.a AND base.y = cls.y GROUP BY ALL),
we AS (SELECT *, exp(score - max(score) OVER (PARTITION BY sample_id, w)) AS e FROM ws),
wp AS (SELECT sample_id, truth, y, e / sum(e) OVER (PARTITION BY sample_id, w) AS p FROM we),
wa AS (SELECT sample_id, truth, y, avg(p) AS p FROM wp GROUP BY ALL)"""


def _page_parts(spark, d):
    pages = src.page_samples(spark, d).withColumn("y", (F.col("page_id") % 4).cast("int"))
    train, test = pages.where("page_id % 3 <> 0"), pages.where("page_id % 3 = 0")
    vocab = runtime.pin(v.build_vocabulary(train))
    return v.encode_sequences(train, vocab), v.encode_sequences(test, vocab), vocab.count()


@query("M2_transition_scores", f"""WITH {_MARKOV} SELECT sample_id, y AS class_idx, {sql_r6('e / sum(e) OVER (PARTITION BY sample_id)')} AS prob FROM ex""")
def m2(spark, d):
    train, test, size = _page_parts(spark, d)
    model = markov.train_transitions(train, 4, size)
    scored = markov.score_padded(test, model, size)
    return scored.select("sample_id", F.posexplode("probs").alias("class_idx", "prob")).withColumn("prob", r6("prob"))


@query("M2_sliding_scores", f"""WITH {_SLIDING} SELECT sample_id, truth AS y, arg_max(y, (round(p, 12), -y)) AS y_pred, {sql_r6('max(p)')} AS confidence FROM wa GROUP BY ALL""")
def m2_sliding(spark, d):
    train, test, size = _page_parts(spark, d)
    model = markov.train_transitions(train, 4, size)
    return markov.score_sliding(test, model, size, stride=20, width=40).select("sample_id", "y", "y_pred", r6(F.array_max("probs")).alias("confidence"))


def _sweep_sql(widths: list[int]) -> str:
    """Predictions of every width, then the model comparison rows."""
    parts = [f"p{w} AS (WITH {_markov(w)} SELECT {w} AS max_len, cast(sample_id AS bigint) % 4 AS y_true, arg_max(y, (round(e, 12), -y)) AS y_pred FROM ex GROUP BY sample_id)" for w in widths]
    rows = " UNION ALL ".join(f"SELECT * FROM p{w}" for w in widths)
    return f"WITH {', '.join(parts)}, pp AS ({rows}), cls AS (SELECT unnest(range(4)) AS class_idx), {_pc_sql('pp', 'max_len')} {_averages('max_len')}"


@query("M3_length_sweep", _sweep_sql(V.SEQUENCE_LENGTHS))
def m3(spark, d):
    train, test, size = _page_parts(spark, d)
    sweep = markov.length_sweep(train, test, metrics.class_table(spark, ["c0", "c1", "c2", "c3"]), size, V.SEQUENCE_LENGTHS)
    for c in [x for x in sweep.columns if x != "max_len"]:
        sweep = sweep.withColumn(c, r6(c))
    return sweep


@query("S12_saved_models", f"WITH {_TEST_ROWS} SELECT cast(sum(n) AS bigint) AS n, 0::bigint AS n_differ FROM sz")
def s12(spark, d):
    models, test = _models(spark, d)
    path = runtime.scratch_path(spark, "models")
    models.save(path)
    again = scoring.ModelSet.load(spark, path, src.LETTERS)
    rows = splits.index_labels(test, again.classes)
    live, saved = [
        scoring.score_models(rows, m).select("sample_id", F.transform("p_first", r6).alias("a"), F.transform("p_second", r6).alias("b"))
        for m in (models, again)
    ]
    same = F.struct("l.a", "l.b").eqNullSafe(F.struct("s.a", "s.b"))
    both = live.alias("l").join(saved.alias("s"), "sample_id", "full")
    return both.agg(F.count("*").alias("n"), F.count_if(~same).alias("n_differ"))


@query("M10_score_texts", r"""SELECT count(*) AS n, count(*) AS n_valid, count(DISTINCT lang) AS n_classes
FROM documents WHERE len(regexp_extract_all(text, '[^\s,]+')) >= 3""")
def m10(spark, d):
    models, _ = _models(spark, d)
    texts = src.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), "text")
    scored = scoring.score_texts(texts, models)
    whole = F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)
    valid = (F.abs(whole - 1) < 1e-6) & (F.col("confidence") == F.array_max("probs")) & F.col("needs_review").isNotNull()
    return scored.agg(F.count("*").alias("n"), F.count_if(valid).alias("n_valid"), F.count_distinct("predicted").alias("n_classes"))


@query("M12_model_suite", f"""WITH {_TEST_ROWS}, m AS (SELECT unnest(['trees', 'order', 'ensemble']) AS model)
SELECT 'documents' AS dataset, model, cast(sum(n) AS bigint) AS n, cast(sum(n) AS bigint) AS n_valid, true AS beats_majority FROM sz, m GROUP BY model""")
def m12(spark, d):
    models, test = _models(spark, d)
    preds = scoring.model_suite(splits.index_labels(test, models.classes), models, "documents")
    return _facts(preds.withColumnRenamed("y_true", "y"), ["dataset", "model"])


@query("M12_suite_comparison")
def m12_comparison(spark, d):
    """Scores with AUC of every model of the suite; the trees have no SQL form."""
    models, test = _models(spark, d)
    preds = runtime.pin(scoring.model_suite(splits.index_labels(test, models.classes), models, "documents"))
    return metrics.comparison(preds, models.classes, ["dataset", "model"])


def _linear(spark, d):
    rows, _ = _engineered(spark, d)
    train = rows.where("split = 'train'")
    model = explain.train_linear(train, 20)
    names = features.STATISTIC_NAMES + features.CATEGORY_NAMES + features.TRANSITION_NAMES
    table = spark.createDataFrame(list(enumerate(names)), "col_idx int, name string")
    coeffs = explain.coefficients(model, explain.feature_means(train, len(names)), table)
    test = rows.where("split = 'test'")
    return test, runtime.pin(coeffs), model


@query("M11_row_attribution", f"WITH {_TEST_ROWS} SELECT unnest(range(1, 16))::int AS rank, (SELECT cast(sum(n) AS bigint) FROM sz) AS n, true AS falls")
def m11(spark, d):
    test, coeffs, model = _linear(spark, d)
    scored = trees.score(model, test)
    best = explain.row_top_contributions(scored, coeffs)
    before = F.lag(F.abs("value")).over(Window.partitionBy("sample_id").orderBy("rank"))
    falls = best.withColumn("ok", F.coalesce(before >= F.abs("value"), F.lit(True)))
    return falls.groupBy("rank").agg(F.count("*").alias("n"), F.every("ok").alias("falls"))


@query("M11_global_attribution", "SELECT unnest(range(4))::int AS class_idx, 81::bigint AS n, true AS valid")
def m11_global(spark, d):
    test, coeffs, _ = _linear(spark, d)
    return explain.global_contributions(test, coeffs).groupBy("class_idx").agg(
        F.count("*").alias("n"), F.every(F.col("mean_abs") >= 0).alias("valid")
    )


def _forest_rows(spark, d):
    """Test rows with the forest's probabilities, and what its columns add to them."""
    rows, _ = _engineered(spark, d)
    model = trees.train_forest(rows.where("split = 'train'"), **FOREST)
    return forest_paths.forest_contributions(trees.score(model, rows.where("split = 'test'")), model)


@query("M11_forest_contributions")
def m11_forest(spark, d):
    """The trees' own contributions to the predicted class; the forest has no SQL form."""
    names = F.array(*[F.lit(n) for n in features.STATISTIC_NAMES + features.CATEGORY_NAMES + features.TRANSITION_NAMES])
    reasons = forest_paths.top_reasons(F.col("contributions"), names, F.col("y_pred").cast("int"))
    return _forest_rows(spark, d).select("sample_id", "y_pred", F.inline(reasons))


@query("M11_forest_sums", f"WITH {_TEST_ROWS} SELECT cast(sum(n) AS bigint) AS n, 0::bigint AS n_differ FROM sz")
def m11_sums(spark, d):
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    total = F.aggregate("contributions", F.col("base"), lambda a, e: add(a, e["changes"]))
    gap = F.array_max(F.zip_with(total, "probs", lambda a, b: F.abs(a - b)))
    return _forest_rows(spark, d).agg(F.count("*").alias("n"), F.count_if(~F.coalesce(gap < 1e-9, F.lit(False))).alias("n_differ"))


@query("M10_text_reasons")
def m10_reasons(spark, d):
    """Predicted class of every text with the 15 columns that moved the trees most."""
    models, _ = _models(spark, d)
    texts = src.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), "text")
    return scoring.score_texts(texts, models, reasons=15).select("sample_id", "predicted", F.inline("reasons"))


# ---- streaming ---------------------------------------------------------------------
_PADDED = f"""WITH {PAGES}, vocab AS (SELECT token, row_number() OVER (ORDER BY token) + 1 AS idx FROM (SELECT DISTINCT unnest(seq) AS token FROM pg)),
c0 AS ({sql_calls('pg')}), c1 AS (SELECT *, {' AND '.join(f'coalesce(lag(token, {i}) OVER w = token, false)' for i in range(1, 6))} AS rep FROM c0
  WINDOW w AS (PARTITION BY sample_id ORDER BY pos)),
e AS (SELECT sample_id, list(idx ORDER BY pos) AS enc FROM c1 JOIN vocab USING (token) WHERE NOT rep GROUP BY 1)
SELECT sample_id, array_to_string((enc || [0 FOR x IN range(50)])[1:50], ' ') AS padded FROM e JOIN pg USING (sample_id) WHERE len(pg.seq) >= 3"""


def _page_texts(spark, d):
    return src.page_samples(spark, d).select("sample_id", F.array_join(F.transform("sequence", F.upper), ",\n").alias("text"))


@query("M10_prepared_texts", _PADDED)
def m10_batch(spark, d):
    vocab = v.row_encoder(v.build_vocabulary(src.page_samples(spark, d)))
    return stream.prepare_texts(_page_texts(spark, d), vocab, 50).select("sample_id", joined("padded").alias("padded"))


@query("M10_prepared_stream", _PADDED)
def m10_stream(spark, d):
    vocab = v.row_encoder(v.build_vocabulary(src.page_samples(spark, d)))
    path, out, state = [runtime.scratch_path(spark, n) for n in ("texts", "prepared", "state")]
    _page_texts(spark, d).repartition(4).write.parquet(path)
    rows = stream.prepare_texts(stream.stream_texts(spark, path, files_per_batch=2), vocab, 50)
    running = rows.writeStream.format("parquet").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(out).select("sample_id", joined("padded").alias("padded"))


@query("M10_scored_stream", r"SELECT count(*) AS n, 0::bigint AS n_differ FROM documents WHERE len(regexp_extract_all(text, '[^\s,]+')) >= 3")
def m10_scored(spark, d):
    models, _ = _models(spark, d)
    path, out, state = [runtime.scratch_path(spark, n) for n in ("texts", "scored", "state")]
    texts = src.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), "text")
    texts.repartition(2).write.parquet(path)
    stream.score_stream(stream.stream_texts(spark, path), models, out, state).awaitTermination()
    live = spark.read.parquet(out).select("sample_id", "predicted", "needs_review")
    batch = scoring.score_texts(texts, models).select("sample_id", "predicted", "needs_review")
    same = F.struct("s.predicted", "s.needs_review").eqNullSafe(F.struct("b.predicted", "b.needs_review"))
    both = live.alias("s").join(batch.alias("b"), "sample_id", "full")
    return both.agg(F.count("*").alias("n"), F.count_if(~same).alias("n_differ"))


@query("M10_evolving_scores", f"""WITH {_MARKOV} SELECT sample_id, len(seq) AS calls, y AS class_idx, {sql_r6('e / sum(e) OVER (PARTITION BY sample_id)')} AS prob
FROM ex JOIN pg USING (sample_id) WHERE len(seq) > 0""")
def m10_evolving(spark, d):
    """Calls of the test pages arrive in two waves; each is scored as it comes."""
    pages = src.page_samples(spark, d).withColumn("y", (F.col("page_id") % 4).cast("int"))
    train, test = pages.where("page_id % 3 <> 0"), pages.where("page_id % 3 = 0")
    vocab = runtime.pin(v.build_vocabulary(train))
    size = vocab.count()
    model = markov.train_transitions(v.encode_sequences(train, vocab), 4, size)
    base, encode = runtime.scratch_path(spark, "evolving"), v.row_encoder(vocab)
    calls = test.select("sample_id", F.posexplode("sequence").alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))
    for wave in (calls.where("pos < 12"), calls.where("pos >= 12")):
        wave.write.mode("append").parquet(f"{base}/calls")
        arriving = spark.readStream.schema("sample_id string, pos long, token string").parquet(f"{base}/calls")
        evolving.store_steps(evolving.follow_calls(arriving, encode, max_repeats=None), f"{base}/steps", f"{base}/log-steps").awaitTermination()
        evolving.score_steps(spark, f"{base}/steps", model, size, f"{base}/scores", f"{base}/log-scores").awaitTermination()
    last = evolving.latest_scores(spark, f"{base}/scores")
    return last.select("sample_id", "calls", F.posexplode("probs").alias("class_idx", "prob")).withColumn("prob", r6("prob"))
