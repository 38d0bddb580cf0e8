import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from seqlab import fixed_values as V
from seqlab.functions.labels import category_from
from seqlab.operators.windows import aggregate_windows, sliding_windows
from seqlab.operators import dictionaries, explain, features, markov, metrics, splits, trees
from seqlab.operators import vocabulary as v
from seqlab.plans import preparation, scoring
from seqlab.streaming import scoring as stream

CATEGORY = category_from({
    "ntcreatefile": "filesystem", "ntreadfile": "filesystem", "connect": "network", "send": "network", "recv": "network",
    "regopenkeyexa": "registry", "regsetvalueexa": "registry",
})
KINDS = {"Adware": ["ntcreatefile", "ntreadfile"], "Spyware": ["connect", "send", "recv"], "Worms": ["regopenkeyexa", "regsetvalueexa"]}


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(4)
    rows = []
    for i in range(240):
        kind = rng.choice(list(KINDS))
        seq = [rng.choice(KINDS[kind] * 3 + ["ntclose", "sleep"]) for _ in range(rng.randint(3, 60))]
        rows.append((f"s{i}", seq, kind))
    return spark.createDataFrame(rows, "sample_id string, sequence array<string>, label string")


@pytest.fixture(scope="module")
def prepared(samples):
    return preparation.prepare_primary(samples)


@pytest.fixture(scope="module")
def models(prepared):
    train, test, vocab = prepared
    return scoring.train_models(train, test, vocab, width=50, max_features=40, category=CATEGORY, n_estimators=8, max_depth=4)


def test_prepared_parts(samples, prepared):
    train, test, vocab = prepared
    assert train.count() + test.count() == samples.count()
    assert train.join(test, "sample_id").count() == 0
    known = {r["token"] for r in vocab.collect()}
    assert {V.PAD_TOKEN, V.UNK_TOKEN} <= known
    assert train.where("size(sequence) <> size(encoded)").count() == 0
    assert train.where(F.exists("encoded", lambda x: x == 1)).count() == 0


def test_suite_probabilities_and_quality(prepared, models):
    _, test, _ = prepared
    preds = scoring.model_suite(splits.index_labels(test, models.classes), models, "home").cache()
    sums = preds.select(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x).alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-6 for r in sums)
    table = {r["model"]: r["accuracy"] for r in metrics.summary(preds, models.classes, ["dataset", "model"]).collect()}
    assert set(table) == {"trees", "order", "ensemble"} and min(table.values()) > 0.8
    sliding = scoring.score_models(test, models, sliding=True, stride=20)
    assert sliding.count() == test.count()


def test_saved_models_score_alike(spark, prepared, models, tmp_path):
    _, test, _ = prepared
    models.save(str(tmp_path / "m"))
    again = scoring.ModelSet.load(spark, str(tmp_path / "m"), CATEGORY)
    a, b = [{r["sample_id"]: (list(r["p_first"]), list(r["p_second"])) for r in scoring.score_models(test, x).collect()} for x in (models, again)]
    assert a == b and len(a) == test.count()


def python_transitions(train, k, size, width):
    steps = [Counter() for _ in range(k)]
    for y, enc in train:
        row = enc[:width]
        steps[y].update(zip(row, row[1:]))
    seen = set().union(*steps)
    prev = [defaultdict(int) for _ in range(k)]
    for c in range(k):
        for (a, _), n in steps[c].items():
            prev[c][a] += n
    firsts = {a for a, _ in seen}

    def score(row):
        out = []
        for c in range(k):
            total = 0.0
            for a, b in zip(row, row[1:]):
                if a not in firsts:
                    total += -math.log(size)
                else:
                    total += math.log((steps[c][(a, b)] + 1) / (prev[c][a] + size)) if (a, b) in seen else math.log(1 / (prev[c][a] + size))
            out.append(total)
        top = max(out)
        e = [math.exp(x - top) for x in out]
        return [x / sum(e) for x in e]

    return score


def test_transition_scores_match_loops(prepared):
    train, test, vocab = prepared
    classes = splits.class_dimension(train)
    tr, te = splits.index_labels(train, classes), splits.index_labels(test, classes)
    size = vocab.count()
    model = markov.train_transitions(tr, 3, size, 30)
    score = python_transitions([(r["y"], list(r["encoded"])) for r in tr.collect()], 3, size, 30)
    rows = {r["sample_id"]: list(r["encoded"]) for r in te.collect()}
    got = {r["sample_id"]: list(r["probs"]) for r in markov.score_padded(te, model, size).collect()}
    for k, enc in rows.items():
        assert got[k] == pytest.approx(score(enc[:30]), abs=1e-9)
    slid = {r["sample_id"]: list(r["probs"]) for r in markov.score_sliding(te, model, size, 10).collect()}
    for k, enc in rows.items():
        starts = [0] if len(enc) <= 30 else [s for s in range(0, len(enc), 10) if s == 0 or s - 10 + 30 < len(enc)]
        each = [score(enc[s:s + 30]) for s in starts]
        assert slid[k] == pytest.approx([sum(x) / len(each) for x in zip(*each)], abs=1e-9)
    sweep = markov.length_sweep(tr, te, classes, size, [5, 30])
    best = markov.best_length(sweep).first()
    assert sweep.count() == 2 and best["max_len"] in (5, 30)


@pytest.mark.parametrize("how", ["mean", "max"])
def test_window_scores_are_those_of_the_windows(spark, how):
    """Differences of sums against windows built one by one; padding inside rows, empty, null and repeated rows."""
    rng = random.Random(5)
    draw = lambda n: [rng.choice([0, 1, 2, 2, 3, 4, 5]) for _ in range(n)]
    lengths = [0, 1, 2, 6, 7, 8, 13, 30, 31, 200]
    rows = [(str(i), draw(n), i % 2, "p") for i, n in enumerate(lengths)] + [("zeros", [0, 0, 0, 2], 0, "p"), ("unseen", [9, 8, 9, 7] * 5, 1, "p")]
    samples = spark.createDataFrame(rows, "sample_id string, encoded array<int>, y int, part string")
    model = markov.train_transitions(samples.where("sample_id < '8'"), 2, 7)
    got = {r["sample_id"]: r for r in markov.score_sliding(samples.repartition(5), model, 7, 4, how, width=7).collect()}
    each = sliding_windows(samples.select("sample_id", "encoded"), 7, 4).withColumn("encoded", F.col("window"))
    want = aggregate_windows(markov.score_padded(each, model, 7).select("sample_id", "probs"), 2, how)
    for r in want.collect():
        assert list(got[r["sample_id"]]["probs"]) == pytest.approx(list(r["probs"]), abs=1e-9)
        assert got[r["sample_id"]]["y_pred"] == r["probs"].index(max(r["probs"]))
    assert len(got) == len(rows)
    odd = spark.createDataFrame([("a", None), ("a", None), ("b", [2, None, 3])], "sample_id string, encoded array<int>")
    assert [list(r["probs"]) for r in markov.score_sliding(odd.where("sample_id = 'a'"), model, 7).collect()] == [[0.5, 0.5]] * 2
    assert markov.score_padded(odd.limit(0), model, 7).count() == 0
    with pytest.raises(ValueError):
        markov.score_sliding(odd, model, 7, how="median")


def test_transition_scores_without_broadcast(prepared, monkeypatch):
    from seqlab.operators import skew

    train, test, vocab = prepared
    size = vocab.count()
    tr = splits.index_labels(train, splits.class_dimension(train))
    model = markov.train_transitions(tr, 3, size, 30)
    a = {r["sample_id"]: list(r["probs"]) for r in markov.score_padded(test, model, size).collect()}
    original = skew.lookup_join
    monkeypatch.setattr(markov, "lookup_join", lambda f, d, on, **_: original(f, d, on, max_broadcast_rows=0, hot_keys=3))
    b = {r["sample_id"]: list(r["probs"]) for r in markov.score_padded(test, model, size).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_texts(spark, models):
    rows = spark.createDataFrame([("ok", "NtCreateFile, NtReadFile\nNtCreateFile NtReadFile NtReadFile"), ("short", "a b"), ("unknown", "q1 q2 q3 q4"), ("cleaned", "__x __y __z")], "sample_id string, text string")
    got = {r["sample_id"]: r for r in scoring.score_texts(rows, models).collect()}
    assert set(got) == {"ok", "unknown", "cleaned"} and got["ok"]["predicted"] == "Adware" and got["ok"]["sequence_length"] == 5
    assert got["cleaned"]["sequence_length"] == 0 and sum(got["cleaned"]["probs"]) == pytest.approx(1.0)


def test_reasons_of_texts(spark, prepared, models):
    rows = spark.createDataFrame([("a", "NtCreateFile NtReadFile NtCreateFile NtReadFile NtReadFile"), ("b", "connect send recv connect"), ("u", "q1 q2 q3")], "sample_id string, text string")
    got = {r["sample_id"]: r for r in scoring.score_texts(rows, models, reasons=4).collect()}
    plain = {r["sample_id"]: r for r in scoring.score_texts(rows, models).collect()}
    names = {r["name"] for r in features.feature_names(models.ngrams).collect()}
    for key, r in got.items():
        assert list(r["probs"]) == pytest.approx(list(plain[key]["probs"])) and r["predicted"] == plain[key]["predicted"]
        assert 0 < len(r["reasons"]) <= 4 and {x["name"] for x in r["reasons"]} <= names
        sizes = [abs(x["value"]) for x in r["reasons"]]
        assert sizes == sorted(sizes, reverse=True)
    _, test, _ = prepared
    scored = scoring.score_models(test, models, contributions=True)
    total = F.aggregate("contributions", F.col("base"), lambda a, e: F.zip_with(a, e["changes"], lambda x, y: x + y))
    gap = F.array_max(F.zip_with(total, "p_first", lambda a, b: F.abs(a - b)))
    assert scored.agg(F.max(gap)).first()[0] < 1e-9


def test_stream_equals_batch(spark, models, samples, tmp_path):
    texts = samples.select("sample_id", F.array_join("sequence", " ").alias("text"))
    texts.repartition(3).write.parquet(str(tmp_path / "in"))
    vocab = v.row_encoder(models.vocab)
    batch = {r["sample_id"]: list(r["padded"]) for r in stream.prepare_texts(texts, vocab, 40).collect()}
    rows = stream.prepare_texts(stream.stream_texts(spark, str(tmp_path / "in"), files_per_batch=1), vocab, 40)
    run = rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert {r["sample_id"]: list(r["padded"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == batch
    stream.score_stream(stream.stream_texts(spark, str(tmp_path / "in")), models, str(tmp_path / "scored"), str(tmp_path / "c2")).awaitTermination()
    a = {r["sample_id"]: r["predicted"] for r in spark.read.parquet(str(tmp_path / "scored")).collect()}
    assert a == {r["sample_id"]: r["predicted"] for r in scoring.score_texts(texts, models).collect()}


def test_search_and_boosting(samples):
    classes = splits.class_dimension(samples)
    rows = features.engineered_features(splits.index_labels(samples, classes), True, CATEGORY).cache()
    found = trees.search_forest(rows, {"n_estimators": [3], "max_depth": [2, 4], "colsample_bytree": [0.6]}, n_iter=2)
    assert len(found.avgMetrics) == 2 and max(found.avgMetrics) > 0.7
    again = trees.draw_parameters(V.SEARCH_SPACE, 40)
    assert len(again) == 40 and again == trees.draw_parameters(V.SEARCH_SPACE, 40)
    boosted = trees.score(trees.train_boosted(rows, rounds=2, depth=2), rows)
    assert boosted.where("y = y_pred").count() > 0.8 * 240
    scored = trees.score(found.bestModel, rows)
    names = features.STATISTIC_NAMES + features.CATEGORY_NAMES + features.TRANSITION_NAMES
    table = rows.sparkSession.createDataFrame(list(enumerate(names)), "col_idx int, name string")
    assert trees.importances(found.bestModel, table).agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    linear = explain.train_linear(rows, 10)
    coeffs = explain.coefficients(linear, explain.feature_means(rows, 81), table)
    top = explain.top_contributions(explain.contributions(scored, coeffs))
    assert top.groupBy("sample_id").count().agg(F.max("count"), F.min("count")).first() == (15, 15)
    key = lambda r: (r["sample_id"], r["rank"], r["name"], r["class_idx"], r["display_name"], round(r["value"], 9), r["feature_value"])
    inside = explain.row_top_contributions(scored, coeffs)
    assert sorted(map(key, inside.collect())) == sorted(map(key, top.collect()))
    every = explain.contributions(rows.crossJoin(F.broadcast(rows.sparkSession.range(3).select(F.col("id").cast("int").alias("y_pred")))), coeffs)
    want = {(r["class_idx"], r["name"]): r["m"] for r in every.groupBy("class_idx", "name").agg(F.avg(F.abs("value")).alias("m")).collect()}
    got = {(r["class_idx"], r["name"]): r["mean_abs"] for r in explain.global_contributions(rows, coeffs).collect()}
    assert len(got) == 3 * 81 and got == pytest.approx(want)


def test_short_trace_plan(spark, samples):
    train, test, vocab = preparation.prepare_short(samples)
    assert train.count() + test.count() == 240 and train.where("size(sequence) > 100").count() == 0
    external = samples.withColumn("label", F.when(F.col("label") == "Worms", "Benign").otherwise(F.col("label")))
    rows = preparation.prepare_short_external(external, splits.class_dimension(train), vocab)
    assert {r["label"] for r in rows.select("label").distinct().collect()} == {"Adware", "Spyware"}
    assert preparation.prepare_external(samples, vocab, normalise=True).where("size(encoded) <> size(sequence)").count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_prepared_rows_are_stored_and_read_by_column(prepared):
    train, test, _ = prepared
    for part in (train, test):
        assert "MapInArrow" not in _plan(part)
        assert "sequence" not in _plan(part.select("label"))


def test_matrix_sends_each_row_to_python_once(prepared, models):
    _, test, _ = prepared
    rows = features.feature_matrix(splits.index_labels(test, models.classes), models.ngrams, True, CATEGORY)
    assert _plan(rows).count("ArrowEvalPython") == 1


def test_kept_columns_alone_pass_between_the_scorers(prepared, models):
    _, test, _ = prepared
    rows = splits.index_labels(test, models.classes)
    scored = scoring.score_models(rows, models, kept=["sample_id", "y"])
    assert scored.columns == ["sample_id", "y", "p_first", "p_second"]
    whole = scoring.score_models(rows, models).select(*scored.columns)
    assert sorted(scored.collect()) == sorted(whole.collect())


def test_folds_are_stored_before_the_search(spark, monkeypatch):
    """Every fold filters the rows twice; the fold lookup must not run again each time."""
    seen = []

    def fit(self, rows):
        seen.append((_plan(rows), rows.count()))

    monkeypatch.setattr(trees.CrossValidator, "fit", fit)
    rows = spark.range(40).select(F.col("id").cast("string").alias("sample_id"), (F.col("id") % 2).cast("int").alias("y"))
    trees.search_forest(rows.withColumn("features", F.lit(1.0)), {"max_depth": [2]}, 1, 2)
    assert len(seen) == 1 and "MapInArrow" not in seen[0][0] and seen[0][1] == 40


def test_search_query_does_all_draws_of_the_whole_space(spark, monkeypatch):
    """The registered search fits the specified draws in the specified folds; few rows are one partition and many fits at once."""
    from types import SimpleNamespace

    from seqlab.catalog import QUERIES

    seen = []

    def fit(self, rows):
        seen.append((self.getEstimatorParamMaps(), self.getNumFolds(), self.getParallelism(), rows.rdd.getNumPartitions()))
        return SimpleNamespace(avgMetrics=[0.5] * len(seen[-1][0]))

    monkeypatch.setattr(trees.CrossValidator, "fit", fit)
    assert QUERIES["M1_random_search"](spark, "/root/testdata/sf0.001").count() == V.CV_DRAWS
    ((maps, folds, parallelism, parts),) = seen
    tried = {}
    for setting in maps:
        for param, value in setting.items():
            tried.setdefault(param.name, set()).add(str(value))
    assert len(maps) == V.CV_DRAWS and folds == V.CV_FOLDS
    assert sorted(map(sorted, tried.values())) == sorted(sorted(map(str, v)) for v in V.SEARCH_SPACE.values())
    assert parts == 1 and parallelism == max(2, spark.sparkContext.defaultParallelism)


def test_texts_cross_to_python_once(spark, samples):
    """Encoding and features come from one step that gives no tokens back; a category without Python form gives the same rows."""
    train, test, vocab = preparation.prepare_primary(samples)
    models = scoring.train_models(train, test, vocab, category=CATEGORY, n_estimators=3, max_depth=3)
    odd = [("a", "NtClose, connect send\nÉté 中文x don't don't connect"), ("b", "x y"), ("c", ""), ("d", "send " * 40)]
    texts = samples.limit(20).select("sample_id", F.array_join("sequence", ",").alias("text")).unionByName(spark.createDataFrame(odd, "sample_id string, text string"))
    scored = scoring.score_texts(texts, models, reasons=2)
    got = sorted(scored.collect())
    models.category = lambda token: CATEGORY(token)
    assert features.matrix_in_python(models.ngrams, True, models.category) is None
    want = sorted(scoring.score_texts(texts, models, reasons=2).collect())
    assert len(got) > 20 and got == want

    usable = dictionaries.stage(samples.select("sample_id", "sequence"))
    matrix = features.matrix_in_python(models.ngrams, True, CATEGORY)
    both = v.encode_staged(usable, vocab, matrix=matrix)
    assert both.columns == ["sample_id", "encoded", "features"] and "ArrowEvalPython" not in _plan(both)
    apart = features.feature_matrix(v.encode_staged(usable, vocab), models.ngrams, True, CATEGORY).select("sample_id", "encoded", "features")
    assert sorted(both.collect()) == sorted(apart.collect()) and "array_distinct" not in _plan(apart)


def test_categories_in_python_are_those_of_the_column(spark):
    from seqlab.sources.adapters import LETTERS

    tokens = ["connect", "ntreadfile", "", "a", "z", "A", "0", "été", "中", "\U0001f600x", " b", None]
    rows = spark.createDataFrame(list(enumerate(tokens)), "i int, t string")
    for of in (CATEGORY, LETTERS):
        assert of.in_python(tokens) == [r["c"] for r in rows.orderBy("i").select(of(F.col("t")).alias("c")).collect()]
