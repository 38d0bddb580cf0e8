"""Feature operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlab import fixed_values as V
from seqlab import runtime
from seqlab.catalog.registry import DOCS, EVENTS, PAGES, query, r6, sql_calls, sql_r6
from seqlab.functions.arrays import vector_cells
from seqlab.functions.encoding import one_hot
from seqlab.functions.labels import category_from, short_feature_name
from seqlab.operators import calls, explain, features, splits
from seqlab.sources import adapters as src
from seqlab.sources import readers

CALLS = f"{DOCS}, calls AS ({sql_calls('docs')})"
COUNTS = CALLS + """, cnt AS (SELECT sample_id, token, count(*) AS n FROM calls GROUP BY ALL),
tot AS (SELECT sample_id, sum(n)::double AS total, count(*) AS u FROM cnt GROUP BY 1)"""
CAT_VALUES = ", ".join(f"({i}, '{c}')" for i, c in enumerate(V.CATEGORIES))
CATS = f"cats(slot, category) AS (VALUES {CAT_VALUES})"
CAT_OF = "(ascii({t}) - 97) % 8"


@query("A2_token_counts", f"WITH {COUNTS} SELECT sample_id, token, n FROM cnt")
def a2(spark, d):
    return features.token_counts(src.doc_samples(spark, d))


@query("K8_consecutive_pairs", f"""WITH {CALLS}, p AS (SELECT sample_id, token, lead(token) OVER (PARTITION BY sample_id ORDER BY pos) AS next_token FROM calls)
SELECT token, next_token, count(*) AS n FROM p WHERE next_token IS NOT NULL GROUP BY ALL""")
def k8(spark, d):
    from seqlab.functions.arrays import pairs

    rows = src.doc_samples(spark, d).select(F.inline(pairs(F.col("sequence"))))
    return rows.groupBy(F.col("a").alias("token"), F.col("b").alias("next_token")).agg(F.count("*").alias("n"))


@query("K8_consecutive_pairs_calls", f"""WITH {EVENTS}, p AS (SELECT sample_id, pos, token, lead(token) OVER (PARTITION BY sample_id ORDER BY pos) AS next_token FROM ev)
SELECT * FROM p WHERE next_token IS NOT NULL""")
def k8_calls(spark, d):
    return calls.consecutive_pairs(src.event_calls(spark, d))


LINES = """li AS (SELECT cast(l_orderkey AS varchar) AS sample_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS pos,
  lower(p_type || '_' || l_returnflag) AS token FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@query("A2_token_counts_calls", f"WITH {LINES} SELECT sample_id, token, count(*) AS n, max(pos) AS last_pos FROM li GROUP BY ALL")
def a2_calls(spark, d):
    return src.line_calls(spark, d).groupBy("sample_id", "token").agg(F.count("*").alias("n"), F.max("pos").alias("last_pos"))


@query("flagship_transition_shares", f"""WITH {EVENTS},
f AS (SELECT sample_id, pos, token, lag(token, 1) OVER w AS a, lag(token, 2) OVER w AS b, lag(token, 3) OVER w AS c,
  lag(token, 4) OVER w AS d, lag(token, 5) OVER w AS e FROM ev WINDOW w AS (PARTITION BY sample_id ORDER BY pos)),
k AS (SELECT * FROM f WHERE NOT coalesce(a = token AND b = token AND c = token AND d = token AND e = token, false)),
p AS (SELECT sample_id, token, lead(token) OVER (PARTITION BY sample_id ORDER BY pos) AS next_token FROM k),
n AS (SELECT sample_id, token, next_token, count(*) AS n FROM p WHERE next_token IS NOT NULL GROUP BY ALL)
SELECT *, {sql_r6('n / sum(n) OVER (PARTITION BY sample_id)::double')} AS share FROM n""")
def flagship(spark, d):
    shares = calls.transition_shares(calls.collapse_runs(src.event_calls(spark, d)))
    return shares.withColumn("share", r6("share"))


def _shares_sql(name: str, max_features: int, high: int) -> str:
    """N-gram tables of the documents: <name>v (vocabulary) and <name>s (shares)."""
    words = "[x FOR x IN seq IF length(x) >= 2]"
    grams = " UNION ALL ".join(
        f"SELECT sample_id, array_to_string(w[i:i + {n - 1}], ' ') AS ngram FROM (SELECT sample_id, w, unnest(generate_series(1, len(w) - {n - 1})) AS i FROM {name}w)"
        for n in range(1, high + 1)
    )
    return f"""{name}w AS (SELECT sample_id, {words} AS w FROM docs), {name}g AS ({grams}),
{name}t AS (SELECT ngram, count(*) AS n FROM {name}g GROUP BY 1 ORDER BY n DESC, ngram LIMIT {max_features}),
{name}v AS (SELECT ngram, n, row_number() OVER (ORDER BY ngram) - 1 AS col_idx FROM {name}t),
{name}c AS (SELECT sample_id, ngram, col_idx, count(*) AS c FROM {name}g JOIN {name}v USING (ngram) GROUP BY ALL),
{name}s AS (SELECT sample_id, ngram, col_idx, c / sum(c) OVER (PARTITION BY sample_id)::double AS value FROM {name}c)"""


@query("F1_ngram_vocabulary", f"WITH {DOCS}, {_shares_sql('g', 5000, 3)} SELECT ngram, col_idx FROM gv")
def f1(spark, d):
    return features.ngram_vocabulary(src.doc_samples(spark, d))


@query("K3_top_ngrams", f"WITH {DOCS}, {_shares_sql('g', 1000, 2)} SELECT ngram, n FROM gv")
def k3(spark, d):
    return features.top_ngrams(src.doc_samples(spark, d), V.SHORT_TF_MAX_FEATURES, V.SHORT_TF_NGRAM_RANGE)


@query("F2_ngram_shares", f"WITH {DOCS}, {_shares_sql('g', 5000, 3)} SELECT sample_id, ngram, col_idx, {sql_r6('value')} AS value FROM gs")
def f2(spark, d):
    docs = src.doc_samples(spark, d)
    vocab = runtime.pin(features.ngram_vocabulary(docs))
    return features.ngram_shares(docs, vocab).withColumn("value", r6("value"))


def _stats_sql(damp: bool, drop_length: bool = False) -> str:
    share = "log2(n + 1) / log2(total + 1)" if damp else "n / total"
    return f"""rk AS (SELECT sample_id, n, total, row_number() OVER (PARTITION BY sample_id ORDER BY n DESC, token) AS r FROM cnt JOIN tot USING (sample_id)),
top AS (SELECT sample_id, {', '.join(f'coalesce(max({share}) FILTER (WHERE r = {i}), 0.0) AS t{i}' for i in range(1, 6))} FROM rk GROUP BY 1),
ent AS (SELECT sample_id, -sum((n / total) * log2(n / total)) AS h FROM cnt JOIN tot USING (sample_id) GROUP BY 1),
st AS (SELECT d.sample_id, coalesce(log2(total + 1), 0.0) AS log_seq_length, coalesce(log2(u + 1), 0.0) AS log_unique_count,
  coalesce(u / total, 0.0) AS unique_ratio, {', '.join(f'coalesce(t{i}, 0.0) AS top{i}_freq_ratio' for i in range(1, 6))},
  coalesce(h, 0.0) AS shannon_entropy FROM docs d LEFT JOIN tot USING (sample_id) LEFT JOIN top USING (sample_id) LEFT JOIN ent USING (sample_id))"""


def _statistics(spark, d, damp):
    rows = src.doc_samples(spark, d).select("sample_id", features.statistics(F.col("sequence"), log_dampen=damp).alias("v"))
    return rows.select("sample_id", *[r6(F.get("v", F.lit(i))).alias(n) for i, n in enumerate(features.STATISTIC_NAMES)])


_STAT_COLUMNS = ", ".join(f"{sql_r6(n)} AS {n}" for n in features.STATISTIC_NAMES)


@query("F3_statistics", f"WITH {COUNTS}, {_stats_sql(False)} SELECT sample_id, {_STAT_COLUMNS} FROM st")
def f3(spark, d):
    return _statistics(spark, d, False)


@query("F3_statistics_dampened", f"WITH {COUNTS}, {_stats_sql(True)} SELECT sample_id, {_STAT_COLUMNS} FROM st")
def f3d(spark, d):
    return _statistics(spark, d, True)


@query("K2_top_shares", f"WITH {COUNTS}, {_stats_sql(False)} SELECT sample_id, {', '.join(f'{sql_r6(f'top{i}_freq_ratio')} AS t{i}' for i in range(1, 6))} FROM st")
def k2(spark, d):
    rows = src.doc_samples(spark, d).select("sample_id", features.statistics(F.col("sequence")).alias("v"))
    return rows.select("sample_id", *[r6(F.get("v", F.lit(2 + i))).alias(f"t{i}") for i in range(1, 6)])


def _cat_sql(damp: bool) -> str:
    weight = "log2(n + 1)" if damp else "n::double"
    return f"""cw AS (SELECT sample_id, {CAT_OF.format(t='token')} AS slot, sum({weight}) AS w FROM cnt GROUP BY ALL),
ct AS (SELECT sample_id, slot, w / sum(w) OVER (PARTITION BY sample_id) AS value FROM cw)"""


def _bigram_sql(damp: bool) -> str:
    weight = "log2(count(*) + 1)" if damp else "count(*)::double"
    return f"""bp AS (SELECT sample_id, token AS a, lead(token) OVER (PARTITION BY sample_id ORDER BY pos) AS b FROM calls),
bc AS (SELECT sample_id, {CAT_OF.format(t='a')} AS s, {CAT_OF.format(t='b')} AS t, {weight} AS w FROM bp WHERE b IS NOT NULL GROUP BY sample_id, a, b),
bs AS (SELECT sample_id, s, t, sum(w) AS w FROM bc GROUP BY ALL),
bt AS (SELECT sample_id, s, t, w / sum(w) OVER (PARTITION BY sample_id) AS value FROM bs)"""


def _category_query(spark, d, damp):
    docs = src.doc_samples(spark, d)
    shares = features.category_shares(F.col("sequence"), damp, src.LETTERS)
    out = features.named_features(docs, shares, features.CATEGORY_NAMES)
    return out.where("value <> 0").withColumn("value", r6("value"))


def _transition_query(spark, d, damp):
    docs = src.doc_samples(spark, d)
    shares = features.transition_shares(F.col("sequence"), damp, src.LETTERS)
    out = features.named_features(docs, shares, features.TRANSITION_NAMES)
    return out.where("value <> 0").withColumn("value", r6("value"))


def _cat_select() -> str:
    return f"SELECT sample_id, 'cat_' || category AS feature, {sql_r6('value')} AS value FROM ct JOIN cats USING (slot)"


def _bigram_select() -> str:
    return f"""SELECT sample_id, 'bigram_' || x.category || '_' || y.category AS feature, {sql_r6('value')} AS value
FROM bt JOIN cats x ON x.slot = s JOIN cats y ON y.slot = t"""


@query("F4_category_shares", f"WITH {COUNTS}, {CATS}, {_cat_sql(False)} {_cat_select()}")
def f4(spark, d):
    return _category_query(spark, d, False)


@query("F4_category_shares_dampened", f"WITH {COUNTS}, {CATS}, {_cat_sql(True)} {_cat_select()}")
def f4d(spark, d):
    return _category_query(spark, d, True)


@query("F5_transition_shares", f"WITH {CALLS}, {CATS}, {_bigram_sql(False)} {_bigram_select()}")
def f5(spark, d):
    return _transition_query(spark, d, False)


@query("F5_transition_shares_dampened", f"WITH {CALLS}, {CATS}, {_bigram_sql(True)} {_bigram_select()}")
def f5d(spark, d):
    return _transition_query(spark, d, True)


# ---- assembled matrices, as one row per sample and non-zero column -----------------
def _engineered_sql(damp: bool, drop_length: bool = False) -> str:
    names = features.STATISTIC_NAMES[1:] if drop_length else features.STATISTIC_NAMES
    stats = " UNION ALL ".join(f"SELECT sample_id, {i} AS k, {n} AS value FROM st" for i, n in enumerate(names))
    width = len(names)
    return f"""{_stats_sql(damp)}, {_cat_sql(damp)}, {_bigram_sql(damp)},
eng AS ({stats} UNION ALL SELECT sample_id, {width} + slot, value FROM ct UNION ALL SELECT sample_id, {width + 8} + s * 8 + t, value FROM bt)"""


def _matrix_sql(max_features: int, high: int, damp: bool, drop_length: bool) -> str:
    return f"""WITH {COUNTS}, {CATS}, {_shares_sql('g', max_features, high)}, {_engineered_sql(damp, drop_length)},
mx AS (SELECT sample_id, col_idx, value FROM gs UNION ALL SELECT sample_id, (SELECT count(*) FROM gv) + k, value FROM eng)
SELECT sample_id, cast(col_idx AS bigint) AS col_idx, {sql_r6('value')} AS value FROM mx WHERE abs(value) > 1e-9"""


def _long(matrix):
    rows = matrix.select("sample_id", F.inline(vector_cells(F.col("features")))).where("abs(x) > 1e-9")
    return rows.select("sample_id", F.col("i").cast("long").alias("col_idx"), r6("x").alias("value"))


@query("F6_feature_matrix", _matrix_sql(5000, 3, True, False))
def f6(spark, d):
    docs = src.doc_samples(spark, d)
    vocab = runtime.pin(features.ngram_vocabulary(docs))
    return _long(features.feature_matrix(docs, vocab, True, src.LETTERS))


@query("F7_engineered_features", f"""WITH {COUNTS}, {CATS}, {_engineered_sql(True)}
SELECT sample_id, cast(k AS bigint) AS col_idx, {sql_r6('value')} AS value FROM eng WHERE abs(value) > 1e-9""")
def f7(spark, d):
    return _long(features.engineered_features(src.doc_samples(spark, d), True, src.LETTERS))


@query("F8_short_trace_features", _matrix_sql(1000, 2, False, True))
def f8(spark, d):
    docs = src.doc_samples(spark, d)
    vocab = runtime.pin(features.ngram_vocabulary(docs, V.SHORT_TF_MAX_FEATURES, V.SHORT_TF_NGRAM_RANGE))
    return _long(features.short_trace_features(docs, vocab, src.LETTERS))


_TAIL = ", ".join(
    f"({i}, '{n}')" for i, n in enumerate(features.STATISTIC_NAMES + features.CATEGORY_NAMES + features.TRANSITION_NAMES)
)
_NAMES = f"""WITH {DOCS}, {_shares_sql('g', 5000, 3)}, tail(k, name) AS (VALUES {_TAIL}),
fn AS (SELECT col_idx, ngram AS name FROM gv UNION ALL SELECT (SELECT count(*) FROM gv) + k, name FROM tail)"""


def _names(spark, d):
    return features.feature_names(runtime.pin(features.ngram_vocabulary(src.doc_samples(spark, d))))


@query("F9_feature_names", f"{_NAMES} SELECT cast(col_idx AS bigint) AS col_idx, name FROM fn")
def f9(spark, d):
    return _names(spark, d).select(F.col("col_idx").cast("long").alias("col_idx"), "name")


@query("F10_short_names", f"""{_NAMES} SELECT name, CASE
  WHEN starts_with(name, 'bigram_') THEN 'bi:' || regexp_replace(replace(name, 'bigram_', ''), '^([^_]*)_', '\\1>')
  WHEN starts_with(name, 'cat_') THEN name WHEN length(name) > 35 THEN left(name, 33) || '..' ELSE name END AS short FROM fn""")
def f10(spark, d):
    return _names(spark, d).select("name", short_feature_name(F.col("name")).alias("short"))


@query("F11_label_index", f"WITH {DOCS} SELECT sample_id, source AS label, dense_rank() OVER (ORDER BY source) - 1 AS y FROM docs")
def f11(spark, d):
    docs = src.doc_samples(spark, d).select("sample_id", F.col("source").alias("label"))
    return splits.index_labels(docs, splits.class_dimension(docs)).select("sample_id", "label", "y")


@query("F12_one_hot", f"""WITH {DOCS}, y AS (SELECT sample_id, dense_rank() OVER (ORDER BY label) - 1 AS y FROM docs)
SELECT sample_id, array_to_string([CASE WHEN i = y THEN 1 ELSE 0 END FOR i IN range(4)], ' ') AS hot FROM y""")
def f12(spark, d):
    docs = src.doc_samples(spark, d).select("sample_id", "label")
    rows = splits.index_labels(docs, splits.class_dimension(docs))
    return rows.select("sample_id", F.array_join(one_hot(F.col("y"), 4), " ").alias("hot"))


# ---- categories by call name -----------------------------------------------------
_SAMPLE_CALLS = {
    "ntcreatefile": "filesystem", "getfilesizeex": "filesystem", "setfilepointer": "filesystem", "searchpathw": "filesystem",
    "regopenkeyexa": "registry", "ntqueryvaluekey": "registry", "regenumkeyw": "registry", "ntopenkeyex": "registry",
    "connect": "network", "internetopenurlw": "network", "httpsendrequesta": "network", "getaddrinfow": "network",
    "createthread": "process", "ntopenprocess": "process", "process32nextw": "process", "shellexecuteexw": "process",
    "ntallocatevirtualmemory": "memory", "ntmapviewofsection": "memory", "rtldecompressbuffer": "memory", "ntopensection": "memory",
    "ntdelayexecution": "synchronization", "openscmanagerw": "synchronization", "setwindowshookexa": "synchronization",
    "cryptdecrypt": "cryptography", "cryptunprotectmemory": "cryptography", "certopensystemstorea": "cryptography",
    "ntclose": "other", "ldrloaddll": "other", "sleep": "other", "getsysteminfo": "other",
}
_CALL_LIST = ", ".join(f"({i}, '{t}', '{c}')" for i, (t, c) in enumerate(_SAMPLE_CALLS.items()))


@query("J7_call_category", f"""WITH c(i, token, category) AS (VALUES {_CALL_LIST})
SELECT o_orderkey, token, category FROM orders JOIN c ON o_orderkey % {len(_SAMPLE_CALLS)} = i""")
def j7(spark, d):
    names = F.array(*[F.lit(t) for t in _SAMPLE_CALLS])
    rows = src.table(spark, d, "orders").select(
        "o_orderkey", F.get(names, (F.col("o_orderkey") % len(_SAMPLE_CALLS)).cast("int")).alias("token")
    )
    return rows.withColumn("category", category_from(_SAMPLE_CALLS)(F.col("token")))


# a call-to-category table as users keep it: two columns in CSV files, here named from the tokens of the events
@query("J7_category_table", f"""WITH {EVENTS}, t AS (SELECT token, length(token) % 9 AS k, count(*) AS n FROM ev GROUP BY ALL)
SELECT token, coalesce({V.CATEGORIES}[1 + k], 'other') AS category, n FROM t""")
def j7_table(spark, d):
    path = runtime.scratch_path(spark, "categories")
    tokens = src.event_calls(spark, d).groupBy("token").agg(F.count("*").alias("n"))
    named = F.get(F.array(*[F.lit(c) for c in V.CATEGORIES]), (F.length("token") % 9).cast("int"))
    tokens.select("token", named.alias("category")).where("category IS NOT NULL").write.option("header", True).csv(path)
    return tokens.select("token", category_from(readers.read_name_table(spark, path))(F.col("token")).alias("category"), "n")


@query("K7_top_contributions", f"""WITH v AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::double AS value FROM embeddings),
n AS (SELECT vec_id, 'cat_' || i AS name, value FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(value) DESC, name) AS rank FROM n)
SELECT cast(vec_id AS varchar) AS sample_id, name, rank, {sql_r6('value')} AS value FROM r WHERE rank <= 15""")
def k7(spark, d):
    rows = src.table(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("sample_id"), F.posexplode("embedding").alias("i", "value")
    ).select("sample_id", F.concat(F.lit("cat_"), F.col("i").cast("string")).alias("name"), F.col("value").cast("double").alias("value"))
    return explain.top_contributions(rows).select("sample_id", "name", "rank", r6("value").alias("value"))
