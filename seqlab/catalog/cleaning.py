"""Cleaning, filters and truncation."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlab.catalog.registry import DOCS, EVENTS, PAGES, RAW, joined, query, sql_calls, sql_joined
from seqlab.functions import cleaning as c
from seqlab.operators import calls, splits
from seqlab.sources import adapters as src

FAMILY_OF_LANG = "CASE label WHEN 'en' THEN 'Trojan' WHEN 'de' THEN 'Spyware' WHEN 'fr' THEN 'Worms' ELSE 'Benign' END"
SQL_MARKED_PAGES = PAGES + """, raw AS (
  SELECT sample_id, label, [CASE WHEN x IN ('a', 'b', 'br') THEN '__' || x ELSE x END FOR x IN seq] AS seq FROM pg)"""


def _marked_pages(spark, d):
    mark = F.transform("sequence", lambda x: F.when(x.isin("a", "b", "br"), F.concat(F.lit("__"), x)).otherwise(x))
    return src.page_samples(spark, d).withColumn("sequence", mark)


def _family_docs(spark, d):
    family = F.when(F.col("label") == "en", "Trojan").when(F.col("label") == "de", "Spyware").when(
        F.col("label") == "fr", "Worms").otherwise("Benign")
    return src.doc_samples(spark, d).withColumn("label", family)


def _show(samples, seq):
    return samples.select("sample_id", joined(seq).alias("seq"), F.size(seq).alias("n"))


def _runs_sql(source: str, k: int, extra: str = "") -> str:
    same = " AND ".join(f"coalesce(lag(token, {i}) OVER w = token, false)" for i in range(1, k + 1))
    return f"""calls AS ({sql_calls(source)}),
flagged AS (SELECT sample_id, pos, token, {same} AS rep FROM calls {extra} WINDOW w AS (PARTITION BY sample_id ORDER BY pos)),
kept AS (SELECT sample_id, string_agg(token, ' ' ORDER BY pos) AS seq, count(*) AS n FROM flagged WHERE NOT rep GROUP BY 1)
SELECT s.sample_id, coalesce(k.seq, '') AS seq, coalesce(k.n, 0) AS n FROM {source} s LEFT JOIN kept k USING (sample_id)"""


@query("P1_remove_sandbox_tokens", f"""WITH {RAW}, o AS (SELECT sample_id, [x FOR x IN seq IF NOT starts_with(x, '__')] AS s FROM raw)
SELECT sample_id, {sql_joined('s')} AS seq, len(s) AS n FROM o""")
def p1(spark, d):
    return _show(src.raw_doc_samples(spark, d), c.remove_sandbox_tokens(F.col("sequence")))


@query("P2_collapse_runs", f"WITH {PAGES}, {_runs_sql('pg', 5)}")
def p2(spark, d):
    return _show(src.page_samples(spark, d), c.collapse_runs(F.col("sequence")))


@query("P2_collapse_runs_calls", f"""WITH {EVENTS},
f AS (SELECT sample_id, pos, token, lag(token) OVER (PARTITION BY sample_id ORDER BY pos) AS prev FROM ev)
SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY pos) AS pos, token FROM f
WHERE prev IS NULL OR prev <> token""")
def p2_calls(spark, d):
    return calls.collapse_runs(src.event_calls(spark, d), 1)


@query("P3_drop_repeats", f"WITH {PAGES}, {_runs_sql('pg', 1)}")
def p3(spark, d):
    return _show(src.page_samples(spark, d), c.drop_repeats(F.col("sequence")))


@query("P4_clean", f"WITH {SQL_MARKED_PAGES}, {_runs_sql('raw', 5, extra=chr(10) + '  WHERE NOT starts_with(token, ' + chr(39) + '__' + chr(39) + ')')}")
def p4(spark, d):
    return _show(_marked_pages(spark, d), c.clean(F.col("sequence")))


@query("P5_short_trace", f"""WITH {RAW}, calls AS ({sql_calls('raw')}),
real AS (SELECT * FROM calls WHERE NOT starts_with(token, '__')),
f AS (SELECT *, lag(token) OVER (PARTITION BY sample_id ORDER BY pos) AS prev FROM real),
k AS (SELECT sample_id, token, row_number() OVER (PARTITION BY sample_id ORDER BY pos) AS rn FROM f WHERE prev IS NULL OR prev <> token),
a AS (SELECT sample_id, string_agg(token, ' ' ORDER BY rn) AS seq, count(*) AS n FROM k WHERE rn <= 100 GROUP BY 1)
SELECT sample_id, coalesce(seq, '') AS seq, coalesce(n, 0) AS n FROM raw r LEFT JOIN a USING (sample_id)""".replace("coalesce(seq, '')", "coalesce(a.seq, '')"))
def p5(spark, d):
    return _show(src.raw_doc_samples(spark, d), c.short_trace(F.col("sequence")))


def _cased(spark, d):
    return src.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("sample_id"),
        F.transform(
            F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)),
            lambda x: F.when(F.length(x) == 1, F.concat(F.lit("__"), x)).otherwise(x),
        ).alias("sequence"),
    )


CASED = """cased AS (SELECT cast(doc_id AS varchar) AS sample_id,
  [CASE WHEN length(x) = 1 THEN '__' || x ELSE x END FOR x IN regexp_extract_all(text, '[A-Za-z]+', 0)] AS seq FROM documents)"""


@query("P6_lowercase", f"WITH {CASED}, o AS (SELECT sample_id, [lower(x) FOR x IN seq] AS s FROM cased) SELECT sample_id, {sql_joined('s')} AS seq, len(s) AS n FROM o")
def p6(spark, d):
    return _show(_cased(spark, d), c.lowercase(F.col("sequence")))


@query("P7_lowercase_without_sandbox", f"""WITH {CASED}, o AS (SELECT sample_id, [lower(x) FOR x IN seq IF NOT starts_with(x, '__')] AS s FROM cased)
SELECT sample_id, {sql_joined('s')} AS seq, len(s) AS n FROM o""")
def p7(spark, d):
    return _show(_cased(spark, d), c.lowercase_without_sandbox(F.col("sequence")))


@query("P8_drop_empty", f"WITH {DOCS}, o AS (SELECT sample_id, [x FOR x IN seq IF length(x) >= 12] AS s FROM docs) SELECT sample_id, len(s) AS n FROM o WHERE len(s) > 0")
def p8(spark, d):
    long_words = F.filter("sequence", lambda x: F.length(x) >= 12)
    rows = src.doc_samples(spark, d).select("sample_id", long_words.alias("sequence")).where(F.size("sequence") > 0)
    return rows.select("sample_id", F.size("sequence").alias("n"))


@query("P9_without_trojan", f"WITH {DOCS} SELECT sample_id, {FAMILY_OF_LANG} AS label FROM docs WHERE {FAMILY_OF_LANG} <> 'Trojan'")
def p9(spark, d):
    return splits.without_label(_family_docs(spark, d), "Trojan").select("sample_id", "label")


@query("P10_malware_only", f"WITH {DOCS} SELECT sample_id, {FAMILY_OF_LANG} AS label FROM docs WHERE {FAMILY_OF_LANG} <> 'Benign'")
def p10(spark, d):
    return splits.without_label(_family_docs(spark, d), "Benign").select("sample_id", "label")


@query("P11_known_classes", """SELECT cast(doc_id AS varchar) AS sample_id, source AS label FROM documents WHERE source IN (
  SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)""")
def p11(spark, d):
    docs = src.table(spark, d, "documents").select("doc_id", F.col("source").alias("label"))
    toxic = src.table(spark, d, "labels").where("toxic = 1").select("doc_id")
    classes = splits.class_dimension(docs.join(toxic, "doc_id", "left_semi"))
    return splits.known_classes_only(docs, classes).select(F.col("doc_id").cast("string").alias("sample_id"), "label")


@query("P12_large_classes", """SELECT cast(doc_id AS varchar) AS sample_id, source AS label FROM documents WHERE source IN (
  SELECT source FROM documents GROUP BY 1 HAVING count(*) >= 10)""")
def p12(spark, d):
    docs = src.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), F.col("source").alias("label"))
    return splits.large_classes_only(docs).select("sample_id", "label")


@query("P13_truncate", f"WITH {DOCS} SELECT sample_id, {sql_joined('seq[1:50]')} AS seq, least(len(seq), 50) AS n FROM docs")
def p13(spark, d):
    return _show(src.doc_samples(spark, d), c.truncate(F.col("sequence"), 50))


@query("P15_parse_text", f"""WITH t AS (SELECT cast(doc_id AS varchar) AS sample_id,
  [x FOR x IN regexp_split_to_array(translate(text, chr(10) || ',', '  '), '\\s+') IF x <> ''] AS s FROM documents)
SELECT sample_id, {sql_joined('s')} AS seq, len(s) AS n, len(s) >= 3 AS usable FROM t""")
def p15(spark, d):
    rows = src.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("sample_id"), c.parse_text(F.col("text")).alias("sequence")
    )
    return rows.select(
        "sample_id", joined("sequence").alias("seq"), F.size("sequence").alias("n"), c.long_enough(F.col("sequence")).alias("usable")
    )


@query("P16_report_names", """SELECT page_id, regexp_extract(url || '.json', '([^/]*)$', 1) AS fname,
  replace(regexp_extract(url || '.json', '([^/]*)$', 1), '.json', '') AS sha256 FROM pages""")
def p16(spark, d):
    name = c.bare_name(F.concat("url", F.lit(".json")))
    return src.table(spark, d, "pages").select("page_id", name.alias("fname"), c.hash_of_report(name).alias("sha256"))
