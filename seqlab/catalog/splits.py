"""Splits, folds, augmentation, weights, distributions and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlab import fixed_values as V
from seqlab.catalog.registry import DOCS, PAGES, joined, query, r6, sql_calls, sql_joined, sql_r6
from seqlab.catalog.vocabulary import VOCAB
from seqlab.operators import distributions as dist
from seqlab.operators import splits
from seqlab.operators import vocabulary as v
from seqlab.plans.preparation import prepare_primary
from seqlab.sources import adapters as src

RANKED = """rk AS (SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(sample_id || ':42'), sample_id) AS r,
  count(*) OVER (PARTITION BY label) AS n FROM docs)"""
SPLIT = f"{DOCS}, {RANKED}, sp AS (SELECT sample_id, label, CASE WHEN r <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM rk)"


def _labels(spark, d):
    return src.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), F.col("lang").alias("label"))


@query("R1_stratified_split", f"WITH {SPLIT} SELECT * FROM sp")
def r1(spark, d):
    return splits.stratified_split(_labels(spark, d)).select("sample_id", "label", "split")


@query("R2_stratified_folds", f"WITH {DOCS}, {RANKED} SELECT sample_id, label, (r - 1) % 3 AS fold FROM rk")
def r2(spark, d):
    return splits.stratified_folds(_labels(spark, d)).select("sample_id", "label", "fold")


_AUGMENTED = f"""WITH {DOCS}, c AS (SELECT sample_id, label, seq, unnest(CASE WHEN len(seq) > 20 THEN [0, 1, 2] ELSE [0] END) AS copy_no FROM docs),
l AS (SELECT *, CASE WHEN copy_no = 0 THEN len(seq) ELSE 20 + cast('0x' || left(md5(sample_id || ':' || copy_no || ':42'), 8) AS bigint)
  % (least(len(seq), 200) - 20 + 1) END AS n FROM c)"""


@query("R3_augment", f"{_AUGMENTED} SELECT sample_id, copy_no, {sql_joined('seq[1:n]')} AS seq FROM l")
def r3(spark, d):
    out = splits.augment(src.doc_samples(spark, d).select("sample_id", "label", "sequence"))
    return out.select("sample_id", "copy_no", joined("sequence").alias("seq"))


@query("U1_originals_and_augmented", f"{_AUGMENTED} SELECT label, count(*) AS n, sum(n)::bigint AS calls FROM l GROUP BY 1")
def u1(spark, d):
    docs = src.doc_samples(spark, d).select("sample_id", "label", "sequence")
    copies = splits.augment(docs).where("copy_no > 0").drop("copy_no")
    both = docs.unionByName(copies)
    return both.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.size("sequence")).alias("calls"))


@query("U2_train_and_test_labels", f"WITH {SPLIT} SELECT label, count(*) AS n FROM sp GROUP BY 1")
def u2(spark, d):
    rows = splits.stratified_split(_labels(spark, d))
    train, test = rows.where("split = 'train'").select("label"), rows.where("split = 'test'").select("label")
    return train.unionByName(test).groupBy("label").agg(F.count("*").alias("n"))


@query("U3_intersect_and_except", """SELECT doc_id, 'found' AS side FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'missing' FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)""")
def u3(spark, d):
    docs, labels = src.table(spark, d, "documents").select("doc_id"), src.table(spark, d, "labels").select("doc_id")
    found, missing = docs.join(labels, "doc_id", "left_semi").distinct(), docs.join(labels, "doc_id", "left_anti").distinct()
    return found.withColumn("side", F.lit("found")).unionByName(missing.withColumn("side", F.lit("missing")))


@query("U4_labels_outside", "SELECT DISTINCT lang AS label FROM documents WHERE lang NOT IN ('en', 'de')")
def u4(spark, d):
    return splits.labels_outside(_labels(spark, d), ["en", "de"])


@query("A1_label_distribution", "SELECT source AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS rank FROM documents GROUP BY 1")
def a1(spark, d):
    return dist.label_distribution(src.table(spark, d, "documents").select(F.col("source").alias("label")))


@query("G16_split_distribution", f"WITH {SPLIT} SELECT label, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'test') AS test FROM sp GROUP BY 1")
def g16(spark, d):
    return dist.split_distribution(splits.stratified_split(_labels(spark, d)))


_LENGTHS = ", ".join(f"{sql_r6(f'quantile_cont(len(seq), {q})')} AS {n}" for n, q in
                     [("median", 0.5), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p99", 0.99)])


@query("A3_length_statistics", f"WITH {DOCS} SELECT count(*) AS n, {sql_r6('avg(len(seq))')} AS mean, {_LENGTHS} FROM docs")
def a3(spark, d):
    out = dist.length_statistics(src.doc_samples(spark, d))
    return out.select("n", *[r6(c).alias(c) for c in out.columns if c != "n"])


@query("A7_removed_rows", "SELECT source AS dataset, count(*) AS before, count(*) FILTER (WHERE lang <> 'en') AS after, count(*) FILTER (WHERE lang = 'en') AS removed FROM documents GROUP BY 1")
def a7(spark, d):
    rows = src.table(spark, d, "documents").select(
        F.col("source").alias("dataset"), F.when(F.col("lang") == "en", V.TROJAN).otherwise("Other").alias("label")
    )
    return dist.removed_trojans(rows, ["dataset"])


@query("A10_length_histogram", f"""WITH {DOCS}, l AS (SELECT len(seq)::double AS n FROM docs), b AS (SELECT min(n) AS lo, max(n) AS hi, (max(n) - min(n)) / 50 AS w FROM l),
h AS (SELECT cast(least(floor((n - lo) / w), 49) AS int) AS bin, count(*) AS n FROM l, b GROUP BY 1)
SELECT i.bin, {sql_r6('lo + i.bin * w')} AS low, {sql_r6('lo + (i.bin + 1) * w')} AS high, coalesce(h.n, 0) AS n
FROM (SELECT unnest(range(50)) AS bin) i CROSS JOIN b LEFT JOIN h ON h.bin = i.bin""")
def a10(spark, d):
    out = dist.length_histogram(src.doc_samples(spark, d))
    return out.select("bin", r6("low").alias("low"), r6("high").alias("high"), "n")


@query("A11_class_weights", f"""WITH c AS (SELECT lang AS label, count(*) AS n FROM documents GROUP BY 1)
SELECT label, n, {sql_r6('sum(n) OVER () / (count(*) OVER () * n)::double')} AS weight FROM c""")
def a11(spark, d):
    return splits.class_weights(_labels(spark, d)).withColumn("weight", r6("weight"))


@query("A11_sample_weights", f"""SELECT cast(doc_id AS varchar) AS sample_id,
  {sql_r6('count(*) OVER () / ((SELECT count(DISTINCT lang) FROM documents) * count(*) OVER (PARTITION BY lang))::double')} AS weight FROM documents""")
def a11_rows(spark, d):
    return splits.add_class_weight(_labels(spark, d)).select("sample_id", r6("weight").alias("weight"))


@query("G13_domain_shift", f"""WITH {VOCAB}, c AS ({sql_calls('docs', 'doc_id')}),
u AS (SELECT doc_id % 2 AS k, count(*) FILTER (WHERE idx IS NULL) / count(*)::double AS unk FROM c LEFT JOIN vocab USING (token) GROUP BY 1),
l AS (SELECT doc_id % 2 AS k, count(*) AS n, avg(len(seq)) AS mean, quantile_cont(len(seq), 0.5) AS median FROM docs GROUP BY 1)
SELECT CASE k WHEN 0 THEN 'train' ELSE 'external' END AS dataset, n, {sql_r6('mean')} AS mean, {sql_r6('median')} AS median,
  {sql_r6('unk')} AS unk_ratio, (SELECT count(*) FROM vocab) AS vocab_size FROM l JOIN u USING (k)""")
def g13(spark, d):
    from seqlab import runtime

    docs = src.doc_samples(spark, d)
    train, external = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    out = dist.domain_shift(train, external, runtime.pin(v.build_vocabulary(train)))
    return out.select("dataset", "n", r6("mean").alias("mean"), r6("median").alias("median"), r6("unk_ratio").alias("unk_ratio"), "vocab_size")


_SAME = " AND ".join(f"coalesce(lag(token, {i}) OVER w = token, false)" for i in range(1, 6))


@query("S11_prepare_primary", f"""WITH {PAGES}, rk AS (SELECT sample_id, label, seq, row_number() OVER (PARTITION BY label ORDER BY md5(sample_id || ':42'), sample_id) AS r,
  count(*) OVER (PARTITION BY label) AS n FROM pg),
sp AS (SELECT sample_id, label, seq, CASE WHEN r <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM rk),
c0 AS ({sql_calls('sp', 'sample_id, label, split')}),
c1 AS (SELECT *, {_SAME} AS rep FROM c0 WINDOW w AS (PARTITION BY sample_id ORDER BY pos)), c AS (SELECT * FROM c1 WHERE NOT rep),
voc AS (SELECT token, row_number() OVER (ORDER BY token) + 1 AS idx FROM (SELECT DISTINCT token FROM c WHERE split = 'train'))
SELECT sample_id, label, split, string_agg(cast(coalesce(idx, 1) AS varchar), ' ' ORDER BY pos) AS enc FROM c LEFT JOIN voc USING (token) GROUP BY ALL""")
def s11(spark, d):
    train, test, _ = prepare_primary(src.page_samples(spark, d).drop("page_id"))
    both = train.unionByName(test)
    return both.select("sample_id", "label", "split", joined("encoded").alias("enc"))
