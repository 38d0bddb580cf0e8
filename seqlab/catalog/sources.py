"""Sources and sinks: tables are written in each layout below the shared folder
and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlab import runtime
from seqlab.catalog.labels import (
    _LABELLED, _NAMES, _SQL_FAMILY, _TRACES, _VOTES, _family_documents, _labelled, _primary_sql, stored_responses, trace_documents,
)
from seqlab.catalog.registry import DOCS, PAGES, joined, query, sql_joined
from seqlab.operators import labels as lab
from seqlab.operators import traces, vote
from seqlab.sources import adapters as src
from seqlab.sources import readers, writers
from seqlab.streaming import ingest


def _extracted_rows(spark, d):
    """The 10 trace columns from pages; some rows without a class."""
    pages = src.page_samples(spark, d)
    k = F.col("page_id")
    names = F.array(*[F.lit(x) for x in ("Spyware", "Trojan", "", "Worms")])
    return pages.select(
        F.col("sample_id").alias("sha256"), F.lit("fam").alias("family_avclass"), F.lit(None).cast("string").alias("family_cape"),
        F.lit(None).cast("string").alias("family_consensus"), F.when(k % 9 != 0, F.get(names, (k % 4).cast("int"))).alias("primary_class"),
        F.when(k % 2 == 0, F.array(F.lit("Trojan"), F.lit("Virus"))).otherwise(F.array().cast("array<string>")).alias("secondary_classes"),
        F.col("sequence").alias("api_sequence"), F.lit(1).alias("num_processes"), F.size("sequence").alias("sequence_length"), F.lit(0).alias("source_volume"),
    )


_EXTRACTED = PAGES + """, ex AS (SELECT sample_id, seq, CASE WHEN page_id % 9 <> 0 THEN ['Spyware', 'Trojan', '', 'Worms'][1 + page_id % 4] END AS label,
  CASE WHEN page_id % 2 = 0 THEN 'Trojan,Virus' ELSE '' END AS secondary FROM pg)"""


def _write_extracted(spark, d, chunks: int = 1):
    path = runtime.scratch_path(spark, "extracted")
    rows = _extracted_rows(spark, d)
    for i in range(chunks):
        part = rows.where(F.pmod(F.xxhash64("sha256"), F.lit(chunks)) == i) if chunks > 1 else rows
        writers.write_extracted(part, path)
    return path


@query("S1_aligned_text", f"WITH {_EXTRACTED} SELECT {sql_joined('seq')} AS seq, label, count(*) AS n FROM ex WHERE label IS NOT NULL AND label <> '' GROUP BY ALL")
def s1(spark, d):
    base = runtime.scratch_path(spark, "aligned")
    writers.write_aligned_text(spark, _write_extracted(spark, d), f"{base}/sequences", f"{base}/labels")
    rows = readers.read_aligned_text(spark, f"{base}/sequences", f"{base}/labels")
    return rows.groupBy(joined("sequence").alias("seq"), "label").agg(F.count("*").alias("n"))


@query("J9_positional_zip", "SELECT c_custkey AS a, c_custkey * 2 AS b FROM customer")
def j9(spark, d):
    base = runtime.scratch_path(spark, "zip")
    rows = runtime.pin(src.table(spark, d, "customer").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") * 2).alias("b")))
    for side in ("a", "b"):
        rows.select(F.col(side).cast("string").alias("value")).write.text(f"{base}/{side}")
    left = readers.numbered_lines(spark, f"{base}/a").select("line_no", F.col("value").cast("long").alias("a"))
    right = readers.numbered_lines(spark, f"{base}/b").select("line_no", F.col("value").cast("long").alias("b"))
    return left.join(right, "line_no").select("a", "b")


@query("S2_wide_csv", f"""WITH {PAGES} SELECT sample_id, CASE WHEN page_id % 2 = 0 THEN 'Benign' ELSE 'Malware' END AS label, {sql_joined('seq')} AS seq FROM pg""")
def s2(spark, d):
    path = runtime.scratch_path(spark, "wide")
    pages = src.page_samples(spark, d)
    lines = pages.select(
        F.concat(F.col("sample_id"), F.lit(","), (F.col("page_id") % 2).cast("string"), F.lit(", ,"), F.array_join("sequence", ","), F.lit(",,")).alias("value")
    )
    header = spark.createDataFrame([("sha256,labels,0,1,2",)], "value string")
    header.unionByName(lines).write.text(path)
    return readers.read_wide_csv(spark, path).select("sample_id", "label", joined("sequence").alias("seq"))


@query("S3_coded_csv", """WITH o AS (SELECT o_orderkey, [(o_orderkey * (i + 3) + o_custkey) % 9 FOR i IN range(100)] AS c, o_custkey % 2 AS m FROM orders)
SELECT cast(o_orderkey AS varchar) AS sample_id, CASE m WHEN 0 THEN 'Benign' ELSE 'Malware' END AS label,
  array_to_string([coalesce(['NtClose', NULL, 'recv', 'NtOpenFile'][1 + x], cast(x AS varchar)) FOR x IN c], ' ') AS seq FROM o""")
def s3(spark, d):
    path = runtime.scratch_path(spark, "coded")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = src.table(spark, d, "orders").select(
        k.cast("string").alias("hash"), *[((k * (i + 3) + c) % 9).alias(f"t_{i}") for i in range(100)], (c % 2).alias("malware")
    )
    rows.write.option("header", True).csv(path)
    names = {0: "NtClose", 2: "recv", 3: "NtOpenFile"}
    return readers.read_coded_csv(spark, path, names).select("sample_id", "label", joined("sequence").alias("seq"))


@query("S4_read_extracted", f"WITH {_EXTRACTED} SELECT sample_id, {sql_joined('seq')} AS seq, label, 'fam' AS family, secondary FROM ex WHERE label NOT IN ('', 'Trojan')")
def s4(spark, d):
    rows = readers.read_extracted(spark, _write_extracted(spark, d))
    return rows.select("sample_id", joined("sequence").alias("seq"), "label", "family", F.array_join("secondary_classes", ",").alias("secondary"))


@query("S5_write_extracted", f"WITH {_EXTRACTED} SELECT sample_id AS sha256, label AS primary_class, secondary AS secondary_classes, {sql_joined('seq')} AS api_sequence, len(seq) AS sequence_length FROM ex")
def s5(spark, d):
    rows = spark.read.parquet(_write_extracted(spark, d, chunks=3))
    return rows.select("sha256", "primary_class", "secondary_classes", "api_sequence", "sequence_length")


@query("U5_concatenated_chunks", f"WITH {_EXTRACTED} SELECT count(*) AS n, sum(len(seq))::bigint AS calls FROM ex")
def u5(spark, d):
    rows = spark.read.parquet(_write_extracted(spark, d, chunks=3))
    return rows.agg(F.count("*").alias("n"), F.sum("sequence_length").alias("calls"))


@query("S6_aligned_export", f"WITH {_EXTRACTED} SELECT label, count(*) AS n FROM ex WHERE label NOT IN ('', 'Trojan') GROUP BY 1")
def s6(spark, d):
    base = runtime.scratch_path(spark, "export")
    writers.write_aligned_text(spark, _write_extracted(spark, d), f"{base}/s", f"{base}/l", drop_trojan=True)
    return spark.read.text(f"{base}/l").groupBy(F.col("value").alias("label")).agg(F.count("*").alias("n"))


@query("S7_trace_files", f"WITH {_TRACES} SELECT fname, status, CASE WHEN status = 'ok' THEN len(tags) ELSE 0 END AS n FROM tr")
def s7(spark, d):
    path = runtime.scratch_path(spark, "traces")
    docs = trace_documents(spark, d)
    # one document per file, as sandboxes store them
    writers.write_text_files(docs, path)
    return traces.parse_traces(readers.read_trace_files(spark, path)).select("fname", "status", F.col("sequence_length").alias("n"))


@query("S8_label_files", _primary_sql(False))
def s8(spark, d):
    path = runtime.scratch_path(spark, "labels")
    docs = _family_documents(spark, d)
    docs.repartitionByRange("doc").sortWithinPartitions("doc").select("value").write.text(path)
    return lab.primary_labels(readers.read_label_documents(spark, path, per_line=True))


# four files of one object each, a family's reports in one list; ranges of 64 KB, so that lists run over many of them
@query("S8_label_objects", f"""SELECT o_custkey || '.json' AS fname,
  arg_max({_SQL_FAMILY}, (o_custkey % 4, cast(left(o_orderpriority, 1) AS int), o_orderkey)) AS family FROM orders WHERE o_orderpriority <> '3-MEDIUM' GROUP BY 1""")
def s8_objects(spark, d):
    path = runtime.scratch_path(spark, "label-objects")
    orders = src.table(spark, d, "orders").select(
        (F.col("o_custkey") % 4).alias("f"), F.substring("o_orderpriority", 1, 1).cast("int").alias("p"), "o_orderkey", "o_custkey", "o_orderpriority"
    )
    element = F.concat(F.lit(',  {"report" : "'), F.col("o_custkey").cast("string"), F.lit('.json", "note": "] } \\" , {"}'))
    names = F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair])
    head = F.concat(F.lit(',\n"'), names[F.col("o_orderpriority")], F.lit('": {"n_reports": 9, "reports": [{"report": "none.json"}'))
    ends = orders.select("f", "p", "o_orderpriority").distinct()
    low, high = F.lit(-1).cast("long"), F.lit(2**62).cast("long")
    lines = orders.select("f", "p", F.col("o_orderkey").alias("k"), element.alias("value"))
    lines = lines.unionByName(ends.select("f", "p", low.alias("k"), head.alias("value"))).unionByName(ends.select("f", "p", high.alias("k"), F.lit("]}").alias("value")))
    for p, mark in ((0, '{"n_reports": 10'), (9, "}")):
        lines = lines.unionByName(orders.select("f", F.lit(p).alias("p"), low.alias("k"), F.lit(mark).alias("value")).distinct())
    lines.repartition(4, "f").sortWithinPartitions("f", "p", "k").select("f", "value").write.partitionBy("f").text(path)
    return lab.primary_labels(readers.read_label_documents(spark, path, split_bytes=1 << 16)).where("fname <> 'none.json'")


@query("S9_report_maps", f"""WITH {_VOTES}, c AS (SELECT c_custkey AS hash FROM customer) SELECT cast(c.hash AS varchar) AS hash, fv.family FROM c LEFT JOIN fv ON fv.hash = c.hash""")
def s9_maps(spark, d):
    path = runtime.scratch_path(spark, "report-maps")
    asked = src.table(spark, d, "customer").select(F.col("c_custkey").alias("hash"))
    # a response lists the engines of a hash in one map
    listed = F.map_from_entries(F.sort_array(F.collect_list(F.struct("engine", F.struct(F.lit("malicious").alias("category"), "result")))))
    body = F.struct(F.struct(F.struct(F.col("r").alias("last_analysis_results")).alias("attributes")).alias("data"))
    stored = src.reports(spark, d).groupBy("hash").agg(listed.alias("r")).select("hash", F.to_json(body).alias("response"))
    entry = F.concat(F.lit(', "'), F.col("hash").cast("string"), F.lit('": '), F.coalesce("response", F.lit("null")))
    lines = asked.join(stored, "hash", "left").select((F.col("hash") % 4).alias("f"), F.lit(1).alias("p"), entry.alias("value"))
    for p, mark in ((0, '{"": null'), (2, "}")):
        lines = lines.unionByName(lines.select("f", F.lit(p).alias("p"), F.lit(mark).alias("value")).distinct())
    lines.repartition(4, "f").sortWithinPartitions("f", "p").select("f", "value").write.partitionBy("f").text(path)
    back = readers.read_report_map(spark, path, split_bytes=1 << 16)
    keys = asked.select(F.col("hash").cast("string").alias("hash"))
    return keys.join(vote.vote_family(vote.report_rows(back)), "hash", "left").select("hash", "family")


@query("S9_stored_reports", f"""WITH {_VOTES}, c AS (SELECT c_custkey AS hash FROM customer) SELECT cast(c.hash AS varchar) AS hash, fv.family FROM c LEFT JOIN fv ON fv.hash = c.hash""")
def s9(spark, d):
    path = runtime.scratch_path(spark, "reports")
    stored = stored_responses(spark, d).withColumn("hash", F.col("hash").cast("string"))
    asked = src.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("hash"))
    absent = asked.join(stored, "hash", "left_anti").withColumn("response", F.lit(None).cast("string"))
    writers.write_reports(stored.unionByName(absent), path)
    back = readers.read_reports(spark, path)
    return asked.join(vote.vote_family(vote.report_rows(back)), "hash", "left").select("hash", "family")


@query("S10_label_report", f"""WITH {_LABELLED}, k AS (SELECT * FROM lb WHERE status <> 'dropped') SELECT label, count(*) AS n, (SELECT count(*) FROM k) AS total_labeled,
  (SELECT count(*) FROM lb WHERE status = 'dropped') AS total_dropped FROM k GROUP BY 1""")
def s10(spark, d):
    path = runtime.scratch_path(spark, "report")
    writers.write_label_report(_labelled(spark, d), path)
    stats = spark.read.schema("total_labeled long, total_dropped long, family_distribution map<string,long>").json(f"{path}/stats")
    return stats.select("total_labeled", "total_dropped", F.explode("family_distribution").alias("label", "n"))


@query("S11_reuse_or_build", f"WITH {DOCS} SELECT label, count(*) AS n FROM docs GROUP BY 1")
def s11(spark, d):
    path = runtime.scratch_path(spark, "cache")
    build = lambda: src.table(spark, d, "documents").groupBy(F.col("lang").alias("label")).agg(F.count("*").alias("n"))
    writers.reuse_or_build(spark, path, build)
    return writers.reuse_or_build(spark, path, lambda: build().where("false"))


@query("S13_resumable_ingest", f"WITH {_TRACES} SELECT fname, CASE WHEN status = 'ok' THEN len(tags) ELSE 0 END AS n FROM tr")
def s13(spark, d):
    path = runtime.scratch_path(spark, "ingest")
    docs = trace_documents(spark, d)
    for share in (docs.where("page_id % 3 = 0"), docs):  # the second run only adds what is missing
        stored = writers.append_new(traces.parse_traces(share).select("fname", F.col("sequence_length").alias("n")), path, "fname")
    return stored.select("fname", "n")


def _ingest_twice(spark, d):
    """A store filled by two runs, the second after the other files arrived; and the last batch of the first run."""
    base = runtime.scratch_path(spark, "stream-ingest")
    docs = trace_documents(spark, d)
    last = -1
    for i, share in enumerate((docs.where("page_id % 3 = 0"), docs.where("page_id % 3 <> 0"))):
        writers.write_text_files(share, f"{base}/files")
        files = ingest.stream_trace_files(spark, f"{base}/files")
        ingest.ingest_traces(files, f"{base}/store", f"{base}/log").awaitTermination()
        if i == 0:
            last = ingest.ingest_counts(spark, f"{base}/store").agg(F.max("batch")).first()[0]
    return f"{base}/store", last


@query("S13_file_ingest", f"""WITH {_TRACES} SELECT fname, status, CASE WHEN status = 'ok' THEN array_to_string(tags, ' ') ELSE '' END AS seq,
  CASE WHEN page_id % 3 = 0 THEN 1 ELSE 2 END AS run FROM tr""")
def s13_files(spark, d):
    store, last = _ingest_twice(spark, d)
    run = F.when(F.col("batch") <= last, 1).otherwise(2)
    return ingest.ingested(spark, store).select("fname", "status", joined("sequence").alias("seq"), run.alias("run"))


@query("A9_ingest_counts", f"""WITH {_TRACES} SELECT CASE WHEN page_id % 3 = 0 THEN 1 ELSE 2 END AS run, count(*) AS files,
  count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'empty') AS empty, count(*) FILTER (status = 'unparsed') AS unparsed,
  coalesce(sum(len(tags)) FILTER (status = 'ok'), 0)::bigint AS calls FROM tr GROUP BY 1""")
def a9_ingest(spark, d):
    store, last = _ingest_twice(spark, d)
    run = F.when(F.col("batch") <= last, 1).otherwise(2)
    totals = [F.sum(c).alias(c) for c in ("files", "ok", "empty", "unparsed", "calls")]
    return ingest.ingest_counts(spark, store).groupBy(run.alias("run")).agg(*totals)
