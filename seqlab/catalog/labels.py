"""Label files, unified labels, target selection, votes and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlab import fixed_values as V
from seqlab import runtime
from seqlab.catalog.registry import EVENTS, joined, query
from seqlab.functions.encoding import decode_codes
from seqlab.operators import labels as lab
from seqlab.operators import traces, vote
from seqlab.sources import adapters as src

CHUNK = 1000  # orders per label document

# ---- label documents derived from orders: one family-keyed JSON object per chunk and priority -----
_NAMES = {"1-URGENT": "RedLine", "2-HIGH": " Berbew ", "3-MEDIUM": "(n/a)", "4-NOT SPECIFIED": "Amadey", "5-LOW": "Vbclone"}
_SQL_FAMILY = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v.strip().lower()}'" for k, v in _NAMES.items()) + " END"
_SQL_ORDER = "(o_orderkey // 1000, cast(left(o_orderpriority, 1) AS int), o_orderkey)"


def _orders(spark, d):
    return src.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")


def _family_documents(spark, d, shift: int = 0):
    """(doc, value): at most CHUNK reports in each document."""
    rows = _orders(spark, d)
    family = F.lit(None).cast("string")
    for k, name in _NAMES.items():
        family = F.when(F.col("o_orderpriority") == k, name).otherwise(family)
    report = F.concat(((F.col("o_custkey") + shift).cast("string")), F.lit(".json"))
    listed = rows.groupBy(
        F.floor(F.col("o_orderkey") / CHUNK).alias("chunk"), F.substring("o_orderpriority", 1, 1).cast("int").alias("p"), family.alias("family")
    ).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", report.alias("report")))).alias("r"))
    body = F.struct(F.size("r").alias("n_reports"), F.transform("r", lambda x: F.struct(x["report"].alias("report"))).alias("reports"))
    text = F.concat(F.lit('{"n_reports": 10, '), F.substring(F.to_json(F.create_map("family", body)), F.lit(2), F.lit(2_000_000_000)))
    return listed.select((F.col("chunk") * 10 + F.col("p")).alias("doc"), text.alias("value"))


def _primary_sql(keep_na: bool, shift: int = 0) -> str:
    where = "" if keep_na else "WHERE o_orderpriority <> '3-MEDIUM'"
    return f"""SELECT (o_custkey + {shift}) || '.json' AS fname, arg_max({_SQL_FAMILY}, {_SQL_ORDER}) AS family FROM orders {where} GROUP BY 1"""


@query("J1_primary_labels", _primary_sql(False))
def j1(spark, d):
    return lab.primary_labels(_family_documents(spark, d))


@query("J2_secondary_labels", _primary_sql(True, 3))
def j2(spark, d):
    return lab.secondary_labels(_family_documents(spark, d, 3))


def _consensus_documents(spark, d):
    rows = src.table(spark, d, "customer").select("c_custkey")
    k = F.col("c_custkey")
    names = F.array(*[F.lit(x) for x in ("Redline", " amadey", "", "Vbclone")])
    body = F.struct(
        F.get(names, (k % 4).cast("int")).alias("avclass"), F.get(names, (k % 3).cast("int")).alias("cape")
    )
    entry = F.struct(k.cast("string").alias("key"), body.alias("value"))
    docs = rows.groupBy(F.floor(k / CHUNK).alias("doc")).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    text = F.concat(F.lit('{"reports_both_no_consensus": 3, '), F.substring(F.to_json("m"), F.lit(2), F.lit(2_000_000_000)))
    return docs.select("doc", text.alias("value"))


_PICK = "nullif(['redline', 'amadey', '', 'vbclone'][1 + c_custkey % {n}], '')"
_CONSENSUS = f"SELECT c_custkey || '.json' AS fname, {_PICK.format(n=4)} AS avclass, {_PICK.format(n=3)} AS cape FROM customer"


@query("J3_consensus_labels", _CONSENSUS)
def j3(spark, d):
    return lab.consensus_labels(_consensus_documents(spark, d))


_UNIFIED = f"""p AS ({_primary_sql(False)}), s AS ({_primary_sql(True, 3)}), c AS ({_CONSENSUS}),
un AS (SELECT p.fname, p.family AS avclass, CASE WHEN s.family NOT IN ('(n/a)', 'n/a', 'none') THEN s.family END AS cape,
  CASE WHEN c.avclass = c.cape THEN c.avclass END AS consensus, replace(p.fname, '.json', '') AS sha256
  FROM p LEFT JOIN s USING (fname) LEFT JOIN c USING (fname))"""


def _unified(spark, d):
    return lab.unify_labels(
        lab.primary_labels(_family_documents(spark, d)), lab.secondary_labels(_family_documents(spark, d, 3)),
        lab.consensus_labels(_consensus_documents(spark, d)),
    )


@query("J4_unified_labels", f"WITH {_UNIFIED} SELECT * FROM un")
def j4(spark, d):
    return _unified(spark, d)


@query("J5_split_targets", f"""WITH {_UNIFIED}, l AS (SELECT DISTINCT c_custkey || '.json' AS fname FROM customer WHERE c_custkey % 5 <> 0)
SELECT fname, CASE WHEN fname IN (SELECT fname FROM l) THEN 'found' ELSE 'missing' END AS side FROM un""")
def j5(spark, d):
    listing = src.table(spark, d, "customer").where("c_custkey % 5 <> 0").select(
        F.concat(F.col("c_custkey").cast("string"), F.lit(".json")).alias("fname")
    )
    found, missing = lab.split_targets(_unified(spark, d).select("fname"), listing)
    return found.withColumn("side", F.lit("found")).unionByName(missing.withColumn("side", F.lit("missing")))


_FAMILY_ROWS = ", ".join(
    f"({i}, '{f}', '{p}', '{','.join(s)}')" for i, (f, (p, s)) in enumerate(V.FAMILY_CLASSES.items())
)
_N_FAMILIES = len(V.FAMILY_CLASSES)


def _order_families(spark, d):
    names = F.array(*[F.lit(f) for f in V.FAMILY_CLASSES])
    k = F.col("o_orderkey") % (_N_FAMILIES + 6)
    return _orders(spark, d).select("o_orderkey", F.coalesce(F.get(names, k.cast("int")), F.lit("unheard")).alias("avclass"))


@query("J6_family_classes", f"""WITH f(i, family, p, s) AS (VALUES {_FAMILY_ROWS})
SELECT o_orderkey, coalesce(family, 'unheard') AS avclass, p AS primary_class, coalesce(s, '') AS secondary
FROM orders LEFT JOIN f ON o_orderkey % {_N_FAMILIES + 6} = i""")
def j6(spark, d):
    out = lab.add_classes(_order_families(spark, d), lab.family_dimension(spark))
    return out.select("o_orderkey", "avclass", "primary_class", F.array_join("secondary_classes", ",").alias("secondary"))


_CODES = "['NtClose', NULL, 'recv', 'NtOpenFile', 'send']"


@query("J11_decode_codes", f"SELECT o_orderkey, coalesce({_CODES}[1 + o_custkey % 8], cast(o_custkey % 8 AS varchar)) AS token FROM orders")
def j11(spark, d):
    codes = F.array((F.col("o_custkey") % 8).cast("int"))
    names = {0: "NtClose", 2: "recv", 3: "NtOpenFile", 4: "send"}
    return _orders(spark, d).select("o_orderkey", F.get(decode_codes(codes, names), F.lit(0)).alias("token"))


# ---- target selection: families from order keys, uneven sizes -----------------------------------
def _selection_input(spark, d):
    k = F.col("o_orderkey")
    family = F.concat(F.lit("fam"), F.floor(F.sqrt((k % 900).cast("double"))).cast("int").cast("string"))
    return _orders(spark, d).select(family.alias("avclass"), F.concat(k.cast("string"), F.lit(".json")).alias("fname"))


_SELECT = """si AS (SELECT 'fam' || cast(floor(sqrt(o_orderkey % 900)) AS int) AS avclass, o_orderkey || '.json' AS fname FROM orders),
sz AS (SELECT avclass AS family, count(*) AS raw_count FROM si GROUP BY 1 HAVING count(*) >= 50),
pl AS (SELECT *, least(raw_count, 300) AS capped_count, row_number() OVER (ORDER BY raw_count DESC, family) AS rank FROM sz QUALIFY rank <= 25)"""


@query("A4_family_plan", f"WITH {_SELECT} SELECT family, raw_count, capped_count, rank FROM pl")
def a4(spark, d):
    return lab.family_plan(_selection_input(spark, d))


@query("A4_plan_totals", f"""WITH {_SELECT} SELECT count(*) AS families, sum(raw_count)::bigint AS total_raw, sum(capped_count)::bigint AS total_capped,
  max(raw_count) FILTER (WHERE rank = 25) AS count_at_rank_k FROM pl""")
def a4t(spark, d):
    return lab.plan_totals(lab.family_plan(_selection_input(spark, d)))


@query("K1_select_targets", f"""WITH {_SELECT}, r AS (SELECT avclass, fname, row_number() OVER (PARTITION BY avclass ORDER BY fname) AS n
  FROM si WHERE avclass IN (SELECT family FROM pl)) SELECT avclass, fname FROM r WHERE n <= 300""")
def k1(spark, d):
    return lab.select_targets(_selection_input(spark, d)).select("avclass", "fname")


@query("K9_sorted_targets", f"""WITH {_SELECT}, r AS (SELECT avclass, fname, row_number() OVER (PARTITION BY avclass ORDER BY fname) AS n
  FROM si WHERE avclass IN (SELECT family FROM pl)) SELECT fname FROM r WHERE n <= 300 ORDER BY fname""")
def k9(spark, d):
    return lab.select_targets(_selection_input(spark, d)).select("fname").orderBy("fname")


@query("A5_class_preview", f"""WITH f(i, family, p, s) AS (VALUES {_FAMILY_ROWS}),
o AS (SELECT coalesce(family, 'unheard') AS family FROM orders LEFT JOIN f ON o_orderkey % {_N_FAMILIES + 6} = i),
pl AS (SELECT family, least(count(*), 300) AS c FROM o GROUP BY 1 HAVING count(*) >= 50 ORDER BY count(*) DESC, family LIMIT 25),
n AS (SELECT coalesce(p, 'unmapped') AS class_name, sum(c)::bigint AS c FROM pl LEFT JOIN f USING (family) GROUP BY 1)
SELECT k.class_name, coalesce(n.c, 0) AS projected FROM (SELECT unnest({V.PLAN_CLASSES + ['unmapped']}) AS class_name) k LEFT JOIN n USING (class_name)""")
def a5(spark, d):
    rows = _order_families(spark, d).withColumn("fname", F.col("o_orderkey").cast("string"))
    return lab.class_preview(lab.family_plan(rows), lab.family_dimension(spark))


# ---- vote ----------------------------------------------------------------------------------------
# The seven results of the report rows vote as follows; the regular expressions behind this table are
# checked case by case in the tests.
_VOTES = """vt(k, family) AS (VALUES (1, 'Trojan'), (2, 'Downloader'), (3, 'Worms'), (4, 'Backdoor')),
vv AS (SELECT o_custkey AS hash, family, count(*) AS votes FROM orders JOIN vt ON o_orderkey % 7 = k GROUP BY ALL),
bs AS (SELECT hash, arg_min(family, (-votes, family)) AS top, arg_min(family, (-votes, family)) FILTER (WHERE family <> 'Trojan') AS spec,
  max(votes) FILTER (WHERE family <> 'Trojan') AS n, coalesce(sum(votes) FILTER (WHERE family = 'Trojan'), 0) AS t FROM vv GROUP BY 1),
fv AS (SELECT hash, CASE WHEN spec IS NOT NULL AND (t = 0 OR (n >= 5 AND n >= 0.30 * t)) THEN spec ELSE top END AS family FROM bs)"""


@query("V1_family_votes", f"WITH {_VOTES} SELECT hash, family, votes FROM vv")
def v1_votes(spark, d):
    return vote.family_votes(src.reports(spark, d))


@query("V1_family_vote", f"WITH {_VOTES} SELECT hash, family FROM fv")
def v1(spark, d):
    return vote.vote_family(src.reports(spark, d))


def stored_responses(spark, d):
    """(hash, response): the report rows as stored JSON, at most CHUNK engines each."""
    rows = src.reports(spark, d)
    part = F.floor(F.substring("engine", 2, 18).cast("long") / CHUNK)
    engines = F.map_from_entries(F.collect_list(F.struct("engine", F.struct(F.lit("malicious").alias("category"), "result"))))
    attributes = F.struct(F.col("r").alias("last_analysis_results"))
    return rows.groupBy("hash", part.alias("part")).agg(engines.alias("r")).select(
        "hash", F.to_json(F.struct(F.struct(attributes.alias("attributes")).alias("data"))).alias("response")
    )


@query("V1_family_vote_json", f"WITH {_VOTES} SELECT hash, family FROM fv")
def v1_json(spark, d):
    return vote.vote_family(vote.report_rows(stored_responses(spark, d)))


_LABELLED = f"""{_VOTES}, sm AS (SELECT c_custkey AS hash, CASE WHEN c_custkey % 3 = 0 THEN 'Benign' ELSE 'Malware' END AS l FROM customer),
lb AS (SELECT sm.hash, CASE WHEN l = 'Benign' THEN 'benign' WHEN family IS NOT NULL THEN 'labelled' ELSE 'dropped' END AS status,
  CASE WHEN l = 'Benign' THEN l ELSE family END AS label FROM sm LEFT JOIN fv USING (hash))"""


def _labelled(spark, d):
    samples = src.table(spark, d, "customer").select(
        F.col("c_custkey").alias("hash"), F.when(F.col("c_custkey") % 3 == 0, "Benign").otherwise("Malware").alias("label")
    )
    return lab.label_from_reports(samples, src.reports(spark, d))


@query("J8_label_from_reports", f"WITH {_LABELLED} SELECT hash, status, label FROM lb")
def j8(spark, d):
    return _labelled(spark, d).select("hash", "status", "label")


@query("A6_label_totals", f"""WITH {_LABELLED} SELECT count(*) FILTER (WHERE status <> 'dropped') AS total_labeled, count(*) FILTER (WHERE status = 'benign') AS benign,
  count(*) FILTER (WHERE status = 'labelled') AS malware, count(*) FILTER (WHERE status = 'dropped') AS total_dropped FROM lb""")
def a6(spark, d):
    return lab.label_totals(_labelled(spark, d))


# ---- traces: conversations as processes, pages as sources of broken documents ------------------------
def trace_documents(spark, d):
    """One JSON trace per page: two processes with the page's tags as calls, dirty
    entries between them; every fifth document is broken, every seventh empty."""
    pages = src.table(spark, d, "pages").select("page_id", F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), F.lit(1)).alias("tags"))
    half = F.floor(F.size("tags") / 2).cast("int")

    def calls(tags):
        items = F.transform(tags, lambda t: F.to_json(F.struct(F.upper(t).alias("api"), F.lit("x").alias("category"))))
        return F.concat(F.lit('['), F.array_join(F.concat(F.array(F.lit('"stray"'), F.lit('{"category":"none"}'), F.lit('{"api":7}')), items), ","), F.lit("]"))

    body = F.concat(
        F.lit('{"behavior":{"processes":[{"process_id":1,"calls":'), calls(F.slice("tags", F.lit(1), half)),
        F.lit('},"noise",{"calls":3},{"process_id":2,"calls":'), calls(F.slice("tags", half + 1, F.size("tags"))), F.lit("}]}}"),
    )
    text = F.when(F.col("page_id") % 5 == 4, '{"behavior":').when(F.col("page_id") % 7 == 6, '{"behavior":{"processes":[]}}').otherwise(body)
    return pages.select("page_id", F.concat(F.col("page_id").cast("string"), F.lit(".json")).alias("fname"), text.alias("text"))


_TRACES = """tr AS (SELECT page_id, page_id || '.json' AS fname, CASE WHEN page_id % 5 = 4 THEN 'unparsed' WHEN page_id % 7 = 6 THEN 'empty' ELSE 'ok' END AS status,
  regexp_extract_all(html, '<([a-z0-9]+)', 1) AS tags FROM pages)"""


@query("T1_parse_traces", f"""WITH {_TRACES} SELECT page_id, status, CASE WHEN status = 'ok' THEN array_to_string(tags, ' ') ELSE '' END AS seq,
  CASE WHEN status = 'ok' THEN 4 ELSE 0 END AS num_processes, CASE WHEN status = 'ok' THEN len(tags) ELSE 0 END AS sequence_length FROM tr""")
def t1(spark, d):
    out = traces.parse_traces(trace_documents(spark, d))
    return out.select("page_id", "status", joined("sequence").alias("seq"), "num_processes", "sequence_length")


@query("T1_parse_traces_events", f"""WITH {EVENTS} SELECT sample_id, (pos - 1) // 4096 AS part, string_agg(lower(token), ' ' ORDER BY pos) AS seq, count(*) AS n FROM ev GROUP BY ALL""")
def t1_events(spark, d):
    calls = src.event_calls(spark, d).withColumn("part", F.floor((F.col("pos") - 1) / 4096))
    # documents of at most 4096 calls each
    listed = calls.groupBy("sample_id", "part").agg(F.sort_array(F.collect_list(F.struct("pos", F.upper("token").alias("api")))).alias("c"))
    text = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("c").alias("calls"))).alias("processes")).alias("behavior")))
    out = traces.parse_traces(listed.select("sample_id", "part", text.alias("text")))
    return out.select("sample_id", "part", joined("sequence").alias("seq"), F.col("sequence_length").alias("n"))


@query("T2_trace_rows", f"""WITH {_TRACES}, {_UNIFIED}, f(i, family, p, s) AS (VALUES {_FAMILY_ROWS})
SELECT replace(tr.fname, '.json', '') AS sha256, avclass AS family_avclass, cape AS family_cape, consensus AS family_consensus,
  p AS primary_class, coalesce(s, '') AS secondary_classes, array_to_string(tags, ' ') AS api_sequence, 4 AS num_processes, len(tags) AS sequence_length
FROM tr JOIN un USING (fname) LEFT JOIN f ON avclass = family WHERE status = 'ok'""")
def t2(spark, d):
    parsed = traces.parse_traces(trace_documents(spark, d))
    rows = traces.trace_rows(parsed, _unified(spark, d), lab.family_dimension(spark))
    return rows.select(
        "sha256", "family_avclass", "family_cape", "family_consensus", "primary_class",
        F.array_join("secondary_classes", ",").alias("secondary_classes"), joined("api_sequence").alias("api_sequence"),
        "num_processes", "sequence_length",
    )


@query("T3_trace_schema", "SELECT 'OBJECT<behavior: OBJECT<processes: ARRAY<VARIANT>>>' AS structure")
def t3(spark, d):
    return traces.trace_schema(trace_documents(spark, d))


@query("T3_call_fields", f"""WITH {_TRACES}, n AS (SELECT sum(len(tags) + 6)::bigint AS calls, sum(len(tags))::bigint AS hits FROM tr WHERE status = 'ok')
SELECT f AS field, calls, CASE WHEN f = 'api' THEN hits ELSE 0 END AS calls_with_text FROM n, (SELECT unnest(['api', 'name', 'function', 'API']) AS f)""")
def t3_fields(spark, d):
    return traces.call_field_candidates(trace_documents(spark, d))


@query("A9_outcome_counts", f"WITH {_TRACES} SELECT status, count(*) AS n FROM tr GROUP BY 1")
def a9(spark, d):
    return traces.outcome_counts(traces.parse_traces(trace_documents(spark, d)))
