"""One registered query per operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlab.llm import (
    embedding_tiles, gated_lm, language_id, merkle_manifest, mixture_packing, pii_surrogates, piece_viterbi, quality_network,
    simhash_tiles, suffix_radix, topk_search, turn_repair, warc_index,
)
from seqlab.llm.checksum_sql import manifest_sql, repair_sql
from seqlab.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_tiles.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op3_embedding_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_tiles.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op9_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_packing.pack(table(spark, sf_dir, "documents"), mixture_packing.public_vocabulary())


@query
def op10_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the pieces of its text and whether decoding gives the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_viterbi.round_trip(docs, piece_viterbi.public_model()).select(
        "doc_id", "n_ids", "ids_crc32", "score", "n_bytes", "same_text"
    )


ORACLES["op7_topk_search"] = """
WITH v AS (
  SELECT vec_id, [cast(floor(64 * cast(x AS double)) AS bigint) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, cast(list_dot_product(cast(q.e AS double[]), cast(c.e AS double[])) AS bigint) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS int) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


@query
def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_index.archived(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query
def op5_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = quality_network.scored(docs, labels, quality_network.fold("doc_id") % 5 != 0)
    return found.select("doc_id", (quality_network.fold("doc_id") % 5 == 0).alias("held_out"), "score", "predicted")


@query
def op6_suffix_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return suffix_radix.repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text with surrogates; a deployment passes its own secret key."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii_surrogates.replaced(docs, "corpus-surrogates").select("doc_id", "text", "n_replaced")


@query
def op2_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated_lm.scored(table(spark, sf_dir, "documents"))


ORACLES["op1_warc_index"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
-- five hexadecimal digits are four characters of base 32
c AS (SELECT page_id, unnest(range(8)) AS i, cast('0x' || substr(h, 5 * unnest(range(8)) + 1, 5) AS int) AS v FROM p),
d AS (SELECT page_id, string_agg(list_reduce([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31) + 1, 1) FOR s IN [15, 10, 5, 0]],
  lambda a, b: a || b), '' ORDER BY i) AS digest FROM c GROUP BY page_id),
g AS (SELECT h, max(page_id) AS last FROM p GROUP BY h)
SELECT page_id, cast(n AS bigint) AS payload_bytes, digest AS payload_digest,
  CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type, nullif(last, page_id) AS refers_to
FROM p JOIN g USING (h) JOIN d USING (page_id)"""

ORACLES["op3_embedding_tiles"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, cast(embedding AS double[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.c),
c AS (SELECT a, min(c) AS component_id FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.a AS vec_id, coalesce(k.n, 0)::bigint AS n_links, component_id, c.a = component_id AS kept FROM c LEFT JOIN k ON k.a = c.a"""


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(table(spark, sf_dir, "documents"))


ORACLES["op13_merkle_manifest"] = manifest_sql()


@query
def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = quality_network.fold("doc_id") % 5
    found = language_id.identified(table(spark, sf_dir, "documents"), fold != 0)
    return found.select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score", "accepted")


@query
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repaired(table(spark, sf_dir, "conversations"))


ORACLES["op12_turn_repair"] = repair_sql()
