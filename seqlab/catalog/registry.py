"""Registered queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def r6(value: Column | str) -> Column:
    """Six decimals, without negative zero."""
    return F.round(value, 6) + F.lit(0.0)


def sql_r6(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0)"


def joined(values: Column | str) -> Column:
    return F.array_join(values, " ")


def sql_joined(expr: str) -> str:
    return f"coalesce(array_to_string({expr}, ' '), '')"


# ---- shared inputs in SQL -------------------------------------------------------
DOCS = """docs AS (
  SELECT cast(doc_id AS varchar) AS sample_id, doc_id, regexp_extract_all(lower(text), '[a-z]+', 0) AS seq,
         lang AS label, source FROM documents)"""
RAW = DOCS + """, raw AS (
  SELECT sample_id, doc_id, label, [CASE WHEN length(x) = 1 THEN '__' || x ELSE x END FOR x IN seq] AS seq FROM docs)"""
PAGES = """pg AS (
  SELECT cast(page_id AS varchar) AS sample_id, page_id, regexp_extract_all(html, '<([a-z0-9]+)', 1) AS seq,
         'c' || cast(page_id % 4 AS varchar) AS label FROM pages)"""
EVENTS = """ev AS (
  SELECT cast(user_id AS varchar) AS sample_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos,
         event_type || '_' || cast(cast(floor(value / 10) AS int) AS varchar) AS token FROM events)"""
EMBED = """e0 AS (SELECT vec_id, label AS y_true, [exp(cast(x AS double)) FOR x IN embedding[1:10]] AS e FROM embeddings),
pe AS (SELECT cast(vec_id AS varchar) AS sample_id, vec_id, y_true, list_position(e, list_max(e)) - 1 AS y_pred,
  [x / list_sum(e) FOR x IN e] AS probs, list_reverse([x / list_sum(e) FOR x IN e]) AS p_second FROM e0)"""
PRED_ORDERS = """po AS (SELECT o_orderkey AS sample_id, cast(substring(o_orderpriority, 1, 1) AS int) - 1 AS y_true,
  cast(o_custkey % 5 AS int) AS y_pred, o_orderstatus AS dataset FROM orders)"""


def sql_calls(source: str, columns: str = "sample_id") -> str:
    """``SELECT columns, pos, token`` from a table with a ``seq`` list."""
    return f"SELECT {columns}, unnest(generate_series(1, len(seq))) AS pos, unnest(seq) AS token FROM {source}"
