"""Nested sandbox traces to samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.functions.arrays import let
from seqlab.functions.cleaning import hash_of_report
from seqlab.operators.labels import add_classes


def _string_field(obj: Column, path: str) -> Column:
    """A field's text only when it is a JSON string."""
    value = F.try_variant_get(obj, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def trace_calls(trace: Column) -> Column:
    """Lowercase call names of a parsed trace, process by process. Entries of
    the wrong shape are skipped."""
    processes = F.try_variant_get(trace, "$.behavior.processes", "array<variant>")
    per_process = F.transform(
        processes,
        lambda p: F.transform(
            F.coalesce(F.try_variant_get(p, "$.calls", "array<variant>"), F.array().cast("array<variant>")),
            lambda c: F.lower(_string_field(c, "$.api")),
        ),
    )
    return let(F.flatten(per_process), lambda a: F.filter(a, lambda x: x.isNotNull() & (x != "")))


def parse_traces(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``sequence``, ``num_processes``, ``sequence_length`` and ``status``
    ('ok', 'unparsed', 'empty') to rows with one JSON document each."""
    parsed = docs.withColumn("_t", F.try_parse_json(text))
    processes = F.try_variant_get("_t", "$.behavior.processes", "array<variant>")
    out = parsed.withColumn("sequence", F.coalesce(trace_calls(F.col("_t")), F.array().cast("array<string>")))
    return out.select(
        *docs.columns, "sequence",
        F.coalesce(F.size(processes), F.lit(0)).alias("num_processes"),
        F.size("sequence").alias("sequence_length"),
        F.when(F.col("_t").isNull(), "unparsed").when(F.size("sequence") == 0, "empty").otherwise("ok").alias("status"),
    )


def outcome_counts(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("status").agg(F.count("*").alias("n"))


def trace_rows(parsed: DataFrame, unified: DataFrame, families: DataFrame) -> DataFrame:
    """The 10 columns of an extracted trace row, joined by report name."""
    labelled = parsed.where(F.col("status") == "ok").join(unified.drop("sha256"), "fname")
    classed = add_classes(labelled, families, "avclass")
    volume = F.col("source_volume") if "source_volume" in parsed.columns else F.lit(0)
    return classed.select(
        hash_of_report(F.col("fname")).alias("sha256"),
        F.col("avclass").alias("family_avclass"), F.col("cape").alias("family_cape"),
        F.col("consensus").alias("family_consensus"), "primary_class", "secondary_classes",
        F.col("sequence").alias("api_sequence"), "num_processes", "sequence_length", volume.cast("int").alias("source_volume"),
    )


def trace_schema(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: the merged structure of all documents."""
    return docs.agg(F.schema_of_variant_agg(F.try_parse_json(text)).alias("structure"))


def call_field_candidates(docs: DataFrame, text: str = "text", fields: tuple[str, ...] = ("api", "name", "function", "API")) -> DataFrame:
    """(field, calls, calls_with_text): which call field carries names."""
    processes = F.try_variant_get(F.try_parse_json(text), "$.behavior.processes", "array<variant>")
    calls = docs.select(F.explode(processes).alias("p")).select(
        F.explode(F.try_variant_get("p", "$.calls", "array<variant>")).alias("c")
    )
    checks = F.array(*[F.struct(F.lit(f).alias("field"), _string_field(F.col("c"), f"$.{f}").isNotNull().alias("hit")) for f in fields])
    return calls.select(F.inline(checks)).groupBy("field").agg(
        F.count("*").alias("calls"), F.count_if("hit").alias("calls_with_text")
    )
