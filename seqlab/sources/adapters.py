"""Canonical inputs derived from the benchmark tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlab import runtime
from seqlab.fixed_values import CATEGORIES
from seqlab.functions.labels import CategoryOf
from seqlab.operators.calls import number_calls
from seqlab.operators.skew import number_within, quantile_bucket


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as samples: words are calls, the language is the class."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return runtime.spread(texts).select(
        F.col("doc_id").cast("string").alias("sample_id"), "doc_id",
        F.array_remove(F.split(F.lower("text"), "[^a-z]+"), "").alias("sequence"),
        F.col("lang").alias("label"), "source",
    )


def raw_doc_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``doc_samples``; one-letter words stand for sandbox markers."""
    marked = F.transform("sequence", lambda x: F.when(F.length(x) == 1, F.concat(F.lit("__"), x)).otherwise(x))
    return doc_samples(spark, sf_dir).withColumn("sequence", marked)


def page_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as samples: opened tags are calls, in page order."""
    return runtime.spread(table(spark, sf_dir, "pages").select("page_id", "html")).select(
        F.col("page_id").cast("string").alias("sample_id"), "page_id",
        F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), F.lit(1)).alias("sequence"),
        F.concat(F.lit("c"), (F.col("page_id") % 4).cast("string")).alias("label"),
    )


def event_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls of their user, numbered in time order."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("sample_id"), "ts", "event_id",
        F.concat_ws("_", "event_type", F.floor(F.col("value") / 10).cast("int")).alias("token"),
    )
    # seconds without a time zone, so the value never falls as ts grows
    seconds = F.unix_date(F.to_date("ts")).cast("long") * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    numbered = number_calls(rows, [F.col("ts"), F.col("event_id")], seconds)
    return numbered.select("sample_id", "pos", "token")


def line_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as calls of their order, spread by line number and part range."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_type")
    rows = lines.join(parts, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("l_orderkey").cast("string").alias("sample_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        "l_extendedprice", F.lower(F.concat_ws("_", "p_type", "l_returnflag")).alias("token"),
    )
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")]
    ranges = F.struct(F.col("l_linenumber").alias("a"), quantile_bucket(lines, F.col("l_partkey")).alias("b"))
    numbered = number_within(rows, ["sample_id"], order, ranges, "pos")
    return numbered.select("sample_id", "pos", "token")


def embed_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, y_true, y_pred, probs, p_second): 10 classes with probabilities."""
    e = F.transform(F.slice("embedding", 1, 10), lambda x: F.exp(x.cast("double")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("y_true"), e.alias("e"))
    s = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    probs = rows.select("vec_id", "y_true", F.transform("e", lambda x: x).alias("e"), s.alias("s")).select(
        F.col("vec_id").cast("string").alias("sample_id"), "vec_id", "y_true",
        (F.array_position("e", F.array_max("e")) - 1).cast("int").alias("y_pred"),
        F.transform("e", lambda x: x / F.col("s")).alias("probs"),
    )
    return probs.withColumn("p_second", F.reverse("probs"))


def order_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, y_true, y_pred, dataset): 5 classes without probabilities."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("sample_id"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("y_true"),
        F.pmod("o_custkey", F.lit(5)).cast("int").alias("y_pred"), F.col("o_orderstatus").alias("dataset"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hash, engine, result) antivirus rows, one engine per order of a customer."""
    n = F.col("o_orderkey") % 7
    result = (
        F.when(n == 0, "Trojan.Generic").when(n == 1, "Trojan.Emotet").when(n == 2, "TrojanDownloader.Agent")
        .when(n == 3, "Worm.Agent.Win32").when(n == 4, "Backdoor.Generic").when(n == 5, "Malware.Generic")
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("hash"), F.concat(F.lit("E"), F.col("o_orderkey").cast("string")).alias("engine"),
        result.alias("result"),
    )


def first_letter(token: Column) -> Column:
    """Categories for word samples: eight groups by first letter."""


    slot = F.pmod(F.ascii(token) - F.lit(97), F.lit(8)).cast("int")
    return F.get(F.array(*[F.lit(c) for c in CATEGORIES]), slot)


first_letter.in_python = lambda tokens: [None if t is None else CATEGORIES[((ord(t[0]) if t else 0) - 97) % 8] for t in tokens]

LETTERS: CategoryOf = first_letter
