"""Family vote over antivirus reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab import fixed_values as V
from seqlab.functions.labels import families_in_label


def report_rows(reports: DataFrame, key: str = "hash") -> DataFrame:
    """(hash, engine, result) from stored JSON responses in ``response``.

    Null, unparseable or shallow responses give no rows.
    """
    parsed = F.try_parse_json("response")
    engines = F.try_variant_get(parsed, "$.data.attributes.last_analysis_results", "map<string,variant>")
    return reports.select(F.col(key).alias("hash"), F.explode(engines).alias("engine", "info")).select(
        "hash", "engine", F.try_variant_get("info", "$.result", "string").alias("result")
    )


def rows_from_map(reports: DataFrame, key: str = "hash", column: str = "results") -> DataFrame:
    """The same from a map column engine -> struct(category, result)."""
    return reports.select(F.col(key).alias("hash"), F.explode(column).alias("engine", "info")).select(
        "hash", "engine", F.col("info.result").alias("result")
    )


def family_votes(reports: DataFrame) -> DataFrame:
    """(hash, family, votes); each engine votes once per family."""
    voted = reports.select("hash", F.explode(families_in_label(F.col("result"))).alias("family"))
    return voted.groupBy("hash", "family").agg(F.count("*").alias("votes"))


def pick_family(votes: DataFrame) -> DataFrame:
    """(hash, family): the best specific family when Trojan has no votes or it
    has enough of them, else the family with most votes. Ties by name."""
    ranked = F.struct((-F.col("votes")).alias("m"), F.col("family").alias("family"))
    specific = F.col("family") != V.TROJAN
    best = votes.groupBy("hash").agg(
        F.min(ranked).alias("top"), F.min(F.when(specific, ranked)).alias("spec"),
        F.coalesce(F.sum(F.when(~specific, F.col("votes"))), F.lit(0)).alias("trojan"),
    )
    n = -F.col("spec.m")
    strong = (F.col("trojan") == 0) | ((n >= V.MIN_SPECIFIC_VOTES) & (n >= F.lit(V.MIN_SPECIFIC_SHARE) * F.col("trojan")))
    return best.select(
        "hash", F.when(F.col("spec").isNotNull() & strong, F.col("spec.family")).otherwise(F.col("top.family")).alias("family")
    )


def vote_family(reports: DataFrame) -> DataFrame:
    """(hash, family) for every hash with at least one vote."""
    return pick_family(family_votes(reports))
