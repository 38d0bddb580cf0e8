"""Label sources, unified labels, target selection and report-based labelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlab import fixed_values as V
from seqlab.functions.cleaning import hash_of_report
from seqlab.operators.vote import vote_family


def _entries(docs: DataFrame) -> DataFrame:
    """Key/value entries of JSON-object documents (``value``; ``doc`` orders
    several documents). Values keep their raw JSON text."""
    ordered = docs if "doc" in docs.columns else docs.withColumn("doc", F.lit(0).cast("long"))
    return ordered.select("doc", F.posexplode(F.from_json("value", "map<string,string>")).alias("at", "key", "body"))


def _reports(docs: DataFrame) -> DataFrame:
    body = F.from_json("body", "struct<reports:array<struct<report:string>>>")
    family = F.lower(F.trim("key"))
    listed = _entries(docs).select("doc", "at", family.alias("family"), body["reports"].alias("reports"))
    rows = listed.where(F.col("reports").isNotNull()).select(
        "doc", "at", "family", F.posexplode("reports").alias("n", "report")
    )
    return rows.select(F.col("report.report").alias("fname"), "family", F.struct("doc", "at", "n").alias("_ord"))


def _last_wins(rows: DataFrame) -> DataFrame:
    return rows.groupBy("fname").agg(F.max_by("family", "_ord").alias("family"))


def primary_labels(docs: DataFrame) -> DataFrame:
    """(fname, family) from a family-keyed label file, unusable names left out."""
    return _last_wins(_reports(docs).where(~F.col("family").isin(V.EMPTY_FAMILY_NAMES)))


def secondary_labels(docs: DataFrame) -> DataFrame:
    """As ``primary_labels`` but n/a names are kept."""
    return _last_wins(_reports(docs))


def consensus_labels(docs: DataFrame) -> DataFrame:
    """(fname, avclass, cape) from a hash-keyed consensus file."""
    rows = _entries(docs).where(~F.col("key").isin(V.CONSENSUS_METADATA_KEYS) & F.startswith(F.trim("body"), F.lit("{")))
    body = F.from_json("body", "struct<avclass:string,cape:string>")

    def name(field: str) -> Column:
        return F.nullif(F.lower(F.trim(body[field])), F.lit(""))

    flat = rows.select(
        F.concat("key", F.lit(".json")).alias("fname"), F.struct("doc", "at").alias("_ord"),
        F.struct(name("avclass").alias("avclass"), name("cape").alias("cape")).alias("family"),
    )
    return _last_wins(flat).select("fname", "family.avclass", "family.cape")


def unify_labels(primary: DataFrame, secondary: DataFrame, consensus: DataFrame) -> DataFrame:
    """(fname, avclass, cape, consensus, sha256), one row per primary label."""
    cape = secondary.select(
        "fname", F.when(~F.col("family").isin([*V.UNSET_FAMILY_NAMES, ""]), F.col("family")).alias("cape")
    )
    agreed = consensus.select("fname", F.when(F.col("avclass") == F.col("cape"), F.col("avclass")).alias("consensus"))
    return (
        primary.withColumnRenamed("family", "avclass")
        .join(cape, "fname", "left").join(agreed, "fname", "left")
        .select("fname", "avclass", "cape", "consensus", hash_of_report(F.col("fname")).alias("sha256"))
    )


# ---- family -> class ----------------------------------------------------------
def family_dimension(spark, mapping: dict[str, tuple[str, list[str]]] | None = None) -> DataFrame:
    """(family, primary_class, secondary_classes), a fixed small table."""
    mapping = V.FAMILY_CLASSES if mapping is None else mapping
    return spark.createDataFrame(
        [(f, p, s) for f, (p, s) in mapping.items()],
        "family string, primary_class string, secondary_classes array<string>",
    )


def add_classes(rows: DataFrame, families: DataFrame, family: str = "avclass") -> DataFrame:
    """Attach primary and secondary classes; unmapped families get null and []."""
    dim = families.withColumnRenamed("family", family)  # built from a dictionary, so small
    out = rows.join(F.broadcast(dim), family, "left")
    return out.withColumn("secondary_classes", F.coalesce("secondary_classes", F.array().cast("array<string>")))


# ---- target selection ------------------------------------------------------------
def family_plan(unified: DataFrame, top_k: int = 25, max_per_family: int = 300, min_samples: int = 50) -> DataFrame:
    """(family, raw_count, capped_count, rank) of the families to extract."""
    sizes = unified.groupBy(F.col("avclass").alias("family")).agg(F.count("*").alias("raw_count"))
    top = sizes.where(F.col("raw_count") >= min_samples).orderBy(F.desc("raw_count"), "family").limit(top_k)
    rank = F.row_number().over(Window.orderBy(F.desc("raw_count"), "family"))  # at most top_k rows
    return top.select(
        "family", "raw_count", F.least("raw_count", F.lit(max_per_family)).alias("capped_count"), rank.alias("rank")
    )


def select_targets(unified: DataFrame, top_k: int = 25, max_per_family: int = 300, min_samples: int = 50) -> DataFrame:
    """Rows of the planned families: the first ``max_per_family`` names of each.

    The plan has at most ``top_k`` rows. Spark applies the per-family limit
    before the shuffle as well, so a dominant family ships few rows.
    """
    plan = family_plan(unified, top_k, max_per_family, min_samples)
    kept = unified.join(F.broadcast(plan.select(F.col("family").alias("avclass"))), "avclass", "left_semi")
    nth = F.row_number().over(Window.partitionBy("avclass").orderBy("fname"))
    return kept.withColumn("_n", nth).where(F.col("_n") <= max_per_family).drop("_n")


def plan_totals(plan: DataFrame, top_k: int = 25) -> DataFrame:
    return plan.agg(
        F.count("*").alias("families"), F.coalesce(F.sum("raw_count"), F.lit(0)).alias("total_raw"),
        F.coalesce(F.sum("capped_count"), F.lit(0)).alias("total_capped"),
        F.max(F.when(F.col("rank") == top_k, F.col("raw_count"))).alias("count_at_rank_k"),
    )


def class_preview(plan: DataFrame, families: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Capped counts by behavioural class, zero classes and ``unmapped`` included."""
    names = [*(V.PLAN_CLASSES if classes is None else classes), "unmapped"]
    dim = plan.sparkSession.createDataFrame([(n,) for n in names], "class_name string")
    counted = (
        plan.join(F.broadcast(families), "family", "left")
        .groupBy(F.coalesce("primary_class", F.lit("unmapped")).alias("class_name"))
        .agg(F.sum("capped_count").alias("projected"))
    )
    return dim.join(counted, "class_name", "left").withColumn("projected", F.coalesce("projected", F.lit(0)))


def split_targets(targets: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing) targets by presence in an archive listing."""
    present = listing.select("fname").distinct()
    return targets.join(present, "fname", "left_semi"), targets.join(present, "fname", "left_anti")


# ---- labelling from reports --------------------------------------------------
def label_from_reports(samples: DataFrame, reports: DataFrame, key: str = "hash") -> DataFrame:
    """Add ``family``, ``status`` ('benign', 'labelled', 'dropped') and the final ``label``.

    ``reports`` is (hash, engine, result), one row per engine. Benign rows pass
    through; malware without a voted family is dropped.
    """
    votes = vote_family(reports).withColumnRenamed("hash", key)
    joined = samples.join(votes, key, "left")
    benign = F.col("label") == V.BENIGN
    status = F.when(benign, "benign").when(F.col("family").isNotNull(), "labelled").otherwise("dropped")
    return joined.withColumn("status", status).withColumn("label", F.when(benign, F.col("label")).otherwise(F.col("family")))


def kept(labelled: DataFrame) -> DataFrame:
    return labelled.where(F.col("status") != "dropped").drop("status", "family")


def dropped(labelled: DataFrame, key: str = "hash") -> DataFrame:
    return labelled.where(F.col("status") == "dropped").select(key)


def label_totals(labelled: DataFrame) -> DataFrame:
    return labelled.agg(
        F.count_if(F.col("status") != "dropped").alias("total_labeled"),
        F.count_if(F.col("status") == "benign").alias("benign"),
        F.count_if(F.col("status") == "labelled").alias("malware"),
        F.count_if(F.col("status") == "dropped").alias("total_dropped"),
    )
