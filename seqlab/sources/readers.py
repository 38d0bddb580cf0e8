"""Dataset readers. Every reader gives a keyed DataFrame with fixed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlab import fixed_values as V
from seqlab.functions.cleaning import bare_name, split_tokens, truncate
from seqlab.functions.encoding import decode_codes
from seqlab.operators.skew import number_within
from seqlab.sources.json_ranges import SPLIT_BYTES, json_items


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of the non-blank lines in file and line order.

    Lines are numbered inside each file split, then shifted by the splits
    before it; only split-sized counts cross splits.
    """
    lines = spark.read.text(path).select(
        "value",
        F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b")).alias("_split"),
        F.monotonically_increasing_id().alias("_at"),
    )
    filled = lines.where(F.trim(F.regexp_replace("value", r"(?U)\s+", " ")) != "").withColumn("_file", F.lit(0))
    out = number_within(filled, ["_file"], [F.col("_at")], F.col("_split"), "line_no")
    return out.select("line_no", F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("value"))


def read_aligned_text(
    spark: SparkSession, sequences: str, labels: str, max_len: int | None = None,
) -> DataFrame:
    """(sample_id, sequence, label) from a token file and a label file joined by
    line. Blank lines are skipped in each file; unequal counts are an error."""
    tokens, names = numbered_lines(spark, sequences), numbered_lines(spark, labels)
    n_tokens, n_names = tokens.count(), names.count()
    if n_tokens != n_names:
        raise ValueError(f"sequence count ({n_tokens}) != label count ({n_names})")
    return tokens.withColumnRenamed("value", "_text").join(names, "line_no").select(
        F.col("line_no").cast("string").alias("sample_id"),
        truncate(split_tokens(F.col("_text")), max_len).alias("sequence"), F.col("value").alias("label"),
    )


def _binary_label(flag: Column) -> Column:
    return F.when(flag.cast("int") == 0, V.BENIGN).otherwise(V.MALWARE)


def read_wide_csv(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, sequence, label) from ``sha256,labels,0,1,..`` lines.

    Lines may have any number of cells, also more than the header; blank cells
    are skipped. The header is the line whose label cell reads ``labels``; any
    other label that is not a whole number is an error, as is a missing one.
    """
    cell = F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)')
    cells = F.transform(
        F.regexp_extract_all("value", cell, F.lit(1)),
        lambda c: F.trim(F.replace(F.regexp_replace(c, r'^"|"$', ""), F.lit('""'), F.lit('"'))),
    )
    rows = spark.read.text(path).where("trim(value) <> ''").select(cells.alias("c"))
    flag = F.get("c", F.lit(1))
    whole = F.coalesce(flag.rlike(r"^-?\d+$"), F.lit(False))
    checked = F.when(whole, flag).otherwise(F.raise_error(F.concat(F.lit("label is not a whole number in line of "), F.get("c", F.lit(0)))))
    return rows.where(F.coalesce(flag != "labels", F.lit(True))).select(
        F.get("c", F.lit(0)).alias("sample_id"),
        F.filter(F.slice("c", F.lit(3), F.greatest(F.size("c") - 2, F.lit(0))), lambda x: x != "").alias("sequence"),
        _binary_label(checked).alias("label"),
    )


def read_name_table(spark: SparkSession, path: str, rows: int = 10_000) -> dict[str, str]:
    """A small lookup table (call to category, code to name) from two-column CSV files with a header."""
    table = spark.read.csv(path, header=True)
    found = table.select(*[F.trim(c).alias(n) for c, n in zip(table.columns[:2], "kv")]).limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"more than {rows} names in {path}")
    return {r["k"]: r["v"] for r in found if r["k"] is not None and r["v"] is not None}


def read_coded_csv(
    spark: SparkSession, path: str, names: dict[int, str] | None = None, calls: int = V.SHORT_TRACE_CALLS,
) -> DataFrame:
    """(sample_id, sequence, label) from ``hash,t_0..,malware`` rows of call codes.

    ``names`` decodes the codes; unknown codes keep their digits.
    """
    steps = [f"t_{i}" for i in range(calls)]
    schema = "hash string, " + ", ".join(f"{s} int" for s in steps) + ", malware int"
    rows = spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    return rows.select(
        F.trim("hash").alias("sample_id"), decode_codes(F.array(*steps), names).alias("sequence"),
        _binary_label(F.col("malware")).alias("label"),
    )


def _secondary(column_type: str) -> Column:
    if column_type.startswith("array"):
        return F.coalesce("secondary_classes", F.array().cast("array<string>"))
    return F.filter(F.split(F.coalesce("secondary_classes", F.lit("")), ","), lambda x: x != "")


def read_extracted(
    spark: SparkSession, path: str, drop_trojan: bool = True, max_len: int | None = None,
) -> DataFrame:
    """Samples from the extracted-trace Parquet; rows without a class are left out."""
    rows = spark.read.parquet(path).select(
        "sha256", "family_avclass", "primary_class", "secondary_classes", "api_sequence"
    )
    types = dict(rows.dtypes)
    kept = rows.where(F.col("primary_class").isNotNull() & (F.col("primary_class") != ""))
    if drop_trojan:
        kept = kept.where(F.col("primary_class") != V.TROJAN)
    return kept.select(
        F.col("sha256").alias("sample_id"),
        truncate(split_tokens(F.coalesce("api_sequence", F.lit(""))), max_len).alias("sequence"),
        F.col("primary_class").alias("label"), F.col("family_avclass").alias("family"),
        _secondary(types["secondary_classes"]).alias("secondary_classes"),
    )


def read_trace_files(spark: SparkSession, path: str, name: Callable[[Column], Column] = bare_name) -> DataFrame:
    """(fname, text): one JSON document per file, invalid UTF-8 replaced. ``name`` takes the report's name from the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        name(F.col("path")).alias("fname"), F.make_valid_utf8(F.col("content").cast("string")).alias("text")
    )


def read_label_documents(spark: SparkSession, path: str, per_line: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(doc, value): JSON label documents; ``doc`` rises in path or line order.

    Files hold one JSON document per line, or one object ``{family: {"reports": [..]}}`` each. Of an object every
    report becomes a document of its own, so a file, or a family in it, is read by many tasks.
    """
    if per_line:
        return numbered_lines(spark, path).select(F.col("line_no").alias("doc"), "value")
    found = json_items(spark, path, 3, split_bytes).where(F.col("key").isNotNull() & (F.col("field") == '"reports"'))
    text = F.concat(F.lit("{"), "key", F.lit(': {"reports": ['), "body", F.lit("]}}"))
    return found.select(F.struct("file", "at").alias("doc"), text.alias("value"))


def read_entry_documents(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(doc, value): every entry of hash-keyed JSON objects as a document of its own; ``doc`` rises in path and file order."""
    found = json_items(spark, path, 1, split_bytes)
    return found.select(F.struct("file", "at").alias("doc"), F.concat(F.lit("{"), "body", F.lit("}")).alias("value"))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(hash, response) stored antivirus responses, those of a hash's last save; a missing store is empty.

    A null response is a stored negative answer and is kept.
    """
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "hash string, response string")
    if "saved_at" not in rows.columns:
        return rows.select("hash", "response")
    save = F.struct("saved_at", "batch")
    last = F.max(save).over(Window.partitionBy("hash"))
    return rows.withColumn("_last", last).where(save == F.col("_last")).select("hash", "response")


def read_report_map(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(hash, response) from JSON objects ``{hash: response or null}``, a hash's last entry in path and file order.

    A file that is not one JSON object gives no rows; see ``json_ranges.json_items``.
    """
    docs = read_entry_documents(spark, path, split_bytes)
    entries = docs.select("doc", F.explode(F.from_json("value", "map<string,string>")).alias("hash", "response"))
    return entries.groupBy("hash").agg(F.max_by("response", "doc").alias("response"))
