"""Stratified splits and folds, augmentation, class weights, class filters."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from seqlab import fixed_values as V
from seqlab import runtime
from seqlab.operators import dictionaries
from seqlab.operators.skew import number_within, rank_rows


def draw(*parts: Column | str | int) -> Column:
    """A reproducible pseudo-random hex string per row, independent of how the
    rows are partitioned."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]).cast("binary"))


def draw_int(hex_digest: Column) -> Column:
    return F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("long")


def _class_of(label: str) -> Column:
    """The label as a key that is never null."""
    return F.to_json(F.struct(F.col(label).alias("v"))).alias("_class")


# Hexadecimal digits of a draw that one pass counts, and the rows of a class in which its cut is then looked for.
DIGITS = 3
CUT_ROWS = 10_000


def class_cuts(samples: DataFrame, size: Column, seed: int, label: str) -> DataFrame:
    """(_class, _cut): the draw and id of each class's row number ``size`` in drawn order; ``size`` sees the class's count ``n``.

    Draws are counted by their leading digits, then only inside the digits that hold the cut, until those hold few
    rows. Counts are added up where the rows are; rows are only sent for the last group of each class.
    """
    own = samples.select(_class_of(label), draw(F.col("sample_id"), seed).alias("d"), F.col("sample_id").alias("i"))

    def groups(rows: DataFrame, digits: int) -> DataFrame:
        """(_class, head, n, before, of): rows by leading digits, those before them and all of their class."""
        heads = rows.groupBy("_class", F.substring("d", 1, digits).alias("head")).agg(F.count("*").alias("n"))
        earlier = Window.partitionBy("_class").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
        return heads.select("*", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("_class")).alias("of"))

    holds = (F.col("before") < F.col("k")) & (F.col("k") <= F.col("before") + F.col("n"))
    found = groups(own, DIGITS).withColumn("k", size(F.col("of")))
    cut = runtime.small_table(found.where(holds).select("_class", "head", "n", (F.col("k") - F.col("before")).alias("k")))
    digits = DIGITS
    while digits < 32 and cut.where(F.col("n") > CUT_ROWS).limit(1).count():
        digits += DIGITS
        inside = own.join(cut.select("_class", "head", "k"), "_class").where(F.startswith("d", "head")).drop("head")
        asked = runtime.small_table(cut.select("_class", "k"))
        found = groups(inside, digits).join(asked, "_class")
        cut = runtime.small_table(found.where(holds).select("_class", "head", "n", (F.col("k") - F.col("before")).alias("k")))
    last = own.join(cut.select("_class", "head", "k"), "_class").where(F.startswith("d", "head"))
    order = Window.partitionBy("_class").orderBy("d", "i")
    at = last.withColumn("r", F.row_number().over(order)).where("r = k")
    return at.select("_class", F.struct("d", "i").alias("_cut"))


def stratified_split(
    samples: DataFrame, test_size: float = V.TEST_SIZE, seed: int = V.RANDOM_SEED, label: str = "label",
) -> DataFrame:
    """Add ``split`` ('train'/'test') with exact per-class test sizes.

    Each class has one cut in drawn order, which the full rows are compared with where they are. Rows without a
    label are a class of their own; rows without an id share one draw and stay together.
    """
    cuts = runtime.small_table(class_cuts(samples, lambda n: F.round(n * F.lit(test_size)).cast("long"), seed, label))
    own = F.struct(draw(F.col("sample_id"), seed).alias("d"), F.col("sample_id").alias("i"))
    split = F.when(own <= F.col("_cut"), "test").otherwise("train")
    keyed = samples.withColumn("_class", _class_of(label))
    return keyed.join(cuts, "_class", "left").select(*samples.columns, split.alias("split"))


def stratified_folds(samples: DataFrame, k: int = V.CV_FOLDS, seed: int = V.RANDOM_SEED, label: str = "label") -> DataFrame:
    """Add ``fold`` in 0..k-1; class sizes differ by at most one between folds.

    Rows are stored once; only their draws are ranked (leading digits spread a large class), and a partition's folds
    come back to it as a dictionary, so full rows never move. Rows without a label are a class of their own; rows
    without an id share one draw, and those of a partition one fold.
    """
    drawn = samples.withColumn("_draw", draw(F.col("sample_id"), seed)).withColumn("_class", _class_of(label))
    name = F.concat_ws(":", "_draw", F.coalesce(F.concat(F.lit("="), F.col("sample_id").cast("string")), F.lit("")), "_class")
    staged = dictionaries.stage(drawn.withColumn("_key", name))
    light = staged.rows.select(F.col(staged.part).alias("part"), F.col("_key").alias("key"), "_class", "_draw")
    ranked = number_within(light, ["_class"], [F.col("_draw"), F.col("key")], F.substring("_draw", 1, DIGITS), "_rank")
    folds = ranked.groupBy("part", "key").agg(F.min(F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).alias("fold"))

    def apply(batch: pa.RecordBatch, known: pa.Table) -> list[pa.Array]:
        at = pc.index_in(batch.column("_key"), value_set=known.column("key"))
        fold = pc.take(known.column("fold"), at)
        return [fold.combine_chunks() if isinstance(fold, pa.ChunkedArray) else fold]

    return dictionaries.looked_up(staged, folds, apply, StructType([StructField("fold", IntegerType())])).select(*samples.columns, "fold")


def augment(
    samples: DataFrame, n_augments: int = 2, min_len: int = 20, max_len: int = 200, seed: int = V.RANDOM_SEED,
) -> DataFrame:
    """Originals plus ``n_augments`` cut prefixes of each longer sample.

    ``copy_no`` is 0 for originals. Fields ``sequence`` and ``encoded`` are cut alike.
    """
    n = F.size("sequence")
    span = F.least(n, F.lit(max_len)) - F.lit(min_len) + 1
    copies = F.when(n > min_len, F.sequence(F.lit(0), F.lit(n_augments))).otherwise(F.array(F.lit(0)))
    out = samples.withColumn("copy_no", F.explode(copies))
    length = F.lit(min_len) + F.pmod(draw_int(draw(F.col("sample_id"), F.col("copy_no"), seed)), span).cast("int")
    out = out.withColumn("_len", F.when(F.col("copy_no") == 0, F.size("sequence")).otherwise(length))
    for column in [c for c in ("encoded", "sequence") if c in samples.columns]:
        out = out.withColumn(column, F.slice(column, F.lit(1), F.col("_len")))
    return out.drop("_len")


def class_weights(samples: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight) with the balanced weight n_total / (k * n_class)."""
    sizes = samples.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # one row per class
    return sizes.select(
        label, "n", (F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))).alias("weight")
    )


def add_class_weight(samples: DataFrame, label: str = "label", column: str = "weight") -> DataFrame:
    """Rows without a label are weighted as a class of their own."""
    weights = runtime.small_table(class_weights(samples, label).select(F.col(label).alias("_class"), F.col("weight").alias(column)))
    return samples.join(weights, F.col(label).eqNullSafe(F.col("_class"))).drop("_class")


def without_label(samples: DataFrame, name: str, label: str = "label") -> DataFrame:
    return samples.where(F.col(label) != name)


def known_classes_only(samples: DataFrame, classes: DataFrame, label: str = "label") -> DataFrame:
    """Keep rows whose label occurs in ``classes`` (a class dimension)."""
    names = runtime.small_table(classes.select(F.col("class_name").alias(label)).distinct())
    return samples.join(names, label, "left_semi")


def large_classes_only(samples: DataFrame, minimum: int = V.MIN_CLASS_SIZE, label: str = "label") -> DataFrame:
    """Drop classes with fewer than ``minimum`` samples."""
    large = samples.groupBy(label).count().where(F.col("count") >= minimum).select(label)
    return samples.join(runtime.small_table(large), label, "left_semi")


def class_dimension(samples: DataFrame, label: str = "label") -> DataFrame:
    """(class_idx, class_name), alphabetical. One row per class."""
    names = samples.select(F.col(label).alias("class_name")).distinct()
    return rank_rows(names, ["class_name"], "class_idx")


def index_labels(samples: DataFrame, classes: DataFrame, label: str = "label", column: str = "y") -> DataFrame:
    """Add the class index; a label outside the dimension is an error."""
    dim = classes.select(F.col("class_name").alias(label), F.col("class_idx").alias(column))
    joined = samples.join(runtime.small_table(dim), label, "left")
    message = F.concat(F.lit("unseen label: "), F.col(label))
    return joined.withColumn(column, F.coalesce(column, F.raise_error(message).cast("int")))


def labels_outside(samples: DataFrame, allowed: list[str], label: str = "label") -> DataFrame:
    """Labels that are not allowed; empty when the set is clean."""
    return samples.select(label).distinct().where(~F.col(label).isin(allowed))
