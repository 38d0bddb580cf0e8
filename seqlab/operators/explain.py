"""Additive attribution on the engineered features."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlab.functions.labels import short_feature_name
from seqlab.operators.splits import add_class_weight


def train_linear(train: DataFrame, iterations: int = 50, regularisation: float = 0.01) -> LogisticRegressionModel:
    """Multinomial logistic regression on (features, y), balanced weights."""
    return LogisticRegression(
        featuresCol="features", labelCol="y", weightCol="weight", family="multinomial",
        maxIter=iterations, regParam=regularisation,
    ).fit(add_class_weight(train, "y"))


def feature_means(rows: DataFrame, width: int) -> DataFrame:
    """(col_idx, mean): one aggregate per column of the dense block."""
    values = vector_to_array("features")
    sums = rows.select(values.alias("v")).agg(*[F.avg(F.get("v", F.lit(i))).alias(f"m{i}") for i in range(width)])
    means = F.array(*[F.col(f"m{i}") for i in range(width)])
    return sums.select(F.posexplode(means).alias("col_idx", "mean"))


def coefficients(model: LogisticRegressionModel, means: DataFrame, names: DataFrame) -> DataFrame:
    """(class_idx, col_idx, name, weight, mean): k x width rows."""
    matrix = model.coefficientMatrix.toArray()
    rows = [(c, f, float(matrix[c, f])) for c in range(matrix.shape[0]) for f in range(matrix.shape[1])]
    table = means.sparkSession.createDataFrame(rows, "class_idx int, col_idx int, weight double")
    return table.join(means, "col_idx").join(names, "col_idx")


def contributions(rows: DataFrame, coeffs: DataFrame, predicted: str = "y_pred") -> DataFrame:
    """(sample_id, class_idx, name, feature_value, value) for the predicted class.

    ``value`` is weight * (x - mean): the terms of the class score. ``coeffs``
    has classes x columns rows, so it is broadcast.
    """
    long = rows.select(
        "sample_id", F.col(predicted).alias("class_idx"), F.posexplode(vector_to_array("features")).alias("col_idx", "x")
    )
    return long.join(F.broadcast(coeffs), ["class_idx", "col_idx"]).select(
        "sample_id", "class_idx", "name", F.col("x").alias("feature_value"),
        (F.col("weight") * (F.col("x") - F.col("mean"))).alias("value"),
    )


def top_contributions(contribs: DataFrame, k: int = 15) -> DataFrame:
    """The k largest contributions by absolute value per sample, ranked."""
    order = Window.partitionBy("sample_id").orderBy(F.desc(F.abs("value")), "name")  # one row per column
    ranked = contribs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("display_name", short_feature_name(F.col("name")))


def row_top_contributions(rows: DataFrame, coeffs: DataFrame, k: int = 15, predicted: str = "y_pred") -> DataFrame:
    """``top_contributions`` of ``contributions``, sorted inside each row: nothing is shuffled.

    ``coeffs`` (classes x columns rows) becomes one row of arrays per class, which is broadcast.
    """
    terms = F.sort_array(F.collect_list(F.struct("col_idx", "name", "weight", "mean")))
    by_class = coeffs.groupBy("class_idx").agg(terms.alias("_terms"))
    values = F.zip_with(vector_to_array("features"), "_terms", lambda x, t: F.struct(
        (-F.abs(t["weight"] * (x - t["mean"]))).alias("o"), t["name"].alias("name"), x.alias("feature_value"), (t["weight"] * (x - t["mean"])).alias("value")
    ))
    best = F.slice(F.array_sort(values), 1, k)
    found = rows.withColumn("class_idx", F.col(predicted)).join(F.broadcast(by_class), "class_idx").select(
        "sample_id", "class_idx", F.posexplode(best).alias("_at", "_c")
    )
    return found.select(
        "sample_id", "class_idx", F.col("_c.name").alias("name"), F.col("_c.feature_value").alias("feature_value"), F.col("_c.value").alias("value"),
        (F.col("_at") + 1).alias("rank"), short_feature_name(F.col("_c.name")).alias("display_name"),
    )


def global_contributions(rows: DataFrame, coeffs: DataFrame) -> DataFrame:
    """(class_idx, name, mean_abs): mean absolute contribution over all rows."""
    # |weight| leaves the mean: the rows are summed per column, and the classes come after
    means = F.broadcast(coeffs.select("col_idx", "mean").distinct())
    long = rows.select(F.posexplode(vector_to_array("features")).alias("col_idx", "x"))
    spread = long.join(means, "col_idx").groupBy("col_idx").agg(F.avg(F.abs(F.col("x") - F.col("mean"))).alias("spread"))
    return coeffs.join(spread, "col_idx").select("class_idx", "name", (F.abs("weight") * F.col("spread")).alias("mean_abs"))
