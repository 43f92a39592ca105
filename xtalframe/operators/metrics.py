"""Model quality as aggregates over a prediction table.

Every metric is a sum, a mean or a variance: one pass, map-side partials, a
result of one row. NaN in a target or prediction poisons the metric, as it
should; null rows are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _errors(y_true: str, y_pred: str) -> tuple[Column, Column]:
    error = F.col(y_true) - F.col(y_pred)
    # y_true counts only where a prediction exists, so that R2 compares like with like.
    truth = F.when(F.col(y_pred).isNotNull(), F.col(y_true))
    return error, truth


def regression_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """One row: n, mae, mse, rmse, r2 (null when all targets are equal)."""
    error, truth = _errors(y_true, y_pred)
    sums = df.agg(
        F.count(error).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.var_pop(truth).alias("variance"),
    )
    return sums.select(
        "n",
        "mae",
        "mse",
        F.sqrt("mse").alias("rmse"),
        (1 - F.col("mse") / F.nullif(F.col("variance"), F.lit(0.0))).alias("r2"),
    )


def classification_metrics(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """One row: n, accuracy, f1_weighted.

    Rows are reduced to confusion counts first; everything after works on at
    most classes x classes rows. The F1 of a class that is neither present nor
    predicted correctly is 0; weights are the class sizes.
    """
    confusion = (
        df.where(F.col(label).isNotNull() & F.col(pred).isNotNull())
        .groupBy(F.col(label).alias("label"), F.col(pred).alias("pred"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    roles = confusion.select(
        "n",
        hit.alias("hit"),
        F.explode(
            F.array(
                F.struct(F.col("label").alias("cls"), F.lit(True).alias("is_label")),
                F.struct(F.col("pred").alias("cls"), F.lit(False).alias("is_label")),
            )
        ).alias("role"),
    )
    per_class = roles.groupBy("role.cls").agg(
        F.sum(F.when(F.col("role.is_label"), F.col("n")).otherwise(0)).alias("support"),
        F.sum("n").alias("label_and_pred"),
        F.sum(F.when(F.col("role.is_label"), F.col("hit")).otherwise(0)).alias("hits"),
    )
    f1 = 2 * F.col("hits") / F.col("label_and_pred")
    return per_class.agg(
        F.sum("support").alias("n"),
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        (F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1_weighted"),
    )


def mean_target(train: DataFrame, target: str) -> DataFrame:
    """One row: the mean target of the training rows."""
    return train.agg(F.avg(target).alias("mean_target"))


def join_baseline(test: DataFrame, train: DataFrame, target: str) -> DataFrame:
    """Add the mean training target to every test row as ``y_baseline``.

    A scalar subquery: the mean is computed once and shipped as a value, so
    there is neither a join nor a shuffle of the test rows.
    """
    return test.withColumn("y_baseline", mean_target(train, target).scalar())


def join_predictions(targets: DataFrame, predictions: DataFrame, key: str = "material_id") -> DataFrame:
    """Targets with their predictions by id; a missing prediction is null."""
    return targets.join(predictions, key, "left")


def top_errors(
    df: DataFrame,
    n: int = 5,
    key: str = "material_id",
    y_true: str = "y_true",
    y_pred: str = "y_pred",
) -> DataFrame:
    """The ``n`` rows with the largest absolute error, ties by id."""
    error = F.abs(F.col(y_true) - F.col(y_pred))
    return (
        df.select(
            key,
            F.col(y_true).alias("true_value"),
            F.col(y_pred).alias("predicted_value"),
            error.alias("absolute_error"),
        )
        .where(F.col("absolute_error").isNotNull())
        .orderBy(F.col("absolute_error").desc(), F.col(key).asc())
        .limit(n)
    )


def baseline_compare(
    test: DataFrame, train: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred"
) -> DataFrame:
    """One row: error of the model next to that of the mean predictor, from one
    scan of the test rows. Without predictions the model's figures are null."""
    rows = join_baseline(test, train, y_true)
    if y_pred not in rows.columns:
        rows = rows.withColumn(y_pred, F.lit(None).cast("double"))
    model = F.col(y_true) - F.col(y_pred)
    base = F.col(y_true) - F.col("y_baseline")
    return rows.agg(
        F.avg(F.abs(model)).alias("model_mae"),
        F.sqrt(F.avg(model * model)).alias("model_rmse"),
        F.avg(F.abs(base)).alias("baseline_mae"),
        F.sqrt(F.avg(base * base)).alias("baseline_rmse"),
    )


def evaluate_model(
    test: DataFrame, train: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", key: str = "material_id", n_errors: int = 5
) -> DataFrame:
    """Metrics of the model and of the mean predictor side by side, and the rows
    with the largest errors (``top_errors``, largest first): one row."""
    rows = join_baseline(test, train, y_true)
    error, truth = _errors(y_true, y_pred)
    base = F.col(y_true) - F.col("y_baseline")
    sums = rows.agg(
        F.count(error).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.var_pop(truth).alias("variance"),
        F.avg(F.abs(base)).alias("baseline_mae"),
        F.sqrt(F.avg(base * base)).alias("baseline_rmse"),
    )
    worst = top_errors(test, n_errors, key, y_true, y_pred)
    order = F.struct((-F.col("absolute_error")).alias("o"), F.col(key).alias("k"), F.struct(*worst.columns).alias("row"))
    listed = worst.agg(F.transform(F.array_sort(F.collect_list(order)), lambda e: e["row"]).alias("rows"))  # n_errors rows
    return sums.select(
        "n",
        "mae",
        F.sqrt("mse").alias("rmse"),
        (1 - F.col("mse") / F.nullif(F.col("variance"), F.lit(0.0))).alias("r2"),
        "baseline_mae",
        "baseline_rmse",
    ).withColumn("top_errors", listed.scalar())
