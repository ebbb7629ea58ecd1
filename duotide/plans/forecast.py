"""The whole two-layer forecast over a table: train, score, combine, rate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duotide import scratch
from duotide.operators import ensemble, model, ordering, scoring, skew


def speed_models(rows: DataFrame, features: Sequence[str], label: str, epoch: str) -> DataFrame:
    """For each epoch the model fitted on the epoch before it; the first has none.

    Rows shrink to one model per epoch before anything is put in order.
    """
    fitted = scratch.materialise(model.fit_var(rows, features, label, [epoch]), "models")
    carried = ordering.over_order(
        fitted, lambda w: [F.lag("weights", 1).over(w).alias("_before")], (), [epoch], back=1
    )
    return carried.where(F.col("_before").isNotNull()).select(epoch, F.col("_before").alias("weights"), "n")


def two_layer(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    epoch: str,
    spread: Sequence[str],
    history_end: int | None = None,
) -> DataFrame:
    """Rows after ``history_end`` with the predictions of both layers.

    ``batch`` comes from one model of all history, ``speed`` from a model of the
    epoch just before the row's own. History is the first third of the span of epochs
    unless its end is given; without rows in it there is no ``batch`` prediction.
    """
    rows = scratch.materialise(df, "rows")  # read to train and to score
    if history_end is None:
        low, high = rows.agg(F.min(epoch), F.max(epoch)).first()  # one row
        history_end = 0 if low is None else low + (high - low) // 3
    history = model.fit_var(rows.where(F.col(epoch) <= history_end), features, label, ()).first()  # one row
    slow = history["weights"] if history else [None] * (len(features) + 1)
    fast = speed_models(rows, features, label, epoch)
    recent = rows.where(F.col(epoch) > history_end).withColumn("batch", scoring.var_prediction(features, slow))
    known = fast.withColumnRenamed("weights", "_weights")
    joined = skew.join_group_stats(recent, known, [epoch], spread).drop("n")
    return joined.withColumn("speed", scoring.var_prediction(features, F.col("_weights"))).drop("_weights")


def combined(
    df: DataFrame, label: str, time: str, width: str, spread: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Both layers' predictions with the fixed and the dynamic combination."""
    dynamic = ensemble.dynamic_ensemble(df, label, "speed", "batch", spread, time, width, by, out="dynamic")
    return dynamic.withColumn("fixed", ensemble.weighted("speed", "batch"))


def errors(df: DataFrame, label: str, by: Sequence[str]) -> DataFrame:
    """RMSE of the four forecasts on the same rows."""
    rmse = [
        F.sqrt(F.avg((F.col(c) - F.col(label)) ** 2)).alias(f"{c}_rmse") for c in ("speed", "batch", "fixed", "dynamic")
    ]
    return df.groupBy(*by).agg(*rmse, F.count("*").alias("n"))
