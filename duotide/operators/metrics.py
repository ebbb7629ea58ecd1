"""Forecast errors and latency stamps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duotide import scratch
from duotide.operators import skew


def _errors(label: str, prediction: str, prefix: str = "") -> list[Column]:
    e = F.col(prediction) - F.col(label)
    return [
        F.sqrt(F.avg(e * e)).alias(f"{prefix}rmse"),
        F.avg(e * e).alias(f"{prefix}mse"),
        F.avg(F.abs(e)).alias(f"{prefix}mae"),
    ]


def regression_metrics(
    df: DataFrame,
    label: str,
    prediction: str,
    by: Sequence[str] = (),
    empty_value: float | None = None,
) -> DataFrame:
    """``rmse``, ``mse``, ``mae`` and ``n`` in one pre-aggregated pass.

    ``empty_value`` replaces the NULL scores of an empty input.
    """
    e = F.col(prediction) - F.col(label)
    out = df.groupBy(*by).agg(*_errors(label, prediction), F.count(e).alias("n"))
    return out if empty_value is None else out.fillna(empty_value, ["rmse", "mse", "mae"])


def with_window(df: DataFrame, time: str, width: str = "60 seconds", out: str = "window_start") -> DataFrame:
    """The start of the tumbling event-time window each row falls in."""
    return df.withColumn(out, F.window(time, width).getField("start"))


def windowed(
    df: DataFrame, time: str, label: str, prediction: str, width: str = "60 seconds", by: Sequence[str] = ()
) -> DataFrame:
    return regression_metrics(with_window(df, time, width), label, prediction, [*by, "window_start"])


def attach_scores(
    df: DataFrame, label: str, prediction: str, by: Sequence[str], spread: Sequence[str | Column]
) -> DataFrame:
    """Each row with the scores of its whole group, as wire-format columns.

    Rows are read twice, for the scores and for the join, so they are written once.
    """
    df = scratch.materialise(df, "rows")
    stats = regression_metrics(df, label, prediction, by).select(
        *by,
        F.col("rmse").alias("RMSE_Score"),
        F.col("mae").alias("MAE_Score"),
        F.col("mse").alias("MSE_Score"),
        F.col("n").alias("_n"),
    )
    return skew.join_group_stats(df, stats, by, spread, weight="_n").drop("_n")


def stamp_latency(df: DataFrame, start: float, end: float) -> DataFrame:
    """Wall-clock stamps of one batch, in seconds since 1970."""
    return df.withColumns(
        {"Latency_Start": F.lit(start), "Latency_End": F.lit(end), "Latency": F.lit(end - start)}
    )
