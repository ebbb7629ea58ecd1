"""Apply trained models to rows without leaving the executors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duotide import scratch
from duotide.operators import skew
from duotide.operators.model import DENSE, HIDDEN, gated_outputs, unpack
from duotide.schemas import SERIES


def var_prediction(features: Sequence[str], weights: Sequence[float] | Column) -> Column:
    """Intercept plus weighted features as one native expression."""
    at = (lambda i: F.get(weights, i)) if isinstance(weights, Column) else (lambda i: F.lit(weights[i]).cast("double"))
    return reduce(add, [at(i + 1) * F.col(f"`{c}`") for i, c in enumerate(features)], at(0))


def gated_prediction(
    features: Sequence[str], weights: Sequence[float], hidden: int = HIDDEN, dense: int = DENSE
) -> Column:
    """Network output for whole Arrow batches; only the features cross to Python.

    Features are narrowed to single precision, as the deployed model takes them.
    """
    k, flat = len(features), np.asarray(weights, dtype=float)

    @F.pandas_udf("double")
    def predict(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype="float32", na_value=np.nan) for c in cols]).astype(float)
        out = gated_outputs(unpack(flat, k, hidden, dense), x)
        return pd.Series(out).where(~np.isnan(out), None)

    return predict(*[F.col(f"`{c}`") for c in features])


def score(
    df: DataFrame,
    features: Sequence[str],
    weights: Sequence[float],
    kind: str = "var",
    out: str = "prediction",
    **shape,
) -> DataFrame:
    """Rows with the prediction of one model, on the row itself."""
    if kind == "var":
        return df.withColumn(out, var_prediction(features, weights))
    if kind == "gated":
        return df.withColumn(out, gated_prediction(features, weights, **shape))
    raise ValueError(f"unknown kind {kind!r}")


def score_by_series(
    df: DataFrame,
    features: Sequence[str],
    models: DataFrame,
    spread: Sequence[str],
    by: Sequence[str] = (SERIES,),
    out: str = "prediction",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rows with the prediction of their own series' ``var`` model, and its ``keep`` columns.

    ``models`` has one row per series; ``n``, its training rows, tells which
    series are large and must be spread over several tasks. Rows of a series without
    a model stay, with no prediction.
    """
    known = models.select(*by, F.col("weights").alias("_weights"), "n", *keep)
    rows = skew.join_group_stats(df, known, by, spread, how="left").drop("n")
    return rows.withColumn(out, var_prediction(features, F.col("_weights"))).drop("_weights")


def attach_by_label(
    df: DataFrame,
    label: str,
    prediction: str,
    order: str,
    out: str = "Temp_Predict",
) -> DataFrame:
    """Each row with a prediction found by label value, not by its own key.

    Rows with equal labels all match one another. Later steps keep one match
    per time, so the match with the lowest ``order`` is chosen per label before
    joining: every row comes back once instead of once per pair.
    """
    df = scratch.materialise(df, "rows")  # read to choose and to join
    found = df.groupBy(label).agg(F.min_by(prediction, order).alias(out), F.count("*").alias("_matches"))
    rows = df.drop(out) if out in df.columns else df
    return skew.join_group_stats(rows, found, [label], [order], weight="_matches").withColumnRenamed(
        "_matches", "matches"
    )
