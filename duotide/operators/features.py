"""Lag, intercept and sliding-array features of ordered series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duotide.operators import ordering
from duotide.schemas import SENSORS, SERIES, TIME

# How far the sliding array looks ahead to fill places before the series began.
LOOKAHEAD = 7


def lag_names(p: int, cols: Sequence[str] = SENSORS) -> list[str]:
    return [f"{c}t-{i}" for i in range(1, p + 1) for c in cols]


def add_lags(
    df: DataFrame,
    p: int = 2,
    cols: Sequence[str] = SENSORS,
    keys: Sequence[str] = (SERIES,),
    order: Sequence[str] = (TIME,),
    const: bool = False,
    drop_warmup: bool = True,
    nth: str | None = None,
    **layout,
) -> DataFrame:
    """The ``p`` previous values of each column, as ``<col>t-<i>``.

    The first ``p`` rows of a series have no full history: they are dropped, or
    kept with 0 for what is missing. ``const`` adds the intercept column, 0 on
    those first rows and 1 elsewhere; ``nth`` names a column for the number of
    rows so far, exact up to ``p + 1``. ``layout`` goes to ``ordering.over_order``.
    """

    def build(w):
        made = [F.lag(c, i, 0.0).over(w).alias(f"{c}t-{i}") for i in range(1, p + 1) for c in cols]
        return [*made, F.row_number().over(w).alias("_nth")]

    out = ordering.over_order(df, build, keys, order, back=p, **layout)
    if const:
        out = out.withColumn("const", F.when(F.col("_nth") > p, 1).otherwise(0))
    if drop_warmup:
        out = out.where(F.col("_nth") > p)
    if nth:
        out = out.withColumn(nth, F.least(F.col("_nth"), F.lit(p + 1)))
    return out.drop("_nth")


def add_const(df: DataFrame, p: int, keys=(SERIES,), order=(TIME,), **layout) -> DataFrame:
    return add_lags(df, p, (), keys, order, const=True, drop_warmup=False, **layout)


def serie(
    df: DataFrame,
    col: str,
    n: int = 7,
    lookahead: int = LOOKAHEAD,
    pad: str = "forward",
    keys: Sequence[str] = (SERIES,),
    order: Sequence[str] = (TIME,),
    out: str = "serie",
    rank: str | None = None,
    **layout,
) -> DataFrame:
    """The last ``n`` values, oldest first, and ``filled_serie``, the places padded.

    ``pad="forward"`` fills a missing place from the rows up to ``lookahead``
    ahead; ``"first"`` from the earliest value in reach, without looking ahead;
    ``"null"`` leaves it empty.
    """
    if pad not in ("forward", "first", "null"):
        raise ValueError(f"unknown pad {pad!r}")
    ahead = lookahead if pad == "forward" else 0

    def build(w):
        places, filled = [], []
        for i in reversed(range(n)):
            past = F.lag(col, i).over(w)
            if pad == "forward":
                filler = F.first(col, ignorenulls=True).over(w.rowsBetween(lookahead - i, lookahead))
            elif pad == "first":
                filler = F.first(col, ignorenulls=True).over(w.rowsBetween(1 - n, 0))
            else:
                filler = F.lit(None)
            places.append(F.coalesce(past, filler))
            filled.append(past.isNull().cast("int"))
        total = filled[0]
        for one in filled[1:]:
            total = total + one
        return [F.array(*places).alias(out), total.alias("filled_serie")]

    made = ordering.over_order(df, build, keys, order, back=n - 1, ahead=ahead, **layout)
    if rank:
        made = ordering.rank(made, keys, order[0], tie=order[1:], out=rank, **layout)
    return made


def feature_columns(df: DataFrame, inputs: Sequence[str], helpers: Sequence[str] = ("const",)) -> list[str]:
    """The columns that feature building added."""
    known = {*inputs, *helpers}
    return [c for c in df.columns if c not in known]


def assemble(
    train: DataFrame, cols: Sequence[str], handle_invalid: str = "error", scale: bool = False
) -> PipelineModel:
    """A fitted pipeline that adds ``features`` and, if asked, ``scaledFeatures``.

    The scaler learns its ranges from ``train`` only.
    """
    stages = [VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid=handle_invalid)]
    if scale:
        stages.append(MinMaxScaler(inputCol="features", outputCol="scaledFeatures"))
    return Pipeline(stages=stages).fit(train)
