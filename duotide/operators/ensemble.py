"""Match the two layers' predictions and combine them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from duotide import scratch
from duotide.functions.scalars import clip
from duotide.operators import metrics, ordering, skew
from duotide.schemas import BATCH_WEIGHT, HYBRID_FIELDS, SERIES, SPEED_WEIGHT

_CARRIED = [
    "Temp",
    "Temp_Predict",
    "RMSE_Score",
    "MAE_Score",
    "Latency_Start",
    "Latency_End",
    "Latency",
]


def weighted(speed: str | Column, batch: str | Column, speed_weight=SPEED_WEIGHT, batch_weight=BATCH_WEIGHT) -> Column:
    """The two predictions as a weighted sum; weights are numbers or columns."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    as_weight = lambda w: w if isinstance(w, Column) else F.lit(float(w))
    return as_weight(speed_weight) * as_col(speed) + as_weight(batch_weight) * as_col(batch)


def split_layers(df: DataFrame, speed: str, batch: str, topic: str = "topic") -> tuple[DataFrame, DataFrame]:
    """The records of the two topics; filters run before any decoding."""
    return df.where(F.col(topic) == speed), df.where(F.col(topic) == batch)


def match_layers(
    df: DataFrame,
    speed: str,
    batch: str,
    topic: str = "topic",
    keys: Sequence[str] = (SERIES,),
    time: str = "TS",
    offset: str = "offset",
    carried: Sequence[str] = _CARRIED,
) -> DataFrame:
    """Event times present in both layers, columns prefixed ``sp_`` and ``bt_``.

    Deduplicating each layer and joining them on time needs two shuffles, two
    sorts and a join. Both layers share the key, so one grouped aggregate does
    it all: the lowest offset per layer wins, and a time that one layer lacks
    is dropped. Copies are merged before the shuffle.
    """
    picked = []
    for name, prefix in ((speed, "sp_"), (batch, "bt_")):
        at = F.when(F.col(topic) == name, F.col(offset))
        picked += [F.min_by(c, at).alias(prefix + c) for c in carried]
        picked.append(F.min(at).alias(prefix + "offset"))
    return (
        df.where(F.col(time).isNotNull() & F.col(topic).isin(speed, batch))
        .groupBy(*keys, time)
        .agg(*picked)
        .where(F.col("sp_offset").isNotNull() & F.col("bt_offset").isNotNull())
    )


def project_hybrid(
    matched: DataFrame,
    speed_weight: float | Column = SPEED_WEIGHT,
    batch_weight: float | Column = BATCH_WEIGHT,
    digits: int = 3,
    keep: Sequence[str] = (SERIES,),
    time: str = "TS",
) -> DataFrame:
    """Matched rows as result rows; predictions are rounded before any score."""
    value = {
        "RT_Temp": F.col("sp_Temp"),
        "Speed_RT_Temp": F.col("sp_Temp_Predict"),
        "Batch_RT_Temp": F.col("bt_Temp_Predict"),
        "Wt_Temp": weighted("sp_Temp_Predict", "bt_Temp_Predict", speed_weight, batch_weight),
        "Speed_RMSE": F.col("sp_RMSE_Score"),
        "Batch_RMSE": F.col("bt_RMSE_Score"),
        "Speed_MAE": F.col("sp_MAE_Score"),
        "Batch_MAE": F.col("bt_MAE_Score"),
    }
    stamps = [
        F.col(prefix + stamp).alias(f"{layer}_{stamp}")
        for stamp in ("Latency", "Latency_Start", "Latency_End")
        for layer, prefix in (("Speed", "sp_"), ("Batch", "bt_"))
    ]
    return matched.select(
        *keep, F.col(time).alias("TS"), *stamps, *[F.round(v, digits).alias(k) for k, v in value.items()]
    )


def hybrid_rows(
    df: DataFrame,
    speed: str,
    batch: str,
    speed_weight: float = SPEED_WEIGHT,
    batch_weight: float = BATCH_WEIGHT,
    digits: int = 3,
    keys: Sequence[str] = (SERIES,),
    **matching,
) -> DataFrame:
    """Result rows from one table that holds the predictions of both topics."""
    matched = match_layers(df, speed, batch, keys=keys, **matching)
    return project_hybrid(matched, speed_weight, batch_weight, digits, keep=keys)


def hybrid_join(sp: DataFrame, bt: DataFrame, **options) -> DataFrame:
    """Result rows from separate prediction tables of the two layers."""
    both = sp.withColumn("topic", F.lit("speed")).unionByName(bt.withColumn("topic", F.lit("batch")))
    return hybrid_rows(both, "speed", "batch", **options)


def hybrid_scores(df: DataFrame, by: Sequence[str] = (), empty_value: float | None = None) -> DataFrame:
    """Ensemble scores of result rows and, for comparison, of each layer on the same rows."""
    out = df.groupBy(*by).agg(
        F.sqrt(F.avg((F.col("Wt_Temp") - F.col("RT_Temp")) ** 2)).alias("Wt_RMSE"),
        F.avg(F.abs(F.col("Wt_Temp") - F.col("RT_Temp"))).alias("Wt_MAE"),
        F.sqrt(F.avg((F.col("Speed_RT_Temp") - F.col("RT_Temp")) ** 2)).alias("Speed_Matched_RMSE"),
        F.avg(F.abs(F.col("Speed_RT_Temp") - F.col("RT_Temp"))).alias("Speed_Matched_MAE"),
        F.sqrt(F.avg((F.col("Batch_RT_Temp") - F.col("RT_Temp")) ** 2)).alias("Batch_Matched_RMSE"),
        F.avg(F.abs(F.col("Batch_RT_Temp") - F.col("RT_Temp"))).alias("Batch_Matched_MAE"),
        F.count("*").alias("n"),
    )
    return out if empty_value is None else out.fillna(empty_value, ["Wt_RMSE", "Wt_MAE"])


def attach_hybrid_scores(df: DataFrame, by: Sequence[str], spread: Sequence[str], latency: float = 0.0) -> DataFrame:
    """Result rows completed with the ensemble scores of their group, in file column order."""
    df = scratch.materialise(df, "rows")  # read for the scores and for the join
    stats = hybrid_scores(df, by).select(*by, "Wt_RMSE", "Wt_MAE", "n")
    out = skew.join_group_stats(df, stats, by, spread).withColumn("Wt_Latency", F.lit(float(latency)))
    return out.select(*[c for c in df.columns if c not in HYBRID_FIELDS], *HYBRID_FIELDS)


def _squared_parts(label: str, speed: str, batch: str) -> list[Column]:
    gap = F.col(speed) - F.col(batch)
    return [
        F.sum((F.col(label) - F.col(batch)) * gap).alias("_num"),
        F.sum(gap * gap).alias("_den"),
        F.count(F.col(label) + gap).alias("n"),
    ]


def _best_share(num: Column, den: Column, start: float) -> Column:
    return F.coalesce(clip(F.try_divide(num, den), 0.0, 1.0), F.lit(start))


def best_weights(
    df: DataFrame,
    label: str,
    speed: str,
    batch: str,
    metric: str = "rmse",
    by: Sequence[str] = (),
    steps: int = 20,
    start: float = 0.5,
) -> DataFrame:
    """Speed and batch weights in [0, 1] that sum to 1 and minimise the error.

    Squared error has one minimum in closed form from two sums. Absolute error
    is summed at ``steps + 1`` evenly spaced weights, all in the same pass.
    ``start`` stands where the layers never differ.
    """
    if metric == "rmse":
        sums = df.groupBy(*by).agg(*_squared_parts(label, speed, batch))
        share = _best_share(F.col("_num"), F.col("_den"), start)
        return sums.select(*by, share.alias("speed_weight"), (1 - share).alias("batch_weight"), "n")
    if metric != "mae":
        raise ValueError(f"unknown metric {metric!r}")
    errors = [
        F.avg(F.abs(F.col(label) - weighted(speed, batch, k / steps, 1 - k / steps))) for k in range(steps + 1)
    ]
    sums = df.groupBy(*by).agg(F.array(*errors).alias("_errors"), F.count(label).alias("n"))
    share = (F.array_position("_errors", F.array_min("_errors")) - 1) / F.lit(float(steps))
    return sums.select(
        *by,
        share.alias("speed_weight"),
        (1 - share).alias("batch_weight"),
        F.array_min("_errors").alias("mae"),
        "n",
    )


def best_weights_exact(
    df: DataFrame,
    label: str,
    speed: str,
    batch: str,
    by: Sequence[str] = (),
    start: float = 0.5,
    bins: int = 256,
) -> DataFrame:
    """The speed weight in [0, 1] with the least absolute error, exactly; ``n`` rows it was learnt from.

    With the gap ``d = speed - batch`` the error is the sum of ``|d| * |r - w|`` for
    ``r = (label - batch) / d``, so the best weight is the median of ``r`` weighted by
    ``|d|``, the smallest where several are as good. No group is sorted: weights are
    summed in ``bins`` equal bins, the bin that holds the median is cut anew between the
    smallest and largest value in it, and so on until all values in it are equal. Each
    pass reads only the rows in such bins. Where the layers never differ, ``start`` stands.
    Rows with a missing value are left out; a NULL key is a key like any other.
    """
    keys = list(by) or ["_all"]
    df = df if by else df.withColumn("_all", F.lit(0))
    gap = F.col(speed) - F.col(batch)
    share = clip(F.try_divide(F.col(label) - F.col(batch), gap), 0.0, 1.0)
    rows = df.where((gap != 0) & F.col(label).isNotNull()).select(*keys, F.abs(gap).alias("_w"), share.alias("_v"))
    rows = scratch.materialise(rows, "shares")
    counts = df.groupBy(*keys).agg(F.count(F.col(label) + gap).alias("n"))
    edges = {"_lo": F.lit(0.0), "_hi": F.lit(1.0), "_below": F.lit(0.0), "_half": F.lit(None).cast("double")}
    left, found = rows.withColumns(edges), None
    order = Window.partitionBy(*keys).orderBy("_bin")  # at most ``bins`` rows of a group
    whole = Window.partitionBy(*keys)
    while True:
        place = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
        binned = left.groupBy(*keys, place.alias("_bin")).agg(
            F.sum("_w").alias("_sum"),
            F.min("_v").alias("_lo"),
            F.max("_v").alias("_hi"),
            F.count("*").alias("n"),
            F.first("_below").alias("_below"),
            F.first("_half").alias("_half"),
        )
        upto = F.col("_below") + F.sum("_sum").over(order)
        half = F.coalesce("_half", F.sum("_sum").over(whole) / 2)
        told = binned.select("*", upto.alias("_upto"), half.alias("_need"), F.max("_bin").over(whole).alias("_last"))
        enough = (F.col("_upto") >= F.col("_need")) | (F.col("_bin") == F.col("_last"))
        chosen = told.where(enough).groupBy(*keys).agg(F.min_by(F.struct("_lo", "_hi", "n", (F.col("_upto") - F.col("_sum")).alias("_below"), F.col("_need").alias("_half")), "_bin").alias("m"))
        chosen = scratch.materialise(chosen.select(*keys, "m.*"), "median-bins")
        done = chosen.where(F.col("_lo") == F.col("_hi")).select(*keys, F.col("_lo").alias("speed_weight"))
        found = done if found is None else found.unionByName(done)
        open_bins = chosen.where(F.col("_lo") < F.col("_hi"))
        if open_bins.isEmpty():
            break
        inside = skew.join_group_stats(rows, open_bins, keys, ["_v", "_w"]).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        left = scratch.materialise(inside.drop("n"), "shares")
        rows = left.select(*keys, "_w", "_v")
    out = skew.on_keys(counts, found, keys, "left").withColumn("speed_weight", F.coalesce("speed_weight", F.lit(start)))
    return out.select(*by, "speed_weight", (1 - F.col("speed_weight")).alias("batch_weight"), "n")


def dynamic_weights(
    df: DataFrame,
    label: str,
    speed: str,
    batch: str,
    time: str = "TS",
    width: str = "60 seconds",
    by: Sequence[str] = (SERIES,),
    start: float = 0.5,
    **layout,
) -> DataFrame:
    """Weights for each window, learnt from the window before it in the same series.

    Rows collapse to two sums per window first; only those are ordered. ``n`` is
    the number of rows in the window itself.
    """
    sums = (
        metrics.with_window(df, time, width)
        .groupBy(*by, "window_start")
        .agg(*_squared_parts(label, speed, batch), F.count("*").alias("rows"))
    )

    def build(w):
        return [F.lag("_num", 1).over(w).alias("_num_before"), F.lag("_den", 1).over(w).alias("_den_before")]

    sums = scratch.materialise(sums, "window-sums")
    carried = ordering.over_order(sums, build, by, ["window_start"], back=1, **layout)
    share = _best_share(F.col("_num_before"), F.col("_den_before"), start)
    return carried.select(
        *by,
        "window_start",
        share.alias("speed_weight"),
        (1 - share).alias("batch_weight"),
        F.col("rows").alias("n"),
    )


def dynamic_ensemble(
    df: DataFrame,
    label: str,
    speed: str,
    batch: str,
    spread: Sequence[str],
    time: str = "TS",
    width: str = "60 seconds",
    by: Sequence[str] = (SERIES,),
    out: str = "Wt_Temp",
    **options,
) -> DataFrame:
    """Rows with the prediction combined by the weights of their window."""
    df = scratch.materialise(df, "rows")  # read for the weights and for the join
    weights = dynamic_weights(df, label, speed, batch, time, width, by, **options)
    rows = metrics.with_window(df, time, width)
    joined = skew.join_group_stats(rows, weights, [*by, "window_start"], spread).drop("n")
    return joined.withColumn(out, weighted(speed, batch, F.col("speed_weight"), F.col("batch_weight")))
