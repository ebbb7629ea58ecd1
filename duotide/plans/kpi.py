"""One key-performance row per epoch of result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duotide.functions.scalars import epoch_seconds
from duotide.schemas import KPI_FIELDS

_SHOWN = [c for c in KPI_FIELDS if c.startswith(("Speed_", "Batch_", "Wt_"))]


def rollup(
    df: DataFrame,
    epoch: str = "epoch_id",
    order: Sequence[str] = ("TS",),
    publish_time: Column | None = None,
    complete: Sequence[str] | None = None,
) -> DataFrame:
    """Count of complete rows and the latency and scores on the first of them.

    Layer scores repeat on the rows of one upstream batch, so the first row
    speaks for the epoch; ``*_Mean`` columns average over all its rows, which
    differs when one epoch mixes upstream batches.
    """
    rows = df.dropna("any", subset=list(complete) if complete else None)
    first = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    out = rows.groupBy(epoch).agg(
        F.count("*").alias("Record_Num"),
        *[F.min_by(c, first).alias(c) for c in _SHOWN],
        *[F.avg(c).alias(f"{c}_Mean") for c in ("Speed_RMSE", "Batch_RMSE")],
    )
    return _stamped(out.withColumnRenamed(epoch, "Epoch_Id"), publish_time)


def of_epoch(
    df: DataFrame,
    epoch_id: int,
    order: Sequence[str] = ("TS",),
    publish_time: Column | None = None,
    complete: Sequence[str] | None = None,
) -> DataFrame:
    """:func:`rollup` of persisted rows that are all of one epoch; no complete row: no row.

    The first row is the least of each task's least, so nothing is sorted, which an
    aggregate that keeps a text as its least value so far would do.
    """
    rows = df.dropna("any", subset=list(complete) if complete else None)
    counted = rows.agg(F.count("*").alias("Record_Num"), *[F.avg(c).alias(f"{c}_Mean") for c in ("Speed_RMSE", "Batch_RMSE")])
    first = rows.orderBy(*order).limit(1).select(F.lit(epoch_id).cast("bigint").alias("Epoch_Id"), *_SHOWN)
    return _stamped(first.crossJoin(counted), publish_time)  # one row each


def _stamped(out: DataFrame, publish_time: Column | None) -> DataFrame:
    stamp = publish_time if publish_time is not None else epoch_seconds(F.current_timestamp())
    means = [c for c in out.columns if c.endswith("_Mean")]
    return out.withColumn("MQTT_Publish_Time", stamp).select(*KPI_FIELDS, *means)
