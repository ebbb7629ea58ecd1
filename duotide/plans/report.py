"""Offline report over result rows: latency, throughput and error per window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from duotide.functions.scalars import rate, row_max, row_min
from duotide.operators import dedup
from duotide.schemas import HYBRID_FIELDS, SERIES

# One window of the stream shows as one combination of these values.
WINDOW_METRICS = [
    "Speed_RMSE",
    "Batch_RMSE",
    "Wt_RMSE",
    "Speed_Latency",
    "Batch_Latency",
    "Wt_Latency",
    "Total_Latency",
]


def union_results(*frames: DataFrame) -> DataFrame:
    """Result tables appended; columns are matched by name and may be missing."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def clean_results(df: DataFrame) -> DataFrame:
    """Rows complete in every result field, one per series and event time."""
    fields = [c for c in HYBRID_FIELDS if c in df.columns]
    keys = [c for c in (SERIES, "TS") if c in df.columns]
    return dedup.keep_first(df.dropna("any", subset=fields), keys, [c for c in fields if c != "TS"])


def total_latency(df: DataFrame) -> DataFrame:
    """From the first start to the last end of the two layers, plus the ensemble's own time."""
    end = row_max("Speed_Latency_End", "Batch_Latency_End")
    start = row_min("Speed_Latency_Start", "Batch_Latency_Start")
    spans = df.withColumns({"End_time": end, "Start_time": start})
    return spans.withColumn("Total_Latency", F.col("End_time") - F.col("Start_time") + F.col("Wt_Latency"))


def window_counts(df: DataFrame) -> DataFrame:
    """Rows per window, and the first event time of each."""
    return df.groupBy(*WINDOW_METRICS).agg(F.count("*").alias("counts"), F.min("TS").alias("TS"))


def window_report(df: DataFrame) -> DataFrame:
    """Windows with the first event time seen at their total latency; one of unknown latency stays.

    There is one row per window of the stream here, however many rows it had.
    """
    first = F.min("TS").over(Window.partitionBy("Total_Latency"))
    return window_counts(df).withColumn("TS", first).select(*WINDOW_METRICS, "counts", "TS")


def throughput(df: DataFrame) -> DataFrame:
    """Records per second of each layer and in total; NULL where no time passed."""
    return df.withColumns(
        {f"{part}_TPS": rate("counts", f"{part}_Latency") for part in ("Speed", "Batch", "Wt", "Total")}
    )


def build(df: DataFrame) -> DataFrame:
    """The whole report, in time order."""
    return throughput(window_report(total_latency(clean_results(df)))).orderBy("TS")


def summary(df: DataFrame, digits: int = 3) -> DataFrame:
    """Means over the windows of a report."""
    cols = [c for c in df.columns if c in WINDOW_METRICS or c.endswith("_TPS")]
    means = [F.round(F.avg(c), digits).alias(f"mean_{c}") for c in cols]
    return df.agg(F.count("*").alias("windows"), F.sum("counts").alias("records"), *means)
