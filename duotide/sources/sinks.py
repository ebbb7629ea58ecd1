"""Where results go. Writes of one epoch replace that epoch, so a retry changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duotide.functions.scalars import epoch_seconds
from duotide.schemas import HYBRID_FIELDS, KPI_FIELDS, SERIES
from duotide.sources import topics


def to_topic(df: DataFrame, brokers: str, topic: str) -> None:
    """Send ``value`` (and ``key``) to a topic; needs the Kafka connector."""
    cols = [F.col(c).cast("string").alias(c) for c in ("key", "value") if c in df.columns]
    df.select(*cols).write.format("kafka").option("kafka.bootstrap.servers", brokers).option("topic", topic).save()


def to_folder(df: DataFrame, path: str, epoch_id: int, format: str = "parquet", **options) -> None:
    df.write.format(format).options(**options).mode("overwrite").save(f"{path}/epoch_id={epoch_id}")


def _send(df: DataFrame, target: dict, epoch_id: int, format: str) -> None:
    if "brokers" in target:
        to_topic(df, target["brokers"], target["topic"])
    elif "topics" in target:
        records = topics.keyed(df, target["topic"], target.get("partitions", 8))
        # epochs belong to a checkpoint, so a name must too: with the old name, a new checkpoint's epochs would count as sent
        topics.write(records, target["topics"], target.get("writer"), epoch_id)
    else:
        to_folder(df, target["path"], epoch_id, format)


def write_predictions(df: DataFrame, target: dict, epoch_id: int) -> None:
    """Encoded predictions to ``{"brokers": .., "topic": ..}``, ``{"topics": folder, "topic": ..}`` or ``{"path": ..}``.

    In a folder of topics, a repeated epoch is sent again unless there is a ``writer``, a name for this query's checkpoint.
    """
    _send(df, target, epoch_id, "parquet")


def write_hybrid(df: DataFrame, path: str, epoch_id: int, format: str = "csv") -> None:
    """Result rows of one epoch, in file column order; CSV files have the series last, the epoch is their folder's name."""
    extra = [c for c in df.columns if c not in HYBRID_FIELDS and (format != "csv" or c == SERIES)]
    options = {"header": "true"} if format == "csv" else {}
    to_folder(df.select(*HYBRID_FIELDS, *extra), path, epoch_id, format, **options)


def archive_json(df: DataFrame, path: str, epoch_id: int | None = None) -> None:
    """JSON objects stamped with their arrival time, in one folder per day."""
    arrival = {"Lambda_get_time": epoch_seconds(F.current_timestamp()), "day": F.current_date()}
    stamped = df.withColumns(arrival)
    target = path if epoch_id is None else f"{path}/epoch_id={epoch_id}"
    stamped.write.mode("append" if epoch_id is None else "overwrite").partitionBy("day").json(target)


def kpi_message(df: DataFrame) -> DataFrame:
    """KPI rows as JSON messages in ``value``; every value is a string there."""
    fields = [F.col(c).cast("string").alias(c) for c in KPI_FIELDS]
    return df.select(F.to_json(F.struct(*fields)).alias("value"))


def write_kpi(df: DataFrame, target: dict, epoch_id: int) -> None:
    _send(kpi_message(df), target, epoch_id, "text")
