"""Versioned models as an append-only table, and artifacts as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from duotide.schemas import REGISTRY_SCHEMA


def version_name(train_start: str, train_end: str) -> str:
    return f"model_{train_start}-{train_end}"


def publish(models: DataFrame, path: str, layer: str, kind: str, version: str, train_start, train_end) -> None:
    """Store fitted models under one version.

    Every version has its own folder, so publishing it again after a failure
    replaces it and leaves the others alone.
    """
    have = set(models.columns)
    given = {
        "model_version": F.lit(version),
        "layer": F.lit(layer),
        "kind": F.lit(kind),
        "train_start": F.lit(train_start).cast("timestamp"),
        "train_end": F.lit(train_end).cast("timestamp"),
    }
    cols = []
    for field in REGISTRY_SCHEMA:
        value = given.get(field.name) if field.name in given else (F.col(field.name) if field.name in have else F.lit(None))
        cols.append(value.cast(field.dataType).alias(field.name))
    models.select(*cols).write.mode("overwrite").parquet(f"{path}/version={version}")


def models(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTRY_SCHEMA).parquet(f"{path}/version=*")


def latest(df: DataFrame, by: Sequence[str] = ("series_key", "layer")) -> DataFrame:
    """The newest model of each series and layer by end of training, then version."""
    newest = F.max_by(F.struct(*df.columns), F.struct("train_end", "model_version")).alias("m")
    return df.groupBy(*by).agg(newest).select("m.*")


MANIFEST = "model_version string, epoch_id long"


def commit(spark: SparkSession, path: str, version: str, epoch_id: int) -> None:
    """Note that an epoch published a version; repeating the epoch replaces the note."""
    note = spark.createDataFrame([(version, epoch_id)], MANIFEST).coalesce(1)
    note.write.mode("overwrite").parquet(f"{path}/manifest/epoch={epoch_id}")


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def committed(spark: SparkSession, path: str) -> DataFrame | None:
    """Versions and the epochs that published them; None before the first."""
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/epoch=*") if _exists(spark, f"{path}/manifest") else None


def snapshot(spark: SparkSession, path: str, layer: str, before: int | None = None, by: Sequence[str] = ("series_key",)) -> DataFrame | None:
    """The newest model of each series among those that epochs earlier than ``before`` published.

    What a later epoch, or the same one when it is repeated, publishes does not change
    it. Newest is the last epoch, whatever times its rows had. None if there is none.
    """
    notes = committed(spark, path)
    if notes is None:
        return None
    notes = notes if before is None else notes.where(F.col("epoch_id") < before)
    if notes.isEmpty():
        return None
    # one note an epoch
    found = models(spark, path).where(F.col("layer") == layer).join(F.broadcast(notes), "model_version")
    columns = F.struct(*REGISTRY_SCHEMA.names)
    return found.groupBy(*by).agg(F.max_by(columns, F.struct("epoch_id", "model_version")).alias("m")).select("m.*")


def pinned(spark: SparkSession, path: str, layer: str, pins: str, epoch_id: int) -> DataFrame | None:
    """The snapshot that an epoch of another query took when it first ran.

    The bound is written to ``pins`` before the models are used, so a repeated epoch
    sees the models of its first attempt although others were published meanwhile.
    """
    pin = f"{pins}/epoch={epoch_id}"
    if not _exists(spark, f"{pin}/_SUCCESS"):
        notes = committed(spark, path)
        newest = notes.agg(F.max("epoch_id")).first()[0] if notes is not None else None  # one row
        bound = -1 if newest is None else newest + 1
        spark.createDataFrame([(bound,)], "bound long").coalesce(1).write.mode("overwrite").parquet(pin)
    bound = spark.read.schema("bound long").parquet(pin).first()["bound"]
    return snapshot(spark, path, layer, bound)


def latest_weights(spark: SparkSession, path: str, layer: str) -> Row | None:
    """The newest single model of a layer: one row, read once per micro-batch."""
    return models(spark, path).where(F.col("layer") == layer).orderBy(F.desc("train_end"), F.desc("model_version")).first()


def latest_artifact(spark: SparkSession, folder: str, pattern: str = "*.tflite") -> DataFrame:
    """Path and time of the newest matching file; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "modificationTime", "length")
    )
    return files.orderBy(F.desc("modificationTime"), F.desc("path")).limit(1)
