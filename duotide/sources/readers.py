"""Streams, tables and files the engine reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duotide.functions.codec import decode_columnar_json, incomplete
from duotide.operators.ordering import row_index
from duotide.schemas import HYBRID_SCHEMA, RECORD_SCHEMA, SENSOR_SCHEMA, SENSORS, SERIES, TIME


def kafka_stream(
    spark: SparkSession,
    brokers: str,
    topics: str | Sequence[str],
    starting: str = "earliest",
    max_offsets: int | None = None,
    **options: str,
) -> DataFrame:
    """Records of one or more topics; needs the Kafka connector on the class path.

    ``max_offsets`` bounds what one micro-batch may hold.
    """
    names = topics if isinstance(topics, str) else ",".join(topics)
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("subscribe", names)
        .option("startingOffsets", starting)
        .options(**options)
    )
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load()


def record_stream(
    spark: SparkSession, path: str, max_files: int | None = None, schema: T.StructType = RECORD_SCHEMA
) -> DataFrame:
    """Parquet files of topic-shaped records as a stream, oldest file first."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A plain scan over all cores when it comes in fewer splits, as one small file does; else as it is.

    Counting the partitions of a plan with shuffles would run them, so keep this on scans.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def sensor_csv(spark: SparkSession, path: str | list[str], infer: bool = False) -> DataFrame:
    """Historic sensor rows with a header line.

    The fixed schema saves the extra pass that inference takes, and turns
    malformed fields into NULL.
    """
    reader = spark.read.option("header", True)
    if infer:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(SENSOR_SCHEMA).csv(path)


def hybrid_results(spark: SparkSession, path: str | list[str], format: str = "csv") -> DataFrame:
    """Result rows of all epochs below a path or glob, as one table.

    The glob names files, or the epoch folders that the sink writes; of the folder
    above them, each row also has its ``epoch_id``. ``series_key`` is NULL in files without it.
    """
    reader = spark.read.schema(T.StructType([*HYBRID_SCHEMA.fields, T.StructField(SERIES, T.StringType())]))
    return reader.option("header", True).csv(path) if format == "csv" else reader.format(format).load(path)


def columnar_json(spark: SparkSession, path: str | list[str], one_per_file: bool = True) -> DataFrame:
    """Sensor rows of columnar JSON batches, one document per file or per line."""
    return decode_columnar_json(spark.read.text(path, wholetext=one_per_file))


def quoted_records(lines: DataFrame, topic: str, keep: Sequence[str] = ()) -> DataFrame:
    """Text lines in ``value`` as JSON-quoted topic records without the incomplete ones."""
    return lines.where(~incomplete("value")).select(
        *keep, F.lit(topic).alias("topic"), F.concat(F.lit('"'), F.trim("value"), F.lit('"')).alias("value")
    )


def replay(spark: SparkSession, path: str | list[str], topic: str, max_line: int | None = None) -> DataFrame:
    """Sensor CSVs as records for a topic: no header, no incomplete rows, the first ``max_line``.

    Files come in order of their names, lines in order within them. The limit keeps
    lines by their number, which takes one range shuffle and no task that holds
    them all.
    """
    header = ",".join([TIME, *SENSORS])
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    # within a block, ids rise in the order of reading
    lines = lines.where(F.trim("value") != header).withColumn("line", F.monotonically_increasing_id())
    place = ["file_path", "file_block_start", "line"]
    if max_line is None:
        return quoted_records(lines, topic, keep=place)
    records = quoted_records(lines, topic, keep=place)
    numbered = row_index(records, place).where(F.col("row_index") <= max_line)
    return numbered.drop("line").withColumnRenamed("row_index", "line")


def replay_stream(spark: SparkSession, path: str, topic: str, max_files: int | None = None) -> DataFrame:
    """The same as a stream over a folder that files are put into; ``max_files`` bounds a micro-batch."""
    reader = spark.readStream.option("wholetext", False)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    header = ",".join([TIME, *SENSORS])
    return quoted_records(reader.text(path).where(F.trim("value") != header), topic)
