"""The driver's tables seen as sensor records and layer predictions.

``lineitem`` plays the wide sensor stream: one row per record, five measures as
the five sensors, the supplier as the series. ``hot=True`` takes the return flag
as the series instead, so that three series share all rows. ``events`` gives the
hourly frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from duotide.functions import codec
from duotide.operators import features, metrics
from duotide.schemas import LABEL, PREDICTION_FIELDS, SENSORS, SERIES, TIME

EPOCH_DAYS = 30

# Order and line number repeat now and then, so a record's number also counts the rows that
# share them, in this order. Numbers stay unique up to LINE_COPIES such rows and 1e15 orders.
LINE_ORDER = "l_partkey l_suppkey l_shipdate l_extendedprice l_quantity l_discount l_tax".split()
LINE_COPIES = 1024

# Records that a partition of a shuffle may hold: beyond, there are more partitions, so no task grows with the table.
PARTITION_ROWS = 500_000

# Event type that stands for each sensor.
EVENT_SENSORS = {
    "click": "Db1t_avg",
    "error": "Db2t_avg",
    "purchase": "Gb1t_avg",
    "signup": "Gb2t_avg",
    "view": "Ot_avg",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(rows: int) -> int:
    """Shuffle partitions that so many records need."""
    return -(-rows // PARTITION_ROWS)


def sized(spark: SparkSession, rows: int) -> SparkSession:
    """The session, or one like it with as many shuffle partitions as the records need, if that is more."""
    if parts_for(rows) <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        return spark
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if session.conf.get(key, None) != value:  # set on the session after its start
            session.conf.set(key, value)
    session.conf.set("spark.sql.shuffle.partitions", parts_for(rows))
    return session


def records(spark: SparkSession, sf_dir: str, hot: bool = False) -> DataFrame:
    series = F.col("l_returnflag") if hot else F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    spark = sized(spark, table(spark, sf_dir, "lineitem").count())
    same_line = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*LINE_ORDER)
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").withColumn("_copy", F.row_number().over(same_line) - 1)
    return lines.select(
        series.alias(SERIES),
        F.col("l_shipdate").alias(TIME),
        (line * LINE_COPIES + F.col("_copy")).alias("offset"),
        F.col("l_extendedprice").alias("Db1t_avg"),
        F.col("l_discount").alias("Db2t_avg"),
        F.col("l_tax").alias("Gb1t_avg"),
        F.col("l_linenumber").cast("double").alias("Gb2t_avg"),
        F.col("l_quantity").alias("Ot_avg"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value per hour and event type, summed in whole cents so that order does not matter."""
    events = table(spark, sf_dir, "events").select(
        F.window("ts", "1 hour").getField("start").alias(TIME),
        "event_type",
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )
    means = []
    for kind, sensor in EVENT_SENSORS.items():
        own = F.when(F.col("event_type") == kind, F.col("cents"))
        means.append((F.sum(own).cast("double") / F.nullif(F.count(own) * F.lit(100.0), F.lit(0.0))).alias(sensor))
    return events.groupBy(TIME).agg(*means)


def epoch_of(time: str):
    """Number of the 30-day window since 1970, whatever the session's time zone."""
    return F.floor(F.unix_date(F.to_date(time)) / EPOCH_DAYS).cast("bigint")


def raw_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both layers' predictions of every record that has the history they need.

    Speed repeats the last value, batch takes the mean of the last two. They
    stand in for models so that every number can be checked exactly.
    """
    lagged = features.add_lags(
        records(spark, sf_dir), 2, [LABEL], order=(TIME, "offset"), drop_warmup=False, nth="nth"
    )
    last, before = F.col(f"{LABEL}t-1"), F.col(f"{LABEL}t-2")
    layers = F.array(
        F.struct(F.lit("speed").alias("topic"), F.lit(1).alias("needs"), last.alias("Temp_Predict")),
        F.struct(F.lit("batch").alias("topic"), F.lit(2).alias("needs"), ((last + before) / 2).alias("Temp_Predict")),
    )
    return (
        lagged.select(SERIES, F.col(TIME).alias("TS"), "offset", F.col(LABEL).alias("Temp"), "nth", F.inline(layers))
        .where("nth > needs")
        .select(SERIES, "topic", "offset", "TS", "Temp", "Temp_Predict", epoch_of("TS").alias("epoch_id"))
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with the scores of their epoch and made-up latency stamps."""
    scored = metrics.attach_scores(
        raw_predictions(spark, sf_dir), "Temp", "Temp_Predict", ["topic", "epoch_id"], ["offset"]
    )
    epoch, speed = F.col("epoch_id"), F.col("topic") == "speed"
    start = (epoch * 60 + F.when(speed, 0).otherwise(1)).cast("double")
    spent = F.when(speed, 5 + epoch % 7).otherwise(4 + epoch % 5).cast("double")
    return scored.select(
        SERIES,
        "topic",
        "offset",
        "epoch_id",
        *[c for c in PREDICTION_FIELDS if not c.startswith("Latency")],
        start.alias("Latency_Start"),
        (start + spent).alias("Latency_End"),
        spent.alias("Latency"),
    )


def sensor_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as topic text, some of them damaged depending on their own values.

    No tax leaves a field empty, a discount of 0.1 is not a number, and the
    seventh line of an order loses its last field, which leaves the closing quote
    in the field before it.
    """
    rows = records(spark, sf_dir)
    text = [
        F.col(TIME).cast("string"),
        F.col("Db1t_avg").cast("string"),
        F.when(F.col("Db2t_avg") == 0.1, "n/a").otherwise(F.col("Db2t_avg").cast("string")),
        F.when(F.col("Gb1t_avg") == 0, "").otherwise(F.col("Gb1t_avg").cast("string")),
        F.col("Gb2t_avg").cast("string"),
        F.when(F.col("Gb2t_avg") != 7, F.col(LABEL).cast("string")),  # NULL is left out below
    ]
    return rows.select(SERIES, "offset", F.concat(F.lit('"'), F.concat_ws(",", *text), F.lit('"')).alias("value"))


def topic_records(rows: DataFrame, topic: str) -> DataFrame:
    """Sensor rows as records of a topic."""
    return wire_records(codec.encode_sensor(rows, keep=(SERIES, "offset")), topic)


def wire_records(rows: DataFrame, topic: str) -> DataFrame:
    """Encoded rows as records of a topic."""
    return rows.select(
        F.col(SERIES).cast("binary").alias("key"),
        F.col("value").cast("binary").alias("value"),
        F.lit(topic).alias("topic"),
        F.lit(0).alias("partition"),
        "offset",
        F.lit(None).cast("timestamp").alias("timestamp"),
        F.lit(0).alias("timestampType"),
    )


def sensor_columns() -> list[str]:
    return [SERIES, TIME, "offset", *SENSORS]
