"""Record layouts shared by sources, operators and sinks.

Column names and field order are fixed values of the wire formats.
"""

from __future__ import annotations

from pyspark.sql import types as T

SENSORS = ["Db1t_avg", "Db2t_avg", "Gb1t_avg", "Gb2t_avg", "Ot_avg"]
LABEL = "Ot_avg"
TIME = "Date_time"
SERIES = "series_key"

SENSOR_SCHEMA = T.StructType(
    [T.StructField(TIME, T.TimestampType())] + [T.StructField(c, T.DoubleType()) for c in SENSORS]
)

# Shape of a record read from a message topic.
RECORD_SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("timestampType", T.IntegerType()),
    ]
)

PREDICTION_FIELDS = [
    "TS",
    "Temp",
    "Temp_Predict",
    "RMSE_Score",
    "MAE_Score",
    "MSE_Score",
    "Latency_Start",
    "Latency_End",
    "Latency",
]

# One row per matched event time; order is the order of the result files.
HYBRID_FIELDS = [
    "TS",
    "Speed_Latency",
    "Batch_Latency",
    "Speed_Latency_Start",
    "Batch_Latency_Start",
    "Speed_Latency_End",
    "Batch_Latency_End",
    "RT_Temp",
    "Speed_RT_Temp",
    "Batch_RT_Temp",
    "Wt_Temp",
    "Speed_RMSE",
    "Batch_RMSE",
    "Speed_MAE",
    "Batch_MAE",
    "Wt_RMSE",
    "Wt_MAE",
    "Wt_Latency",
]
HYBRID_SCHEMA = T.StructType(
    [T.StructField("TS", T.TimestampType())] + [T.StructField(c, T.DoubleType()) for c in HYBRID_FIELDS[1:]]
)

KPI_FIELDS = [
    "Epoch_Id",
    "Record_Num",
    "Speed_Latency",
    "Batch_Latency",
    "Wt_Latency",
    "Speed_RMSE",
    "Batch_RMSE",
    "Wt_RMSE",
    "Speed_MAE",
    "Batch_MAE",
    "Wt_MAE",
    "MQTT_Publish_Time",
]

REGISTRY_SCHEMA = T.StructType(
    [
        T.StructField("model_version", T.StringType()),
        T.StructField("series_key", T.StringType()),
        T.StructField("layer", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("train_start", T.TimestampType()),
        T.StructField("train_end", T.TimestampType()),
        T.StructField("weights", T.ArrayType(T.DoubleType())),
        T.StructField("n", T.LongType()),
        T.StructField("rmse", T.DoubleType()),
    ]
)

# Shares of the two layers in the fixed ensemble.
SPEED_WEIGHT = 0.3
BATCH_WEIGHT = 0.7
