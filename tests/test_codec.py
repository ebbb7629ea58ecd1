import json
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from duotide.functions import codec
from duotide.schemas import PREDICTION_FIELDS, SENSORS

GOOD = '"2021-03-01 00:00:00,41.20,42.75,50.10,49.80,12.30"'


def decode(spark, *values, **options):
    df = spark.createDataFrame([(v,) for v in values], "value string")
    return [tuple(r) for r in codec.decode_sensor(df, **options).collect()]


def test_decode_strips_the_outer_quotes(spark):
    assert decode(spark, GOOD) == [(datetime(2021, 3, 1), 41.2, 42.75, 50.1, 49.8, 12.3)]


@pytest.mark.parametrize(
    "bad, missing",
    [
        ('"2021-03-01 00:00:00,x,1,1,1,1"', [1]),
        ('"2021-03-01 00:00:00,1,1,1,1,"', [5]),
        ('"not a time,1,1,1,1,1"', [0]),
        ('"2021-03-01 00:00:00,1"', [1, 2, 3, 4, 5]),  # the closing quote stays in field 1
        ('""', [0, 1, 2, 3, 4, 5]),
    ],
)
def test_decode_malformed_fields(spark, bad, missing):
    (row,) = decode(spark, bad)
    assert [i for i, v in enumerate(row) if v is None] == missing
    assert len(decode(spark, bad, GOOD, on_error="drop")) == 1
    with pytest.raises(Exception, match="malformed record"):
        decode(spark, bad, on_error="fail")


def test_decode_good_record_does_not_fail(spark):
    assert len(decode(spark, GOOD, on_error="fail")) == 1


def test_decode_drop_parses_each_field_once(spark):
    df = spark.createDataFrame([(GOOD,)], "value string")
    plan = codec.decode_sensor(df, on_error="drop")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("as timestamp)") == 1


def test_encode_null_policies(spark):
    row = (datetime(2021, 3, 1), 1.0, None, 1e-5, 2.0, 3.0, 12345678.9, 5.0, 6.0)
    df = spark.createDataFrame([row], "TS timestamp, " + ", ".join(f"{c} double" for c in PREDICTION_FIELDS[1:]))
    assert codec.encode_prediction(df).first()["value"] is None
    text = codec.encode_prediction(df, null_policy="empty").first()["value"]
    assert text == "2021-03-01 00:00:00,1.0,,1.0E-5,2.0,3.0,1.23456789E7,5.0,6.0"
    back = codec.decode_prediction(spark.createDataFrame([(text,)], "value string"), keep=()).first()
    assert tuple(back) == row


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=8, max_size=8))
def test_decode_inverts_encode(spark, numbers):
    row = (datetime(2021, 3, 1, 1, 2, 3, 456000), *numbers)
    df = spark.createDataFrame([row], "TS timestamp, " + ", ".join(f"{c} double" for c in PREDICTION_FIELDS[1:]))
    assert tuple(codec.decode_prediction(codec.encode_prediction(df), keep=()).first()) == row


def _columnar(spark, document):
    df = spark.createDataFrame([(json.dumps(document),)], "value string")
    return sorted(map(tuple, codec.decode_columnar_json(df).collect()))


def test_columnar_json_keys_in_any_order_or_missing(spark):
    document = {"Date_time": {"10": "2021-03-01 00:10:00", "2": "2021-03-01 00:02:00"}, "Lambda_get_time": "16.5"}
    document |= {c: {"2": 2.0, "10": 10.0} for c in SENSORS}
    document["Db1t_avg"] = {"2": None}
    got = _columnar(spark, document)
    assert got == [
        (2, datetime(2021, 3, 1, 0, 2), None, 2.0, 2.0, 2.0, 2.0, 16.5),
        (10, datetime(2021, 3, 1, 0, 10), None, 10.0, 10.0, 10.0, 10.0, 16.5),
    ]


def test_columnar_json_of_empty_maps(spark):
    assert _columnar(spark, {"Date_time": {}, **{c: {} for c in SENSORS}}) == []


def test_columnar_json_messages_are_bounded(spark):
    cols = [F.col("id").cast("double").alias(c) for c in SENSORS]
    df = spark.range(1003).select(F.timestamp_seconds("id").alias("Date_time"), *cols)
    messages = codec.encode_columnar_json(df, rows_per_message=100).collect()
    sizes = sorted(len(json.loads(m["value"])["Date_time"]) for m in messages)
    assert sizes == [3] + [100] * 10
    first = json.loads(next(m["value"] for m in messages if m["message"] == 0))
    assert list(first["Ot_avg"]) == [str(i) for i in range(100)]
    assert first["Ot_avg"]["7"] == 7.0


def test_messages_without_a_total_order(spark):
    cols = [F.when(F.col("id") % 5 > 0, F.col("id").cast("double")).alias(c) for c in SENSORS]
    df = spark.range(0, 1003, 1, 7).select(F.timestamp_seconds(F.col("id") % 9).alias("Date_time"), *cols)
    df = df.unionByName(df.limit(1))  # a repeated row
    messages = codec.frame_columnar_json(df, rows_per_message=100)
    sizes = [len(json.loads(m["value"])["Date_time"]) for m in messages.orderBy("message").collect()]
    assert sizes == [100] * 10 + [4]
    plan = messages._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and plan.count("Exchange hashpartitioning") <= 1
    back = codec.decode_columnar_json(messages).select("Date_time", *SENSORS)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert codec.frame_columnar_json(df.limit(0)).collect() == []
