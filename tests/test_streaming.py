from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from duotide.functions import codec
from duotide.operators import features, model, registry
from duotide.plans import catalog_streams, frames, kpi
from duotide.schemas import HYBRID_FIELDS, PREDICTION_FIELDS, RECORD_SCHEMA, SENSORS, SERIES, TIME
from duotide.sources import readers, sinks
from duotide.streaming import queries

T0 = datetime(2021, 3, 1)


def _sensor_records(spark, places, series="s"):
    rows = [(series, T0 + timedelta(minutes=i), i, *[float(i * i % 17 + k) for k in range(5)]) for i in places]
    schema = f"series_key string, Date_time timestamp, offset long, {', '.join(c + ' double' for c in SENSORS)}"
    df = spark.createDataFrame(rows, schema)
    return df, frames.topic_records(df, "source").select(*RECORD_SCHEMA.names)


def _prediction_records(spark, rows):
    cols = "key string, topic string, offset long, TS timestamp, " + ", ".join(f"{c} double" for c in PREDICTION_FIELDS[1:])
    df = spark.createDataFrame(
        [(k, topic, off, T0 + timedelta(minutes=m), 10.0, p, 1.0, 1.0, 1.0, 0.0, 2.0, 2.0) for k, topic, off, m, p in rows], cols
    )
    wire = codec.encode_prediction(df, keep=("key", "topic", "offset"))
    return wire.select(
        F.col("key").cast("binary").alias("key"),
        F.col("value").cast("binary").alias("value"),
        "topic",
        F.lit(0).alias("partition"),
        "offset",
        F.lit(None).cast("timestamp").alias("timestamp"),
        F.lit(0).alias("timestampType"),
    )


class Folders:
    def __init__(self, spark, tmp_path):
        self.spark, self.source, self.checkpoint = spark, str(tmp_path / "source"), str(tmp_path / "checkpoint")
        self.out, self.state = str(tmp_path / "out"), str(tmp_path / "state")

    def feed(self, records, on_batch=None):
        records.write.mode("append").parquet(self.source)
        if on_batch:
            self.run(on_batch)

    def run(self, on_batch):
        return queries.run_query(readers.record_stream(self.spark, self.source), on_batch, self.checkpoint)


@pytest.fixture
def folders(spark, tmp_path):
    return Folders(spark, tmp_path)


def _last_value():
    names = features.lag_names(2)
    return "v1", [0.0, *[1.0 if c == "Ot_avgt-1" else 0.0 for c in names]]


def test_scoring_restarts_history_and_does_not_repeat_after_restart(spark, folders):
    on_batch = queries.scoring_layer("speed", _last_value, {"path": folders.out}, clock=iter([100.0, 103.5] * 9).__next__)
    for part in (range(0, 10), range(10, 20)):
        folders.feed(_sensor_records(spark, part)[1], on_batch)
    folders.run(on_batch)  # nothing new
    got = codec.decode_prediction(spark.read.parquet(folders.out), ("epoch_id", "topic", "model_version")).collect()
    assert len(got) == 2 * (10 - 2)
    assert {r["topic"] for r in got} == {"speed"} and {r["model_version"] for r in got} == {"v1"}
    assert {r["Latency"] for r in got} == {3.5}
    last = {T0 + timedelta(minutes=i): float((i - 1) ** 2 % 17 + 4) for i in range(20)}
    assert all(r["Temp_Predict"] == last[r["TS"]] for r in got)
    assert all(r["MSE_Score"] == pytest.approx(r["RMSE_Score"] ** 2) for r in got)


def test_scoring_skips_batches_without_usable_rows(spark, folders):
    on_batch = queries.scoring_layer("speed", _last_value, {"path": folders.out})
    broken = _sensor_records(spark, range(3))[1].withColumn("value", F.lit(b"junk"))
    folders.feed(broken, on_batch)
    folders.feed(_sensor_records(spark, range(2))[1], on_batch)  # shorter than the lag
    folders.feed(_sensor_records(spark, range(5))[1], on_batch)
    assert spark.read.parquet(folders.out).count() == 3


@pytest.mark.parametrize("layout", ["keyed", "ranged"])
def test_carried_lags_equal_batch_lags(spark, folders, layout):
    def write(rows, epoch_id):
        sinks.to_folder(rows, folders.out, epoch_id)

    on_batch = queries.carried_lags(folders.state, write, layout=layout)
    parts = [range(0, 7), range(7, 8), range(8, 20)]  # the second is shorter than the lag
    for part in parts:
        other = _sensor_records(spark, part, "t")[1]
        folders.feed(_sensor_records(spark, part)[1].union(other), on_batch)
    both = _sensor_records(spark, range(20))[0].union(_sensor_records(spark, range(20), "t")[0])
    cols = [SERIES, TIME, "offset", *SENSORS, *features.lag_names(2)]
    want = sorted(map(tuple, features.add_lags(both, 2).select(*cols).collect()))
    got = spark.read.parquet(folders.out)
    assert got.count() == 40
    assert sorted(map(tuple, got.where("const = 1").select(*cols).collect())) == want


def test_hybrid_layer_writes_rows_and_kpi_once_per_epoch(spark, folders, tmp_path):
    rows_path, kpi_path = str(tmp_path / "rows"), str(tmp_path / "kpi")
    on_batch = queries.hybrid_layer("speed", "batch", rows_path, {"path": kpi_path}, clock=iter([5.0, 6.0, 7.0] * 9).__next__)
    first = [("s", "speed", 1, 0, 9.0), ("s", "batch", 2, 0, 11.0), ("s", "speed", 3, 1, 9.0)]
    folders.feed(_prediction_records(spark, first), on_batch)
    folders.feed(_prediction_records(spark, [("s", "batch", 4, 1, 12.0), ("s", "batch", 5, 2, 1.0)]), on_batch)
    folders.feed(_prediction_records(spark, [("s", "batch", 6, 3, 8.0), ("s", "speed", 7, 3, 8.0)]), on_batch)
    rows = readers.hybrid_results(spark, f"{rows_path}/epoch_id=*").orderBy("TS").collect()
    # the pair split over two micro-batches never meets here
    assert [r["TS"] for r in rows] == [T0, T0 + timedelta(minutes=3)]
    assert rows[0]["Wt_Temp"] == pytest.approx(10.4) and rows[0]["Wt_RMSE"] == pytest.approx(0.4)
    assert rows[0]["Wt_Latency"] == 1.0
    messages = [r[0] for r in spark.read.text(f"{kpi_path}/epoch_id=*").orderBy("value").collect()]
    assert len(messages) == 2 and messages[0].startswith('{"Epoch_Id":"0","Record_Num":"1","Speed_Latency":"2.0"')
    assert messages[0].endswith('"MQTT_Publish_Time":"7.0"}')


def test_stream_join_matches_over_batches_and_drops_late_rows(spark, folders):
    def run():
        stream = readers.record_stream(spark, folders.source)
        joined = queries.hybrid_join_stream(stream, "speed", "batch", delay="10 minutes")
        writer = joined.writeStream.format("parquet").option("checkpointLocation", folders.checkpoint)
        writer.trigger(availableNow=True).start(folders.out).awaitTermination()

    folders.feed(_prediction_records(spark, [("s", "speed", 1, 0, 9.0), ("s", "speed", 2, 0, 99.0), ("t", "speed", 3, 0, 1.0)]))
    run()
    folders.feed(_prediction_records(spark, [("s", "batch", 4, 0, 11.0), ("s", "batch", 5, 60, 1.0), ("s", "speed", 6, 60, 2.0)]))
    run()
    folders.feed(_prediction_records(spark, [("t", "batch", 7, 0, 1.0)]))  # an hour behind the watermark
    run()
    got = spark.read.parquet(folders.out).orderBy("TS").collect()
    assert [(r[SERIES], r["TS"]) for r in got] == [("s", T0), ("s", T0 + timedelta(minutes=60))]
    assert got[0]["Batch_RT_Temp"] == 11.0 and got[0]["Speed_RT_Temp"] in (9.0, 99.0)


def test_retraining_publishes_one_model_per_epoch(spark, folders, tmp_path):
    path = str(tmp_path / "registry")
    on_batch = queries.retraining(path)
    for part in (range(0, 40), range(40, 100)):
        folders.feed(_sensor_records(spark, part)[1], on_batch)
    rows = registry.models(spark, path).orderBy("train_end").collect()
    assert [r["n"] for r in rows] == [38, 58]
    assert rows[1]["train_end"] == T0 + timedelta(minutes=99)
    newest = registry.latest_weights(spark, path, "speed")
    sensors, _ = _sensor_records(spark, range(40, 100))
    want = model.train(features.add_lags(sensors, 2), features.lag_names(2), by=()).first()["weights"]
    assert newest["weights"] == pytest.approx(want, abs=1e-9)


def test_publishing_archives_every_row(spark, folders):
    on_batch = queries.publishing(folders.out, rows_per_message=4)
    sensors, records = _sensor_records(spark, range(10))
    folders.feed(records, on_batch)
    assert spark.read.text(f"{folders.out}/epoch_id=0").count() == 3
    back = readers.columnar_json(spark, f"{folders.out}/epoch_id=*", one_per_file=False)
    want = sorted(map(tuple, sensors.select(TIME, *SENSORS).collect()))
    assert sorted(map(tuple, back.select(TIME, *SENSORS).collect())) == want


def test_epoch_rewrite_replaces_only_that_epoch(spark, tmp_path):
    path = str(tmp_path / "p")
    for epoch_id, n in ((0, 3), (1, 5), (0, 4)):
        sinks.to_folder(spark.range(n), path, epoch_id)
    counts = dict(spark.read.parquet(path).groupBy("epoch_id").count().collect())
    assert counts == {0: 4, 1: 5}


def test_kafka_source_needs_the_connector(spark):
    with pytest.raises(Exception, match="kafka"):
        readers.kafka_stream(spark, "localhost:1", ["a", "b"], max_offsets=10)


def test_two_layer_decodes_a_batch_once(spark, folders, tmp_path, monkeypatch):
    decoded, decode = [], queries.sensor_rows
    monkeypatch.setattr(queries, "sensor_rows", lambda *a, **k: decoded.append(1) or decode(*a, **k))
    paths = [str(tmp_path / n) for n in ("registry", "sent", "rows", "kpi", "weights")]
    on_batch = queries.two_layer(*paths[:3], {"path": paths[3]}, paths[4], 1, [SENSORS[-1]], clock=lambda: 7.0)
    for at in (0, 40):
        folders.feed(_sensor_records(spark, range(at, at + 40))[1], on_batch)
    assert len(decoded) == 2
    assert spark.read.parquet(f"{paths[1]}/speed/epoch_id=1").count() == 39


def test_kpi_row_of_an_epoch_sorts_nothing(spark):
    names = [c for c in HYBRID_FIELDS if c != "TS"]
    rows = [(s, T0 + timedelta(minutes=m), *[v + i for i in range(len(names))]) for s, m, v in (("b", 1, 5.0), ("a", 1, 7.0), ("c", 2, 9.0))]
    rows.append(("a", T0, *[None] * len(names)))  # incomplete
    df = spark.createDataFrame(rows, f"{SERIES} string, TS timestamp, " + ", ".join(f"{c} double" for c in names))
    options = dict(order=("TS", SERIES), publish_time=F.lit(1.0), complete=HYBRID_FIELDS)
    got = kpi.of_epoch(df, 4, **options)
    assert got.collect() == kpi.rollup(df.withColumn("epoch_id", F.lit(4).cast("bigint")), **options).collect()
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert kpi.of_epoch(df.where(F.col(names[0]).isNull()), 4, **options).isEmpty()


def test_feed_reads_a_part_without_the_others(spark, monkeypatch):
    plans = []
    rows = spark.range(30).select(F.lit("s").alias("key"), F.col("id").alias("offset"))

    def to_records(part):
        plans.append(part._jdf.queryExecution().executedPlan().toString())
        record = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in RECORD_SCHEMA.fields}
        return part.select(*[F.col(n).cast(RECORD_SCHEMA[n].dataType).alias(n) if n in part.columns else c for n, c in record.items()])

    seen = []
    catalog_streams._feed(spark, (F.col("offset") % 3).cast("int"), rows, to_records, lambda stream: seen.append(stream.isStreaming))
    assert seen == [True] * 3 and all("PartitionFilters: [isnotnull(_part" in p for p in plans)
