"""Topics kept as files: offsets, admission, restarts, repeated batches."""

import json

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from duotide.schemas import KPI_FIELDS
from duotide.sources import sinks, topics


def _records(spark, rows, topic="a", partitions=2):
    df = spark.createDataFrame(rows, "key string, value string")
    return topics.keyed(df.repartition(3), topic, partitions)


def _read(df):
    cols = [F.col(c).cast("string").alias(c) for c in ("key", "value")]
    return sorted(map(tuple, df.select("topic", "partition", "offset", *cols).collect()))


def _values(df):
    return sorted(r[0] for r in df.select(F.col("value").cast("string")).collect() if r[0] is not None)


def _gapless(df):
    got = df.groupBy("topic", "partition").agg(F.min("offset"), F.max("offset"), F.count("*"), F.count_distinct("offset"))
    return all(low == 0 and high + 1 == n == distinct for _, _, low, high, n, distinct in got.collect())


def test_offsets_have_no_gaps_over_appends(spark, tmp_path):
    path = str(tmp_path / "topics")
    for k in range(3):
        topics.write(_records(spark, [(f"k{i % 5}", f"{k}-{i}") for i in range(40)]), path)
    topics.write(_records(spark, [("x", "1")], "b"), path)
    both = topics.scan(spark, path, ["a", "b"])
    assert both.count() == 121 and _gapless(both)
    assert topics.scan(spark, path, "b").count() == 1
    assert both.groupBy("key").agg(F.count_distinct("topic", "partition").alias("n")).where("n > 1").count() == 0


def test_nulls_repeats_and_nothing(spark, tmp_path):
    path = str(tmp_path / "topics")
    assert topics.scan(spark, path, "none").count() == 0
    topics.write(_records(spark, []), path)
    assert topics.scan(spark, path, "a").count() == 0
    topics.write(_records(spark, [(None, "v"), (None, None), ("k", None), ("k", ""), ("k", "v"), ("k", "v")]), path)
    got = topics.scan(spark, path, "a")
    assert sorted((r[3] or "-", "null" if r[4] is None else r[4]) for r in _read(got)) == [
        ("-", "null"), ("-", "v"), ("k", ""), ("k", "null"), ("k", "v"), ("k", "v"),
    ]
    assert _gapless(got)


def test_order_of_a_key_is_kept(spark, tmp_path):
    path = str(tmp_path / "topics")
    rows = spark.range(2000).select((F.col("id") % 7).cast("string").alias("key"), F.col("id").cast("string").alias("value"))
    topics.write(topics.keyed(rows.repartition(4, "key").sortWithinPartitions(F.col("value").cast("long")), "a", 3), path)
    by_key = {}
    for _, partition, offset, key, value in _read(topics.scan(spark, path, "a", rowsPerTask="150")):
        by_key.setdefault(key, []).append((partition, offset, int(value)))
    assert sum(map(len, by_key.values())) == 2000
    assert all([v for *_, v in sorted(own)] == sorted(v for *_, v in own) for own in by_key.values())


def test_a_repeated_epoch_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "topics")
    rows = [("k", str(i)) for i in range(10)]
    for epoch in (0, 0, 1, 0, 1):
        topics.write(_records(spark, rows), path, "layer", epoch)
    assert topics.scan(spark, path, "a").count() == 20
    topics.write(_records(spark, rows), path, "other", 0)
    assert topics.scan(spark, path, "a").count() == 30
    with pytest.raises(Exception, match="epoch"):
        spark_write = _records(spark, rows).write.format(topics.FORMAT).mode("append").option("path", path)
        spark_write.option("writer", "layer").save()


def test_a_record_without_partition_is_refused(spark, tmp_path):
    path = str(tmp_path / "topics")
    with pytest.raises(Exception, match="no partition"):
        topics.write(_records(spark, [("k", "v")]).withColumn("partition", F.lit(None).cast("int")), path)
    assert topics.scan(spark, path, "a").count() == 0


def _drain(spark, path, out, checkpoint, runs, **options):
    sizes = []
    for _ in range(runs):
        stream = topics.stream(spark, path, ["a", "b"], **options)
        query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
        query.awaitTermination()
        sizes.append(sum(p["numInputRows"] for p in query.recentProgress))
    return sizes


def test_limit_and_restarts_read_every_offset_once(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / n) for n in ("topics", "out", "checkpoint"))
    topics.write(_records(spark, [(f"k{i % 9}", f"a{i}") for i in range(70)]), path)
    topics.write(_records(spark, [(f"k{i % 9}", f"b{i}") for i in range(5)], "b"), path)
    sizes = _drain(spark, path, out, checkpoint, 2, max_offsets=30, group="g")
    assert all(0 < n <= 30 for n in sizes)
    topics.write(_records(spark, [("new", f"c{i}") for i in range(12)], "b"), path)  # a partition grows in between
    sizes += _drain(spark, path, out, checkpoint, 4, max_offsets=30, group="g")
    got = spark.read.parquet(out)
    assert max(sizes) <= 30 and sum(sizes) == got.count() == 87
    assert _read(got) == _read(topics.scan(spark, path, ["a", "b"]))


def test_latest_starts_behind_what_is_there(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / n) for n in ("topics", "out", "checkpoint"))
    topics.write(_records(spark, [("k", "old")]), path)
    _drain(spark, path, out, checkpoint, 1, starting="latest")
    topics.write(_records(spark, [("k", "new")]), path)
    _drain(spark, path, out, checkpoint, 1, starting="latest")
    assert _values(spark.read.parquet(out)) == ["new"]


def test_stream_to_topic_and_a_lost_commit(spark, tmp_path):
    """A batch whose entry was written, but not the query's own commit, is repeated and adds nothing."""
    path, checkpoint = str(tmp_path / "topics"), tmp_path / "checkpoint"

    def copy():
        stream = topics.stream(spark, path, "a").select(F.col("key"), F.col("value"))
        records = topics.keyed(stream, "copy", 2)
        out = records.writeStream.format(topics.FORMAT).option("path", path).option("writer", "copy")
        out.option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()

    topics.write(_records(spark, [("k", str(i)) for i in range(20)]), path)
    copy()
    for name in ("0", ".0.crc"):
        (checkpoint / "commits" / name).unlink(missing_ok=True)
    topics.write(_records(spark, [("k", str(i)) for i in range(20, 25)]), path)
    copy()  # repeats the first batch
    assert topics.scan(spark, path, "copy").count() == 20
    copy()
    got = topics.scan(spark, path, "copy")
    assert _values(got) == sorted(str(i) for i in range(25)) and _gapless(got)


def test_predictions_and_kpi_to_topics(spark, tmp_path):
    path = str(tmp_path / "topics")
    df = spark.createDataFrame([("s", "1,2")], "key string, value string")
    for epoch in (0, 0, 1):
        sinks.write_predictions(df, {"topics": path, "topic": "speed", "writer": "layer"}, epoch)
        sinks.write_predictions(df, {"topics": path, "topic": "again"}, epoch)
    assert [r[3:] for r in _read(topics.scan(spark, path, "speed"))] == [("s", "1,2")] * 2
    assert topics.scan(spark, path, "again").count() == 3
    row = spark.range(1).select(*[F.lit(i).alias(c) for i, c in enumerate(KPI_FIELDS)])
    sinks.write_kpi(row, {"topics": path, "topic": "kpi"}, 0)
    (message,) = _values(topics.scan(spark, path, "kpi"))
    assert json.loads(message) == {c: str(i) for i, c in enumerate(KPI_FIELDS)}


def test_sessions_of_their_own(spark, tmp_path):
    """A query over many records has a session with more partitions; the thread's active one stays as it is."""
    path, out, checkpoint = (str(tmp_path / n) for n in ("topics", "out", "checkpoint"))
    topics.write(_records(spark, [("k", "main")]), path)
    for n in range(2):  # beside an active session that has the format
        own = spark.newSession()
        rows = own.range(3).select(F.col("id").cast("string").alias("value"))
        topics.write(topics.keyed(rows, "a", 2), path)
        assert topics.scan(own, path, "a").count() == topics.scan(spark, path, "a").count() == 1 + 3 * (n + 1)
        _drain(own, path, out, checkpoint, 1)
        assert SparkSession.getActiveSession()._jsparkSession.equals(spark._jsparkSession)
    assert _values(spark.read.parquet(out)) == sorted(["main", *"012012"])
