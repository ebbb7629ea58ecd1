"""Nothing drops rows silently: dates, NULL keys, damaged and late records, several files."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from duotide.operators import model, skew
from duotide.plans import catalog, report
from duotide.schemas import LABEL, SENSORS, SERIES, TIME
from duotide.sources import readers, sinks
from duotide.streaming import queries
from duotide.plans import frames

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
T0 = datetime(2021, 3, 1)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("years", [-4, 12])
def test_every_row_is_fed_at_any_date(spark, tmp_path, years):
    table = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    moved = table.withColumn("l_shipdate", F.col("l_shipdate") + F.make_ym_interval(F.lit(years)))
    moved.write.parquet(f"{tmp_path}/lineitem.parquet")
    run = catalog.load()[0]
    assert run["stream_publishing"](spark, str(tmp_path)).count() == table.count()
    assert run["latest_models"](spark, str(tmp_path)).count() == table.select("l_suppkey").distinct().count()
    assert run["latest_artifact"](spark, str(tmp_path)).first()["model_version"] == f"model_{2001 + years}-{2002 + years}"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_large_keys_stay_unique(spark, tmp_path):
    table = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    large = table.withColumns({"l_orderkey": F.col("l_orderkey") + 10**12, "l_partkey": F.col("l_partkey") + 10**9, "l_suppkey": F.col("l_suppkey") + 10**8})
    large.write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = frames.records(spark, str(tmp_path))
    assert rows.select("offset").distinct().count() == table.count()


@pytest.mark.parametrize("limit, parts", [(100, 512), (0, 512), (0, 2)])
def test_null_keys_join(spark, limit, parts):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([None, "a", "a", "b", None, "a", "a"])], "k string, i int")
    stats = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("i").alias("s"))
    got = skew.join_group_stats(rows, stats, ["k"], ["i"], parts=parts, broadcast_groups=limit)
    assert got.columns == ["k", "i", "n", "s"]
    assert sorted((r["i"], r["s"]) for r in got.collect()) == [(0, 4), (1, 14), (2, 14), (3, 3), (4, 4), (5, 14), (6, 14)]


def test_window_of_unknown_latency_stays(spark):
    row = {c: 1.0 for c in report.WINDOW_METRICS}
    rows = [(*row.values(), T0), (*[*row.values()][:-1], None, T0 + timedelta(1))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in row) + ", TS timestamp")
    got = {r["Total_Latency"]: (r["counts"], r["TS"]) for r in report.window_report(df).collect()}
    assert got == {1.0: (1, T0), None: (1, T0 + timedelta(1))}


def test_levels_far_apart(spark):
    far = spark.range(2000).selectExpr("id % 2 AS g", "id", "sin(id * 7.1) AS e", "(id % 2) * 1e9 AS level")
    rows = far.selectExpr("g", "level + e AS x", "level + 0.5 * e + 0.1 * cos(id * 3.3) AS y")
    want = {r["g"]: r["s"] for r in rows.groupBy("g").agg(F.regr_slope("y", "x").alias("s")).collect()}
    got = {r["g"]: r["weights"][1] for r in model.train(rows, ["x"], "y", by=["g"]).collect()}
    assert got == pytest.approx(want, rel=1e-6) and abs(got[0] - 0.5) < 0.05


def _lines(first, n):
    return "\n".join([",".join([TIME, *SENSORS])] + [f"2021-03-01 00:00:{first + i:02d}," + ",".join([str(first + i)] * 5) for i in range(n)]) + "\n"


def test_replay_order_over_files(spark, tmp_path):
    (tmp_path / "part-0.csv").write_text(_lines(0, 3))
    (tmp_path / "part-1.csv").write_text(_lines(3, 50))
    got = readers.replay(spark, str(tmp_path), "source", max_line=5).orderBy("line").collect()
    assert [r["value"].split(",")[1] for r in got] == ["0", "1", "2", "3", "4"] and [r["line"] for r in got] == [1, 2, 3, 4, 5]


def test_replay_as_a_timed_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(_lines(0, 4) + "2021-03-01 00:01:00,1,2,3,4\n")
    out = str(tmp_path / "out")

    def on_batch(rows, epoch_id):
        sinks.to_folder(rows, out, epoch_id)

    stream = readers.replay_stream(spark, str(tmp_path / "in"), "source")
    query = queries.run_query(stream, on_batch, str(tmp_path / "checkpoint"), seconds=1, wait=False)
    try:
        query.processAllAvailable()
        (tmp_path / "in" / "b.csv").write_text(_lines(4, 6))
        query.processAllAvailable()
    finally:
        query.stop()
    assert spark.read.parquet(out).count() == 10


def _records(spark, times, broken=()):
    rows = [("s", T0 + timedelta(minutes=t), i, *[float(t)] * 5) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, f"series_key string, Date_time timestamp, offset long, {', '.join(c + ' double' for c in SENSORS)}")
    wire = frames.topic_records(df, "source")
    return wire.withColumn("value", F.when(F.col("offset").isin(*broken), F.regexp_replace(F.col("value").cast("string"), r",[^,]*,", ",,").cast("binary")).otherwise(F.col("value")))


def test_damaged_record_keeps_its_place(spark, tmp_path):
    out, counts = str(tmp_path / "out"), str(tmp_path / "counts")
    weights = [0.0, *[1.0 if i == 4 else 0.0 for i in range(10)]]
    queries.scoring_layer("speed", lambda: ("v", weights), {"path": out}, counts=counts)(_records(spark, range(8), [4]), 0)
    got = sorted(r["offset"] for r in spark.read.parquet(out).collect())
    assert got == [2, 3, 4, 7]  # 5 and 6 have the damaged record among their lags
    assert tuple(spark.read.parquet(counts).select("records", "damaged", "scored").first()) == (8, 1, 4)


def test_late_rows_are_flagged(spark, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    on_batch = queries.carried_lags(state, lambda rows, e: sinks.to_folder(rows, out, e), cols=[LABEL])
    on_batch(_records(spark, [0, 1, 2, 5, 8, 9]), 0)
    on_batch(_records(spark, [3, 4, 6, 10]), 1)
    rows = {r[LABEL]: r for r in spark.read.parquet(out).where(f"{SERIES} = 's'").collect()}
    assert [t for t, r in sorted(rows.items()) if r["late"]] == [3, 4, 6]
    assert all(rows[t]["const"] == 0 and rows[t][f"{LABEL}t-1"] == 0 for t in (3, 4, 6))
    assert (rows[10][f"{LABEL}t-1"], rows[10][f"{LABEL}t-2"], rows[10]["const"]) == (9, 8, 1)


def test_series_and_epoch_survive_csv(spark, tmp_path):
    from duotide.schemas import HYBRID_FIELDS

    schema = "series_key string, TS timestamp, " + ", ".join(f"{c} double" for c in HYBRID_FIELDS[1:])
    for epoch_id, name in enumerate(("a", "b")):
        sinks.write_hybrid(spark.createDataFrame([(name, T0, *[1.0] * (len(HYBRID_FIELDS) - 1))], schema), str(tmp_path / "r"), epoch_id)
    got = readers.hybrid_results(spark, str(tmp_path / "r")).collect()
    assert sorted((r["series_key"], r["epoch_id"]) for r in got) == [("a", 0), ("b", 1)]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_partitions_grow_with_the_records(spark, monkeypatch):
    """A task's share of the records is bounded, whatever the usual number of partitions; the session itself stays as it was."""
    usual, rows = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    before = frames.records(spark, SF_DIR)
    assert before.sparkSession is spark
    monkeypatch.setattr(frames, "PARTITION_ROWS", rows // (3 * usual))
    after = frames.records(spark, SF_DIR)
    assert int(after.sparkSession.conf.get("spark.sql.shuffle.partitions")) >= 3 * usual == 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert after.sparkSession.conf.get("spark.sql.session.timeZone") == spark.conf.get("spark.sql.session.timeZone")
    assert sorted(after.collect()) == sorted(before.collect())
    assert catalog.load()[0]["dynamic_ensemble"](spark, SF_DIR).count() > 0 and catalog.load()[0]["replay_limit"](spark, SF_DIR).count() > 0


def test_result_rows_are_written_once(spark, tmp_path, monkeypatch):
    """Result rows go to CSV as they are computed, not through a table of their own."""
    from duotide import scratch
    from duotide.plans import catalog_layers
    from duotide.schemas import HYBRID_FIELDS

    rows = [(i // 3, i % 3, i % 7, i % 2, datetime(1995, 1, 1) + timedelta(days=i // 2), 1.0 + i, float(i % 50), 0.05, 0.02) for i in range(300)]
    names = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate timestamp_ntz, l_extendedprice double, l_quantity double, l_discount double, l_tax double"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    written, write = [], scratch.materialise
    monkeypatch.setattr(scratch, "materialise", lambda df, *a, **b: written.append(df.columns) or write(df, *a, **b))
    got = catalog_layers.hybrid_results_csv(spark, str(tmp_path)).collect()
    assert written and not [c for c in written if {*HYBRID_FIELDS} <= {*c}]
    want = catalog_layers._hybrid(spark, str(tmp_path)).collect()
    assert {r["epoch_id"] for r in got} == {0, 1} and len(got) == len(want) > 200
    key = lambda r: (r["series_key"], r["TS"])
    assert [[r[c] for c in HYBRID_FIELDS] for r in sorted(got, key=key)] == [[r[c] for c in HYBRID_FIELDS] for r in sorted(want, key=key)]
