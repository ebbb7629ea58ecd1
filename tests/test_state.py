import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_streaming import T0, Folders, _prediction_records, _sensor_records

from duotide.operators import features, registry, scoring
from duotide.schemas import LABEL, RECORD_SCHEMA, SENSORS, SERIES, TIME
from duotide.sources import readers
from duotide.streaming import queries, state


@pytest.fixture
def streams(spark):
    return state.enable(spark.newSession())


class Stream(Folders):
    """Feeds records, runs a streaming DataFrame over them and keeps the progress of each run."""

    def __init__(self, spark, tmp_path, build):
        super().__init__(spark, tmp_path)
        self.build = build

    def take(self, records):
        records.write.mode("append").parquet(self.source)
        stream = self.build(readers.record_stream(self.spark, self.source))
        query = stream.writeStream.format("parquet").option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start(self.out)
        query.awaitTermination()
        return [p for p in query.recentProgress if p["stateOperators"]]

    def rows(self):
        return self.spark.read.parquet(self.out)


def rows_of(spark, rows):
    schema = "series_key string, Date_time timestamp, offset long, Ot_avg double"
    full = spark.createDataFrame(rows, schema)
    return full.select(SERIES, TIME, "offset", *[F.col(LABEL).alias(c) for c in SENSORS])


def records_of(spark, rows):
    """Records without a time or with a damaged value keep their place."""
    from duotide.plans import frames

    text = F.concat_ws(",", F.coalesce(F.col(TIME).cast("string"), F.lit("?")), *[F.coalesce(F.col(c).cast("string"), F.lit("x")) for c in SENSORS])
    wire = rows_of(spark, rows).select(SERIES, "offset", F.concat(F.lit('"'), text, F.lit('"')).alias("value"))
    return frames.wire_records(wire, "source").select(*RECORD_SCHEMA.names)


def minute(i):
    return T0 + timedelta(minutes=i)


def lagged(stream):
    return state.lag_stream(queries.sensor_rows(stream), 2, [LABEL])


def test_lags_go_on_and_touch_only_their_series(streams, tmp_path):
    run = Stream(streams, tmp_path, lagged)
    run.take(_sensor_records(streams, range(6), "s")[1].union(_sensor_records(streams, range(9), "t")[1]))
    run.take(_sensor_records(streams, range(6, 7), "s")[1])  # shorter than the lag
    progress = run.take(_sensor_records(streams, range(7, 30), "s")[1])
    assert [(o["numRowsUpdated"], o["numRowsTotal"]) for p in progress for o in p["stateOperators"]] == [(1, 2)]
    both = _sensor_records(streams, range(30), "s")[0].union(_sensor_records(streams, range(9), "t")[0])
    names = features.lag_names(2, [LABEL])
    want = sorted(map(tuple, features.add_lags(both, 2, [LABEL]).select(SERIES, TIME, "offset", *names).collect()))
    got = run.rows()
    assert got.count() == 39 and sorted(map(tuple, got.where("const = 1").select(SERIES, TIME, "offset", *names).collect())) == want
    assert got.where("late").count() == 0


def test_ties_repeats_missing_and_late_rows(streams, tmp_path):
    run = Stream(streams, tmp_path, lagged)
    run.take(records_of(streams, [("s", minute(5), 4, 4.0), ("s", minute(5), 3, 3.0), ("s", None, 9, 9.0), (None, minute(1), 1, 1.0)]))
    second = [("s", minute(5), 4, 4.5), ("s", minute(5), 6, None), ("s", minute(4), 7, 7.0), (None, minute(2), 2, 2.0), ("s", minute(6), 8, 8.0), ("s", minute(6), 8, 8.0)]
    run.take(records_of(streams, second))
    far = datetime(9000, 1, 1)
    run.take(records_of(streams, [("s", far, 10, 10.0)]))
    got = [tuple(r) for r in run.rows().select(SERIES, TIME, "offset", f"`{LABEL}t-1`", f"`{LABEL}t-2`", "const", "late").collect()]
    assert sorted(got, key=str) == sorted(
        [
            ("s", None, 9, 0.0, 0.0, 0, False),  # a missing time comes first
            ("s", minute(5), 3, 9.0, 0.0, 0, False),
            ("s", minute(5), 4, 3.0, 9.0, 1, False),
            ("s", minute(5), 4, 0.0, 0.0, 0, True),  # a repeat in a later micro-batch
            ("s", minute(4), 7, 0.0, 0.0, 0, True),
            ("s", minute(5), 6, 4.0, 3.0, 1, False),
            ("s", minute(6), 8, None, 4.0, 1, False),  # what was missing stays missing
            ("s", minute(6), 8, 8.0, None, 1, False),  # a repeat in one micro-batch
            ("s", far, 10, 8.0, 8.0, 1, False),
            (None, minute(1), 1, 0.0, 0.0, 0, False),
            (None, minute(2), 2, 1.0, 0.0, 0, False),
        ],
        key=str,
    )


def test_forgotten_series_start_anew(streams, tmp_path):
    # else a query that waits for the clock never runs out of batches without data
    streams.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    run = Stream(streams, tmp_path, lambda s: state.lag_stream(queries.sensor_rows(s), 1, [LABEL], ttl=1))
    run.take(records_of(streams, [("s", minute(1), 1, 1.0)]))
    time.sleep(1.2)
    run.take(records_of(streams, [("s", minute(2), 2, 2.0), ("s", minute(3), 3, 3.0)]))
    assert sorted(map(tuple, run.rows().select("offset", "const").collect())) == [(1, 0), (2, 0), (3, 1)]


def matched(stream):
    return queries.hybrid_match_stream(stream, "speed", "batch", "10 minutes", span=60)


def test_lowest_offset_survives_whatever_batch_it_comes_in(streams, tmp_path):
    run = Stream(streams, tmp_path, matched)
    p = lambda *rows: _prediction_records(streams, list(rows))
    run.take(p(("s", "speed", 7, 0, 9.0), ("s", "speed", 8, 0, 99.0), ("t", "speed", 3, 0, 1.0), ("s", "other", 1, 0, 5.0), (None, "speed", 1, 0, 4.0)))
    first = run.take(p(("s", "batch", 20, 0, 11.0), ("s", "speed", 2, 0, 5.0), ("s", "batch", 21, 0, 12.0), ("s", "speed", 5, 3, 1.0), (None, "batch", 9, 0, 6.0)))
    assert first[-1]["stateOperators"][0]["numRowsTotal"] > 0 and run.rows().count() == 0
    damaged = p(("s", "speed", 30, 4, 1.0)).withColumn("value", F.lit(b"junk"))
    seen = run.take(p(("u", "speed", 40, 30, 1.0)).union(damaged))  # moves the watermark to minute 20
    assert [(x["records"], x["damaged"]) for x in (q["observedMetrics"]["predictions"] for q in seen if q["numInputRows"])] == [(2, 1)]
    late = run.take(p(("t", "batch", 41, 0, 1.0), ("u", "batch", 42, 30, 3.0)))
    assert sum(o["numRowsDroppedByWatermark"] for q in late for o in q["stateOperators"]) == 1
    last = run.take(p(("end", "speed", 50, 90, 1.0)))
    got = run.rows().orderBy("TS").collect()
    assert sorted(((r[SERIES], r["TS"], r["Speed_RT_Temp"], r["Batch_RT_Temp"]) for r in got), key=str) == sorted(
        [("s", T0, 5.0, 11.0), (None, T0, 4.0, 6.0), ("u", minute(30), 1.0, 3.0)], key=str
    )
    # what the watermark has passed is forgotten: the closing record and its timer are all that is left
    assert last[-1]["stateOperators"][0]["numRowsTotal"] <= 2


def test_matching_needs_no_python(streams, tmp_path):
    """One native aggregate: no task goes through Python for each series and span of time."""
    run = Stream(streams, tmp_path, matched)
    seen = run.take(_prediction_records(streams, [("s", "speed", 1, 0, 9.0), ("s", "batch", 2, 0, 9.0)]))
    assert {q["stateOperators"][0]["operatorName"] for q in seen} == {"stateStoreSave"}


def test_windows_sent_when_the_watermark_passes(streams, tmp_path):
    def build(stream):
        return state.windowed_metrics(queries.prediction_rows(stream), "TS", "Temp", "Temp_Predict", "10 minutes", ["topic"], "5 minutes")

    run = Stream(streams, tmp_path, build)
    run.take(_prediction_records(streams, [("s", "speed", 1, 0, 9.0), ("s", "speed", 2, 0, 9.0), ("s", "speed", 3, 12, 14.0)]))
    assert run.rows().count() == 0
    run.take(_prediction_records(streams, [("s", "speed", 4, 8, 12.0), ("s", "batch", 5, 16, 10.0)]))  # out of order, in time
    run.take(_prediction_records(streams, [("s", "speed", 6, 9, 0.0)]))  # its window is sent
    got = [tuple(r) for r in run.rows().select("topic", "window_start", "n", "mae", "mse").collect()]
    assert got == [("speed", T0, 3, pytest.approx(4 / 3), pytest.approx(2.0))]


def least_squares(x, y, w):
    a = np.column_stack([np.ones(len(x)), x]) * np.sqrt(w)[:, None]
    beta = np.linalg.lstsq(a, y * np.sqrt(w), rcond=None)[0]
    return beta, np.sqrt((w * (y - beta[0] - x @ beta[1:]) ** 2).sum() / w.sum())


@pytest.mark.parametrize("forget", [1.0, 0.5])
def test_incremental_least_squares(streams, tmp_path, forget):
    rng = np.random.default_rng(0)
    n = 400
    x1, x2, part = rng.normal(size=n) + 1e6, rng.normal(size=n), np.sort(rng.integers(0, 4, n))
    y = 3 * x1 - x2 * (1 + part) + rng.normal(size=n)
    key = np.where(rng.random(n) < 0.3, "a", "b")
    rows = [(k, None if i == 7 else float(a), float(b), float(c), int(p)) for i, (k, a, b, c, p) in enumerate(zip(key, x1, x2, y, part, strict=True))]
    use = np.arange(n) != 7
    late = part == 1
    late[rng.random(n) < 0.9] = False  # some rows of part 1 come with part 3
    source = str(tmp_path / "in")

    def run(chosen):
        schema = "series_key string, x1 double, x2 double, y double, part long"
        streams.createDataFrame([r for r, c in zip(rows, chosen, strict=True) if c], schema).repartition(3).write.mode("append").parquet(source)
        models = state.incremental_var(streams.readStream.schema(schema).parquet(source), ["x1", "x2"], "part", "y", keep=2, forget=forget)
        query = models.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "o"))
        query.awaitTermination()

    steps = [(part == 0), (part == 1) & ~late, (part == 2), (part == 3) | late]
    for chosen in steps:
        run(chosen)
    got = {(r[SERIES], r["part"]): r for r in streams.read.parquet(str(tmp_path / "o")).collect()}
    assert len(got) == 8
    seen = np.zeros(n, bool)
    for newest, chosen in enumerate(steps):
        seen |= chosen
        for k in "ab":
            own = seen & use & (key == k)
            weight = forget ** (newest - part[own]).astype(float)
            r = got[k, newest]
            for prefix, rows_, w in (("", own, weight), ("recent_", own & (part > newest - 2), None)):
                w = np.ones(rows_.sum()) if w is None else w
                beta, rmse = least_squares(np.column_stack([x1[rows_] - 1e6, x2[rows_]]), y[rows_] - 3e6, w)
                assert r[f"{prefix}n"] == pytest.approx(w.sum()) and r[f"{prefix}rmse"] == pytest.approx(rmse, rel=1e-6)
                assert r[f"{prefix}weights"][1:] == pytest.approx(beta[1:], rel=1e-6)


def test_a_hot_series_is_merged_before_the_shuffle(spark):
    rows = spark.range(20_000).selectExpr("'hot' AS series_key", "id % 7 * 1.0D AS x", "id % 7 * 2.0D AS y", "CAST(0 AS LONG) AS part").repartition(4)
    sent = state.partial_moments(rows, ["x", "y"], "part").collect()
    assert len(sent) <= 8 and sum(r["n"] for r in sent) == 20_000


def chain(tmp_path, **options):
    folders = {n: str(tmp_path / n) for n in ("registry", "predictions", "rows", "kpi", "weights")}
    on_batch = queries.two_layer(folders["registry"], folders["predictions"], folders["rows"], {"path": folders["kpi"]}, folders["weights"], 1, [LABEL], lambda: 0.0, **options)
    return folders, on_batch


@pytest.mark.parametrize("by", [(), (SERIES,)])
def test_a_repeated_epoch_scores_with_the_models_of_its_first_attempt(spark, tmp_path, by):
    folders, on_batch = chain(tmp_path, by=by)
    for epoch in range(3):
        part = range(20 * epoch, 20 * epoch + 20)
        records = _sensor_records(spark, part, "s")[1].union(_sensor_records(spark, part, "t")[1])
        on_batch(records, epoch)

    def sent(epoch):
        return sorted(tuple(r) for layer in ("speed", "batch") for r in spark.read.parquet(f"{folders['predictions']}/{layer}/epoch_id={epoch}").collect())

    before = {e: sent(e) for e in (1, 2)}
    assert before[1] != before[2] and len(before[2]) == 2 * 2 * 19
    for epoch in (1, 2):  # both fail after publishing, and are repeated
        part = range(20 * epoch, 20 * epoch + 20)
        records = _sensor_records(spark, part, "s")[1].union(_sensor_records(spark, part, "t")[1])
        on_batch(records, epoch)
        assert sent(epoch) == before[epoch]


def models_frame(spark, weight, series=("s",)):
    return spark.createDataFrame([(k, 5, [weight, 0.0], 0.1) for k in series], "series_key string, n long, weights array<double>, rmse double")


def publish(spark, path, epoch, weight, series=("s",)):
    version = f"model-{epoch}"
    registry.publish(models_frame(spark, weight, series), path, "speed", "var", version, "2020-01-01", f"20{30 - epoch:02d}-01-01")
    registry.commit(spark, path, version, epoch)


def test_snapshots(spark, tmp_path):
    path, pins = str(tmp_path / "registry"), str(tmp_path / "pins")
    assert registry.snapshot(spark, path, "speed") is None and registry.pinned(spark, path, "speed", pins, 0) is None
    publish(spark, path, 0, 1.0, ("s", "t"))
    publish(spark, path, 1, 2.0)  # its rows were older, yet it is newer
    found = {r[SERIES]: r["weights"][0] for r in registry.snapshot(spark, path, "speed").collect()}
    assert found == {"s": 2.0, "t": 1.0}
    assert {r["weights"][0] for r in registry.snapshot(spark, path, "speed", before=1).collect()} == {1.0}
    assert registry.snapshot(spark, path, "speed", before=0) is None
    first = sorted(map(str, registry.pinned(spark, path, "speed", pins, 7).collect()))
    publish(spark, path, 2, 3.0, ("s", "t"))
    assert sorted(map(str, registry.pinned(spark, path, "speed", pins, 7).collect())) == first  # the repeated epoch
    assert {r["weights"][0] for r in registry.pinned(spark, path, "speed", pins, 8).collect()} == {3.0}
    assert registry.pinned(spark, path, "speed", pins, 0) is None  # there was none when it first ran


def test_series_without_a_model_are_counted(spark, tmp_path):
    out, counts, path = (str(tmp_path / n) for n in ("out", "counts", "registry"))
    publish(spark, path, 0, 1.0)
    on_batch = queries.scoring_layer("speed", None, {"path": out}, 1, cols=[LABEL], counts=counts, models_of=lambda e: registry.snapshot(spark, path, "speed", e))
    on_batch(_sensor_records(spark, range(5), "s")[1].union(_sensor_records(spark, range(4), "t")[1]), 1)
    row = spark.read.parquet(counts).first()
    assert (row["records"], row["damaged"], row["scored"], row["without_model"]) == (9, 0, 4, 3)
    assert {bytes(r["key"]).decode() if not isinstance(r["key"], str) else r["key"] for r in spark.read.parquet(out).collect()} == {"s"}


@pytest.mark.parametrize("broadcast", [True, False])
def test_rows_without_a_model_stay(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr("duotide.operators.skew.join_group_stats.__defaults__", ("n", 2, 0, "inner"))
    rows = spark.createDataFrame([("s", 1.0, i) for i in range(9)] + [("t", 2.0, 10), (None, 3.0, 11)], "series_key string, x double, id long")
    got = scoring.score_by_series(rows, ["x"], models_frame(spark, 4.0), ["id"]).collect()
    assert len(got) == 11 and {(r[SERIES], r["prediction"]) for r in got} == {("s", 4.0), ("t", None), (None, None)}


def test_packed_rows_are_one_a_key_however_many_keys_and_batches(streams):
    streams.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    rows = streams.range(0, 4000, 1, 4).select((F.col("id") % 500).cast("int").alias("k"), F.col("id").alias("v"))
    packed = state.packed(rows, "k")
    found = packed.collect()
    assert len(found) == 500 and all(len(r["v"]) == 8 and {v % 500 for v in r["v"]} == {r["k"]} for r in found)
    assert state.packed(rows, "k", limit=1).select(F.explode("v")).distinct().count() == 4000  # cut often, nothing lost


@pytest.mark.parametrize("buckets", [1, 2048])
def test_series_of_one_call_keep_apart(streams, tmp_path, monkeypatch, buckets):
    """A call of the state operator has a bucket of series; each has its own lags, moments and lateness."""
    monkeypatch.setattr(state, "BUCKETS", buckets)
    first = [(s, minute(i), i, 10.0 * n + i) for n, s in enumerate(("s", "t", "u", None)) for i in range(2 + n)]
    second = [(s, minute(i), i, 100.0 * n + i * i) for n, s in enumerate(("t", "v", None)) for i in range(1, 6)]
    run = Stream(streams, tmp_path, lagged)
    run.take(records_of(streams, first))
    run.take(records_of(streams, second))
    want, held = [], {}
    for part in (first, second):
        newest = {s: h[-1][:2] for s, h in held.items()}
        for s, at, n, value in sorted(part, key=lambda r: r[1:3]):
            if s in newest and (at, n) <= newest[s]:
                want.append((s, n, value, 0.0, 0.0, 0, True))
                continue
            before = [v for _, _, v in reversed(held.setdefault(s, []))][:2]
            want.append((s, n, value, *[*before, 0.0, 0.0][:2], int(len(before) == 2), False))
            held[s].append((at, n, value))
    got = run.rows().select(SERIES, "offset", LABEL, f"`{LABEL}t-1`", f"`{LABEL}t-2`", "const", "late").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    folder = tmp_path / "models"
    folder.mkdir()
    fit = lambda s: state.incremental_var(state.lag_stream(queries.sensor_rows(s), 1, [LABEL]).where("const = 1").withColumn("part", F.lit(0)), features.lag_names(1, [LABEL]), "part")
    models = Stream(streams, folder, fit)
    models.take(records_of(streams, first))
    models.take(records_of(streams, second))
    assert sorted((str(r[SERIES]), r["n"]) for r in models.rows().collect()) == sorted(
        [("s", 1.0), ("t", 2.0), ("u", 3.0), ("None", 4.0), ("t", 5.0), ("v", 4.0), ("None", 5.0)]
    )
