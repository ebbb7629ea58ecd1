from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from duotide import scratch
from duotide.functions import calendar
from duotide.functions.scalars import clip, rate, row_max, row_min
from duotide.operators import dedup, drift, ensemble, features, metrics, scoring, skew, split
from duotide.schemas import HYBRID_FIELDS, SENSORS
from duotide.sources import readers


def test_serie_fixture_values(spark):
    df = spark.range(1, 11).select("id", (F.col("id") * 10.0).alias("v"))
    made = features.serie(df, "v", keys=(), order=("id",), rank="rank").orderBy("id").collect()
    want = {
        1: ([20, 30, 40, 50, 60, 70, 10], 6),
        2: ([30, 40, 50, 60, 70, 10, 20], 5),
        6: ([70, 10, 20, 30, 40, 50, 60], 1),
        7: ([10, 20, 30, 40, 50, 60, 70], 0),
        8: ([20, 30, 40, 50, 60, 70, 80], 0),
    }
    for place, (serie, filled) in want.items():
        row = made[place - 1]
        assert (row["serie"], row["filled_serie"], row["rank"]) == ([float(v) for v in serie], filled, place)


def test_serie_maker_stage_round_trips(spark, tmp_path):
    df = spark.range(1, 11).select("id", (F.col("id") * 10.0).alias("v"))
    stage = calendar.SerieMaker(inputCol="v", dateCol="id", serieSize=3)
    fitted = Pipeline(stages=[stage]).fit(df)
    fitted.write().overwrite().save(str(tmp_path / "serie"))
    loaded = PipelineModel.load(str(tmp_path / "serie"))
    assert loaded.transform(df).collect() == fitted.transform(df).collect()


def test_lag_order_and_names(spark):
    data = [("a", i, *[float(10 * i + k) for k in range(5)]) for i in range(4)]
    df = spark.createDataFrame(data, f"series_key string, Date_time int, {', '.join(c + ' double' for c in SENSORS)}")
    made = features.add_lags(df, 2)
    assert made.columns[7:] == [f"{c}t-1" for c in SENSORS] + [f"{c}t-2" for c in SENSORS]
    assert [r["Ot_avgt-2"] for r in made.orderBy("Date_time").collect()] == [4.0, 14.0]
    assert features.feature_columns(made, df.columns) == features.lag_names(2)
    kept = features.add_lags(df, 2, const=True, drop_warmup=False).orderBy("Date_time").collect()
    assert [r["const"] for r in kept] == [0, 0, 1, 1]
    assert [r["Ot_avgt-1"] for r in kept] == [0.0, 4.0, 14.0, 24.0]


def test_calendar_edges(spark):
    days = [date(2024, m, d) for m in (1, 3, 4, 6, 7, 9, 10, 12) for d in (1, 7, 8, 23, 24)]
    df = spark.createDataFrame([(d,) for d in days], "Date_time date")
    for r in calendar.add_calendar(df).collect():
        d = r["Date_time"]
        assert r["weekday"] == d.weekday() and r["weekend"] == int(d.weekday() >= 5)
        assert r["monthbegin"] == int(d.day <= 7) and r["monthend"] == int(d.day >= 24)
        assert r["yearquarter"] == (d.month - 1) // 3


def test_calendar_null_counts_as_otherwise(spark):
    df = spark.createDataFrame([(None,)], "Date_time date")
    r = calendar.add_calendar(df).first()
    assert (r["day"], r["weekend"], r["monthbegin"], r["monthend"], r["yearquarter"]) == (None, 0, 0, 0, 3)


@pytest.mark.parametrize(
    "stage, schema",
    [
        (calendar.DateConverter(inputCol="x", outputCol="y"), "x date"),
        (calendar.DayExtractor(inputCol="x"), "x timestamp"),
        (calendar.WeekDayExtractor(inputCol="x"), "x string"),
        (calendar.WeekendExtractor(inputCol="x"), "x double"),
        (calendar.YearQuarterExtractor(inputCol="x"), "x date"),
    ],
)
def test_stage_input_types(spark, stage, schema):
    with pytest.raises(TypeError):
        stage.transform(spark.createDataFrame([], schema))


def test_dedup_lowest_offset_and_null_values(spark):
    data = [("a", 1, 5, 1.0), ("a", 1, 3, None), ("a", 2, 9, 2.0)]
    df = spark.createDataFrame(data, "series_key string, Date_time int, offset int, v double")
    assert sorted(map(tuple, dedup.by_time(df).collect())) == [("a", 1, 3, None), ("a", 2, 9, 2.0)]
    first = dedup.keep_first(df, ["series_key"], ["offset"]).collect()
    assert [tuple(r) for r in first] == [("a", 1, 3, None)]


def test_join_group_stats_spreads_hot_groups(spark):
    # one group holds half of the rows
    rows = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 500).alias("g"))
    stats = rows.groupBy("g").agg(F.count("*").alias("n"), F.sum("id").alias("total"))
    want = sorted(map(tuple, rows.join(stats, "g").select("id", "g", "n", "total").collect()))
    for groups in (0, 10_000):
        got = skew.join_group_stats(rows, stats, ["g"], ["id"], parts=16, broadcast_groups=groups)
        assert sorted(map(tuple, got.select("id", "g", "n", "total").collect())) == want


def test_attach_by_label_returns_each_row_once(spark):
    data = [(i, float(i % 3), float(i)) for i in range(30)]
    df = spark.createDataFrame(data, "offset int, Ot_avg double, pred double")
    got = scoring.attach_by_label(df, "Ot_avg", "pred", "offset").collect()
    assert len(got) == 30
    assert all(r["Temp_Predict"] == r["Ot_avg"] and r["matches"] == 10 for r in got)


def test_metrics_match_numpy_and_empty_policy(spark):
    rng = np.random.default_rng(0)
    y, p = rng.normal(size=200), rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))
    r = metrics.regression_metrics(df, "y", "p").first()
    assert r["n"] == 200
    assert np.allclose([r["rmse"], r["mse"], r["mae"]], [np.sqrt(((p - y) ** 2).mean()), ((p - y) ** 2).mean(), abs(p - y).mean()])
    empty = df.where("y > 99")
    assert metrics.regression_metrics(empty, "y", "p").first()["rmse"] is None
    assert metrics.regression_metrics(empty, "y", "p", empty_value=0.0).first()["rmse"] == 0.0


def test_scalars(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, nan, 0.0, None)], "a double, b double, z double, n double")
    r = df.select(
        row_max("a", "b", "n").alias("hi"),
        row_min("a", "b", "n").alias("lo"),
        rate("a", "z").alias("none"),
        clip(F.col("n"), 0.0, 1.0).alias("clip_null"),
        clip(F.lit(7.0), 0.0, 1.0).alias("clip"),
    ).first()
    assert tuple(r) == (1.0, 1.0, None, None, 1.0)


def _layers(spark):
    t0 = datetime(2021, 3, 1)
    cols = "series_key string, topic string, offset int, TS timestamp, Temp double, Temp_Predict double, RMSE_Score double, MAE_Score double, Latency_Start double, Latency_End double, Latency double"
    data = [
        ("a", "speed", 1, t0, 10.0, 9.0, 1.0, 1.0, 0.0, 2.0, 2.0),
        ("a", "speed", 2, t0, 10.0, 99.0, 1.0, 1.0, 0.0, 2.0, 2.0),  # later copy
        ("a", "batch", 3, t0, 10.0, 12.00049, 2.0, 2.0, 1.0, 4.0, 3.0),
        ("a", "speed", 4, t0 + timedelta(minutes=1), 10.0, 9.0, 1.0, 1.0, 0.0, 2.0, 2.0),  # no partner
        ("b", "batch", 5, t0, 10.0, 9.0, 1.0, 1.0, 0.0, 2.0, 2.0),  # other series
        ("a", "batch", 6, None, 10.0, 9.0, 1.0, 1.0, 0.0, 2.0, 2.0),
        ("a", "speed", 7, None, 10.0, 9.0, 1.0, 1.0, 0.0, 2.0, 2.0),  # no time, so no match
        ("a", "other", 0, t0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    ]
    return spark.createDataFrame(data, cols)


def test_hybrid_rows_match_dedupe_and_round(spark):
    (row,) = ensemble.hybrid_rows(_layers(spark), "speed", "batch").collect()
    assert row["Speed_RT_Temp"] == 9.0 and row["Batch_RT_Temp"] == 12.0
    assert row["Wt_Temp"] == 11.1  # 0.3 * 9 + 0.7 * 12.00049 = 11.100343
    assert (row["Speed_Latency"], row["Batch_Latency"]) == (2.0, 3.0)
    sp, bt = ensemble.split_layers(_layers(spark), "speed", "batch")
    assert ensemble.hybrid_join(sp.drop("topic"), bt.drop("topic")).collect() == [row]


def test_match_layers_shuffles_once_and_does_not_join(spark):
    plan = ensemble.hybrid_rows(_layers(spark), "speed", "batch")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_hybrid_scores_of_nothing(spark):
    none = ensemble.hybrid_rows(_layers(spark).where("offset < 0"), "speed", "batch")
    assert ensemble.hybrid_scores(none).first()["Wt_RMSE"] is None
    assert ensemble.hybrid_scores(none, empty_value=0.0).first()["Wt_RMSE"] == 0.0


def test_best_weight_closed_form(spark):
    # y = 0.75 s + 0.25 b exactly
    data = [(0.75 * s + 0.25 * b, s, b) for s, b in [(1.0, 5.0), (2.0, -3.0), (7.0, 7.0), (0.5, 9.0)]]
    df = spark.createDataFrame(data, "y double, s double, b double")
    for metric in ("rmse", "mae"):
        assert ensemble.best_weights(df, "y", "s", "b", metric=metric).first()["speed_weight"] == pytest.approx(0.75)


def test_best_weight_is_the_grid_minimum_and_in_bounds(spark):
    rng = np.random.default_rng(4)
    frames = []
    for g in range(20):
        y, s, b = rng.normal(size=(3, 30)) + rng.normal(size=(3, 1)) * 3
        frames.append(pd.DataFrame({"g": g, "y": y, "s": s, "b": b}))
    data = pd.concat(frames)
    best = ensemble.best_weights(spark.createDataFrame(data), "y", "s", "b", by=["g"]).toPandas().set_index("g")
    for g, part in data.groupby("g"):
        w = best.loc[g, "speed_weight"]
        assert 0 <= w <= 1 and best.loc[g, "batch_weight"] == pytest.approx(1 - w)
        error = lambda w, p=part: ((p.y - w * p.s - (1 - w) * p.b) ** 2).sum()
        assert error(w) <= min(error(k / 50) for k in range(51)) + 1e-9


def test_equal_layers_keep_the_start_weight(spark):
    df = spark.createDataFrame([(1.0, 2.0, 2.0)], "y double, s double, b double")
    assert ensemble.best_weights(df, "y", "s", "b").first()["speed_weight"] == 0.5


def test_dynamic_weights_use_the_window_before(spark):
    t0 = datetime(2021, 3, 1)
    rows = []
    for minute, (y, s, b) in enumerate([(1.0, 1.0, 5.0), (2.0, 9.0, 2.0), (3.0, 0.0, 1.0)]):
        rows.append(("a", t0 + timedelta(minutes=minute, seconds=5), y, s, b, minute))
    df = spark.createDataFrame(rows, "series_key string, TS timestamp, y double, s double, b double, id int")
    for layout in ("keyed", "ranged"):
        got = ensemble.dynamic_weights(df, "y", "s", "b", layout=layout).orderBy("window_start").collect()
        assert [r["speed_weight"] for r in got] == [0.5, 1.0, 0.0]
    made = ensemble.dynamic_ensemble(df, "y", "s", "b", ["id"]).orderBy("TS").collect()
    assert [r["Wt_Temp"] for r in made] == [3.0, 9.0, 1.0]


def test_split_is_stable_under_repartitioning(spark):
    df = spark.range(2000)
    train, validation = split.by_hash(df, "id")
    again, _ = split.by_hash(df.repartition(13), "id")
    assert sorted(train.collect()) == sorted(again.collect())
    assert train.count() + validation.count() == 2000 and 1500 < train.count() < 1700


def test_split_by_time_is_ordered(spark):
    df = spark.range(100).select(F.timestamp_seconds("id").alias("t"))
    train, validation = split.by_time(df, "t")
    assert train.agg(F.max("t")).first()[0] < validation.agg(F.min("t")).first()[0]
    assert (train.count(), validation.count()) == (80, 20)


def _sensors(spark, n=50):
    cols = [F.lit(10.0).alias(c) for c in SENSORS]
    return spark.range(n).select(F.timestamp_seconds("id").alias("Date_time"), "id", *cols)


def test_gradual_drift_grows_with_the_row(spark):
    got = drift.gradual(_sensors(spark), partitions=5).orderBy("id").collect()
    assert [r["Db2t_avg"] for r in got] == [round(10 + 0.002 * (i + 1) + 1e-9, 2) for i in range(50)]


def test_abrupt_drift_shares_one_draw_per_row(spark):
    got = drift.abrupt(_sensors(spark), "id", digits=8).collect()
    for r in got:
        draws = {round((r[c] - 10.0) / s) for c, s in drift.SLOPES.items()}
        assert len(draws) == 1 and 1 <= draws.pop() <= 30000
    other = drift.abrupt(_sensors(spark), "id", seed=2, digits=8).collect()
    assert got != other and got == drift.abrupt(_sensors(spark).repartition(7), "id", digits=8).orderBy("id").collect()


def test_replay_keeps_file_order_and_limit(spark, tmp_path):
    lines = ["Date_time," + ",".join(SENSORS)] + [f"2021-03-01 00:00:{i:02d},1,2,3,4,{'' if i == 2 else i}" for i in range(6)]
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    got = readers.replay(spark, str(tmp_path / "in.csv"), "source", max_line=4).orderBy("line").collect()
    assert [r["value"][-2:] for r in got] == ['0"', '1"', '3"', '4"']
    assert readers.replay(spark, str(tmp_path / "in.csv"), "source").count() == 5


def test_sensor_csv_schema_and_inference(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("Date_time," + ",".join(SENSORS) + "\n2021-03-01 00:00:00,1.5,2,x,4,5\n")
    row = readers.sensor_csv(spark, str(path)).first()
    assert row["Db1t_avg"] == 1.5 and row["Gb1t_avg"] is None
    assert dict(readers.sensor_csv(spark, str(path), infer=True).dtypes)["Gb1t_avg"] == "string"


def test_scratch_uses_the_session_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert scratch.new_dir(spark, "x").startswith(folder)
    table = scratch.materialise(spark.range(5))
    assert table.count() == 5 and scratch.release(spark) >= 1


def test_hybrid_fields_order():
    assert HYBRID_FIELDS[0] == "TS" and HYBRID_FIELDS[-1] == "Wt_Latency" and len(HYBRID_FIELDS) == 18
