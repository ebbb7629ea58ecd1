from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from duotide.plans import kpi, report
from duotide.schemas import HYBRID_FIELDS, KPI_FIELDS
from duotide.sources import sinks

T0 = datetime(2021, 3, 1)


def _rows(spark, windows):
    """``windows``: (rows, speed latency, batch latency, ensemble latency) each."""
    data, minute = [], 0
    for n, sp, bt, wt in windows:
        for _ in range(n):
            values = dict.fromkeys(HYBRID_FIELDS, 1.0) | {
                "TS": T0 + timedelta(minutes=minute),
                "Speed_Latency": sp,
                "Batch_Latency": bt,
                "Speed_Latency_Start": 0.0,
                "Batch_Latency_Start": 1.0,
                "Speed_Latency_End": sp,
                "Batch_Latency_End": 1.0 + bt,
                "Wt_Latency": wt,
            }
            data.append(tuple(values[c] for c in HYBRID_FIELDS))
            minute += 1
    return spark.createDataFrame(data, "TS timestamp, " + ", ".join(f"{c} double" for c in HYBRID_FIELDS[1:]))


def test_report_of_windows(spark):
    df = _rows(spark, [(3, 4.0, 2.0, 0.5), (2, 0.0, 5.0, 1.0)])
    doubled = report.union_results(df, df, _rows(spark, [(1, 4.0, 2.0, 0.5)]).withColumn("Wt_RMSE", F.lit(None).cast("double")))
    got = report.build(doubled).collect()
    assert [r["counts"] for r in got] == [3, 2]
    assert [r["TS"] for r in got] == [T0, T0 + timedelta(minutes=3)]
    assert got[0]["Total_Latency"] == 4.5 and got[0]["Speed_TPS"] == 0.75
    assert got[1]["Speed_TPS"] is None and got[1]["Total_TPS"] == pytest.approx(2 / 7)
    total = report.summary(report.build(df)).first()
    assert (total["windows"], total["records"], total["mean_Speed_Latency"]) == (2, 5, 2.0)


def test_equal_total_latency_shares_the_first_time(spark):
    df = _rows(spark, [(2, 4.0, 3.0, 0.5), (2, 3.0, 3.0, 0.5)])  # both end at 4 and take 4.5 in total
    got = report.window_report(report.total_latency(df)).collect()
    assert [r["TS"] for r in got] == [T0, T0] and [r["counts"] for r in got] == [2, 2]


# Published measurements of eight epochs, newest last.
PUBLISHED = {
    "records": [320, 2398, 2163, 1503, 1807, 892, 1146, 292],
    "Speed": [137.369, 59.335, 59.335, 30.247, 20.588, 15.881, 16.600, 12.167],
    "Batch": [134.126, 55.518, 34.973, 35.152, 26.670, 16.780, 15.642, 12.532],
    "Wt": [47.990, 54.399, 45.034, 39.634, 34.871, 21.723, 14.795, 8.817],
}


def test_throughput_of_the_published_epochs(spark):
    data = [(n, *[float(PUBLISHED[p][i]) for p in ("Speed", "Batch", "Wt")], 1.0) for i, n in enumerate(PUBLISHED["records"])]
    df = spark.createDataFrame(data, "counts long, Speed_Latency double, Batch_Latency double, Wt_Latency double, Total_Latency double")
    means = report.throughput(df).agg(*[F.round(F.avg(f"{p}_TPS"), 1) for p in ("Speed", "Batch", "Wt")]).first()
    assert tuple(means) == (45.7, 46.0, 42.5)
    pooled = df.agg(*[F.round(F.sum("counts") / F.sum(f"{p}_Latency"), 1) for p in ("Speed", "Batch", "Wt")]).first()
    assert tuple(pooled) == (29.9, 31.7, 39.4)


def test_kpi_takes_the_first_complete_row(spark):
    df = _rows(spark, [(1, 9.0, 9.0, 9.0), (4, 4.0, 2.0, 0.5)]).withColumn("epoch_id", F.lit(7))
    first = F.when(F.col("TS") > T0, F.col("Wt_MAE"))  # the first row is incomplete
    row = kpi.rollup(df.withColumn("Wt_MAE", first), publish_time=F.lit(12.5)).first()
    assert (row["Epoch_Id"], row["Record_Num"], row["Speed_Latency"], row["MQTT_Publish_Time"]) == (7, 4, 4.0, 12.5)
    text = sinks.kpi_message(kpi.rollup(df)).first()["value"]
    assert all(f'"{c}":"' in text for c in KPI_FIELDS)
