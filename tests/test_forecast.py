import duckdb
import pytest
from pyspark.sql import functions as F

import check
from __spark_entry__ import SMOKE_DIR, oracle_sql, queries
from duotide.plans import forecast


@pytest.mark.parametrize("years", [-4, 12])
def test_two_layer_forecast_at_other_dates(spark, tmp_path, years):
    lines = spark.read.parquet(f"{SMOKE_DIR}/lineitem.parquet")
    moved = lines.withColumn("l_shipdate", F.col("l_shipdate") + F.expr(f"INTERVAL {years} YEARS"))
    moved.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = queries()["two_layer_forecast"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert len(got) > 40 and check.compare(got, con.execute(oracle_sql()["two_layer_forecast"]).df()) == "ok"


def test_without_history_or_rows(spark):
    rows = spark.createDataFrame([(3, 1.0, 2.0, i) for i in range(4)] + [(4, 1.5, 2.0, 9)], "epoch int, x double, y double, id long")
    got = forecast.two_layer(rows, ["x"], "y", "epoch", ["id"], history_end=1).collect()
    assert [(r["epoch"], r["batch"]) for r in got] == [(4, None)] and got[0]["speed"] is not None
    assert forecast.two_layer(rows.limit(0), ["x"], "y", "epoch", ["id"]).collect() == []
