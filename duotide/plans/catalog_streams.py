"""Streaming queries, fed in parts and restarted from their checkpoint for each part.

The records arrive in three parts, cut by year over the years that the table
has. Every part is written to the input folder, then the query takes what is new
in one micro-batch and stops.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duotide import scratch
from duotide.functions import codec
from duotide.operators import features, metrics, registry
from duotide.plans import frames
from duotide.plans.catalog import query
from duotide.plans.catalog_features import lag_oracle
from duotide.plans.catalog_layers import _window
from duotide.plans.oracle import BATCH, BOTH_LAYERS, LAGGED, PREDICTED, RAW_PREDICTIONS, RECORDS, SHOWN, SPEED, half_up, lags, with_
from duotide.schemas import KPI_FIELDS, LABEL, PREDICTION_FIELDS, RECORD_SCHEMA, SENSORS, SERIES, SPEED_WEIGHT, TIME
from duotide.sources import readers, topics
from duotide.streaming import queries, state

PARTS = 3
_LOW, _HIGH = (f"(SELECT {f}(year(l_shipdate)) FROM lineitem)" for f in ("min", "max"))


def part_sql(time: str, parts: int = PARTS) -> str:
    return f"coalesce((year({time}) - {_LOW}) * {parts} // ({_HIGH} - {_LOW} + 1), 0)"


PART_SQL = part_sql("{t}")
ORDER_SQL = 'Date_time, "offset"'


def _stream_session(spark, flush: bool = False):
    """A session for streams with no more state partitions than the cluster has cores for.

    The count is fixed when a streaming query first starts, so it is a choice
    for the cluster and not for one batch; the batch default may be far larger.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.shuffle.partitions", min(usual, 2 * spark.sparkContext.defaultParallelism))
    # batches without data only clean up state, unless what they ``flush`` is the result
    session.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(flush).lower())
    return state.enable(session)


def _part(spark, sf_dir, time: str, parts: int = PARTS) -> Column:
    """Part of a row: equal spans of the table's years. Rows without a time come first."""
    year = F.year("l_shipdate")
    low, high = frames.table(spark, sf_dir, "lineitem").agg(F.min(year), F.max(year)).first()  # one row
    if low is None:
        return F.lit(0)
    return F.coalesce(F.floor((F.year(time) - low) * parts / (high - low + 1)).cast("int"), F.lit(0))


def _feed(
    spark, part: Column, rows: DataFrame, to_records: Callable, run: Callable, parts: int = PARTS, closing: DataFrame | None = None
) -> None:
    """Write each part in turn and let ``run`` take it from the stream; ``closing`` rows come last and let the rest be sent."""
    rows = scratch.materialise(rows.withColumn("_part", part), "feed", by="_part")  # a part is read without the others
    source, streams = scratch.new_dir(spark, "source"), _stream_session(spark, flush=closing is not None)
    for n in range(parts + (closing is not None)):
        records = to_records(closing if n == parts else rows.where(F.col("_part") == n).drop("_part"))
        records.select(*RECORD_SCHEMA.names).write.mode("append").parquet(source)
        run(readers.record_stream(streams, source))


def _sensor_feed(spark, sf_dir, run) -> None:
    rows = frames.records(spark, sf_dir)
    _feed(spark, _part(spark, sf_dir, TIME), rows, lambda rows: frames.topic_records(rows, "source"), run)


def _prediction_records(rows: DataFrame) -> DataFrame:
    wire = codec.encode_prediction(rows, keep=(SERIES, "topic", "offset"))
    return wire.select(
        F.col(SERIES).cast("binary").alias("key"),
        F.col("value").cast("binary").alias("value"),
        "topic",
        F.lit(0).alias("partition"),
        "offset",
        F.lit(None).cast("timestamp").alias("timestamp"),
        F.lit(0).alias("timestampType"),
    )


def _append(stream: DataFrame, out: str, checkpoint: str):
    """Run a streaming DataFrame over what is there now and add its rows to a folder of files."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return query


def _naive(df: DataFrame, time: str) -> DataFrame:
    return df.withColumn(time, F.col(time).cast("timestamp_ntz"))


@query(lag_oracle(RECORDS, "PARTITION BY series_key", ORDER_SQL))
def stream_carried_lags(spark, sf_dir):
    """Lags that go on over micro-batches equal the lags of the whole table."""
    out, checkpoint = (scratch.new_dir(spark, n) for n in ("lags", "checkpoint"))
    _sensor_feed(spark, sf_dir, lambda stream: _append(state.lag_stream(queries.sensor_rows(stream)), out, checkpoint))
    rows = spark.read.parquet(out).where("const = 1")
    return _naive(rows, TIME).select(*frames.sensor_columns(), *features.lag_names(2))


@query(
    with_(
        RECORDS,
        f"""l AS (SELECT *, {PART_SQL.format(t='Date_time')} AS part, row_number() OVER w AS nth, lag(Ot_avg, 1) OVER w AS l1
  FROM rec WINDOW w AS (PARTITION BY {PART_SQL.format(t='Date_time')}, series_key ORDER BY {ORDER_SQL}))""",
        """s AS (SELECT part, sqrt(avg((l1 - Ot_avg) * (l1 - Ot_avg))) AS RMSE_Score, avg(abs(l1 - Ot_avg)) AS MAE_Score,
    avg((l1 - Ot_avg) * (l1 - Ot_avg)) AS MSE_Score FROM l WHERE nth > 2 GROUP BY 1)""",
    )
    + """SELECT part AS epoch_id, series_key, "offset", Date_time AS TS, Ot_avg AS Temp, l1 AS Temp_Predict,
  RMSE_Score, MAE_Score, MSE_Score, 'last-value' AS model_version FROM l JOIN s USING (part) WHERE nth > 2"""
)
def stream_scoring(spark, sf_dir):
    """The speed layer with a model that repeats the last value; history restarts with each batch."""
    out, checkpoint = scratch.new_dir(spark, "predictions"), scratch.new_dir(spark, "checkpoint")
    names = features.lag_names(2)
    weights = [0.0, *[1.0 if c == f"{LABEL}t-1" else 0.0 for c in names]]
    on_batch = queries.scoring_layer("speed", lambda: ("last-value", weights), {"path": out})
    _sensor_feed(spark, sf_dir, lambda stream: queries.run_query(stream, on_batch, checkpoint))
    keep = ("epoch_id", F.col("key").alias(SERIES), "offset", "model_version")
    rows = codec.decode_prediction(spark.read.parquet(out), keep, time_type="timestamp_ntz")
    epoch = F.col("epoch_id").cast("bigint").alias("epoch_id")
    return rows.select(epoch, SERIES, "offset", *PREDICTION_FIELDS[:6], "model_version")


HYBRID_PARTS = BOTH_LAYERS.format(source="pred") + f""",
matched AS (
  SELECT {PART_SQL.format(t='TS')} AS epoch_id, series_key, TS, sp_Latency AS Speed_Latency, bt_Latency AS Batch_Latency, {SHOWN}
  FROM pairs)"""


def _hybrid_epochs(spark, sf_dir):
    rows_path, kpi_path, checkpoint = (scratch.new_dir(spark, n) for n in ("hybrid", "kpi", "checkpoint"))
    on_batch = queries.hybrid_layer("speed", "batch", rows_path, {"path": kpi_path}, format="parquet", clock=CLOCK)
    predictions = frames.predictions(spark, sf_dir)
    _feed(spark, _part(spark, sf_dir, "TS"), predictions, _prediction_records, lambda s: queries.run_query(s, on_batch, checkpoint))
    return rows_path, kpi_path


@query(
    with_(*PREDICTED, HYBRID_PARTS)
    + """SELECT epoch_id, series_key, TS, RT_Temp, Speed_RT_Temp, Batch_RT_Temp, Wt_Temp, Speed_RMSE,
  round(sqrt(avg((Wt_Temp - RT_Temp) ** 2) OVER (PARTITION BY epoch_id)), 6) AS Wt_RMSE,
  round(avg(abs(Wt_Temp - RT_Temp)) OVER (PARTITION BY epoch_id), 6) AS Wt_MAE FROM matched"""
)
def stream_hybrid(spark, sf_dir):
    """Both layers' predictions matched, combined and scored per micro-batch."""
    rows_path, _ = _hybrid_epochs(spark, sf_dir)
    rows = _naive(spark.read.parquet(rows_path), "TS")
    shown = ["TS", "RT_Temp", "Speed_RT_Temp", "Batch_RT_Temp", "Wt_Temp", "Speed_RMSE"]
    scores = [F.round(c, 6).alias(c) for c in ("Wt_RMSE", "Wt_MAE")]
    return rows.select(F.col("epoch_id").cast("bigint").alias("epoch_id"), SERIES, *shown, *scores)


SENT = [f"{p}_{m}" for m in ("Latency", "RMSE", "MAE") for p in ("Speed", "Batch")]
# A clock that stands still: no time passes in the ensemble, and messages are sent at this second.
CLOCK_SECONDS = 7.0


def CLOCK() -> float:
    return CLOCK_SECONDS


@query(
    with_(*PREDICTED, HYBRID_PARTS)
    + """SELECT CAST(epoch_id AS VARCHAR) AS Epoch_Id, CAST(count(*) AS VARCHAR) AS Record_Num,
  """
    + ", ".join(f"arg_min({c}, (TS, series_key)) AS {c}" for c in SENT)
    + f""", CAST(0 AS DOUBLE) AS Wt_Latency, round(sqrt(avg((Wt_Temp - RT_Temp) ** 2)), 6) AS Wt_RMSE,
  round(avg(abs(Wt_Temp - RT_Temp)), 6) AS Wt_MAE, CAST({CLOCK_SECONDS} AS DOUBLE) AS MQTT_Publish_Time
FROM matched GROUP BY epoch_id"""
)
def stream_kpi(spark, sf_dir):
    """The KPI message of each micro-batch, with all its fields."""
    _, kpi_path = _hybrid_epochs(spark, sf_dir)
    return kpi_fields(spark.read.text(f"{kpi_path}/epoch_id=*"))


def kpi_fields(messages: DataFrame) -> DataFrame:
    """The fields of JSON messages, all strings there, as what they are."""
    schema = ", ".join(f"{c} string" for c in KPI_FIELDS)
    back = messages.select(F.from_json("value", schema).alias("m")).select("m.*")
    numbers = [F.round(F.col(c).cast("double"), 6).alias(c) for c in KPI_FIELDS[2:]]
    return back.select(*KPI_FIELDS[:2], *numbers)


# Some rows come a part late: one in five by up to 8 days, one in seven by up to 60. The watermark waits 10 days.
DELAY_DAYS, LATE = 10, {"% 7 = 3": 60, "% 5 = 1": 8}


def _late_part(spark, sf_dir) -> Column:
    part = lambda days: _part(spark, sf_dir, F.col("TS") + F.expr(f"INTERVAL {days} DAYS"))
    by = [F.when(F.expr(f"offset {rest}"), part(days)) for rest, days in LATE.items()]
    return F.least(F.coalesce(*by, part(0)), F.lit(PARTS - 1))


LATE_SQL = f"""fed AS MATERIALIZED (SELECT *, least({PARTS - 1}, CASE {' '.join(
    f'WHEN "offset" {rest} THEN ' + part_sql(f'(TS + INTERVAL {days} DAY)') for rest, days in LATE.items())}
    ELSE {part_sql('TS')} END) AS part FROM {{source}}),
parts AS (SELECT part, max(TS) AS newest FROM fed GROUP BY 1),
marks AS (SELECT p.part, max(q.newest) - INTERVAL {DELAY_DAYS} DAY AS watermark FROM parts p JOIN parts q ON q.part < p.part GROUP BY 1)"""


def _closing(spark, topics=("speed",)) -> DataFrame:
    """A record far in the future, which lets the watermark pass all others."""
    fields = ", ".join(f"CAST(0 AS DOUBLE) AS {c}" for c in PREDICTION_FIELDS[1:])
    return spark.sql(f"SELECT 'END' AS {SERIES}, '{topics[0]}' AS topic, -1L AS offset, TIMESTAMP '2200-01-01 00:00:00' AS TS, {fields}")


@query(
    with_(
        *PREDICTED,
        LATE_SQL.format(source="pred"),
        "kept AS (SELECT fed.* FROM fed LEFT JOIN marks USING (part) WHERE watermark IS NULL OR TS > watermark)",
        BOTH_LAYERS.format(source="kept"),
    )
    + f"SELECT series_key, TS, {SHOWN} FROM pairs"
)
def stream_hybrid_join(spark, sf_dir):
    """The layers matched across micro-batches: copies of one time come in different ones, some after the watermark."""
    out, checkpoint = scratch.new_dir(spark, "joined"), scratch.new_dir(spark, "checkpoint")

    def run(stream):
        joined = queries.hybrid_match_stream(stream, "speed", "batch", f"{DELAY_DAYS} days", span=365 * 86400)
        _append(joined, out, checkpoint)

    _feed(spark, _late_part(spark, sf_dir), frames.predictions(spark, sf_dir), _prediction_records, run, closing=_closing(spark))
    shown = ["TS", "RT_Temp", "Speed_RT_Temp", "Batch_RT_Temp", "Wt_Temp", "Speed_RMSE", "Batch_RMSE", "Speed_MAE", "Batch_MAE"]
    return _naive(spark.read.parquet(out), "TS").select(SERIES, *shown)


WINDOW_DAYS = 28


@query(
    with_(
        RECORDS,
        LAGGED,
        RAW_PREDICTIONS,
        LATE_SQL.format(source="raw"),
        f"windows AS (SELECT *, {_window('TS', WINDOW_DAYS * 86400)} AS window_start FROM fed)",
        f"""kept AS (SELECT w.* FROM windows w LEFT JOIN marks USING (part)
  WHERE watermark IS NULL OR window_start + INTERVAL {WINDOW_DAYS} DAY > watermark)""",
    )
    + """SELECT topic, window_start, count(*) AS n, round(sqrt(avg((Temp_Predict - Temp) ** 2)), 6) AS rmse,
  round(avg((Temp_Predict - Temp) ** 2), 6) AS mse, round(avg(abs(Temp_Predict - Temp)), 6) AS mae,
  (SELECT count(*) FROM fed) - (SELECT count(*) FROM kept) AS late FROM kept GROUP BY 1, 2"""
)
def stream_windowed_metrics(spark, sf_dir):
    """Errors of event-time windows sent as the watermark passes them, and how many rows came too late for theirs."""
    out, checkpoint, seen = scratch.new_dir(spark, "windows"), scratch.new_dir(spark, "checkpoint"), []

    def run(stream):
        rows = queries.prediction_rows(stream)
        windows = state.windowed_metrics(rows, "TS", "Temp", "Temp_Predict", f"{WINDOW_DAYS} days", ["topic"], f"{DELAY_DAYS} days")
        query = _append(windows, out, checkpoint)
        seen.extend(p["observedMetrics"]["rows"]["seen"] for p in query.recentProgress if p["observedMetrics"])

    rows = frames.raw_predictions(spark, sf_dir).withColumns({c: F.lit(0.0) for c in PREDICTION_FIELDS[3:]})
    _feed(spark, _late_part(spark, sf_dir), rows, _prediction_records, run, closing=_closing(spark))
    windows = _naive(spark.read.parquet(out), "window_start")
    sent = windows.agg(F.sum("n")).first()[0] or 0  # one row
    scores = [F.round(c, 6).alias(c) for c in ("rmse", "mse", "mae")]
    return windows.select("topic", "window_start", "n", *scores, F.lit(sum(seen) - 1 - sent).cast("bigint").alias("late"))


RECENT = 2


@query(
    with_(
        RECORDS,
        LAGGED,
        f"e AS MATERIALIZED (SELECT *, {PART_SQL.format(t='Date_time')} AS part FROM lagged WHERE nth > 1)",
        "had AS (SELECT DISTINCT series_key, part FROM e)",
    )
    + f"""SELECT series_key, a.part, count(*) AS n, round(regr_intercept(Ot_avg, l1), 6) AS w0, round(regr_slope(Ot_avg, l1), 6) AS w1,
  round(sqrt(greatest(0, regr_syy(Ot_avg, l1) - regr_slope(Ot_avg, l1) * regr_sxy(Ot_avg, l1)) / count(*)), 6) AS rmse,
  count(*) FILTER (WHERE e.part > a.part - {RECENT}) AS recent_n,
  round(regr_intercept(Ot_avg, l1) FILTER (WHERE e.part > a.part - {RECENT}), 6) AS recent_w0,
  round(regr_slope(Ot_avg, l1) FILTER (WHERE e.part > a.part - {RECENT}), 6) AS recent_w1
FROM had a JOIN e USING (series_key) WHERE e.part <= a.part GROUP BY 1, 2"""
)
def stream_incremental_var(spark, sf_dir):
    """Least squares that goes on over micro-batches: over all rows seen, and over the last two parts."""
    out, checkpoint = scratch.new_dir(spark, "models"), scratch.new_dir(spark, "checkpoint")
    part = _part(spark, sf_dir, TIME)

    def run(stream):
        lagged = state.lag_stream(queries.sensor_rows(stream), 1, [LABEL]).where("const = 1").withColumn("part", part)
        _append(state.incremental_var(lagged, features.lag_names(1, [LABEL]), "part", keep=RECENT), out, checkpoint)

    _sensor_feed(spark, sf_dir, run)
    rows = spark.read.parquet(out)
    weights = [F.round(F.get(f"{p}weights", i), 6).alias(f"{p}w{i}") for p in ("", "recent_") for i in range(2)]
    counts = [F.col(c).cast("bigint").alias(c) for c in ("n", "recent_n")]
    return rows.select(SERIES, F.col("part").cast("bigint").alias("part"), *counts, F.round("rmse", 6).alias("rmse"), *weights)


@query(
    with_(
        RECORDS,
        f"""l AS (SELECT *, {PART_SQL.format(t='Date_time')} AS part, row_number() OVER w AS nth, lag(Ot_avg, 1) OVER w AS l1
  FROM rec WINDOW w AS (PARTITION BY {PART_SQL.format(t='Date_time')}, series_key ORDER BY {ORDER_SQL}))""",
    )
    + """SELECT 'speed' AS layer, 'var' AS kind, count(*) FILTER (WHERE nth > 1) AS n, min(Date_time) AS train_start,
  max(Date_time) AS train_end, round(regr_intercept(Ot_avg, l1) FILTER (WHERE nth > 1), 6) AS w0,
  round(regr_slope(Ot_avg, l1) FILTER (WHERE nth > 1), 6) AS w1 FROM l GROUP BY part"""
)
def stream_retraining(spark, sf_dir):
    """One model per micro-batch of recent rows, published to the registry."""
    path, checkpoint = scratch.new_dir(spark, "registry"), scratch.new_dir(spark, "checkpoint")
    on_batch = queries.retraining(path, p=1, cols=[LABEL])
    _sensor_feed(spark, sf_dir, lambda stream: queries.run_query(stream, on_batch, checkpoint))
    rows = registry.models(spark, path)
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("train_start", "train_end")]
    weights = [F.round(F.get("weights", i), 6).alias(f"w{i}") for i in range(2)]
    return rows.select("layer", "kind", "n", *times, *weights)


@query(with_(RECORDS) + f"SELECT Date_time, {', '.join(SENSORS)} FROM rec")
def stream_publishing(spark, sf_dir):
    """Micro-batches archived as columnar JSON and read back as rows."""
    archive, checkpoint = scratch.new_dir(spark, "archive"), scratch.new_dir(spark, "checkpoint")
    on_batch = queries.publishing(archive)
    _sensor_feed(spark, sf_dir, lambda stream: queries.run_query(stream, on_batch, checkpoint))
    rows = readers.columnar_json(spark, f"{archive}/epoch_id=*", one_per_file=False)
    return _naive(rows, TIME).select(TIME, *SENSORS)


# Field by field what the damaged records of ``frames.sensor_wire`` still say.
DAMAGED = """wire AS (SELECT series_key, Date_time, "offset", Db1t_avg, nullif(Db2t_avg, 0.1::DOUBLE) AS Db2t_avg,
    nullif(Gb1t_avg, 0) AS Gb1t_avg, Gb2t_avg, CASE WHEN Gb2t_avg <> 7 THEN Ot_avg END AS Ot_avg FROM rec)"""


@query(
    with_(
        RECORDS,
        DAMAGED,
        f"""l AS (SELECT *, {PART_SQL.format(t='Date_time')} AS part, row_number() OVER w AS nth,
    {lags(2, SENSORS, f"PARTITION BY {PART_SQL.format(t='Date_time')}, series_key", ORDER_SQL)}
  FROM wire WINDOW w AS (PARTITION BY {PART_SQL.format(t='Date_time')}, series_key ORDER BY {ORDER_SQL}))""",
        """good AS (SELECT part, series_key, "offset", "Ot_avgt-1" AS Temp_Predict FROM l WHERE nth > 2 AND Ot_avg IS NOT NULL AND """
        + " AND ".join(f'"{c}" IS NOT NULL' for c in features.lag_names(2))
        + ")",
        """counted AS (SELECT part, count(*) AS records, count(*) FILTER (WHERE Db2t_avg IS NULL OR Gb1t_avg IS NULL
    OR Ot_avg IS NULL) AS damaged FROM l GROUP BY 1)""",
    )
    + """SELECT part AS epoch_id, series_key, "offset", Temp_Predict, records, damaged,
  count(*) OVER (PARTITION BY part) AS scored FROM good JOIN counted USING (part)"""
)
def stream_malformed(spark, sf_dir):
    """Damaged records keep their place among the lags, have no prediction, and are counted."""
    out, counts, checkpoint = (scratch.new_dir(spark, n) for n in ("predictions", "counts", "checkpoint"))
    names = features.lag_names(2)
    weights = [0.0, *[1.0 if c == f"{LABEL}t-1" else 0.0 for c in names]]
    on_batch = queries.scoring_layer("speed", lambda: ("last-value", weights), {"path": out}, counts=counts)
    wire = frames.sensor_wire(spark, sf_dir)
    year = codec.decode_sensor(wire, (SERIES, "offset", "value"))
    _feed(
        spark,
        _part(spark, sf_dir, TIME),
        year.select(SERIES, "offset", "value", TIME),
        lambda rows: frames.wire_records(rows, "source"),
        lambda stream: queries.run_query(stream, on_batch, checkpoint),
    )
    rows = codec.decode_prediction(spark.read.parquet(out), ("epoch_id", F.col("key").alias(SERIES), "offset"))
    seen = spark.read.parquet(counts).select("epoch_id", "records", "damaged", F.col("scored").cast("bigint").alias("scored"))
    joined = rows.join(seen, "epoch_id")  # one row an epoch
    return joined.select(F.col("epoch_id").cast("bigint").alias("epoch_id"), SERIES, "offset", "Temp_Predict", "records", "damaged", "scored")


@query(
    with_(
        RECORDS,
        'p AS (SELECT *, "offset" % 3 AS part FROM rec)',
        """newest AS (SELECT series_key, part, max({'t': Date_time, 'o': "offset"}) AS newest FROM p GROUP BY ALL)""",
        """r AS (SELECT p.*, EXISTS (SELECT 1 FROM newest n WHERE n.series_key = p.series_key AND n.part < p.part
    AND {'t': p.Date_time, 'o': p."offset"} <= n.newest) AS late FROM p)""",
        f"""l AS (SELECT *, row_number() OVER w AS nth, lag(Ot_avg, 1, CAST(0 AS DOUBLE)) OVER w AS l1
  FROM r WHERE NOT late WINDOW w AS (PARTITION BY series_key ORDER BY {ORDER_SQL}))""",
    )
    + """SELECT series_key, "offset", late, CASE WHEN nth > 2 THEN 1 ELSE 0 END AS const, l1 FROM l
UNION ALL SELECT series_key, "offset", late, 0, CAST(0 AS DOUBLE) FROM r WHERE late"""
)
def stream_late_rows(spark, sf_dir):
    """Rows dealt over the parts whatever their time: those older than what was seen are flagged."""
    out, checkpoint = (scratch.new_dir(spark, n) for n in ("lags", "checkpoint"))
    rows = frames.records(spark, sf_dir)
    _feed(
        spark,
        (F.col("offset") % 3).cast("int"),
        rows,
        lambda rows: frames.topic_records(rows, "source"),
        lambda stream: _append(state.lag_stream(queries.sensor_rows(stream), cols=[LABEL]), out, checkpoint),
    )
    rows = spark.read.parquet(out)
    return rows.select(SERIES, "offset", "late", "const", F.col(f"{LABEL}t-1").alias("l1"))


CHAIN_PARTS = 5
_CHAIN_PART = part_sql("Date_time", CHAIN_PARTS)
CHAIN = [
    RECORDS,
    f"""l AS (SELECT *, {_CHAIN_PART} AS part, row_number() OVER w AS nth, lag(Ot_avg, 1) OVER w AS l1
  FROM rec WINDOW w AS (PARTITION BY {_CHAIN_PART}, series_key ORDER BY {ORDER_SQL}))""",
    "e AS MATERIALIZED (SELECT * FROM l WHERE nth > 1)",
    "models AS MATERIALIZED (SELECT part, regr_intercept(Ot_avg, l1) AS b, regr_slope(Ot_avg, l1) AS a FROM e GROUP BY 1)",
    """scored AS MATERIALIZED (SELECT e.part, e.series_key, Date_time, "offset", Ot_avg, m.b + m.a * l1 AS s, h.b + h.a * l1 AS f
  FROM e JOIN models m ON m.part = e.part - 1 JOIN models h ON h.part = 0)""",
    """errors AS (SELECT part, sqrt(avg((s - Ot_avg) ** 2)) AS s_rmse, sqrt(avg((f - Ot_avg) ** 2)) AS f_rmse,
    avg(abs(s - Ot_avg)) AS s_mae, avg(abs(f - Ot_avg)) AS f_mae FROM scored GROUP BY 1)""",
    """once AS MATERIALIZED (SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY part, series_key, Date_time ORDER BY "offset") = 1)""",
    f"""shown AS (SELECT part, series_key, Date_time AS TS, s, f, {half_up('Ot_avg', 3)} AS RT_Temp, {half_up('s', 3)} AS Speed_RT_Temp,
    {half_up('f', 3)} AS Batch_RT_Temp FROM once)""",
    """sums AS (SELECT part, sum((RT_Temp - Batch_RT_Temp) * (Speed_RT_Temp - Batch_RT_Temp)) AS num,
    sum((Speed_RT_Temp - Batch_RT_Temp) ** 2) AS den FROM shown GROUP BY 1)""",
    """learnt AS (SELECT part, CASE WHEN den > 0 THEN least(1, greatest(0, num / den)) ELSE 0.5 END AS share FROM sums)""",
    f"""made AS (SELECT shown.*, coalesce(share, {SPEED}) AS w, coalesce(share, {SPEED}) * s
    + coalesce(1 - share, {BATCH}) * f AS Wt_Temp
  FROM shown LEFT JOIN learnt ON learnt.part = shown.part - 1)""",
]


@query(
    with_(*CHAIN)
    + f"""SELECT CAST(part AS VARCHAR) AS Epoch_Id, CAST(count(*) AS VARCHAR) AS Record_Num, CAST(0 AS DOUBLE) AS Speed_Latency,
  CAST(0 AS DOUBLE) AS Batch_Latency, CAST(0 AS DOUBLE) AS Wt_Latency, round(any_value(s_rmse), 3) AS Speed_RMSE,
  round(any_value(f_rmse), 3) AS Batch_RMSE, round(any_value(s_mae), 3) AS Speed_MAE, round(any_value(f_mae), 3) AS Batch_MAE,
  CAST({CLOCK_SECONDS} AS DOUBLE) AS MQTT_Publish_Time, round(any_value(w), 4) AS speed_weight,
  round(sqrt(avg((Wt_Temp - RT_Temp) ** 2)), 2) AS Wt_RMSE, round(avg(abs(Wt_Temp - RT_Temp)), 2) AS Wt_MAE
FROM made JOIN errors USING (part) GROUP BY part"""
)
def stream_two_layer(spark, sf_dir):
    """Refresh, score by both layers, match, combine by learnt weights, report and retrain, per micro-batch."""
    registry_path, sent, rows_path, kpi_path, weights, checkpoint = (
        scratch.new_dir(spark, n) for n in ("registry", "predictions", "hybrid", "kpi", "weights", "checkpoint")
    )
    on_batch = queries.two_layer(registry_path, sent, rows_path, {"path": kpi_path}, weights, 1, [LABEL], CLOCK)
    rows = frames.records(spark, sf_dir)
    _feed(
        spark,
        _part(spark, sf_dir, TIME, CHAIN_PARTS),
        rows,
        lambda rows: frames.topic_records(rows, "source"),
        lambda stream: queries.run_query(stream, on_batch, checkpoint),
        CHAIN_PARTS,
    )
    messages = kpi_fields(spark.read.text(f"{kpi_path}/epoch_id=*"))
    # the weights learnt on one epoch are used in the next; the fixed ones in the first that has both layers
    learnt = spark.read.schema(queries.WEIGHTS_SCHEMA).parquet(weights)
    used = learnt.select((F.col("epoch_id") + 1).cast("string").alias("Epoch_Id"), F.round("speed_weight", 4).alias("speed_weight"))
    rounded = messages.withColumns({c: F.round(c, 2) for c in ("Wt_RMSE", "Wt_MAE")})
    return rounded.join(used, "Epoch_Id", "left").withColumn("speed_weight", F.coalesce("speed_weight", F.lit(SPEED_WEIGHT)))


OWN_CHAIN = [
    *CHAIN[:3],
    """models AS MATERIALIZED (SELECT part, series_key, regr_intercept(Ot_avg, l1) AS b, coalesce(regr_slope(Ot_avg, l1), 0) AS a,
    avg(Ot_avg) AS m FROM e GROUP BY 1, 2)""",
    """scored AS MATERIALIZED (SELECT e.part, e.series_key, Date_time, "offset", Ot_avg, coalesce(m.b, m.m) + m.a * l1 AS s,
    coalesce(h.b, h.m) + h.a * l1 AS f
  FROM e ASOF JOIN models m ON m.series_key = e.series_key AND m.part < e.part
  LEFT JOIN models h ON h.series_key = e.series_key AND h.part = 0 AND e.part > 0)""",
]


@query(
    with_(*OWN_CHAIN)
    + """SELECT part AS epoch_id, topic, count(*) AS n, round(sqrt(avg((p - Ot_avg) ** 2)), 6) AS rmse, round(avg(abs(p - Ot_avg)), 6) AS mae
FROM (SELECT part, 'speed' AS topic, s AS p, Ot_avg FROM scored UNION ALL SELECT part, 'batch', f, Ot_avg FROM scored)
WHERE p IS NOT NULL GROUP BY 1, 2"""
)
def stream_two_layer_by_series(spark, sf_dir):
    """The chain with a model per series: each epoch scores with the newest models of the epochs before it."""
    registry_path, sent, rows_path, kpi_path, weights, checkpoint = (
        scratch.new_dir(spark, n) for n in ("registry", "predictions", "hybrid", "kpi", "weights", "checkpoint")
    )
    on_batch = queries.two_layer(registry_path, sent, rows_path, {"path": kpi_path}, weights, 1, [LABEL], CLOCK, by=[SERIES])
    rows = frames.records(spark, sf_dir)
    _feed(
        spark,
        _part(spark, sf_dir, TIME, CHAIN_PARTS),
        rows,
        lambda rows: frames.topic_records(rows, "source"),
        lambda stream: queries.run_query(stream, on_batch, checkpoint),
        CHAIN_PARTS,
    )
    both = spark.read.parquet(f"{sent}/speed").unionByName(spark.read.parquet(f"{sent}/batch"))
    found = codec.decode_prediction(both, ("topic", "epoch_id"))
    scores = metrics.regression_metrics(found, "Temp", "Temp_Predict", ["epoch_id", "topic"])
    rounded = [F.round(c, 6).alias(c) for c in ("rmse", "mae")]
    return scores.select(F.col("epoch_id").cast("bigint").alias("epoch_id"), "topic", "n", *rounded)


TOPICS, TOPIC_PARTITIONS = ("sensors-a", "sensors-b"), 3


def _topic_feed(spark, sf_dir, run) -> str:
    """Records of two topics, by odd and even series, added in parts; ``run`` takes what is there after each."""
    path, rows = scratch.new_dir(spark, "topics"), frames.records(spark, sf_dir)
    supplier = F.substring(SERIES, 2, 20).cast("bigint")
    topic = F.when(supplier % 2 == 0, TOPICS[0]).otherwise(TOPICS[1])
    text = codec.encode_sensor(rows, keep=(SERIES, "offset", TIME)).withColumn("_part", _part(spark, sf_dir, TIME))
    wire = scratch.materialise(text.withColumns({"key": F.col(SERIES), "topic": topic, "number": supplier % TOPIC_PARTITIONS}), "feed")
    for n in range(PARTS):
        # within a series, records are sent in the order of their numbers
        sent = wire.where(F.col("_part") == n).repartition(SERIES).sortWithinPartitions("offset")
        topics.write(topics.keyed(sent, F.col("topic"), partition=F.col("number")), path, "feed", n)
        run(path)
    return path


@query(
    with_(
        RECORDS,
        f"""sent AS (SELECT *, CASE WHEN CAST(substr(series_key, 2) AS BIGINT) % 2 = 0 THEN '{TOPICS[0]}' ELSE '{TOPICS[1]}' END AS topic,
    CAST(substr(series_key, 2) AS BIGINT) % {TOPIC_PARTITIONS} AS "partition" FROM rec)""",
    )
    + f"""SELECT topic, "partition", series_key, Date_time, {', '.join(SENSORS)}, count(*) OVER p AS read,
  count(*) OVER p - 1 AS last_offset, count(*) OVER p AS offsets FROM sent WINDOW p AS (PARTITION BY topic, "partition")"""
)
def stream_topic_scan(spark, sf_dir):
    """Two topics read as one stream, restarted from its checkpoint for each part: every offset once, none left out."""
    out, checkpoint = scratch.new_dir(spark, "scanned"), scratch.new_dir(spark, "checkpoint")
    _topic_feed(spark, sf_dir, lambda path: _append(topics.stream(spark, path, TOPICS), out, checkpoint))
    records = spark.read.parquet(out)
    rows = codec.decode_sensor(records, ("topic", "partition", F.col("key").cast("string").alias(SERIES)), time_type="timestamp_ntz")
    counts = records.groupBy("topic", "partition").agg(
        F.count("*").alias("read"), F.max("offset").alias("last_offset"), F.count_distinct("offset").alias("offsets")
    )
    joined = rows.join(F.broadcast(counts), ["topic", "partition"])  # one row a topic and partition
    return joined.withColumn("partition", F.col("partition").cast("bigint"))


@query(
    with_(
        RECORDS,
        f"""l AS (SELECT *, {PART_SQL.format(t='Date_time')} AS part, row_number() OVER w AS nth, lag(Ot_avg, 1) OVER w AS l1
  FROM rec WINDOW w AS (PARTITION BY {PART_SQL.format(t='Date_time')}, series_key ORDER BY {ORDER_SQL}))""",
        """s AS (SELECT part, sqrt(avg((l1 - Ot_avg) * (l1 - Ot_avg))) AS RMSE_Score, avg(abs(l1 - Ot_avg)) AS MAE_Score
  FROM l WHERE nth > 2 GROUP BY 1)""",
    )
    + """SELECT series_key, Date_time AS TS, Ot_avg AS Temp, l1 AS Temp_Predict, round(RMSE_Score, 6) AS RMSE_Score,
  round(MAE_Score, 6) AS MAE_Score FROM l JOIN s USING (part) WHERE nth > 2"""
)
def stream_topic_predictions(spark, sf_dir):
    """The speed layer from topics to a topic: predictions are read back from where it sent them."""
    checkpoint, names = scratch.new_dir(spark, "checkpoint"), features.lag_names(2)
    weights = [0.0, *[1.0 if c == f"{LABEL}t-1" else 0.0 for c in names]]

    def run(path):
        on_batch = queries.scoring_layer("speed", lambda: ("last-value", weights), {"topics": path, "topic": "speed", "writer": "speed"})
        queries.run_query(topics.stream(spark, path, TOPICS), on_batch, checkpoint)

    path = _topic_feed(spark, sf_dir, run)
    rows = codec.decode_prediction(topics.scan(spark, path, "speed"), (F.col("key").cast("string").alias(SERIES),), time_type="timestamp_ntz")
    scores = [F.round(c, 6).alias(c) for c in ("RMSE_Score", "MAE_Score")]
    return rows.select(SERIES, "TS", "Temp", "Temp_Predict", *scores)
