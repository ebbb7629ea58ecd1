"""Queries over sources, codecs, features, calendar, deduplication and drift."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duotide import scratch
from duotide.functions import calendar, codec
from duotide.operators import dedup, drift, features, ordering, split
from duotide.plans import frames
from duotide.plans.catalog import query
from duotide.plans.oracle import HOT_RECORDS, HOURLY, PREDICTED, RECORDS, half_up, lags, with_
from duotide.schemas import LABEL, PREDICTION_FIELDS, SENSORS, SERIES, TIME
from duotide.sources import readers, sinks

ORDER = (TIME, "offset")
BY_SERIES = 'PARTITION BY series_key'
SENSOR_LIST = ", ".join(SENSORS)
ROW = f'series_key, Date_time, "offset", {SENSOR_LIST}'


@query(with_(HOURLY) + "SELECT * FROM hourly")
def sensor_frame(spark, sf_dir):
    return frames.hourly(spark, sf_dir)


@query(
    with_(RECORDS)
    + """SELECT series_key, "offset", Date_time, Db1t_avg,
  CASE WHEN Db2t_avg <> 0.1::DOUBLE THEN Db2t_avg END AS Db2t_avg,
  CASE WHEN Gb1t_avg <> 0 THEN Gb1t_avg END AS Gb1t_avg,
  CASE WHEN Gb2t_avg <> 7 THEN Gb2t_avg END AS Gb2t_avg,
  CASE WHEN Gb2t_avg <> 7 THEN Ot_avg END AS Ot_avg
FROM rec"""
)
def decode_sensor(spark, sf_dir):
    wire = frames.sensor_wire(spark, sf_dir)
    return codec.decode_sensor(wire, (SERIES, "offset"), time_type="timestamp_ntz")


@query(
    with_(RECORDS)
    + f"SELECT {ROW} FROM rec WHERE Db2t_avg <> 0.1::DOUBLE AND Gb1t_avg <> 0 AND Gb2t_avg <> 7"
)
def decode_sensor_drop(spark, sf_dir):
    wire = frames.sensor_wire(spark, sf_dir)
    rows = codec.decode_sensor(wire, (SERIES, "offset"), on_error="drop", time_type="timestamp_ntz")
    return rows.select(*frames.sensor_columns())


@query(with_(*PREDICTED) + f'SELECT series_key, "offset", topic, {", ".join(PREDICTION_FIELDS)} FROM pred')
def encode_prediction_roundtrip(spark, sf_dir):
    keep = (SERIES, "offset", "topic")
    wire = codec.encode_prediction(frames.predictions(spark, sf_dir), keep)
    return codec.decode_prediction(wire, keep, time_type="timestamp_ntz")


@query(
    with_(RECORDS, 'l AS (SELECT *, lag(Ot_avg, 2) OVER (PARTITION BY series_key ORDER BY Date_time, "offset") AS b FROM rec)')
    + 'SELECT series_key, "offset", b IS NULL AS is_null, Ot_avg AS Temp, b AS Temp_Predict FROM l'
)
def encode_null_policy(spark, sf_dir):
    """A missing prediction empties the whole record, or only its own field."""
    rows = frames.records(spark, sf_dir)
    lagged = features.add_lags(rows, 2, [LABEL], order=ORDER, drop_warmup=False, const=True)
    zero = F.lit(0.0)
    made = lagged.select(
        SERIES,
        "offset",
        F.col(TIME).alias("TS"),
        F.col(LABEL).alias("Temp"),
        F.when(F.col("const") == 1, F.col(f"{LABEL}t-2")).alias("Temp_Predict"),
        *[zero.alias(c) for c in PREDICTION_FIELDS[3:]],
    )
    strict = codec.encode_prediction(made, (SERIES, "offset", *PREDICTION_FIELDS)).withColumnRenamed("value", "strict")
    lenient = codec.encode_prediction(strict, (SERIES, "offset", "strict"), null_policy="empty")
    decoded = codec.decode_prediction(lenient, (SERIES, "offset", "strict"), time_type="timestamp_ntz")
    return decoded.select(SERIES, "offset", F.col("strict").isNull().alias("is_null"), "Temp", "Temp_Predict")


@query(
    with_(RECORDS)
    + f"""SELECT (row_number() OVER (ORDER BY Date_time, "offset") - 1) % 2500 AS row_id,
  Date_time, {SENSOR_LIST}, CAST(NULL AS DOUBLE) AS Lambda_get_time FROM rec"""
)
def columnar_json_roundtrip(spark, sf_dir):
    messages = codec.encode_columnar_json(frames.records(spark, sf_dir), ORDER, rows_per_message=2500)
    return codec.decode_columnar_json(messages, time_type="timestamp_ntz")


REPLAYED = 5000


@query(with_(RECORDS) + f"SELECT Date_time, {SENSOR_LIST} FROM rec")
def sensor_csv_scan(spark, sf_dir):
    path = scratch.new_dir(spark, "csv")
    frames.records(spark, sf_dir).select(TIME, *SENSORS).write.option("header", True).csv(path)
    return readers.sensor_csv(spark, path).withColumn(TIME, F.col(TIME).cast("timestamp_ntz"))


@query(with_(RECORDS) + f"SELECT Date_time, {SENSOR_LIST} FROM rec WHERE Gb2t_avg <> 7")
def replay_csv(spark, sf_dir):
    """Lines without a label are left out when a file is replayed into a topic."""
    path = scratch.new_dir(spark, "lines")
    label = F.when(F.col("Gb2t_avg") != 7, F.col(LABEL))
    rows = frames.records(spark, sf_dir).withColumn(LABEL, label).select(TIME, *SENSORS)
    rows.write.option("header", True).csv(path)
    return codec.decode_sensor(readers.replay(spark, path, "source"), time_type="timestamp_ntz")


@query(
    with_(RECORDS)
    + f"""SELECT Date_time, {SENSOR_LIST} FROM (
  SELECT * FROM rec WHERE Gb2t_avg <> 7 ORDER BY Date_time, "offset" LIMIT {REPLAYED})"""
)
def replay_limit(spark, sf_dir):
    """The first lines over several files of different length, in order of files and lines."""
    path = scratch.new_dir(spark, "lines")
    label = F.when(F.col("Gb2t_avg") != 7, F.col(LABEL))
    rows = frames.records(spark, sf_dir).withColumn(LABEL, label)
    files = max(5, frames.parts_for(frames.table(spark, sf_dir, "lineitem").count()))
    parts = rows.repartitionByRange(files, F.greatest(F.col(TIME), F.lit("1996-01-01").cast("timestamp_ntz")), *ORDER)
    parts.sortWithinPartitions(*ORDER).select(TIME, *SENSORS).write.option("header", True).csv(path)
    return codec.decode_sensor(readers.replay(spark, path, "source", REPLAYED), time_type="timestamp_ntz")


@query(with_(RECORDS) + f"SELECT {ROW}, true AS stamped FROM rec")
def archive_json_roundtrip(spark, sf_dir):
    path = scratch.new_dir(spark, "archive")
    rows = frames.records(spark, sf_dir)
    sinks.archive_json(rows, path)
    stamped = T.StructType([*rows.schema, T.StructField("Lambda_get_time", T.DoubleType())])
    back = spark.read.schema(stamped).json(path)
    return back.select(*rows.columns, (F.col("Lambda_get_time") > 0).alias("stamped"))


def lag_oracle(records: str, partition: str, order: str, p: int = 2) -> str:
    over = f"({partition} ORDER BY {order})"
    names = ", ".join(f'"{n}"' for n in features.lag_names(p))
    return (
        with_(records, f"l AS (SELECT *, row_number() OVER {over} AS nth, {lags(p, SENSORS, partition, order)} FROM rec)")
        + f"SELECT {ROW}, {names} FROM l WHERE nth > {p}"
    )


@query(lag_oracle(RECORDS, BY_SERIES, 'Date_time, "offset"'))
def lag_features(spark, sf_dir):
    return features.add_lags(frames.records(spark, sf_dir), 2, order=ORDER)


@query(lag_oracle(RECORDS, BY_SERIES, '"offset", Date_time'))
def lag_features_ingest_order(spark, sf_dir):
    return features.add_lags(frames.records(spark, sf_dir), 2, order=("offset", TIME))


@query(lag_oracle(HOT_RECORDS, BY_SERIES, 'Date_time, "offset"'))
def lag_features_hot_series(spark, sf_dir):
    """Three series hold all rows; each is spread over every range."""
    return features.add_lags(frames.records(spark, sf_dir, hot=True), 2, order=ORDER, layout="ranged")


@query(lag_oracle(RECORDS, "", 'Date_time, "offset"', 3))
def lag_features_global(spark, sf_dir):
    return features.add_lags(frames.records(spark, sf_dir), 3, keys=(), order=ORDER, layout="ranged")


@query(
    with_(RECORDS)
    + f"""SELECT {ROW}, CAST(row_number() OVER (PARTITION BY series_key ORDER BY Date_time, "offset") > 2 AS INTEGER)
  AS const FROM rec"""
)
def intercept_column(spark, sf_dir):
    return features.add_const(frames.records(spark, sf_dir), 2, order=ORDER)


def serie_oracle(pad: str, lookahead: int = 7, n: int = 7) -> str:
    places, filled = [], []
    for place, i in enumerate(reversed(range(n))):
        past = f"lag(Ot_avg, {i}) OVER w"
        if pad == "forward":
            frame = f"ROWS BETWEEN {lookahead - i} FOLLOWING AND {lookahead} FOLLOWING"
        else:
            frame = f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
        filler = f'first_value(Ot_avg IGNORE NULLS) OVER (PARTITION BY series_key ORDER BY Date_time, "offset" {frame})'
        places.append(f"{past if pad == 'null' else f'coalesce({past}, {filler})'} AS serie_{place}")
        filled.append(f"CAST({past} IS NULL AS INTEGER)")
    return (
        with_(HOT_RECORDS)
        + f"""SELECT series_key, "offset", {", ".join(places)}, {" + ".join(filled)} AS filled_serie FROM rec
WINDOW w AS (PARTITION BY series_key ORDER BY Date_time, "offset")"""
    )


def _serie(spark, sf_dir, pad):
    made = features.serie(
        frames.records(spark, sf_dir, hot=True).select(SERIES, TIME, "offset", LABEL),
        LABEL,
        pad=pad,
        order=ORDER,
        layout="ranged",
    )
    places = [F.get("serie", i).alias(f"serie_{i}") for i in range(7)]
    return made.select(SERIES, "offset", *places, "filled_serie")


@query(serie_oracle("forward"))
def serie_maker(spark, sf_dir):
    return _serie(spark, sf_dir, "forward")


@query(serie_oracle("first"))
def serie_pad_first(spark, sf_dir):
    return _serie(spark, sf_dir, "first")


@query(serie_oracle("null"))
def serie_pad_null(spark, sf_dir):
    return _serie(spark, sf_dir, "null")


@query(
    with_(HOT_RECORDS)
    + """SELECT series_key, "offset",
  CAST(rank() OVER (PARTITION BY series_key ORDER BY Date_time) AS INTEGER) AS rank FROM rec"""
)
def serie_rank(spark, sf_dir):
    rows = frames.records(spark, sf_dir, hot=True).select(SERIES, TIME, "offset")
    return ordering.rank(rows, (SERIES,), TIME, ("offset",), layout="ranged").select(SERIES, "offset", "rank")


@query(with_(RECORDS) + 'SELECT "offset", row_number() OVER (ORDER BY Date_time, "offset") AS row_index FROM rec')
def row_index(spark, sf_dir):
    rows = frames.records(spark, sf_dir).select(TIME, "offset")
    return ordering.row_index(rows, ORDER).select("offset", "row_index")


CALENDAR_SQL = """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, CAST(day(o_orderdate) AS INTEGER) AS day,
  CAST(month(o_orderdate) AS INTEGER) AS month, CAST(year(o_orderdate) AS INTEGER) AS year,
  CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday, CAST(isodow(o_orderdate) >= 6 AS INTEGER) AS weekend,
  CAST(day(o_orderdate) <= 7 AS INTEGER) AS monthbegin, CAST(day(o_orderdate) >= 24 AS INTEGER) AS monthend,
  CAST(quarter(o_orderdate) - 1 AS INTEGER) AS yearquarter FROM orders"""


@query(CALENDAR_SQL)
def calendar_features(spark, sf_dir):
    orders = frames.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return calendar.add_calendar(orders, "o_orderdate").drop("o_orderdate")


@query(CALENDAR_SQL)
def calendar_stages(spark, sf_dir):
    """The same columns from a pipeline of transformers."""
    orders = frames.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate")
    )
    stages = [
        calendar.DateConverter(inputCol="o_orderdate", outputCol="date"),
        calendar.DayExtractor(inputCol="date"),
        calendar.MonthExtractor(inputCol="date"),
        calendar.YearExtractor(inputCol="date"),
        calendar.WeekDayExtractor(inputCol="date"),
        calendar.WeekendExtractor(),
        calendar.MonthBeginExtractor(),
        calendar.MonthEndExtractor(),
        calendar.YearQuarterExtractor(),
    ]
    return Pipeline(stages=stages).fit(orders).transform(orders).drop("o_orderdate")


def train_condition(key: str, percent: int = 80) -> str:
    return f"CAST('0x' || substr(md5('1:' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT) % 100 < {percent}"


@query(with_(RECORDS) + f"""SELECT "offset", {train_condition('"offset"')} AS is_train FROM rec""")
def train_split(spark, sf_dir):
    train, validation = split.by_hash(frames.records(spark, sf_dir).select("offset"), "offset")
    return train.withColumn("is_train", F.lit(True)).union(validation.withColumn("is_train", F.lit(False)))


@query(
    with_(
        RECORDS,
        """cut AS (SELECT epoch_us(min(Date_time)) AS low, epoch_us(max(Date_time)) AS high FROM rec)""",
    )
    + """SELECT "offset", epoch_us(Date_time) < low + (high - low) * 80 // 100 AS is_train FROM rec, cut"""
)
def train_split_by_time(spark, sf_dir):
    train, validation = split.by_time(frames.records(spark, sf_dir).select(TIME, "offset"), TIME)
    parts = train.withColumn("is_train", F.lit(True)).union(validation.withColumn("is_train", F.lit(False)))
    return parts.drop(TIME)


@query(
    with_(RECORDS)
    + f"""SELECT {ROW} FROM rec
QUALIFY row_number() OVER (PARTITION BY series_key, Date_time ORDER BY "offset") = 1"""
)
def dedup_by_time(spark, sf_dir):
    return dedup.by_time(frames.records(spark, sf_dir))


@query(
    with_(RECORDS)
    + f"""SELECT {ROW} FROM rec
QUALIFY row_number() OVER (PARTITION BY Ot_avg, Gb2t_avg ORDER BY Date_time, "offset") = 1"""
)
def keep_first(spark, sf_dir):
    return dedup.keep_first(frames.records(spark, sf_dir), [LABEL, "Gb2t_avg"], ORDER)


def drift_sql(step: str, source: str) -> str:
    moved = ", ".join(
        f"{half_up(f'({slope}::DOUBLE * {step} + {c})', 2)} AS {c}" for c, slope in drift.SLOPES.items()
    )
    return with_(RECORDS, source) + f'SELECT series_key, Date_time, "offset", {moved} FROM moved'


@query(
    drift_sql("step", 'moved AS (SELECT *, row_number() OVER (ORDER BY Date_time, "offset") AS step FROM rec)')
)
def drift_gradual(spark, sf_dir):
    return drift.gradual(frames.records(spark, sf_dir), order=ORDER)


@query(
    drift_sql(
        "step",
        """moved AS (SELECT *, 1 + CAST('0x' || substr(md5('1:' || CAST("offset" AS VARCHAR)), 1, 8) AS BIGINT) % 30000
    AS step FROM rec)""",
    )
)
def drift_abrupt(spark, sf_dir):
    return drift.abrupt(frames.records(spark, sf_dir), "offset")
