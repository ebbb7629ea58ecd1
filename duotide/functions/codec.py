"""Wire formats: comma-joined text records and columnar JSON batches."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duotide import scratch
from duotide.operators import ordering
from duotide.schemas import LABEL, PREDICTION_FIELDS, SENSORS, TIME

ROWS_PER_MESSAGE = 2500


def _fields(names: Sequence[str], time_type: str) -> list[Column]:
    """Field *i* of ``_parts``: a time first, then doubles; NULL where malformed.

    The outer two fields carry the quotes of the JSON string they came in.
    """
    cols = []
    for i, name in enumerate(names):
        text = F.get("_parts", i)
        if i in (0, len(names) - 1):
            text = F.replace(text, F.lit('"'), F.lit(""))
        cols.append(text.try_cast(time_type if i == 0 else "double").alias(name))
    return cols


def _decode(df, names, keep, on_error, time_type) -> DataFrame:
    if on_error not in ("null", "drop", "fail"):
        raise ValueError(f"unknown on_error {on_error!r}")
    kept = df.select(*keep, F.split(F.col("value").cast("string"), ",").alias("_parts"))
    fields = _fields(names, time_type)
    if on_error == "drop":
        # a filter after a plain projection is pushed below it and parses every field twice
        rows = kept.select(*kept.columns[:-1], F.inline_outer(F.array(F.struct(*fields))))
        return rows.dropna("any", subset=list(names))
    out = kept.select(*kept.columns[:-1], *fields)
    if on_error == "fail":
        bad = F.greatest(*[F.col(c).isNull() for c in names])
        message = F.concat(F.lit("malformed record at time "), F.coalesce(F.col(names[0]).cast("string"), F.lit("?")))
        checked = F.when(bad, F.raise_error(message).cast("double")).otherwise(F.col(names[-1]))
        return out.withColumn(names[-1], checked)
    return out


def decode_sensor(
    df: DataFrame, keep: Sequence[str | Column] = (), on_error: str = "null", time_type: str = "timestamp"
) -> DataFrame:
    """``value`` of each record as the six sensor fields, plus the ``keep`` columns."""
    return _decode(df, [TIME, *SENSORS], keep, on_error, time_type)


def decode_prediction(
    df: DataFrame, keep: Sequence[str | Column] = ("topic",), on_error: str = "null", time_type: str = "timestamp"
) -> DataFrame:
    """``value`` of each record as the nine prediction fields, plus the ``keep`` columns."""
    return _decode(df, PREDICTION_FIELDS, keep, on_error, time_type)


def _join_text(names: Sequence[str], null_policy: str) -> Column:
    if null_policy not in ("propagate", "empty"):
        raise ValueError(f"unknown null_policy {null_policy!r}")
    text = [F.col(c).cast("string") for c in names]
    if null_policy == "empty":
        text = [F.coalesce(t, F.lit("")) for t in text]
        return F.concat_ws(",", *text)
    # concat, unlike concat_ws, makes the record NULL when any field is
    return F.concat(*[piece for i, t in enumerate(text) for piece in ([F.lit(",")] * bool(i) + [t])])


def encode_prediction(df: DataFrame, keep: Sequence[str] = (), null_policy: str = "propagate") -> DataFrame:
    return df.select(*keep, _join_text(PREDICTION_FIELDS, null_policy).alias("value"))


def encode_sensor(df: DataFrame, keep: Sequence[str] = (), null_policy: str = "empty") -> DataFrame:
    """Sensor rows as the quoted text the source topic carries."""
    text = _join_text([TIME, *SENSORS], null_policy)
    return df.select(*keep, F.concat(F.lit('"'), text, F.lit('"')).alias("value"))


_MAPS = T.StructType(
    [T.StructField(TIME, T.MapType(T.StringType(), T.StringType()))]
    + [T.StructField(c, T.MapType(T.StringType(), T.DoubleType())) for c in SENSORS]
    + [T.StructField("Lambda_get_time", T.StringType())]
)


def encode_columnar_json(
    df: DataFrame,
    order: Sequence[str] = (TIME,),
    rows_per_message: int = ROWS_PER_MESSAGE,
    partitions: int | None = None,
) -> DataFrame:
    """Rows as ``{column: {row index: value}}`` messages of bounded length.

    A batch is cut into consecutive messages of ``rows_per_message`` rows, so no
    task ever holds more than that many rows of one message.
    """
    return _messages(ordering.row_index(df, order, "_place", partitions), rows_per_message)


def frame_columnar_json(df: DataFrame, rows_per_message: int = ROWS_PER_MESSAGE) -> DataFrame:
    """The same messages for rows whose order over messages does not matter: no range shuffle, no sort.

    The rows are written once and numbered by file and place in it, which stay as they
    are however often a task is repeated. A message takes consecutive numbers, so all
    but the last are full. Only whole messages move, built in tasks before the shuffle.
    """
    table = scratch.materialise(df, "rows")
    place = table.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = sorted(tuple(r) for r in place.groupBy("_file").count().collect())  # one row a written file
    starts = [(f, at) for (f, _), at in zip(counts, [0, *accumulate(n for _, n in counts)])]
    first = df.sparkSession.createDataFrame(starts, "_file string, _start long")
    placed = place.join(F.broadcast(first), "_file").withColumn("_place", F.col("_start") + F.col("_row") + 1)
    return _messages(placed, rows_per_message)


def _messages(placed: DataFrame, rows_per_message: int) -> DataFrame:
    """Messages of rows numbered from 1 as ``_place``."""
    place = F.col("_place") - 1
    numbered = placed.withColumn("message", F.floor(place / rows_per_message)).withColumn(
        "_at", F.pmod(place, F.lit(rows_per_message))
    )

    rows = F.struct("_at", F.col(TIME).cast("string").alias(TIME), *SENSORS)
    lists = numbered.groupBy("message").agg(F.sort_array(F.collect_list(rows)).alias("rows"))

    def column_map(name: str) -> Column:
        entries = F.transform("rows", lambda r: F.struct(r["_at"].cast("string"), r[name]))
        return F.map_from_entries(entries).alias(name)

    body = F.to_json(F.struct(*[column_map(c) for c in [TIME, *SENSORS]]))
    return lists.select("message", body.alias("value"))


def decode_columnar_json(df: DataFrame, keep: Sequence[str] = (), time_type: str = "timestamp") -> DataFrame:
    """The rows of columnar JSON messages in ``value``; a key missing in a column gives NULL.

    Columns that list the same keys in the same order, as writers do, are read
    side by side. Only a column that differs is looked up key by key.
    """
    parsed = df.select(*keep, F.from_json(F.col("value").cast("string"), _MAPS).alias("m"))
    parsed = parsed.select(*keep, "m.*", F.map_keys(f"m.{TIME}").alias("_keys"))

    def in_key_order(name: str) -> Column:
        looked_up = F.transform("_keys", lambda k: F.try_element_at(F.col(name), k))
        return F.when(F.map_keys(name) == F.col("_keys"), F.map_values(name)).otherwise(looked_up).alias(name)

    zipped = parsed.select(
        *keep,
        "Lambda_get_time",
        F.arrays_zip(
            F.col("_keys").alias("row_id"), F.map_values(TIME).alias(TIME), *[in_key_order(c) for c in SENSORS]
        ).alias("_rows"),
    )
    # a plain inline makes the optimizer add a filter that parses every message again per column
    rows = zipped.select(*keep, "Lambda_get_time", F.inline_outer("_rows")).where(F.col("row_id").isNotNull())
    return rows.select(
        *keep,
        F.col("row_id").try_cast("bigint").alias("row_id"),
        F.col(TIME).try_cast(time_type).alias(TIME),
        *SENSORS,
        F.col("Lambda_get_time").try_cast("double").alias("Lambda_get_time"),
    )


def incomplete(value: str = "value") -> Column:
    """True for a sensor record whose label field is empty or missing."""
    parts = F.split(F.regexp_replace(F.col(value).cast("string"), '"', ""), ",")
    at = 1 + SENSORS.index(LABEL)
    return F.coalesce(F.trim(F.get(parts, at)) == "", F.lit(True))
