"""What the text operators share: words, hold-out splits, Arrow batches, ids.

Words are runs of bytes other than ``[\\x20\\x09-\\x0D]``. ``bytes.split()``
cuts at exactly these six, and since no byte of a multi-byte UTF-8 character is
among them, splitting bytes and splitting characters agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a function gets at once.
SLICE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % n


def raw(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` on each Arrow batch, in slices that bound a task's memory; None stands for no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                if (out := fn(batch.slice(at, SLICE))) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))
