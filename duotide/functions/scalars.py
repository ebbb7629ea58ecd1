"""Small column expressions used across operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def not_nan(col: str | Column) -> Column:
    """NaN as NULL, so that null-skipping functions skip it too."""
    return F.nanvl(F.col(col) if isinstance(col, str) else col, F.lit(None).cast("double"))


def row_max(*cols: str) -> Column:
    return F.greatest(*[not_nan(c) for c in cols])


def row_min(*cols: str) -> Column:
    return F.least(*[not_nan(c) for c in cols])


def rate(count: str | Column, seconds: str | Column) -> Column:
    """Records per second; NULL when no time passed."""
    count = F.col(count) if isinstance(count, str) else count
    seconds = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.try_divide(count.cast("double"), seconds)


def clip(col: Column, low: float, high: float) -> Column:
    inside = F.greatest(F.lit(low), F.least(F.lit(high), col))
    return F.when(col.isNotNull(), inside)  # greatest and least skip NULL


def md5_draw(key: Column, buckets: int, salt: str = "") -> Column:
    """A uniform integer in ``[0, buckets)`` that depends on ``key`` alone.

    Unlike ``rand`` it is the same however the rows are partitioned or retried.
    """
    text = F.concat(F.lit(salt), key.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def epoch_seconds(col: str | Column) -> Column:
    """A timestamp as seconds since 1970 with fraction."""
    col = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(col) / F.lit(1e6)
