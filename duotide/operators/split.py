"""Train and validation parts that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duotide.functions.scalars import md5_draw


def is_train(key: Column, percent: int = 80, seed: int = 1) -> Column:
    return md5_draw(key, 100, f"{seed}:") < percent


def by_hash(df: DataFrame, key: str, percent: int = 80, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """``percent`` of the rows, drawn by a hash of their ``key``, and the others."""
    train = is_train(F.col(key), percent, seed)
    return df.where(train), df.where(~train)


def by_time(df: DataFrame, time: str, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """The earliest ``percent`` of the time span, and what came after it.

    The cut is a point on the time axis, taken from the first and last time of
    the whole table, so finding it needs one aggregate and no sort.
    """
    at = F.unix_micros(F.col(time).cast("timestamp"))
    low, high = df.agg(F.min(at), F.max(at)).first()
    if low is None:
        return df, df
    early = at < low + (high - low) * percent // 100
    return df.where(early), df.where(~early)
