"""Inject drift into sensor tables to test how forecasts adapt."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duotide.functions.scalars import md5_draw
from duotide.operators import ordering
from duotide.schemas import TIME

# Drift per step of each sensor, and the largest abrupt shift in steps.
SLOPES = {"Db1t_avg": 0.0012, "Db2t_avg": 0.002, "Gb1t_avg": 0.0008, "Gb2t_avg": 0.0016, "Ot_avg": 0.001}
MAX_SHIFT = 30000


def _shift(df: DataFrame, slopes: Mapping[str, float], steps, digits: int) -> DataFrame:
    return df.withColumns({c: F.round(F.lit(s) * steps + F.col(c), digits) for c, s in slopes.items()})


def gradual(
    df: DataFrame,
    slopes: Mapping[str, float] = SLOPES,
    order: Sequence[str] = (TIME,),
    digits: int = 2,
    partitions: int | None = None,
) -> DataFrame:
    """Each value moved by its slope times the row's place in the whole order."""
    placed = ordering.row_index(df, order, "_step", partitions)
    return _shift(placed, slopes, F.col("_step"), digits).drop("_step")


def abrupt(
    df: DataFrame,
    key: str,
    slopes: Mapping[str, float] = SLOPES,
    seed: int = 1,
    max_shift: int = MAX_SHIFT,
    digits: int = 2,
) -> DataFrame:
    """Each value moved by its slope times one draw per row in 1..``max_shift``."""
    draw = 1 + md5_draw(F.col(key), max_shift, f"{seed}:")
    return _shift(df, slopes, draw, digits)
