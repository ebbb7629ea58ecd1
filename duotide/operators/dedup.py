"""One row per key, chosen by order.

Both forms aggregate instead of numbering rows, so copies are merged before the
shuffle and a key with very many copies costs no task more than others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duotide.schemas import SERIES, TIME


def by_time(
    df: DataFrame, keys: Sequence[str] = (SERIES, TIME), offset: str = "offset"
) -> DataFrame:
    """The copy with the lowest ``offset`` of each key; ``offset`` is unique within a key."""
    rest = [c for c in df.columns if c not in (*keys, offset)]
    firsts = [F.min_by(c, offset).alias(c) for c in rest]
    return df.groupBy(*keys).agg(F.min(offset).alias(offset), *firsts).select(*df.columns)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by ``order``; whole rows are compared, so ties are settled too."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.min(F.struct(*order, *rest)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])
