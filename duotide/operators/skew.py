"""Join rows back to their group's statistics when groups differ wildly in size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duotide import scratch

BROADCAST_GROUPS = 20_000


def join_group_stats(
    rows: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str | Column],
    weight: str = "n",
    parts: int = 512,
    broadcast_groups: int = BROADCAST_GROUPS,
    how: str = "inner",
) -> DataFrame:
    """Equi-join of ``rows`` with ``stats`` (one row per key), inner or left; a NULL key is a key like any other.

    ``weight`` is the number of rows in each group. Few groups are broadcast
    after counting them. Otherwise groups with more than 1/``parts`` of all rows
    (at most ``parts`` of them, so that list may be broadcast) are copied once
    per share and their rows dealt out over the copies by a hash of ``spread``,
    which should be unique per row.
    """
    stats = scratch.materialise(stats, "group-stats")
    groups, total, largest = stats.agg(F.count("*"), F.sum(weight), F.max(weight)).first()
    if groups <= broadcast_groups:
        return on_keys(rows, F.broadcast(stats), keys, how)
    share = max(total // parts, 1)
    if largest <= share:
        return on_keys(rows, stats, keys, how)
    hot = stats.where(F.col(weight) > share).select(*keys, F.ceil(F.col(weight) / share).cast("int").alias("_copies"))
    salt = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_copies")).cast("int"), F.lit(0))
    dealt = on_keys(rows, F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_copies")
    copies = (
        on_keys(stats, F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1)))
        .drop("_copies")
    )
    return on_keys(dealt, copies, [*keys, "_salt"], how).drop("_salt")


def on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal or both NULL keys, which appear once."""
    names = {k: f"_right_{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(names)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return left.join(right, same, how).drop(*names.values())
