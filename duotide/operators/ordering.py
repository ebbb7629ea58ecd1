"""Order-dependent work on sequences of any size.

``Window.partitionBy(series)`` puts a whole series into one task, which fails
as soon as one series holds a large share of the rows. When the longest series
is over a checked limit, the rows are instead range-partitioned on the full
order, written once with their range number and position, and each range gets
copies of the few rows just outside it. Window functions that look a bounded
number of rows back or ahead then run per range and give the same answer as
over the whole sequence.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate
from operator import and_

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from duotide import scratch

ROWS_PER_TASK = 2_000_000
MAX_LARGE_KEYS = 20_000

_RANGE, _POS, _START, _ROWS = "_range", "_pos", "_range_start", "_range_rows"
_POSITION_BITS = (1 << 33) - 1  # low bits of monotonically_increasing_id


@dataclass(frozen=True)
class Ranges:
    """A written table in range order plus one summary row per range."""

    table: DataFrame
    summary: list[tuple[int, int, int]]  # range, index of its first row, rows

    def bounds(self) -> DataFrame:
        schema = T.StructType(
            [
                T.StructField(_RANGE, T.IntegerType(), False),
                T.StructField(_START, T.LongType(), False),
                T.StructField(_ROWS, T.LongType(), False),
            ]
        )
        return self.table.sparkSession.createDataFrame(self.summary, schema)

    def indexed(self) -> DataFrame:
        """Rows with their 0-based place in the whole order as ``_index``.

        The broadcast side has one row per range, so its size is fixed by the
        partition count and not by the data.
        """
        return self.table.join(F.broadcast(self.bounds()), _RANGE).withColumn("_index", F.col(_START) + F.col(_POS))


def lay_out(df: DataFrame, order: Sequence[str], partitions: int | None = None) -> Ranges:
    """Range-partition ``df`` on ``order`` and write it with range and position."""
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn(_RANGE, F.spark_partition_id())
        .withColumn(_POS, F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_BITS)))
    )
    table = scratch.materialise(ordered, "ranges")
    counts = sorted((r[0], r[1]) for r in table.groupBy(_RANGE).count().collect())  # one row per range
    starts = [0, *accumulate(n for _, n in counts)]
    return Ranges(table, [(rng, start, n) for (rng, n), start in zip(counts, starts)])


def measure(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """All rows and those of the largest key group, from one pruned and pre-aggregated pass."""
    if not keys:
        rows = df.count()
        return rows, rows
    total, longest = df.groupBy(*keys).count().agg(F.sum("count"), F.max("count")).first()
    return total or 0, longest or 0


def choose_layout(
    df: DataFrame, keys: Sequence[str], layout: str, rows_per_task: int, partitions: int | None = None
) -> tuple[str, int | None]:
    """The layout to use, and into how many ranges to cut if it is ``"ranged"``."""
    if layout not in ("auto", "keyed", "ranged"):
        raise ValueError(f"unknown layout {layout!r}")
    if layout != "auto":
        return layout, partitions
    rows, longest = measure(df, keys)
    if longest <= rows_per_task:
        return "keyed", None
    return "ranged", partitions or _range_count(df, rows, rows, rows_per_task)


def _range_count(df: DataFrame, rows: int, of: int, rows_per_task: int) -> int:
    """The usual partition count for the share of ``rows`` in all rows, or more to keep tasks small."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(-(-usual * rows // max(of, 1)), -(-rows // rows_per_task), 1)


def over_order(
    df: DataFrame,
    build: Callable[[WindowSpec], list[Column]],
    keys: Sequence[str] = (),
    order: Sequence[str] = ("Date_time",),
    back: int = 0,
    ahead: int = 0,
    layout: str = "auto",
    rows_per_task: int = ROWS_PER_TASK,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``build(window)`` columns that look at most ``back``/``ahead`` rows away.

    ``layout="keyed"`` is one window per key (one shuffle), ``"ranged"`` splits
    any key over many tasks. ``"auto"`` counts rows per key first and takes the
    ranged way only for the keys with more than ``rows_per_task`` rows.
    """
    if layout == "auto" and keys:
        rows, longest = measure(df, keys)
        if longest > rows_per_task:
            return _split_by_size(df, build, keys, order, back, ahead, rows_per_task, partitions, rows)
        layout = "keyed"
    layout, partitions = choose_layout(df, keys, layout, rows_per_task, partitions)
    if layout == "keyed":
        return df.select("*", *build(Window.partitionBy(*keys).orderBy(*order)))
    ranges = lay_out(df, [*keys, *order], partitions)
    rows = ranges.table.withColumn("_halo", F.lit(False))
    if back or ahead:
        rows = rows.unionByName(_halo(ranges, back, ahead))
    window = Window.partitionBy(_RANGE, *keys).orderBy(_POS)
    return rows.select("*", *build(window)).where(~F.col("_halo")).drop("_halo", _RANGE, _POS)


def _split_by_size(df, build, keys, order, back, ahead, rows_per_task, partitions, rows) -> DataFrame:
    """Long series by ranges, all others by key."""
    large = df.groupBy(*keys).count().where(F.col("count") > rows_per_task)
    large = scratch.materialise(large.withColumnsRenamed({k: f"_large_{k}" for k in keys}), "large-keys")
    found, large_rows = large.agg(F.count("*"), F.sum("count")).first()
    ranges = partitions or _range_count(df, large_rows, rows, rows_per_task)
    if found > MAX_LARGE_KEYS:
        return over_order(df, build, keys, order, back, ahead, "ranged", rows_per_task, partitions)
    names = F.broadcast(large.drop("count"))  # counted above
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_large_{k}")) for k in keys])
    short = over_order(df.join(names, same, "left_anti"), build, keys, order, layout="keyed")
    long = over_order(df.join(names, same, "left_semi"), build, keys, order, back, ahead, "ranged", partitions=ranges)
    return short.unionByName(long)


def _halo(ranges: Ranges, back: int, ahead: int) -> DataFrame:
    """Copies of the rows just before and after each range, placed in that range.

    At most ``(back + ahead)`` rows per range. Ranges shorter than the reach
    are spanned because rows are matched by their place in the whole order.
    """
    first, last = F.col(_START), F.col(_START) + F.col(_ROWS) - 1
    wanted = []
    if back:
        wanted.append(F.sequence(first - back, first - 1))
    if ahead:
        wanted.append(F.sequence(last + 1, last + ahead))
    targets = ranges.bounds().select(_RANGE, _START, F.explode(F.concat(*wanted)).alias("_index"))
    near_edge = (F.col(_POS) < ahead) | (F.col(_POS) >= F.col(_ROWS) - back)
    edges = ranges.indexed().where(near_edge).drop(_RANGE, _POS, _START, _ROWS)
    return (
        edges.join(targets, "_index")
        .withColumn(_POS, F.col("_index") - F.col(_START))
        .withColumn("_halo", F.lit(True))
        .select(*ranges.table.columns, "_halo")
    )


def row_index(
    df: DataFrame, order: Sequence[str], out: str = "row_index", partitions: int | None = None
) -> DataFrame:
    """1-based place of each row in the whole order, without a single-task sort.

    One range shuffle; the position inside a range is known when it is written.
    """
    ranges = lay_out(df, order, partitions)
    return ranges.indexed().withColumn(out, F.col("_index") + 1).drop("_index", _RANGE, _POS, _START, _ROWS)


def rank(
    df: DataFrame,
    keys: Sequence[str] = (),
    order: str = "Date_time",
    tie: Sequence[str] = (),
    out: str = "rank",
    layout: str = "auto",
    rows_per_task: int = ROWS_PER_TASK,
    partitions: int | None = None,
) -> DataFrame:
    """``rank()`` by ``order`` inside each key, ties sharing the lowest place.

    Ranged layout: a run of equal values may cross ranges, so the start of the
    run that opens each range is carried over from the ranges before it.
    """
    layout, partitions = choose_layout(df, keys, layout, rows_per_task, partitions)
    if layout == "keyed":
        return df.withColumn(out, F.rank().over(Window.partitionBy(*keys).orderBy(order)))
    ranges = lay_out(df, [*keys, order, *tie], partitions)
    return _finish_rank(ranges, {"_value_run": [*keys, order]} | ({"_key_run": list(keys)} if keys else {}), out)


def _run_openings(ranges: Ranges, runs: dict[str, list[str]]) -> DataFrame:
    """For each range, per run, the index at which the run of equal columns that opens it began.

    One job with one row a range as its result: the first and last values of a range
    are broadcast to it, which tells where the run of the last value begins.
    """
    value = {name: F.struct(*cols) for name, cols in runs.items()}
    ends = [f(v, _POS).alias(f"{end}{name}") for name, v in value.items() for end, f in (("head", F.min_by), ("tail", F.max_by))]
    known = ranges.table.join(F.broadcast(ranges.table.groupBy(_RANGE).agg(*ends)), _RANGE)
    begins = [F.min(F.when(v.eqNullSafe(F.col(f"tail{name}")), F.col(_POS))).alias(f"pos{name}") for name, v in value.items()]
    kept = [F.first(f"{end}{name}").alias(f"{end}{name}") for name in runs for end in ("head", "tail")]
    edges = {r[_RANGE]: r for r in known.groupBy(_RANGE).agg(*begins, *kept).collect()}
    opening = {rng: [rng, start, n] for rng, start, n in ranges.summary}
    for name in runs:
        carried, previous = 0, None
        for rng, start, _ in ranges.summary:
            edge = edges[rng]
            head_start = carried if previous is not None and edge[f"head{name}"] == previous else start
            opening[rng].append(head_start)
            carried = head_start if edge[f"pos{name}"] == 0 else start + edge[f"pos{name}"]
            previous = edge[f"tail{name}"]
    schema = f"{_RANGE} int, {_START} bigint, {_ROWS} bigint, " + ", ".join(f"{name}_open bigint" for name in runs)
    return ranges.table.sparkSession.createDataFrame([tuple(r) for r in opening.values()], schema)


def _finish_rank(ranges: Ranges, runs: dict[str, list[str]], out: str) -> DataFrame:
    """Ranks from the places where runs begin: all windows share one exchange, by range."""
    rows = ranges.table.join(F.broadcast(_run_openings(ranges, runs)), _RANGE)  # one row a range
    window = Window.partitionBy(_RANGE).orderBy(_POS)
    cols = runs["_value_run"]
    rows = rows.withColumns({f"_before_{i}": F.lag(c, 1).over(window) for i, c in enumerate(cols)})
    same = {c: F.col(c).eqNullSafe(F.col(f"_before_{i}")) for i, c in enumerate(cols)}
    begins = {f"{name}_at": F.when(~reduce(and_, [same[c] for c in own]) | (F.col(_POS) == 0), F.col(_POS)) for name, own in runs.items()}
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns(begins).withColumns({name: F.max(f"{name}_at").over(upto) for name in runs})
    place = {name: F.when(F.col(name) == 0, F.col(f"{name}_open")).otherwise(F.col(_START) + F.col(name)) for name in runs}
    base = place.get("_key_run", F.lit(0))
    original = [c for c in ranges.table.columns if c not in (_RANGE, _POS)]
    return rows.select(*original, (place["_value_run"] - base + 1).cast("int").alias(out))
