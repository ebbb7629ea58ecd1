"""Operators that keep state per series from one micro-batch to the next.

State lives in the checkpointed state store: a micro-batch reads and writes the
series that it has rows of, and no others. Rows of one series meet in one task, so
the source's admission limit (files or offsets per trigger) bounds what that task
holds; :func:`duotide.streaming.queries.carried_lags` is for batches in which one
series is larger than a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from duotide.operators import ensemble, features, metrics
from duotide.operators.model import _solve
from duotide.schemas import LABEL, SENSORS, SERIES, TIME

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def enable(spark: SparkSession) -> SparkSession:
    """Keyed state needs the store that has several state variables per operator."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


def _gathered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    parts = [r for r in rows if len(r)]
    return pd.concat(parts, ignore_index=True) if len(parts) > 1 else (parts[0] if parts else pd.DataFrame())


#: Rows of a task that are packed together at most.
PACKED = 200_000


def packed(rows: DataFrame, key: str, limit: int = PACKED) -> DataFrame:
    """One row per ``key`` and up to ``limit`` or so rows of a task, every other column an array of its values.

    The state operator handles what it gets row by row, so it gets few rows: rows of a
    key meet first, and a key is one row a micro-batch or few, however many keys there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= limit:
                yield from together(held)
                held, count = [], 0
        yield from together(held)

    def together(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pa.Table.from_batches(held).combine_chunks().to_batches() if held else []:
            if not batch.num_rows:
                continue
            codes = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            batch = batch.take(pa.array(order))
            ends = pa.array(np.append(starts, len(order)), pa.int32())
            columns = [
                batch.column(n).take(pa.array(starts)) if n == key else pa.ListArray.from_arrays(ends, batch.column(n)) for n in batch.schema.names
            ]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return rows.repartition(F.col(f"`{key}`")).mapInArrow(run, _arrays(rows.schema, key))


def _arrays(schema: T.StructType, key: str) -> T.StructType:
    return T.StructType([f if f.name == key else T.StructField(f.name, T.ArrayType(f.dataType)) for f in schema])


def unpacked(rows: DataFrame, key: str) -> DataFrame:
    """The rows of :func:`packed`; doubles that are missing come back from Python as no number."""
    names = [c for c in rows.columns if c != key]
    out = rows.select(key, F.inline(F.arrays_zip(*[F.col(f"`{n}`").alias(n) for n in names])))
    doubles = [f.name for f in out.schema if isinstance(f.dataType, T.DoubleType)]
    return out.select([F.nanvl(F.col(f"`{c}`"), F.lit(None).cast("double")).alias(c) if c in doubles else F.col(f"`{c}`") for c in [n for n in rows.columns]])


def _values(chunks: pd.Series, kind: T.DataType, order: np.ndarray | None = None):
    """All values of an array column, in ``order``; missing ones as Spark takes them back."""
    every = np.concatenate([np.asarray(c) for c in chunks])
    every = every if order is None else every[order]
    if isinstance(kind, T.DoubleType):
        return every.astype(float)
    missing = pd.isna(every)
    if not missing.any():
        return every
    return [None if gone else (int(v) if isinstance(kind, T.IntegralType) else v) for v, gone in zip(every, missing, strict=True)]


def _series(keys: np.ndarray) -> tuple[np.ndarray, list]:
    """Number of each key, and the distinct keys as the state takes them."""
    numbers, names = pd.factorize(keys, use_na_sentinel=False)
    return numbers, [None if pd.isna(n) else n.item() if isinstance(n, np.generic) else n for n in names]


#: Series that a call of the state operator has together: a call costs far more than a series in
#: it. State is kept for each series, but which bucket holds it, so the number is part of a checkpoint.
BUCKET, BUCKETS = "_bucket", 2048


def bucketed(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(BUCKETS)).cast("int"))


#: A missing time is before every other.
FIRST = -(2**63)
#: Times that pandas can hold.
TIMES = ("1678-01-01", "2262-01-01")


class LagRing(StatefulProcessor):
    """The last ``p`` rows of each series, as one state row a series; a call has the series of one bucket."""

    def __init__(self, p: int, cols: Sequence[str], key: T.StructField, time: str, tie: str, types: dict[str, T.DataType], ttl_ms: int | None):
        self.p, self.cols, self.key, self.time, self.tie, self.types, self.ttl_ms = p, list(cols), key, time, tie, types, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [T.StructField("at", T.ArrayType(T.LongType())), T.StructField("tie", T.ArrayType(T.LongType()))]
        fields += [T.StructField(f"v{i}", T.ArrayType(T.DoubleType())) for i in range(len(self.cols))]
        self.rings = handle.getMapState("rings", T.StructType([self.key]), T.StructType(fields), self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _gathered(rows)
        if not len(new):
            return
        series, names = _series(np.concatenate([np.asarray(c, object) for c in new[self.key.name]]))
        at, tie = (np.concatenate([np.asarray(c, np.int64) for c in new[n]]) for n in (self.time, self.tie))
        order = np.lexsort((tie, at, series))
        series, at, tie = series[order], at[order], tie[order]
        count, p = len(order), self.p
        data = {n: _values(new[n], kind, order) for n, kind in self.types.items()}
        # what is kept of each series, the newest last
        old = [self.rings.getValue((name,)) for name in names]
        known = np.array([0 if o is None else len(o[0]) for o in old])
        newest = [np.array([o[i][-1] if k else 0 for o, k in zip(old, known, strict=True)], np.int64)[series] for i in (0, 1)]
        late = (known[series] > 0) & ((at < newest[0]) | ((at == newest[0]) & (tie <= newest[1])))
        on_time = np.flatnonzero(~late)
        group = series[on_time]
        sizes = np.bincount(group, minlength=len(names))
        ends = np.cumsum(sizes)
        place = np.arange(len(on_time)) - (ends - sizes)[group]  # among the new rows of the series
        nth = np.full(count, 0)
        nth[on_time] = known[group] + place
        out, kept = {}, []
        for i, c in enumerate(self.cols):
            own = data[c][on_time]
            before = np.full((len(names), p), np.nan)
            for g, (o, k) in enumerate(zip(old, known, strict=True)):
                if k:
                    before[g, p - k :] = [np.nan if v is None else v for v in o[2 + i]]
            for k in range(1, p + 1):
                lagged, new_ones = np.zeros(count), np.flatnonzero(place >= k)
                lagged[on_time[new_ones]] = own[new_ones - k]
                carried = np.flatnonzero((place < k) & (known[group] + place >= k))
                lagged[on_time[carried]] = before[group[carried], p - k + place[carried]]
                out[f"{c}t-{k}"] = lagged
            kept.append(own)
        for g in np.flatnonzero(sizes).tolist():
            own = slice(ends[g] - min(sizes[g], p), ends[g])
            rest = max(0, min(known[g], p - sizes[g]))
            last = [[*(old[g][n][len(old[g][n]) - rest :] if rest else ()), *x[on_time[own]].tolist()] for n, x in enumerate((at, tie))]
            for i, x in enumerate(kept):
                ours = [None if np.isnan(v) else v for v in x[own].tolist()]
                last.append([*(old[g][2 + i][len(old[g][2 + i]) - rest :] if rest else ()), *ours])
            self.rings.updateValue((names[g],), tuple(last))
        data |= {n: out[n] for n in features.lag_names(p, self.cols)} | {"const": (nth >= p).astype("int32"), "late": late}
        yield pd.DataFrame({BUCKET: [key[0]]} | {n: [v] for n, v in data.items()})

    def close(self) -> None:
        pass


def lag_stream(
    rows: DataFrame,
    p: int = 2,
    cols: Sequence[str] = SENSORS,
    key: str = SERIES,
    time: str = TIME,
    tie: str = "offset",
    ttl: int | None = None,
) -> DataFrame:
    """``rows`` as a stream with lag columns, ``const`` and ``late``; history goes on over micro-batches.

    Only the series in a micro-batch are read from and written to the state. Within it,
    rows go by ``time``, a missing one first, and ``tie``. A row that is not newer than
    the newest kept of its series is ``late``: lags 0, ``const`` 0, and in no other
    row's history. ``const`` is 1 where ``p`` earlier rows were known; lags that reach
    before the first row are 0, missing values stay missing. A series of which nothing
    came for ``ttl`` seconds of the clock is forgotten and starts anew; such a query has
    work whenever time passes, so run it by a timed trigger, or over what is there now
    with ``spark.sql.streaming.noDataMicroBatches.enabled`` off. Rows without a series are a
    series of their own. The session needs :func:`enable`.
    """
    extra = [T.StructField(n, T.DoubleType()) for n in features.lag_names(p, cols)]
    extra += [T.StructField("const", T.IntegerType()), T.StructField("late", T.BooleanType())]
    # as whole numbers, times of any century reach Python
    plain = rows.withColumns({time: F.coalesce(F.unix_micros(time), F.lit(FIRST))} | {c: F.col(f"`{c}`").cast("double") for c in cols})
    types = {f.name: f.dataType for f in plain.schema}
    ring = LagRing(p, cols, plain.schema[key], time, tie, types, None if ttl is None else 1000 * ttl)
    schema = T.StructType([T.StructField(BUCKET, T.IntegerType()), *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in [*plain.schema, *extra]]])
    found = packed(bucketed(plain, key), BUCKET).groupBy(BUCKET).transformWithStateInPandas(ring, schema, "Append", "None" if ttl is None else "ProcessingTime")
    lagged = unpacked(found, BUCKET).withColumn(time, F.timestamp_micros(F.nullif(time, F.lit(FIRST))))
    return lagged.select(*[f"`{c}`" for c in [*rows.columns, *[f.name for f in extra]]])


def match_stream(
    predictions: DataFrame,
    speed: str,
    batch: str,
    carried: Sequence[str],
    delay: str = "10 minutes",
    time: str = "TS",
) -> DataFrame:
    """Event times that both layers have, columns prefixed ``sp_`` and ``bt_``, each once.

    Predictions of a layer and time may come in any micro-batches within ``delay``; the
    one with the lowest offset is taken, whichever came first. This is
    :func:`ensemble.match_layers` on a stream: one state row for each series and time,
    with copies merged before the shuffle, sent and forgotten when the watermark passes
    the time, so the state holds what came within delay. Predictions without a time or
    with one outside ``TIMES``, or of other topics, match nothing and move no watermark;
    those at or before the watermark are dropped and counted in the progress of the query
    (``numRowsDroppedByWatermark``, copies in a task as one).
    """
    rows = predictions.where(F.col(time).between(*map(F.lit, TIMES)) & F.col("topic").isin(speed, batch)).withWatermark(time, delay)
    matched = ensemble.match_layers(rows, speed, batch, time=time, carried=carried)
    return matched.select(SERIES, time, *[prefix + c for prefix in ("sp_", "bt_") for c in ("offset", *carried)])


def partial_moments(rows: DataFrame, cols: Sequence[str], part: str, key: str = SERIES) -> DataFrame:
    """Count, means and co-moments of ``cols`` per ``key``, ``part`` and Arrow batch.

    What a task sends on is one row a group and batch, however many rows a series has;
    rows with a missing value are left out.
    """
    i, j = np.triu_indices(len(cols))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows_ = batch.dropna(subset=list(cols))
            if not len(rows_):
                continue
            groups = rows_.groupby([key, part], dropna=False, sort=False)
            number = groups.ngroup().to_numpy()
            x, n = rows_[list(cols)].to_numpy(float), np.bincount(number)
            order = np.argsort(number, kind="stable")
            starts = np.cumsum(n) - n
            mean = np.add.reduceat(x[order], starts) / n[:, None]
            away = x - mean[number]
            products = np.add.reduceat((away[:, i] * away[:, j])[order], starts)
            first = rows_.iloc[order[starts]]
            yield pd.DataFrame({key: first[key].to_numpy(), part: first[part].to_numpy(), "n": n.astype(float), "mean": list(mean), "co": list(products)})

    schema = T.StructType([rows.schema[key], T.StructField(part, T.LongType()), *_MOMENTS])
    chosen = rows.select(key, F.col(part).cast("long").alias(part), *[F.col(f"`{c}`").cast("double") for c in cols])
    return chosen.mapInPandas(run, schema)


_MOMENTS = [T.StructField("n", T.DoubleType()), T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("co", T.ArrayType(T.DoubleType()))]


def merged(n: np.ndarray, mean: np.ndarray, co: np.ndarray, weight: np.ndarray | float = 1.0) -> tuple[float, np.ndarray, np.ndarray]:
    """Moments of the union of groups, the rows of each counted ``weight`` times."""
    i, j = np.triu_indices(mean.shape[1])
    n = n * weight
    total = n.sum()
    centre = (n[:, None] * mean).sum(axis=0) / total
    away = mean - centre
    return total, centre, (co * np.broadcast_to(weight, n.shape)[:, None] + n[:, None] * away[:, i] * away[:, j]).sum(axis=0)


class MomentRing(StatefulProcessor):
    """Moments of each series: one entry for each of the last ``keep`` parts, and one for all rows seen.

    One state row a series; a call has the series of one bucket.
    """

    def __init__(self, key: T.StructField, part: str, keep: int, forget: float):
        self.key, self.part, self.keep, self.forget = key, part, keep, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        numbers = [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("n", "mean", "co")]
        moments = T.StructType([T.StructField("part", T.ArrayType(T.LongType())), *numbers])
        self.state = handle.getMapState("moments", T.StructType([self.key]), moments)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _gathered(rows)
        if not len(new):
            return
        series, names = _series(new[self.key.name].to_numpy(object))
        order = np.argsort(series, kind="stable")
        cuts = np.cumsum(np.bincount(series))[:-1]
        part, n = new[self.part].to_numpy(np.int64), new["n"].to_numpy(float)
        mean, co = np.stack(new["mean"].to_numpy()), np.stack(new["co"].to_numpy())
        found = [self.grown(name, part[own], n[own], mean[own], co[own]) for name, own in zip(names, np.split(order, cuts), strict=True)]
        out = {self.key.name: names, self.part: [newest for newest, *_ in found]}
        for prefix, at in (("", 1), ("recent_", 2)):
            count, centre, products = (np.stack([f[at][k] for f in found]) for k in range(3))
            weights, rmse = _solve(centre, products / count[:, None])
            out |= {f"{prefix}n": count, f"{prefix}weights": weights.tolist(), f"{prefix}rmse": rmse}
        yield pd.DataFrame(out)

    def grown(self, name, part: np.ndarray, n: np.ndarray, mean: np.ndarray, co: np.ndarray) -> tuple[int, tuple, tuple]:
        """Newest part of a series with new moments, and its moments over all rows seen and over the last parts."""
        # the first entry is all rows seen, as of the newest part; the others are the last parts
        held, seen = self.state.getValue((name,)), (part, n, mean, co)
        newest = int(part.max())
        every = list(seen)
        if held is not None:
            old = [np.array(held[0], np.int64), np.array(held[1], float)]
            old += [np.array(x, float).reshape(len(old[0]), -1) for x in held[2:]]
            newest = max(newest, int(old[0][0]))
            every = [np.concatenate([o[:1], s]) for o, s in zip(old, seen, strict=True)]
            seen = tuple(np.concatenate([o[1:], s]) for o, s in zip(old, seen, strict=True))
        total = merged(*every[1:], self.forget ** (newest - every[0]).astype(float))
        entries = []
        for p in range(newest - self.keep + 1, newest + 1):
            own = seen[0] == p
            if own.any():
                entries.append((p, *merged(*(s[own] for s in seen[1:]))))
        self.state.updateValue(
            (name,),
            (
                [newest, *(e[0] for e in entries)],
                [float(total[0]), *(float(e[1]) for e in entries)],
                np.concatenate([total[1], *(e[2] for e in entries)]).tolist(),
                np.concatenate([total[2], *(e[3] for e in entries)]).tolist(),
            ),
        )
        return newest, total, merged(*(np.stack([e[k] for e in entries]) for k in (1, 2, 3)))

    def close(self) -> None:
        pass


def incremental_var(
    rows: DataFrame, feature_names: Sequence[str], part: str, label: str = LABEL, key: str = SERIES, keep: int = 1, forget: float = 1.0
) -> DataFrame:
    """Least squares per series that goes on over micro-batches, as a stream of updated models.

    For each series with new rows: its newest ``part``; ``n``, ``weights`` and ``rmse``
    over all rows seen, a row of a part that lies d parts back counting ``forget ** d``;
    and the same over the last ``keep`` parts (``recent_``). Moments are merged, never
    refitted from rows, and tasks merge theirs before the shuffle, so a series with most
    of the rows is no hot group. Parts are whole numbers that grow with time; late rows
    join their part while it is kept, and all rows seen in any case. Rows with a missing
    feature or label are left out. The session needs :func:`enable`.
    """
    moments = partial_moments(rows, [*feature_names, label], part, key)
    models = [T.StructField(p + n, t) for p in ("", "recent_") for n, t in (("n", T.DoubleType()), ("weights", T.ArrayType(T.DoubleType())), ("rmse", T.DoubleType()))]
    schema = T.StructType([rows.schema[key], T.StructField(part, T.LongType()), *models])
    ring = MomentRing(rows.schema[key], part, keep, forget)
    return bucketed(moments, key).groupBy(BUCKET).transformWithStateInPandas(ring, schema, "Append", "None")


def windowed_metrics(
    scored: DataFrame, time: str, label: str, prediction: str, width: str = "60 seconds", by: Sequence[str] = (), delay: str = "10 minutes"
) -> DataFrame:
    """Errors of each event-time window, sent once the watermark has passed it.

    The state holds sums per open window, merged in tasks before the shuffle. Rows at or
    before the watermark are dropped; ``seen`` in the observed metrics of the query
    (``rows``) counts all that came, so what is missing from ``n`` was late or is open.
    """
    rows = scored.observe("rows", F.count(F.lit(1)).alias("seen")).withWatermark(time, delay)
    start = F.window(time, width)
    found = metrics.regression_metrics(rows.withColumn("window", start), label, prediction, [*by, "window"])
    return found.select(*by, F.col("window.start").alias("window_start"), "rmse", "mse", "mae", "n")
