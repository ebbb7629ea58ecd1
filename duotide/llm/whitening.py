"""Whitening of vectors on an integer grid, with eigenvectors refined by matrix products.

Vectors become whole numbers, so equal ones are recognised exactly and sums do not
round. The covariance of the distinct ones is summed by tasks over their own rows,
centred before multiplying. Its eigenvectors are first found in single precision and
then corrected by Ogita and Aishima's iteration in extended precision: from
``R = I - X'X`` and ``S = X'AX`` each pair of vectors gets the correction that its
eigenvalues allow, and pairs too close to tell apart are turned by solving the
small problem of their cluster, shifted by its mean.

The driver sees one number per dimension and per pair of dimensions, whatever the
number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duotide import scratch
from duotide.llm import text

#: Steps of the grid in one; components returned.
STEPS, COMPONENTS = 256, 4
#: Grid values beyond this are no long.
LARGEST = 2.0**62
#: Rounds of refinement at most; a correction below this ends them.
ROUNDS, SETTLED = 30, 1e-17


def on_grid(column: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(rows kept, grid vector of each as bytes, dimensions): ``floor(256 * c)``, little-endian in the fewest bytes that hold it."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        grid = np.floor(flat * STEPS)
        bad = np.concatenate([[0], np.cumsum(~(np.abs(grid) < LARGEST))])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    rows = np.flatnonzero((lengths > 0) & (bad[ends] == bad[starts]))
    out: list[bytes] = [b""] * len(rows)
    for d in np.unique(lengths[rows]):
        these = np.flatnonzero(lengths[rows] == d)
        x = grid[starts[rows[these]][:, None] + np.arange(d)].astype(np.int64)
        low, high = x.min(axis=1), x.max(axis=1)
        width = np.full(len(x), 8)
        for w in (4, 2, 1):
            width[(low >= -(1 << 8 * w - 1)) & (high < 1 << 8 * w - 1)] = w
        for w in np.unique(width):
            chosen = np.flatnonzero(width == w)
            data = x[chosen].astype(f"<i{w}").tobytes()
            for i, at in zip(these[chosen], range(0, len(data), int(d * w)), strict=True):
                out[i] = bytes([w]) + data[at : at + int(d * w)]
    return rows, out, lengths[rows]


def from_grid(vectors: list[bytes], d: int) -> np.ndarray:
    """The grid vectors as a matrix of longs."""
    x = np.empty((len(vectors), d), np.int64)
    width = np.array([v[0] for v in vectors])
    for w in np.unique(width):
        these = np.flatnonzero(width == w)
        x[these] = np.frombuffer(b"".join(vectors[i][1:] for i in these), f"<i{w}").reshape(len(these), d)
    return x


def partial_sums(df: DataFrame, add: Callable[[np.ndarray], np.ndarray], value: str, d: int) -> list:
    """Sum over all rows of the numbers that ``add`` makes of a block of grid vectors; a task shuffles them once."""
    exact = value.startswith("decimal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, text.SLICE):
                own = add(from_grid(batch.slice(at, text.SLICE).column("x").to_pylist(), d))
                total = own if total is None else total + own
        if total is not None:
            values = pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0)) if exact else pa.array(total)
            yield text.record(at=pa.array(range(len(total)), pa.int32()), v=values)

    sums = df.select("x").mapInArrow(run, f"at int, v {value}").groupBy("at").agg(F.sum("v").alias("v"))
    return [r["v"] for r in sums.orderBy("at").collect()]  # bounded by the square of the dimensions


def exact_sum(x: np.ndarray) -> np.ndarray:
    """Sum of each column as whole numbers of any size."""
    safe = np.abs(x).max(initial=0) < (1 << 62) // max(len(x), 1)
    return (x if safe else x.astype(object)).sum(axis=0).astype(object)


def single_precision(a: np.ndarray) -> np.ndarray:
    """Eigenvectors found in single precision, one per column."""
    return np.linalg.eigh(a.astype(np.float32))[1]


def clusters(values: np.ndarray, apart: float) -> list[np.ndarray]:
    """Groups of two or more eigenvalues, each nearer than ``apart`` to the next of its group."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > apart) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def refined(a: np.ndarray, x: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors) of the symmetric ``a``, falling, from approximate eigenvectors ``x``.

    Corrections are matrix products in extended precision. They square the error
    of well-parted vectors; a cluster's vectors keep its subspace and are turned in
    it by a sub-solve, after which they are parted too.
    """
    wide = np.longdouble
    a, x = a.astype(wide), x.astype(wide)
    size = np.linalg.norm(a.astype(float), 2)
    for _ in range(rounds):
        ax = a @ x
        r, s = np.eye(len(a), dtype=wide) - x.T @ x, x.T @ ax
        s = (s + s.T) / 2  # else what rounding leaves between the halves is divided by small gaps
        values = np.diag(s) / (1 - np.diag(r))
        apart = 2 * (np.linalg.norm((s - np.diag(values)).astype(float), 2) + size * np.linalg.norm(r.astype(float), 2))
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= apart
        e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
        x = x + x @ e
        turned = 0.0
        for group in clusters(values, apart):
            part = x[:, group]
            small = part.T @ (a @ part) - values[group].mean() * (part.T @ part)
            low = np.abs(small - np.diag(np.diag(small))).max()
            if low > SETTLED * size:
                turn = np.linalg.eigh(((small + small.T) / 2).astype(float))[1]
                x[:, group] = part @ turn.astype(wide)
                turned = max(turned, float(low / size))
        if max(float(np.abs(e).max()), turned) <= SETTLED:
            break
    for _ in range(3):  # rounding turns vectors of a cluster a little; this makes them square to each other again
        x = x + x @ (np.eye(len(a), dtype=wide) - x.T @ x) / 2
    values = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-values, kind="stable")
    unit = x / np.sqrt(np.einsum("ij,ij->j", x, x))
    return values[order].astype(float), unit[:, order].astype(float)


@dataclass
class Whitening:
    """What is learnt from the fit list: counts, sums, the covariance and its first components."""

    d: int
    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Decimal(s) / Decimal(self.n)) for s in self.sums])

    @property
    def explained(self) -> np.ndarray:
        return self.values / np.trace(self.covariance)


def centred(x: np.ndarray, n: int, sums: list[int], mean: np.ndarray) -> np.ndarray:
    """``x - S/n``; from the whole numbers ``n*x - S`` while they are exact in a double."""
    if n * np.abs(x).max(initial=0) < 2**52 and max(map(abs, sums), default=0) < 2**52:
        return (n * x - np.array(sums, np.int64)) / n
    return x - mean


def coded(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, d, x``: the rows whose vector has an entry and only finite ones, on the grid."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, x, d = on_grid(batch.column("v"))
        return text.record(id=batch.column("id").take(pa.array(rows)), d=pa.array(d, pa.int32()), x=pa.array(x, pa.binary()))

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    return text.map_batches(rows, run, "id long, d int, x binary")


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Learn from the distinct vectors of ``coded`` rows; None where there are none.

    The dimension is the commonest length (the longer of two as common). Components
    whose eigenvalue is zero to working precision have no whitened value and are
    left out, so that a table of copies of one vector has none.
    """
    lengths = vectors.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()  # one row
    if lengths is None:
        return None
    d = lengths["d"]
    once = scratch.materialise(vectors.where(F.col("d") == d).select("x").distinct(), "fit_list")
    n = once.count()
    sums = [int(v) for v in partial_sums(once, exact_sum, "decimal(38,0)", d)]
    mean = np.array([float(Decimal(s) / Decimal(n)) for s in sums])
    rows, cols = np.triu_indices(d)

    def products(x: np.ndarray) -> np.ndarray:
        c = centred(x, n, sums, mean)
        return (c.T @ c)[rows, cols]

    v = np.zeros((d, d))
    v[rows, cols] = v[cols, rows] = np.array(partial_sums(once, products, "double", d)) / n
    scale = float(np.abs(v).max()) or 1.0
    values, vectors_ = refined(v / scale, single_precision(v / scale))
    values = values * scale
    k = int((values[:components] > np.trace(v) * d * np.finfo(float).eps).sum())
    values, vectors_ = values[:k], vectors_[:, :k]

    def whitened_products(x: np.ndarray) -> np.ndarray:
        w = centred(x, n, sums, mean) @ vectors_ / np.sqrt(values)
        return (w.T @ w).ravel()

    error = 0.0
    if k:  # whitened values are projections of centred vectors, so they are centred
        seen = np.array(partial_sums(once, whitened_products, "double", d)).reshape(k, k) / n
        error = float(np.abs(seen - np.eye(k)).max())
    return Whitening(d, n, sums, v, values, vectors_, error)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[Decimal]:
    """Sum over the dimensions of ``(n*x - S)**2`` of each row, exact."""
    largest = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if x.shape[1] * largest**2 < 1 << 62:
        return [Decimal(v) for v in ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()]
    return [Decimal(int(v)) for v in ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)]


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` for each row and component.

    Rows whose vector is null, empty, of another length than the table's, or holds
    null, non-finite or too large entries (256 times it is no long) are left out.
    Repeated rows and null ids come back as often as they came, and equal vectors count
    once in what is learnt. Equal eigenvalues have any directions of their plane.
    ``deviation`` is a decimal, exact while it has up to 38 digits. Very long vectors
    cost the square of their length on the driver. Other columns are ignored. A table
    without usable vectors, or with one distinct vector, gives no rows.
    """
    vectors = scratch.materialise(coded(df, id_col, vec_col), "grid")
    model = fit(vectors, components)
    schema = "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    n, sums, d, mean, k = model.n, model.sums, model.d, model.mean, len(model.values)
    turn, explained, error = model.vectors / np.sqrt(model.values), model.explained, model.identity_error

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = from_grid(batch.column("x").to_pylist(), d)
        deviation = pa.array(deviations(x, n, sums), pa.decimal128(38, 0))
        each = pa.array(np.repeat(np.arange(len(x)), k))
        return text.record(
            id=batch.column("id").take(each),
            component=pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
            n=pa.array(np.full(len(x) * k, n), pa.int64()),
            deviation=deviation.take(each),
            whitened=(centred(x, n, sums, mean) @ turn).ravel(),
            explained=np.tile(explained, len(x)),
            identity_error=np.full(len(x) * k, error),
        )

    return text.map_batches(vectors.where(F.col("d") == d).select("id", "x"), run, schema)
