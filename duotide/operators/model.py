"""Train forecasters on lag features.

``var``    least squares with intercept, from central moments (one pass).
``gated``  a gated unit with two dense layers, from per-partition gradients.

Rows never reach the driver: it sees one small row per model or per weight.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duotide import scratch
from duotide.schemas import LABEL, SERIES

# Fixed values of the network and its optimiser.
HIDDEN = 40
DENSE = 10
EPOCHS = 50
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-7
# Rows that go through the network together: its arrays of so many rows stay in a core's cache.
SLICE = 512


def train(
    df: DataFrame,
    features: Sequence[str],
    label: str = LABEL,
    kind: str = "var",
    by: Sequence[str] = (SERIES,),
    handle_invalid: str = "skip",
    **options,
) -> DataFrame:
    """Fitted models: ``by`` columns, ``n``, ``weights`` and ``rmse``."""
    rows = _complete(df, [*features, label], handle_invalid)
    if kind == "var":
        return fit_var(rows, features, label, by, **options)
    if kind == "gated":
        if by:
            raise ValueError("the gated model is trained on all rows; pass by=()")
        return fit_gated(rows, features, label, **options)
    raise ValueError(f"unknown kind {kind!r}")


def _complete(df: DataFrame, cols: Sequence[str], handle_invalid: str) -> DataFrame:
    if handle_invalid == "skip":
        return df.dropna("any", subset=list(cols))
    if handle_invalid != "error":
        raise ValueError(f"unknown handle_invalid {handle_invalid!r}")
    check = {c: F.coalesce(F.col(c), F.raise_error(F.lit(f"null in {c}")).cast("double")) for c in cols}
    return df.withColumns(check)


def fit_var(df: DataFrame, features: Sequence[str], label: str = LABEL, by: Sequence[str] = (SERIES,)) -> DataFrame:
    """Least squares per group; ``weights`` is the intercept, then one per feature.

    One pass: each partition reduces its rows to central moments per group, which
    merge without losing digits however far a group lies from zero or from others,
    and a series with most of the rows is summed by all tasks.
    """
    cols = [*features, label]
    pairs = [F.covar_pop(cols[i], cols[j]) for i in range(len(cols)) for j in range(i, len(cols))]
    moments = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.array(*[F.avg(c) for c in cols]).alias("_mean"), F.array(*pairs).alias("_cov")
    )
    moments = moments.where("n > 0")
    fields = [moments.schema[c] for c in by] + [
        T.StructField("n", T.LongType()),
        T.StructField("weights", T.ArrayType(T.DoubleType())),
        T.StructField("rmse", T.DoubleType()),
    ]
    keep = [*by, "n"]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in batches:
            if len(groups):
                weights, rmse = _solve(np.stack(groups["_mean"]), np.stack(groups["_cov"]))
                yield groups[keep].assign(weights=list(weights), rmse=rmse)

    return moments.mapInPandas(solve, T.StructType(fields))


def _solve(mean, upper):
    """Least squares for many groups at once from their means and the upper triangles of their covariances."""
    m = mean.shape[1]
    cov = np.empty((len(mean), m, m))
    i, j = np.triu_indices(m)
    cov[:, i, j] = upper
    cov[:, j, i] = upper
    a, c, spread = cov[:, :-1, :-1], cov[:, :-1, -1], cov[:, -1, -1]
    scale = np.sqrt(np.clip(np.einsum("bii->bi", a), 0, None))
    scale[scale == 0] = 1.0
    scaled = a / scale[:, :, None] / scale[:, None, :]
    # pinv keeps collinear or constant features from blowing up
    slope = np.einsum("bij,bj->bi", np.linalg.pinv(scaled, rcond=1e-10, hermitian=True), c / scale) / scale
    intercept = mean[:, -1] - (slope * mean[:, :-1]).sum(axis=1)
    left = spread - (slope * c).sum(axis=1)
    return np.column_stack([intercept, slope]), np.sqrt(np.clip(left, 0, None))


def gated_shapes(k: int, hidden: int = HIDDEN, dense: int = DENSE) -> list[tuple[int, ...]]:
    gates = [(k, hidden), (hidden,)] * 3
    return [*gates, (hidden, dense), (dense,), (dense, 1), (1,)]


def unpack(weights: np.ndarray, k: int, hidden: int = HIDDEN, dense: int = DENSE) -> list[np.ndarray]:
    parts, at = [], 0
    for shape in gated_shapes(k, hidden, dense):
        size = int(np.prod(shape))
        parts.append(weights[at : at + size].reshape(shape))
        at += size
    return parts


def _sigmoid(x):
    # in place: the array is the caller's own result
    np.clip(x, -60, 60, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1.0
    return np.divide(1.0, x, out=x)


def gated_forward(parts: list[np.ndarray], x: np.ndarray):
    """Predictions of the network, and what its gradient needs.

    With one time step and no earlier state the recurrent kernel and the forget
    gate of the unit never act, so they are left out.
    """
    wi, bi, wg, bg, wo, bo, w1, b1, w2, b2 = parts
    i, g, o = _sigmoid(x @ wi + bi), np.tanh(x @ wg + bg), _sigmoid(x @ wo + bo)
    t = np.tanh(i * g)
    h = o * t
    d = np.maximum(h @ w1 + b1, 0)
    return (d @ w2 + b2)[:, 0], (i, g, o, t, h, d)


def gated_outputs(parts: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Predictions of the network, slice by slice."""
    return np.concatenate([np.zeros(0), *[gated_forward(parts, x[at : at + SLICE])[0] for at in range(0, len(x), SLICE)]])


def gated_gradient(parts: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Sum over rows of the gradient of the absolute error, and that error."""
    *_, w1, _, w2, _ = parts
    out, (i, g, o, t, h, d) = gated_forward(parts, x)
    dy = np.sign(out - y)[:, None]
    dd = (dy @ w2.T) * (d > 0)
    dh = dd @ w1.T
    dc = dh * o * (1 - t * t)
    di, dg, do = dc * g * i * (1 - i), dc * i * (1 - g * g), dh * t * o * (1 - o)
    grads = [x.T @ di, di.sum(0), x.T @ dg, dg.sum(0), x.T @ do, do.sum(0), h.T @ dd, dd.sum(0), d.T @ dy, dy.sum(0)]
    return np.concatenate([part.ravel() for part in grads]), float(np.abs(out - y).sum())


def _initial(k: int, hidden: int, dense: int, seed: int) -> np.ndarray:
    """Glorot-uniform gates and output, Glorot-normal dense layer, zero biases."""
    rng, parts = np.random.default_rng(seed), []
    for at, shape in enumerate(gated_shapes(k, hidden, dense)):
        if len(shape) == 1:
            parts.append(np.zeros(shape))
            continue
        fan = sum(shape) + (3 * hidden if at < 6 else 0)  # the unit's four gates share one kernel
        if at == 6:
            parts.append(rng.normal(0, np.sqrt(2 / fan), shape))
        else:
            parts.append(rng.uniform(-1, 1, shape) * np.sqrt(6 / fan))
    return np.concatenate([p.ravel() for p in parts])


def fit_gated(
    df: DataFrame,
    features: Sequence[str],
    label: str = LABEL,
    epochs: int = EPOCHS,
    rate: float = 0.02,
    hidden: int = HIDDEN,
    dense: int = DENSE,
    seed: int = 1,
    start: Sequence[float] | None = None,
    local: int | None = None,
) -> DataFrame:
    """Adam on the absolute error, one pass over a written table per epoch.

    Every partition sends the sum of its gradients; the driver gets one number
    per weight. Inputs and label are standardised while training and the scaling
    is folded into the returned weights, which apply to raw features. ``start`` are
    weights, for standardised features, to begin with.

    With ``local`` rows a step, every partition takes Adam steps of its own over its
    rows in each pass, and sends where they led; weights and moments are averaged by
    rows. A pass is then worth many, so few ``epochs`` do. A partition's rows come
    in the order they were written in, so a repeated task takes the same steps.
    """
    k = len(features)
    rows = scratch.materialise(df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate([*features, label])]))
    cols = rows.columns
    moments = rows.agg(F.count("*"), *[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols]).first()
    n, mean, std = moments[0], np.array(moments[1 : k + 2], float), np.array(moments[k + 2 :], float)
    if not n:
        raise ValueError("no complete rows to train on")
    std[std == 0] = 1.0
    weights = _initial(k, hidden, dense, seed) if start is None else np.array(start, float)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    if local:
        steps = np.zeros(1)
        for _ in range(epochs):
            weights, m, v, steps = _averaged_steps(rows, (weights, m, v, steps), local, rate, (mean, std), (k, hidden, dense))
        epochs = 0
    for step in range(1, epochs + 2):
        sums = _gradient_sums(rows, weights, mean, std, k, hidden, dense)
        grad, loss = sums[:-1] / n, sums[-1] / n
        if step > epochs:  # the last pass only measures the final weights
            break
        m = BETA1 * m + (1 - BETA1) * grad
        v = BETA2 * v + (1 - BETA2) * grad * grad
        weights = weights - rate * (m / (1 - BETA1**step)) / (np.sqrt(v / (1 - BETA2**step)) + EPSILON)
    raw = _fold_scaling(weights, mean, std, k, hidden, dense)
    fitted = [(n, raw.tolist(), float(loss * std[-1]))]
    return df.sparkSession.createDataFrame(fitted, "n bigint, weights array<double>, train_mae double")


def _gradient_sums(rows, weights, mean, std, k, hidden, dense) -> np.ndarray:
    size = len(weights) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, total = unpack(weights, k, hidden, dense), np.zeros(size)
        for batch in batches:
            values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            values = (values - mean) / std
            for at in range(0, len(values), SLICE):
                own = values[at : at + SLICE]
                grad, loss = gated_gradient(parts, own[:, :k], own[:, k])
                total[:-1] += grad
                total[-1] += loss
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["at", "g"])

    sums = rows.mapInArrow(partial, "at int, g double").groupBy("at").agg(F.sum("g").alias("g"))
    out = np.zeros(size)
    for at, g in sums.collect():  # one row per weight
        out[at] = g
    return out


def _averaged_steps(rows, state, size: int, rate: float, scaling, shape) -> list[np.ndarray]:
    """Weights, moments and steps taken so far, after each partition's own steps over its rows, averaged by rows."""
    cuts = np.cumsum([len(a) for a in state])
    (mean, std), (k, hidden, dense) = scaling, shape

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (w, m, v, t), n = (a.copy() for a in state), 0
        for batch in batches:
            values = (np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - mean) / std
            for at in range(0, len(values), size):
                own = values[at : at + size]
                grad = gated_gradient(unpack(w, k, hidden, dense), own[:, :k], own[:, k])[0] / len(own)
                t += 1
                m = BETA1 * m + (1 - BETA1) * grad
                v = BETA2 * v + (1 - BETA2) * grad * grad
                w = w - rate * (m / (1 - BETA1 ** t[0])) / (np.sqrt(v / (1 - BETA2 ** t[0])) + EPSILON)
            n += len(values)
        if n:
            out = np.concatenate([w, m, v, t, [1.0]]) * n
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], ["at", "g"])

    sums = rows.mapInArrow(walk, "at int, g double").groupBy("at").agg(F.sum("g").alias("g")).orderBy("at")
    total = np.array([r["g"] for r in sums.collect()])  # three rows per weight
    return np.split(total[:-1] / total[-1], cuts[:-1])


def _fold_scaling(weights, mean, std, k, hidden, dense) -> np.ndarray:
    parts = [p.copy() for p in unpack(weights, k, hidden, dense)]
    for kernel, bias in ((0, 1), (2, 3), (4, 5)):
        parts[kernel] = parts[kernel] / std[:k, None]
        parts[bias] = parts[bias] - mean[:k] @ parts[kernel]
    parts[8] = parts[8] * std[k]
    parts[9] = parts[9] * std[k] + mean[k]
    return np.concatenate([p.ravel() for p in parts])
