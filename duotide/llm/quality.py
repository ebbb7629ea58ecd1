"""Quality by hierarchical empirical Bayes.

A logistic model on a bounded sample of labelled texts turns each document into
evidence, the log of a likelihood ratio. Hosts, and paths within hosts, have their
own share of good documents: grouped sums of the documents' probabilities, a path
shrunk towards its host and a host towards the corpus. How strongly is read off the
data: the less sites differ beyond what their sizes explain, the more they shrink,
and a site with few documents always does. A document's probability adds its path's
prior to its own evidence.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from duotide import scratch
from duotide.llm import text
from duotide.llm.rules import BLANKS, LOWER, SYMBOLS, UPPER, count

#: Labelled rows that the document model is fitted on at most.
EXAMPLES = 20_000
PUNCTUATION, DIGITS = b".,;:?", b"0123456789"
NAMES = ("log_words", "word_bytes", "symbols", "exclamations", "capitals", "digits", "punctuation", "outside_ascii", "repeated_lines", "repeated_words", "repeated_windows", "empty")
#: Evidence is held within these odds, so that no single text outweighs everything.
LIMIT = 12.0


def features(data: bytes) -> list[float]:
    words = data.split()
    n, size = max(len(words), 1), max(len(data), 1)
    upper, lower = count(data, UPPER), count(data, LOWER)
    lines = [x for x in data.split(b"\n") if x.strip(BLANKS)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    ascii_size = len(data) if data.isascii() else len(data.decode("utf-8", "ignore").encode("ascii", "ignore"))
    values = (
        float(np.log1p(len(words))) / 5,
        min((size - count(data, BLANKS)) / n / 10, 5),
        min(count(data, SYMBOLS) / n, 3),
        min(data.count(b"!") / n, 3),
        upper / max(upper + lower, 1),
        count(data, DIGITS) / size,
        min(count(data, PUNCTUATION) / n, 3),
        1 - ascii_size / size,
        1 - len(set(lines)) / max(len(lines), 1),
        1 - len(set(words)) / n if words else 0.0,
        1 - len(set(windows)) / max(len(windows), 1),
        float(not words),
    )
    return list(values)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Newton's method with a ridge; weights, the constant last. One label only: no evidence."""
    if len(set(y.tolist())) < 2:
        return np.zeros(x.shape[1] + 1)
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def shrinkage(groups: DataFrame, prior: Column, good: str = "good", n: str = "n") -> float:
    """Weight, in documents, of the prior of a group, from the spread of groups beyond chance."""
    share = F.col(good) / F.col(n)
    row = groups.agg(
        F.avg(F.pow(share - prior, 2)).alias("spread"),
        F.avg(prior * (1 - prior) / F.col(n)).alias("chance"),
        F.avg(prior * (1 - prior)).alias("var"),
    ).first()
    if row["var"] is None:
        return 1.0
    between = max(row["spread"] - row["chance"], row["var"] * 1e-4)
    return min(max(row["var"] / between - 1, 1.0), 1e4)


@dataclass(frozen=True)
class Model:
    """Weights of the document model, its prior log-odds, and a table ``(host, path, host_prior, path_prior)``."""

    weights: list[float]
    prior: float
    paths: DataFrame

    def evidence(self) -> Column:
        if not any(self.weights):
            return F.lit(0.0)
        margin = F.lit(self.weights[-1])
        for i, w in enumerate(self.weights[:-1]):
            margin = margin + F.col("features")[i] * w
        return F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), margin - self.prior))

    def scored(self, rows: DataFrame) -> DataFrame:
        """``host, path, features`` give ``evidence, host_prior, path_prior, score``."""
        rows = rows.withColumn("evidence", self.evidence()).drop("features").join(self.paths, ["host", "path"])
        return rows.withColumn("score", 1 / (1 + F.exp(-F.col("evidence") - logit(F.col("path_prior")))))


def _site(column: str | None) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")) if column else F.lit("")


def described(df: DataFrame, carried: Column, text_col: str, host_col: str | None, path_col: str | None) -> DataFrame:
    """``(carried, host, path, features)``."""
    rows = df.select(carried.alias("carried"), _site(host_col).alias("host"), _site(path_col).alias("path"), F.col(text_col).alias("features"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([features(x) for x in text.raw(batch, "features")], pa.list_(pa.float64()))
        return text.record(carried=batch.column("carried"), host=batch.column("host"), path=batch.column("path"), features=found)

    schema = StructType([*rows.schema.fields[:3], StructField("features", ArrayType(DoubleType()))])
    return rows.mapInArrow(lambda batches: (run(b) for b in batches), schema)


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = "source", path_col: str | None = "lang", examples: int = EXAMPLES) -> tuple[Model, DataFrame]:
    """The model, and the described rows (``carried`` is the id) that its sums were taken over.

    ``labels(id, label)`` marks good documents with 1; at most ``examples`` of them, by
    hash of the id, are used. Null ids and labels are left out, repeated ones count as
    the larger, and of rows that repeat an id the one with the largest features. Without examples of both labels there is no evidence.
    """
    seen = scratch.materialise(described(df, F.col(id_col).cast("long"), text_col, host_col, path_col), "features")
    drawn = labels.where("id IS NOT NULL AND label IS NOT NULL").groupBy(F.col("id").alias("carried")).agg(F.max("label").alias("label"))
    drawn = drawn.orderBy(F.xxhash64("carried"), "carried").limit(examples)
    found = seen.select("carried", "features").join(F.broadcast(drawn), "carried")  # at most ``examples`` ids
    sample = found.groupBy("carried").agg(F.max("features").alias("features"), F.max("label").alias("label")).collect()
    sample.sort(key=lambda r: (r["carried"], r["features"], r["label"]))
    x, y = np.array([r["features"] for r in sample]).reshape(-1, len(NAMES)), np.array([float(r["label"]) for r in sample])
    rate = (y.sum() + 1) / (len(y) + 2)
    model = Model(fit_logistic(x, y).tolist(), float(np.log(rate / (1 - rate))), seen)
    weighed = seen.withColumn("p", 1 / (1 + F.exp(-model.evidence() - model.prior)))
    paths = scratch.materialise(weighed.groupBy("host", "path").agg(F.sum("p").alias("good"), F.count("*").alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))
    top = hosts.agg(F.sum("host_good").alias("g"), F.sum("host_n").alias("n")).first()
    overall = F.lit((top["g"] + 1) / (top["n"] + 2) if top["n"] else 0.5)
    k = shrinkage(hosts, overall, "host_good", "host_n")
    hosts = hosts.select("host", ((F.col("host_good") + k * overall) / (F.col("host_n") + k)).alias("host_prior"))
    paths = paths.join(hosts, "host")
    k = shrinkage(paths, F.col("host_prior"))
    paths = paths.select("host", "path", "host_prior", ((F.col("good") + k * F.col("host_prior")) / (F.col("n") + k)).alias("path_prior"))
    return replace(model, paths=scratch.materialise(paths, "priors")), seen


def posteriors(df: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """``(id, evidence, host_prior, path_prior, score)`` for every row; ``columns`` as of :func:`fit`.

    Null hosts and paths count as one unnamed site. A null or empty text has a
    feature of its own. Repeated rows count each; null ids are scored but match no
    label. No rows: no rows.
    """
    model, seen = fit(df, labels, **columns)
    return model.scored(seen).select(F.col("carried").alias("id"), "evidence", "host_prior", "path_prior", "score")


def keeps(df: DataFrame, labels: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = "source", path_col: str | None = "lang", examples: int = EXAMPLES) -> DataFrame:
    """The rows, with all their columns, whose score is at least ``least``; texts are read again rather than stored."""
    model, _ = fit(df, labels, id_col, text_col, host_col, path_col, examples)
    rows = described(df, F.struct(*[F.col(f"`{c}`") for c in df.columns]), text_col, host_col, path_col)
    return model.scored(rows).where(F.col("score") >= least).select("carried.*")
