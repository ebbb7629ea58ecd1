"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``.

A written table cuts lineage, survives the loss of any executor and is read
back with column pruning, which a cached or locally checkpointed one is not.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}
_scopes = threading.local()


def root(spark: SparkSession) -> str:
    """The shared folder; only a local session without the setting gets its own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="duotide-"))
    return sc.getCheckpointDir().rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, noted for :func:`release`."""
    app = spark.sparkContext.applicationId
    path = f"{root(spark)}/duotide/{app}/{name}-{uuid.uuid4().hex}"
    open_scopes = getattr(_scopes, "stack", [])
    (open_scopes[-1] if open_scopes else _written.setdefault(app, [])).append(path)
    return path


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and folder, for tasks that read or write files; a plain path and ``file:/path`` are local."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def materialise(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """Write ``df`` once and return the table that was written, in a folder per value of its last column ``by``."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> int:
    """Delete every intermediate table this application wrote; returns how many."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        delete(spark, path)
    return len(paths)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete the tables written inside the block, by this thread, when it ends.

    For micro-batches: their results are stored by then, and a query that runs
    for months must not keep what each epoch wrote on the way.
    """
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            delete(spark, path)
