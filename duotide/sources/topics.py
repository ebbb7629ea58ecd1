"""Topics kept as files: records with topic, partition and offset, read and written as a data source.

``path/<topic>/log/<n>.json`` says, in order, which row groups of which Parquet files hold
which offsets; a file is part of the topic once such an entry names it, so half-written
batches are never seen. A task writes one file, with a row group per topic and partition,
and nothing is shuffled. Offsets of a partition start at 0 and have no gaps.

Entries remember the last batch of each named writer: a batch that is repeated after its
entry was written adds nothing. One query or job at a time may write a topic.
``path`` must be a folder that driver and executors share.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections import defaultdict
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)

from duotide.schemas import RECORD_SCHEMA
from duotide.scratch import opened

FORMAT = "topic_files"
#: Rows that a writer holds back over all partitions before it writes row groups, and rows a reading task takes.
HELD_ROWS, TASK_ROWS = 50_000, 200_000

STORED = pa.schema([("key", pa.binary()), ("value", pa.binary()), ("timestamp", pa.timestamp("us", "UTC"))])
_EMPTY = {"parts": [], "ends": {}, "writers": {}}


class Log:
    """The entries of one topic; ``refresh`` reads those that were added since."""

    def __init__(self, path: str, topic: str):
        if not topic or topic != posixpath.basename(topic):
            raise ValueError(f"unusable topic name {topic!r}")
        self.files, root = opened(path)
        self.folder = posixpath.join(root, topic)
        self.entries: list[dict] = []

    def _name(self, number: int) -> str:
        return posixpath.join(self.folder, "log", f"{number:020d}.json")

    def refresh(self) -> Log:
        while self.files.get_file_info(self._name(len(self.entries))).type == fs.FileType.File:
            with self.files.open_input_stream(self._name(len(self.entries))) as f:
                self.entries.append(json.loads(f.read()))
        return self

    @property
    def last(self) -> dict:
        return self.entries[-1] if self.entries else _EMPTY

    def add(self, groups: list[tuple[str, int, int, int]], writer: str | None, batch: int | None) -> bool:
        """Give ``(file, row group, partition, rows)`` their offsets; False if this writer's batch has them already."""
        last = self.refresh().last
        if writer is not None and last["writers"].get(writer, -1) >= batch:
            return False
        ends, parts = dict(last["ends"]), []
        for file, group, partition, rows in groups:
            first = ends.get(str(partition), 0)
            parts.append([file, group, partition, first, rows])
            ends[str(partition)] = first + rows
        writers = last["writers"] | ({writer: batch} if writer is not None else {})
        entry, name = {"parts": parts, "ends": ends, "writers": writers}, self._name(len(self.entries))
        self.files.create_dir(posixpath.dirname(name), recursive=True)
        staged = f"{name}.{uuid.uuid4().hex}"
        with self.files.open_output_stream(staged) as f:
            f.write(json.dumps(entry).encode())
        self.files.move(staged, name)
        return True


@dataclass
class Written(WriterCommitMessage):
    """Row groups of one task's file: ``(topic, partition, rows)`` in order."""

    file: str
    groups: list[tuple[str, int, int]]


class _Writer:
    def __init__(self, options: dict):
        self.path, self.name = options["path"], options.get("writer")
        self.epoch = int(options["epoch"]) if "epoch" in options else None
        if self.name is not None and self.epoch is None and options.get("mode") == "batch":
            raise ValueError("a named writer needs the number of its epoch")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = opened(self.path)
        files.create_dir(posixpath.join(root, "_rows"), recursive=True)
        name, groups = f"_rows/{uuid.uuid4().hex}.parquet", []
        held: dict[tuple[str, int], list[pa.Table]] = defaultdict(list)
        out, n = None, 0

        def flush():
            nonlocal out, n
            for (topic, partition), tables in sorted(held.items()):
                table = pa.concat_tables(tables).combine_chunks()
                out = out or pq.ParquetWriter(posixpath.join(root, name), STORED, filesystem=files)
                out.write_table(table, row_group_size=max(1, table.num_rows))
                groups.append((topic, partition, table.num_rows))
            held.clear()
            n = 0

        for batch in iterator:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            if table["topic"].null_count or table["partition"].null_count:
                raise ValueError("a record has no topic or no partition")
            rows = table.select(STORED.names).cast(STORED)
            topic = table["topic"].combine_chunks().dictionary_encode()
            codes = topic.indices.to_numpy(zero_copy_only=False)
            partition = table["partition"].to_numpy()
            order = np.lexsort((partition, codes))  # stable: records of a partition keep their order
            cuts = np.flatnonzero((np.diff(codes[order]) != 0) | (np.diff(partition[order]) != 0)) + 1
            for own in np.split(order, cuts):
                held[topic.dictionary[int(codes[own[0]])].as_py(), int(partition[own[0]])].append(rows.take(pa.array(own)))
            n += len(order)
            if n >= HELD_ROWS:
                flush()
        flush()
        if out:
            out.close()
        return Written(name, groups)

    def _commit(self, messages: Sequence[Written | None], batch: int | None) -> None:
        topics = defaultdict(list)
        for m in messages:
            for i, (topic, partition, rows) in enumerate(m.groups if m else []):
                topics[topic].append((m.file, i, partition, rows))
        for topic in sorted(topics):
            Log(self.path, topic).add(topics[topic], self.name, batch)

    def _abort(self, messages: Sequence[Written | None]) -> None:
        files, root = opened(self.path)
        for m in messages:
            if m and m.groups:
                files.delete_file(posixpath.join(root, m.file))


class BatchWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages):
        self._commit(messages, self.epoch)

    def abort(self, messages):
        self._abort(messages)


class StreamWriter(_Writer, DataSourceStreamArrowWriter):
    def commit(self, messages, batchId):
        self._commit(messages, batchId)

    def abort(self, messages, batchId):
        self._abort(messages)


@dataclass
class Ranges(InputPartition):
    """What a task reads: ``(topic, file, row group, partition, first offset there, from, to)``."""

    parts: list[tuple]


Offsets = dict[str, dict[str, int]]


class _Reader:
    def __init__(self, options: dict):
        self.path = options["path"]
        self.topics = sorted({t.strip() for t in options["subscribe"].split(",") if t.strip()})
        self.rows = int(options.get("rowsPerTask", TASK_ROWS))
        self.logs = {t: Log(self.path, t) for t in self.topics}

    def ends(self) -> Offsets:
        return {t: dict(log.refresh().last["ends"]) for t, log in self.logs.items()}

    def ranges(self, start: Offsets, end: Offsets) -> list[Ranges]:
        """The offsets from ``start`` up to ``end``, about ``rowsPerTask`` a task."""
        tasks, size = [[]], 0
        for topic, log in self.logs.items():
            for file, group, partition, first, n in (p for e in log.refresh().entries for p in e["parts"]):
                low = max(first, start.get(topic, {}).get(str(partition), 0))
                high = min(first + n, end.get(topic, {}).get(str(partition), 0))
                while low < high:
                    take = min(high - low, self.rows - size)
                    tasks[-1].append((topic, file, group, partition, first, low, low + take))
                    low, size = low + take, size + take
                    if size >= self.rows:
                        tasks.append([])
                        size = 0
        return [Ranges(t) for t in tasks if t]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        files, root = opened(self.path)
        for topic, file, group, number, first, low, high in partition.parts:
            with files.open_input_file(posixpath.join(root, file)) as f:
                at = first
                for batch in pq.ParquetFile(f).iter_batches(10_000, row_groups=[group]):
                    begin, stop = max(low, at), min(high, at + batch.num_rows)
                    if begin < stop:
                        rows, n = batch.slice(begin - at, stop - begin), stop - begin
                        columns = [
                            rows["key"],
                            rows["value"],
                            pa.array([topic] * n, pa.string()),
                            pa.array(np.full(n, number, np.int32)),
                            pa.array(np.arange(begin, stop, dtype=np.int64)),
                            rows["timestamp"],
                            pa.array(np.zeros(n, np.int32)),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, RECORD_SCHEMA.names)
                    at += batch.num_rows


class BatchReader(_Reader, DataSourceReader):
    def partitions(self):
        return self.ranges({}, self.ends()) or [Ranges([])]


class StreamReader(_Reader, DataSourceStreamReader):
    """``maxOffsetsPerTrigger`` bounds a micro-batch, dealt over partitions by what each has waiting.

    Where the reader stands is known from the last batch it planned; a named ``group`` keeps
    that in a file too, so that the bound holds from the first batch after a restart. The
    checkpoint, not that file, decides what is read.
    """

    def __init__(self, options: dict):
        super().__init__(options)
        self.starting = options.get("startingOffsets", "earliest")
        if self.starting not in ("earliest", "latest"):
            raise ValueError(f"unknown startingOffsets {self.starting!r}")
        self.limit = int(options["maxOffsetsPerTrigger"]) if "maxOffsetsPerTrigger" in options else None
        self.group, self.begin, self.at = options.get("group"), None, None
        if self.limit is not None and (self.limit < 1 or not self.group):
            raise ValueError("maxOffsetsPerTrigger must be at least 1 and needs the name of a group")

    def _place(self) -> tuple[fs.FileSystem, str]:
        files, root = opened(self.path)
        return files, posixpath.join(root, "_groups", f"{self.group}.json")

    def initialOffset(self) -> Offsets:
        """The same whenever it is asked; a new query asks for the latest offset first."""
        if self.begin is None:
            self.begin = self.ends() if self.starting == "latest" else {t: {} for t in self.topics}
        return self.begin

    def _stands(self) -> Offsets:
        files, name = self._place()
        if files.get_file_info(name).type != fs.FileType.File:
            return self.initialOffset()
        with files.open_input_stream(name) as f:
            return json.loads(f.read())

    def latestOffset(self) -> Offsets:
        if self.at is None and self.limit is not None:
            self.at = self._stands()
        if self.starting == "latest":
            self.initialOffset()  # never later than the first batch's end
        ends = self.ends()
        if self.limit is None:
            return ends
        waiting = {(t, p): end - self.at.get(t, {}).get(p, 0) for t, own in ends.items() for p, end in own.items()}
        total, left = sum(waiting.values()), self.limit
        if total <= left:
            return ends
        out = {t: {p: self.at.get(t, {}).get(p, 0) for p in own} for t, own in ends.items()}
        for t, p in sorted(waiting, key=lambda k: (-waiting[k], k)):
            take = min(waiting[t, p], max(1, self.limit * waiting[t, p] // total), left)
            out[t][p] += take
            left -= take
        return out

    def partitions(self, start: Offsets, end: Offsets) -> list[Ranges]:
        self.at = end
        if self.group:
            files, name = self._place()
            files.create_dir(posixpath.dirname(name), recursive=True)
            staged = f"{name}.{uuid.uuid4().hex}"
            with files.open_output_stream(staged) as f:
                f.write(json.dumps(end).encode())
            files.move(staged, name)
        return self.ranges(start, end)


class TopicFiles(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return RECORD_SCHEMA

    def reader(self, schema):
        return BatchReader(self.options)

    def streamReader(self, schema):
        return StreamReader(self.options)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("topics are only added to")
        return BatchWriter(dict(self.options) | {"mode": "batch"})

    def streamWriter(self, schema, overwrite):
        return StreamWriter(self.options)


@contextmanager
def use(spark: SparkSession) -> Iterator[SparkSession]:
    """The session, with the format registered, as the active one inside the block.

    Spark looks a format up in the thread's active session and in the table's own, which
    for the tables of a ``newSession`` is another; it refuses to register what the active one has.
    """
    sessions = spark._jvm.org.apache.spark.sql.classic.SparkSession
    before = sessions.getActiveSession()
    sessions.setActiveSession(spark._jsparkSession)
    try:
        try:
            spark.dataSource.register(TopicFiles)
        except AnalysisException as error:  # a micro-batch's copy of a session has it already
            if error.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
                raise
        yield spark
    finally:
        if before.isDefined():
            sessions.setActiveSession(before.get())
        else:
            sessions.clearActiveSession()


def keyed(df: DataFrame, topic: str | Column, partitions: int = 8, partition: Column | None = None) -> DataFrame:
    """``value`` and, where there are such columns, ``key`` and ``timestamp`` as records for a topic.

    Records of one key share a partition, in the order they have within a task; those
    without a key are dealt by value.
    """
    kinds = {"key": "binary", "value": "binary", "timestamp": "timestamp"}
    cols = [(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()]
    by = F.coalesce("key", "value") if "key" in df.columns else F.col("value")
    number = partition if partition is not None else F.pmod(F.xxhash64(by.cast("binary")), F.lit(partitions))
    return df.select(*cols, (F.lit(topic) if isinstance(topic, str) else topic).alias("topic"), number.cast("int").alias("partition"))


def write(records: DataFrame, path: str, writer: str | None = None, epoch: int | None = None) -> None:
    """Add records of :func:`keyed`; with a ``writer``, an ``epoch`` that it has sent already adds nothing."""
    out = records.write.format(FORMAT).mode("append").option("path", path)
    if writer is not None:
        out = out.option("writer", writer).option("epoch", epoch)
    with use(records.sparkSession):
        out.save()


def scan(spark: SparkSession, path: str, topics: str | Sequence[str], **options) -> DataFrame:
    """All records of the topics as a table; a topic that nothing was sent to has none."""
    names = topics if isinstance(topics, str) else ",".join(topics)
    with use(spark):
        return spark.read.format(FORMAT).option("subscribe", names).options(**options).load(path)


def stream(
    spark: SparkSession,
    path: str,
    topics: str | Sequence[str],
    starting: str = "earliest",
    max_offsets: int | None = None,
    group: str | None = None,
) -> DataFrame:
    """Records of one or more topics as a stream, at most ``max_offsets`` a micro-batch.

    A run over what is there now takes one micro-batch, so with a limit it may leave some.
    """
    names = topics if isinstance(topics, str) else ",".join(topics)
    reader = spark.readStream.format(FORMAT).option("subscribe", names).option("startingOffsets", starting)
    for name, value in (("maxOffsetsPerTrigger", max_offsets), ("group", group)):
        if value is not None:
            reader = reader.option(name, value)
    with use(spark):
        return reader.load(path)
