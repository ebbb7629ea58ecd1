"""SimHash near-duplicates: Pigeonring filtering of candidate pairs.

A 64-bit fingerprint is cut into a ring of four 16-bit segments. If two
fingerprints differ in at most 3 bits, the ring has a start from which the first
l segments together differ in at most floor(3 l / 4) bits, for every l: 0, 1, 2
and 3. (Plain pigeonhole asks for l = 1 only.) The chain of the first two is
the join key: the first segment equal and the second with at most one bit
changed, 32 bits in all, so a bucket stays small where 16 bits would hold
thousands. The third step of the chain and the full distance are checked inside
the join, before a pair becomes a row.

Work is done on distinct fingerprints: copies cost one row however many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from duotide import scratch
from duotide.llm import text
from duotide.llm.components import components

SEED, SHINGLE, MAX_BITS = 42, 3, 3
#: Shingles whose bits are counted at once; bounds memory for very long texts.
SLICE = 1 << 16


def fingerprint(data: bytes) -> int:
    """Bits set in over half the XXH64 hashes of the 3-word shingles; 0 without words."""
    words = data.lower().split()
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), SLICE):
        part = hashes[i : i + SLICE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` with the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(x) for x in text.raw(batch, "text")], dtype=np.uint64).view(np.int64)
        return text.record(id=batch.column("id"), fp=fp)

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return text.map_batches(rows, run, "id long, fp long")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF))


def links(fps: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints at most 3 bits apart, each once or more.

    Of two second segments that differ in one bit, the one with the bit clear
    probes for the other, so each fingerprint probes its own segment and those
    with one more bit set.
    """
    fp = F.col("fp")
    ring = [F.struct(F.lit(i).alias("i"), _segment(fp, i).alias("s"), _segment(fp, i + 1).alias("t"), _segment(fp, i + 2).alias("r")) for i in range(4)]
    chains = fps.select(fp, F.explode(F.array(*ring)).alias("c")).select("fp", "c.*")
    index = chains.select((F.col("i").cast("long") * (1 << 32) + F.col("s") * (1 << 16) + F.col("t")).alias("key"), F.col("fp").alias("b"), F.col("t").alias("bt"), F.col("r").alias("br"))
    near = F.array_distinct(F.array(F.col("t"), *[F.col("t").bitwiseOR(F.lit(1 << k)) for k in range(16)]))
    probe = chains.withColumn("p", F.explode(near)).select((F.col("i").cast("long") * (1 << 32) + F.col("s") * (1 << 16) + F.col("p")).alias("key"), F.col("fp").alias("a"), F.col("t").alias("at"), F.col("r").alias("ar"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    chain = F.bit_count(F.col("at").bitwiseXOR(F.col("bt"))) + F.bit_count(F.col("ar").bitwiseXOR(F.col("br"))) <= 2
    same = (probe["key"] == index["key"]) & ((F.col("at") != F.col("bt")) | (F.col("a") < F.col("b"))) & chain & (apart <= MAX_BITS)
    return probe.join(index.hint("shuffle_merge"), same).select("a", "b")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, component)`` for every row; component is the smallest id reachable over links.

    Texts without words share fingerprint 0 and are linked like any other. A null
    text has no words. Rows with a null id are linked but never name a component;
    a component of such rows alone has a null one. Repeated ids and rows stay.
    No rows: no rows.
    """
    rows = scratch.materialise(fingerprints(df, id_col, text_col), "fingerprints")
    distinct = scratch.materialise(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    stars = components(links(distinct.select("fp")))
    rooted = distinct.join(stars, distinct["fp"] == stars["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(smallest, "root").select("fp", "component")
    return rows.join(named, "fp").select("id", "fp", "component")


def keeps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, with all its columns, of each component: that with the smallest id; of equal or only null ids, one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x) for x in text.raw(batch, "text")], dtype=np.uint64).view(np.int64)
            yield text.record(row=batch.column("row"), id=batch.column("id"), fp=fp)

    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = StructType([*rows.schema.fields[:2], StructField("fp", LongType())])
    rows = scratch.materialise(rows.mapInArrow(run, schema).withColumn("uid", F.monotonically_increasing_id()), "rows")
    # the order among rows: null ids last, then the smallest
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("first")
    distinct = scratch.materialise(rows.groupBy("fp").agg(first), "distinct")
    stars = components(links(distinct.select("fp")))
    rooted = distinct.join(stars, distinct["fp"] == stars["node"], "left").select("first", F.coalesce("root", "fp").alias("root"))
    chosen = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.uid").alias("uid"))
    return rows.join(chosen, "uid", "left_semi").select("row.*")


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
