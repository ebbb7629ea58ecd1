"""Near copies of texts by five-word shingles: wide SimHash fingerprints and Pigeonring filtering.

Texts are near copies if their sets of five-word shingles have a Jaccard similarity
of ``similarity`` or more. At 0.8 two fingerprints differ in about 15 % of their
bits, which 64 bits cannot tell from chance, so a fingerprint has 504 bits, a ring
of 18 segments of 28. Bits that differ are mostly those with a small margin, whose
shingles vote nearly even. (:func:`signature` also has each segment as a key in eight
forms, its three least certain bits either way; the job needs the plain segments only.)

A pair of fingerprints passes if the ring has a start from which 1, 2, ... ``CHAIN``
consecutive segments differ in at most as many times ``BUDGET`` bits, and all in 18
times that. (Pigeonring: a pair within the whole budget has such a start.) What passes
is compared by the shingles themselves. So nothing is linked wrongly.

Fingerprints bring most copies together: nodes that share a whole segment are led by
the smallest that has it. A node is compared with the leader that it shares most segments
with, then with its other leaders that are not in its component by now, so a large group
of near copies costs one comparison a node. What they miss is found by an exact
join of the sets, between nodes that are not yet in one component: with all shingles in
one order, rare ones first, two sets of ``n <= m`` shingles and similarity ``t`` share one
of the first ``n - 2 t n / (1 + t) + 1`` of the smaller and the first ``m - t m + 1`` of the larger,
at places that leave room for all they must share. So no link between components is lost.
Any order is exact; which shingles are common is taken from a sample of ``SAMPLE`` texts.

Of shingles that the very same prefixes hold, the join takes the first, which stands for all.
A pair meets in it only if ``BITS`` parity bits of the sets leave room for the similarity.
Before sets are sent to be compared, a longer sketch of each set bounds how much they differ: a
shingle flips one bit of some ``ODD`` or more, so two sets differ in at least as many
shingles as their sketches in bits. A pair whose bits differ in more than the similarity
allows is no near copy; the sketch is an eighth of a byte a bit, the set eight bytes a shingle.

Texts with equal sets are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from duotide import scratch
from duotide.llm import text
from duotide.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
#: 64-bit hashes of a shingle; segments and their bits; bits of a segment taken either way.
LANES, SEGMENTS, WIDTH, FLIPS = 8, 18, 28, 3
#: Differing bits a segment that a chain may hold, and segments of a chain. 18 times 6 bits is 0.21 of all; 0.8 has 0.15 with a deviation of 0.016.
BUDGET, CHAIN = 6, 4
#: Shingles whose bits are counted at once: counts fit a byte.
SLICE = 255
#: Texts, by hash, from which the common shingles are learnt; how often such a shingle is in them; how many are kept.
SAMPLE, COMMON, KEPT = 20_000, 3, 100_000
#: Ids that may be sent to every task, so that no text is shuffled to be picked; more are joined.
SENT = 1_000_000

#: Bits of a sketch at least, a power of two; a set of more shingles has more. Bits that go through the join of prefixes, 64 a number.
ODD, BITS = 1024, 512

#: Multiplier that joins the hashes of words, and steps from a hash to its lanes.
_FACTOR, _STEPS = np.uint64(0x9E3779B97F4A7C15), np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_PLACES = (np.uint64(1) << np.arange(WIDTH, dtype=np.uint64)).astype(np.int64)
_FORMS = np.array([[f >> k & 1 for k in range(FLIPS)] for f in range(1 << FLIPS)], np.int64)


def shingles(data: bytes) -> np.ndarray:
    """Hashes of the distinct shingles, ascending; fewer words: of the whole sequence; none: empty."""
    words = data.lower().split()
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    found = np.zeros(len(words) - size + 1 if size else 0, np.uint64)
    for k in range(size):
        found = found * _FACTOR + own[k : k + len(found)]
    return np.unique(found)


def _lanes(h: np.ndarray) -> np.ndarray:
    """``LANES`` times 64 bits of each hash, as bytes."""
    z = h[:, None] + _STEPS
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z.view(np.uint8)


def _margin(hashes: np.ndarray) -> np.ndarray:
    """For each bit, by segments, how many more hashes have it set than not."""
    votes = np.zeros(64 * LANES, np.int64)
    for i in range(0, len(hashes), SLICE):
        bits = np.unpackbits(_lanes(hashes[i : i + SLICE]).ravel())
        votes += bits.reshape(-1, 64 * LANES).sum(axis=0, dtype=np.uint8)
    return (2 * votes - len(hashes))[: SEGMENTS * WIDTH].reshape(SEGMENTS, WIDTH)


def fingerprint(hashes: np.ndarray) -> bytes:
    """The fingerprint, a segment in four bytes; empty without shingles."""
    return ((_margin(hashes) > 0) @ _PLACES).astype("<u4").tobytes() if len(hashes) else b""


def signature(hashes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The fingerprint and the keys of its segments, in all forms."""
    if not len(hashes):
        return b"", np.zeros(0, np.int64)
    margin = _margin(hashes)
    bits = margin > 0
    unsure = np.argsort(np.abs(margin), axis=1, kind="stable")[:, :FLIPS]
    value = bits @ _PLACES
    kept = value & ~_PLACES[unsure].sum(axis=1)
    keys = kept[:, None] + _PLACES[unsure] @ _FORMS.T + (np.arange(SEGMENTS) << WIDTH)[:, None]
    return value.astype("<u4").tobytes(), keys.ravel()


def sketch(hashes: np.ndarray) -> bytes:
    """Which bits are hit by an odd number of the hashes; as many bits as hashes or more, ``ODD`` at least."""
    bits = max(ODD, 1 << max(len(hashes) - 1, 0).bit_length())
    hit = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(hit.astype(np.uint8), bitorder="little").tobytes()


def folded(odd: bytes) -> np.ndarray:
    """A sketch as ``BITS`` bits: it would be the same with that many to begin with."""
    return np.bitwise_xor.reduce(np.frombuffer(odd, np.int64).reshape(-1, BITS // 64), axis=0)


def differ(a: bytes, b: bytes) -> int:
    """Of two sets by their sketches, how many shingles only one of them has, at least."""
    a, b = (np.frombuffer(x, np.uint64) for x in sorted((a, b), key=len))
    while len(b) > len(a):  # half as many bits: the upper half falls on the lower one
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _unapart(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sketches leave room for the similarity. ``nodes(node, size, odd)``."""
    most = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()
            apart = [differ(x, y) for x, y in zip(batch.column("oa").to_pylist(), batch.column("ob").to_pylist(), strict=True)]
            good = pa.array(np.array(apart, np.int64) <= most * sizes + 1e-6)
            yield text.record(a=batch.column("a").filter(good), b=batch.column("b").filter(good))

    for side in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("size").alias(f"n{side}"), F.col("odd").alias(f"o{side}")), side)
    return pairs.select("a", "b", "na", "nb", "oa", "ob").mapInArrow(run, "a long, b long")


def passes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of fingerprints (rows of segments) have a chain, and are within the whole budget."""
    apart = np.bitwise_count(a ^ b).astype(np.int64)
    ring = np.concatenate([apart, apart[:, : CHAIN - 1]], axis=1)
    start, total = np.ones(apart.shape, bool), np.zeros(apart.shape, np.int64)
    for k in range(CHAIN):
        total = total + ring[:, k : k + SEGMENTS]
        start &= total <= (k + 1) * BUDGET
    good = start.any(axis=1)
    good[good] = apart[good].sum(axis=1) <= SEGMENTS * BUDGET
    return good


def _chained(pairs: DataFrame) -> DataFrame:
    """``(a, b)`` of the pairs ``(a, b, fa, fb)`` whose fingerprints pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fa, fb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, SEGMENTS) for c in ("fa", "fb"))
                good = pa.array(passes(fa, fb))
                yield text.record(a=batch.column("a").filter(good), b=batch.column("b").filter(good))

    return pairs.select("a", "b", "fa", "fb").mapInArrow(run, "a long, b long")


def _sets(rows: DataFrame) -> DataFrame:
    """``(node, s)`` with the shingle hashes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(x).view(np.int64) for x in text.raw(batch, "text")]
        return text.record(node=batch.column("node"), s=pa.array(found, pa.list_(pa.int64())))

    return text.map_batches(rows.select("node", "text"), run, "node long, s array<long>")


def _by_node(rows: DataFrame, nodes: DataFrame, how: str) -> DataFrame:
    """``rows`` in or not in the written ``nodes``; texts stay where they are while these are few."""
    return rows.join(F.broadcast(nodes) if nodes.count() <= SENT else nodes, "node", how)


def _similar(rows: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` that are near copies, written. ``rows(node, text)``."""
    asked = pairs.select(F.col("a").alias("node")).distinct().unionByName(pairs.select(F.col("b").alias("node")).distinct()).distinct()
    sets = scratch.materialise(_sets(_by_node(rows, scratch.materialise(asked, "asked"), "left_semi")), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return scratch.materialise(both.where(common >= F.lit(similarity) * (F.size("sa") + F.size("sb") - common)).select("a", "b"), "similar")


def _led(rows: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)`` of near copies that share a segment, one of them the smallest node that has it. ``rows(node, text)``; ``nodes(node, fp)``.

    Each node meets one leader first; the others only if that leaves them in different components.
    """
    segment = lambda i: F.xxhash64(i, F.substring(F.col("fp"), i * 4 + 1, F.lit(4)))
    keyed = nodes.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), segment)).alias("key"))
    leaders = keyed.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").select("key", "leader")
    pairs = keyed.join(leaders, "key").where("node <> leader").groupBy("leader", "node").agg(F.count("*").alias("n"))
    pairs = scratch.materialise(pairs.select(F.col("leader").alias("a"), F.col("node").alias("b"), "n"), "leaders")
    left, right = nodes.select(F.col("node").alias("a"), F.col("fp").alias("fa")), nodes.select(F.col("node").alias("b"), F.col("fp").alias("fb"))
    met = lambda p: _similar(rows, scratch.materialise(_chained(p.join(left, "a").join(right, "b")), "led"), similarity)
    found = met(pairs.groupBy("b").agg(F.max_by("a", "n").alias("a")).select("a", "b"))
    stars = scratch.materialise(components(found), "led-stars")
    for side in "ab":
        own = stars.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
        pairs = pairs.join(own, side, "left").withColumn(f"r{side}", F.coalesce(f"r{side}", side))
    return found.unionByName(met(pairs.where("ra <> rb").select("a", "b")))


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that many texts of a sample have, ascending, and how many of its texts have each. ``texts(text)``."""
    share = max(1, texts.count() // SAMPLE)
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).select(F.lit(0).cast("long").alias("node"), "text")
    sample = _sets(sample).select(F.explode("s").alias("h"))
    found = sample.groupBy("h").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "h").limit(KEPT).toArrow()
    h = found.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], found.column("count").to_numpy()[order]


def prefix(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """Of a set's shingles in order, rare ones first, those of which a similar set that is not larger has one."""
    count = np.zeros(len(hashes), np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], hashes), len(common[0]) - 1)
        count = np.where(common[0][at] == hashes, common[1][at], 0)
    # a little more than needed, so that no rounding shortens it
    return hashes[np.lexsort((hashes, count))][: int(len(hashes) * (1 - similarity) + 1e-6) + 1]


def _joined(nodes: DataFrame, stars: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)`` of nodes in different components whose prefixes, sizes and sketches leave room for the similarity. ``nodes(node, size, odd, bits, keys)``."""
    every = nodes.select("node", "size", F.posexplode("keys").alias("at", "key"))
    alike = Window.partitionBy("key")  # most shingles are one node's
    found = every.withColumns({"lo": F.min("node").over(alike), "hi": F.max("node").over(alike)}).where("lo < hi")
    found = scratch.materialise(found.select("key", "node", "size", "at"), "shared")
    members = scratch.materialise(found.join(stars, "node", "left").select("key", "node", "size", "at", F.coalesce("root", "node").alias("root")), "members")
    # keys of the very same nodes find the same pairs: the first in the order leaves them the most room
    same = {"n": F.count("*"), "least": F.min("node"), "x": F.bit_xor(F.xxhash64("node")), "y": F.bit_xor(F.xxhash64("node", F.lit(1)))}
    mixed = members.groupBy("key").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.min_by("at", "node").alias("place"), *[c.alias(k) for k, c in same.items()]
    )
    mixed = mixed.where("lo < hi").groupBy(*same).agg(F.min_by("key", "place").alias("key")).select("key")
    members = members.join(mixed, "key", "left_semi").join(nodes.select("node", "bits"), "node")
    least = F.lit(similarity / (1 + similarity))
    small = members.where(F.col("at") <= F.col("size") * (1 - 2 * least) + 1e-6).select("key", *[F.col(c).alias(f"{c}_a") for c in ("node", "size", "at", "root", "bits")])
    large = members.select("key", *[F.col(c).alias(f"{c}_b") for c in ("node", "size", "at", "root", "bits")])
    ahead = (F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("node_a") < F.col("node_b")))
    room = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")) + 1e-6 >= least * (F.col("size_a") + F.col("size_b"))
    fits = ahead & room & (F.col("size_a") + 1e-6 >= F.lit(similarity) * F.col("size_b")) & (F.col("root_a") != F.col("root_b"))
    apart = reduce(add, [F.bit_count(F.get("bits_a", i).bitwiseXOR(F.get("bits_b", i))) for i in range(BITS // 64)])
    fits = fits & (apart <= (1 - similarity) / (1 + similarity) * (F.col("size_a") + F.col("size_b")) + 1e-6)
    pairs = small.join(large.withColumnRenamed("key", "key_b"), (F.col("key") == F.col("key_b")) & fits)
    pairs = scratch.materialise(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), "joined")
    return scratch.materialise(_unapart(pairs, nodes, similarity), "near")


def _groups(rows: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """``(node, root)`` of the nodes that are not their component's smallest. ``rows(node, text)``; ``nodes(node, fp, size, odd, bits, keys)``."""
    led = _led(rows, nodes.select("node", "fp"), similarity)
    stars = scratch.materialise(components(led), "stars")
    return components(led.unionByName(_similar(rows, _joined(nodes, stars, similarity), similarity)))


def keeps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row, with all its columns, of each group of near copies: that with the smallest id; of equal or only null ids, one.

    Groups are the components of links. Letters A-Z count as a-z. A null text is
    empty; texts without words are copies of each other, and texts of fewer than five
    words of those with the same words. Very long texts are compared whole. Repeated
    ids and rows are rows of their own, of which one stays. Columns may have any name.
    No rows: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, text.SLICE):
                part = batch.slice(at, text.SLICE)
                equal, fps, sizes, odd, bits, keys = [], [], [], [], [], []
                for data in text.raw(part, "text"):
                    hashes = shingles(data)
                    equal.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    fps.append(fingerprint(hashes))
                    sizes.append(len(hashes))
                    odd.append(sketch(hashes))
                    bits.append(folded(odd[-1]))
                    keys.append(prefix(hashes, common.value, similarity).view(np.int64))
                found = {"equal": pa.array(equal, pa.binary()), "fp": pa.array(fps, pa.binary()), "size": pa.array(sizes, pa.int32()), "odd": pa.array(odd, pa.binary()), "bits": pa.array(bits, pa.list_(pa.int64())), "keys": pa.array(keys, pa.list_(pa.int64()))}
                yield text.record(row=part.column("row"), id=part.column("id"), **found)

    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    common = df.sparkSession.sparkContext.broadcast(_common(rows.select("text")))
    own = [StructField("equal", BinaryType()), StructField("fp", BinaryType()), StructField("size", IntegerType()), StructField("odd", BinaryType()), StructField("bits", ArrayType(LongType())), StructField("keys", ArrayType(LongType()))]
    rows = rows.mapInArrow(run, StructType([*rows.schema.fields[:2], *own])).withColumn("node", F.monotonically_increasing_id())
    rows = scratch.materialise(rows, "rows")
    path = scratch.new_dir(df.sparkSession, "dropped")
    with scratch.scope(df.sparkSession):  # only the ids of the rows that go are needed after
        rows.select("node").join(_chosen(rows, text_col, similarity), "node", "left_anti").write.parquet(path)
    return _by_node(rows, df.sparkSession.read.schema("node long").parquet(path), "left_anti").select("row.*")


def _chosen(rows: DataFrame, text_col: str, similarity: float) -> DataFrame:
    """``node`` of the row that stays of each group. ``rows(row, id, equal, fp, size, odd, bits, keys, node)``."""
    # the order among rows: null ids last, then the smallest
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("first")
    classes = scratch.materialise(rows.groupBy("equal").agg(F.min("node").alias("node"), first), "classes")
    nodes = rows.where(F.length("fp") > 0).select("node", "fp", "size", "odd", "bits", "keys").join(classes.select("node"), "node", "left_semi")
    nodes = scratch.materialise(nodes, "nodes")
    stars = _groups(rows.select("node", F.col(f"row.`{text_col}`").alias("text")), nodes, similarity)
    rooted = classes.join(stars, "node", "left").select("first", F.coalesce("root", "node").alias("root"))
    return rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.node").alias("node"))
