import itertools
import random

import xxhash
from pyspark.sql import functions as F

from duotide.llm import simhash
from duotide.llm.components import components


def plain(t):
    w = [x for x in __import__("re").split(b"[\x20\x09-\x0d]+", (t or "").encode().lower()) if x]
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(pairs):
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return find


def test_fingerprints(awkward):
    texts = {r["doc_id"]: r["text"] for r in awkward.collect()}
    for r in simhash.fingerprints(awkward).collect():
        assert r["id"] is None or r["fp"] & (1 << 64) - 1 == plain(texts[r["id"]])


def test_hash_is_sparks(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("größe und")).alias("h")).first()
    assert row["h"] & (1 << 64) - 1 == xxhash.xxh64_intdigest("größe und".encode(), 42)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_lose_none(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(12):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps.add(x)
    fps |= {0, 1, 3, 7, 15, (1 << 64) - 1}
    want = {(a, b) for a, b in itertools.combinations(sorted(map(signed, fps)), 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    got = simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long").repartition(4))
    assert {(min(r), max(r)) for r in map(tuple, got.collect())} == want and len(want) > 300


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 400)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randrange(5000, 6000), rng.randrange(5000, 6000)) for _ in range(600)] + [(7, 7)]
    find = union(edges)
    want = {x: find(x) for x in {y for e in edges for y in e} if find(x) != x}
    rng.shuffle(edges)
    frame = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")
    assert dict(map(tuple, components(frame).collect())) == want
    assert components(frame.limit(0)).count() == 0


def test_near_duplicates(awkward):
    rows = [(r["doc_id"], plain(r["text"])) for r in awkward.collect()]
    distinct = sorted({f for _, f in rows})
    find = union([(a, b) for a, b in itertools.combinations(distinct, 2) if (a ^ b).bit_count() <= 3])
    smallest = {}
    for i, f in rows:
        if i is not None:
            smallest[find(f)] = min(i, smallest.get(find(f), i))
    want = sorted([(i, f, smallest.get(find(f))) for i, f in rows], key=str)
    got = [(r["id"], r["fp"] & (1 << 64) - 1, r["component"]) for r in simhash.near_duplicates(awkward).collect()]
    assert sorted(got, key=str) == want
    kept = simhash.keeps(awkward)
    assert kept.schema == awkward.schema
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(smallest.values()))


def test_only_null_ids(awkward):
    nulls = awkward.where("doc_id IS NULL")
    assert {r["component"] for r in simhash.near_duplicates(nulls).collect()} == {None}
    assert simhash.keeps(nulls).count() == 2


def test_nothing(nothing):
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keeps(nothing).count() == 0
