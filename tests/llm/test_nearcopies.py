import random

import numpy as np
import pytest

from duotide.llm import nearcopies
from llm_rows import SCHEMA, rows, words


def shingles(t):
    w = (t or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(t, least, rng):
    """A copy with words changed while the similarity stays at ``least`` or above."""
    w, own = t.split(), shingles(t)
    while True:
        new = list(w)
        new[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
        if similarity(own, shingles(" ".join(new))) < least:
            return " ".join(w)
        w = new


def groups(texts, least=0.8):
    """Smallest row of each component, by comparing all pairs."""
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= least:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {find(i) for i in range(len(texts))}


def test_wide_fingerprints_bring_near_copies_together():
    rng, met, all_pass = random.Random(2), [], True
    for i in range(150):
        base = " ".join(words(rng.randint(60, 500), i))
        copy = edited(base, rng.choice([0.8, 0.85, 0.9, 0.95]), rng)
        (fa, ka), (fb, kb) = (nearcopies.signature(nearcopies.shingles(x.encode())) for x in (base, copy))
        a, b = (np.frombuffer(f, "<u4").reshape(1, -1) for f in (fa, fb))
        all_pass &= bool(nearcopies.passes(a, b)[0])
        met.append(len(np.intersect1d(ka, kb)) > 0)
    assert all_pass and np.mean(met) >= 0.95


def test_chains_lose_no_pair_within_the_budget():
    rng = np.random.default_rng(3)
    n, width = nearcopies.SEGMENTS, nearcopies.WIDTH
    a = rng.integers(0, 1 << width, (2000, n)).astype(np.uint32)
    b = a.copy()
    for i in range(len(a)):  # differing bits anywhere, often bunched
        size = rng.integers(0, n * nearcopies.BUDGET + 40)
        places = rng.permutation(rng.integers(1, n + 1) * width if i % 2 else n * width)[:size]
        np.bitwise_xor.at(b[i], places // width, (1 << (places % width)).astype(np.uint32))
    apart = np.bitwise_count(a ^ b).sum(axis=1)
    assert (nearcopies.passes(a, b) == (apart <= n * nearcopies.BUDGET)).all()


def test_shingle_sets():
    for t in ("", " \n", "a", "A b c d", "a b c d e", "a b c d e f a b c d e", "x " * 40):
        assert len(nearcopies.shingles(t.encode())) == len(shingles(t))
    assert (nearcopies.shingles(b"A b\tC d E f") == nearcopies.shingles(b"a b c\nd e f")).all()


def test_planted_copies(spark):
    rng, texts = random.Random(4), []
    for i in range(60):
        base = " ".join(words(rng.randint(60, 300), 50 + i))
        texts += [base, edited(base, 0.95, rng), edited(base, 0.8, rng)]
        texts.append(" ".join(words(120, 500 + i)))
    got = {r["doc_id"] for r in nearcopies.keeps(spark.createDataFrame(rows(texts), SCHEMA).repartition(3)).collect()}
    want = groups(texts)
    assert want <= got and len(got) <= len(want) + 4


def test_no_pair_at_the_threshold_is_left_out(spark):
    """Pairs at 0.8 to 0.83, short and long, among texts that share a long common passage: exactly the groups of all pairs."""
    rng, shared, texts = random.Random(6), " ".join(words(60, 900)), []
    for i in range(150):
        base = " ".join(words(rng.randint(20, 250), 2000 + i)) + (" " + shared if i % 3 == 0 else "")
        texts += [base, edited(base, 0.8, rng)]
    found = groups(texts)
    assert len(found) < 200  # nearly all of them are pairs
    got = {r["doc_id"] for r in nearcopies.keeps(spark.createDataFrame(rows(texts), SCHEMA).repartition(3)).collect()}
    assert got == found


def test_large_group_and_chain(spark):
    """Hundreds of copies of one text; and texts each near the next only, which is one group."""
    rng, base = random.Random(5), " ".join(words(200, 9))
    texts = [base] * 50 + [edited(base, 0.9, rng) for _ in range(300)]
    chain = [" ".join(words(200, 10))]
    for _ in range(6):
        chain.append(edited(chain[-1], 0.82, rng))
    got = sorted(r["doc_id"] for r in nearcopies.keeps(spark.createDataFrame(rows(texts + chain), SCHEMA).repartition(4)).collect())
    assert got == [0, 350]


def test_awkward(awkward):
    before, got = awkward.collect(), nearcopies.keeps(awkward)
    assert got.columns == awkward.columns
    found = got.collect()
    texts = [r["text"] for r in before]
    assert len(found) == len(groups(texts)) and all(r in before for r in found)
    assert not any(r["doc_id"] is None for r in found)


def test_nothing(nothing):
    assert nearcopies.keeps(nothing).count() == 0


@pytest.mark.parametrize("ids", [[None, None], [3, 3], [None, 2]])
def test_ids(spark, ids):
    frame = spark.createDataFrame([(i, "one two three four five six") for i in ids], "doc_id long, text string")
    got = nearcopies.keeps(frame).collect()
    assert len(got) == 1 and got[0]["doc_id"] == next((i for i in ids if i is not None), None)


def test_sketches_never_overstate_the_difference():
    rng = np.random.default_rng(5)
    for n, m, both in [(0, 0, 0), (1, 0, 0), (300, 320, 290), (1024, 1025, 1000), (5000, 900, 100), (3000, 4100, 2900), (400, 400, 0)]:
        every = rng.integers(0, 1 << 63, n + m - both, dtype=np.int64).view(np.uint64)
        a, b = every[:n], every[n - both :]
        at_most = n + m - 2 * both
        found = nearcopies.differ(nearcopies.sketch(a), nearcopies.sketch(b))
        assert found <= at_most and nearcopies.differ(nearcopies.sketch(b), nearcopies.sketch(a)) == found
        assert found > 0 or not at_most
    assert nearcopies.differ(nearcopies.sketch(every[:400]), nearcopies.sketch(every[400:])) > 800 / 9  # no near copy, and seen as none


def test_sets_of_pairs_that_are_far_apart_are_not_sent(spark, monkeypatch):
    """Texts that share one rare passage only meet in the prefix join; their sets stay where they are."""
    asked, similar = [], nearcopies._similar

    def seen(rows, pairs, similarity):
        asked.append(pairs.count())
        return similar(rows, pairs, similarity)

    monkeypatch.setattr(nearcopies, "_similar", seen)
    rng, common = random.Random(9), [" ".join(words(60, 700 + k)) for k in range(40)]
    # each text has a passage from a common stock, which the sample knows as common, and a rare one that 20 texts share
    texts = [f"{' '.join(words(40, 5000 + i // 20))} {' '.join(rng.sample(common, 3))}" for i in range(200)]
    base = " ".join(words(200, 9000))
    texts += [base, edited(base, 0.8, random.Random(1))]
    table = [(i, t, *rows([""])[0][2:]) for i, t in enumerate(texts)]
    kept = {r["doc_id"] for r in nearcopies.keeps(spark.createDataFrame(table, SCHEMA)).select("doc_id").collect()}
    assert kept == groups(texts)
    assert sum(asked) < 300


def test_folded_sketches_never_overstate_the_difference():
    rng = np.random.default_rng(11)
    for size in (1, 40, 900, 5000):
        a = np.unique(rng.integers(0, 2**63, size, np.uint64))
        b = np.unique(np.concatenate([a[: size // 2 + 1], rng.integers(0, 2**63, size // 3, np.uint64)]))
        fa, fb = (nearcopies.folded(nearcopies.sketch(x)).view(np.uint64) for x in (a, b))
        assert len(fa) * 64 == nearcopies.BITS
        assert np.bitwise_count(fa ^ fb).sum() <= len(np.setxor1d(a, b))


def test_a_group_of_near_copies_costs_few_comparisons(spark, monkeypatch):
    rng, met, sets = random.Random(12), [], nearcopies._similar
    base = " ".join(words(300, 12))
    texts = [edited(base, 0.93, rng) for _ in range(60)] + [" ".join(words(200, 800 + k)) for k in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(nearcopies, "_similar", lambda rows, pairs, t: met.append(pairs.count()) or sets(rows, pairs, t))
    assert {r.doc_id for r in nearcopies.keeps(df).collect()} == groups(texts)
    assert sum(met) <= 2 * len(texts)


def test_shingles_of_the_same_nodes_meet_once(spark):
    def node(i, keys, size=30):
        return (i, size, bytes(nearcopies.ODD // 8), [0] * (nearcopies.BITS // 64), keys)

    found = [node(1, [5, 6, 7]), node(2, [5, 6, 7]), node(3, [6, 8]), node(4, [9])]
    nodes = spark.createDataFrame(found, "node long, size int, odd binary, bits array<long>, keys array<long>")
    stars = spark.createDataFrame([], "node long, root long")
    assert sorted(tuple(r) for r in nearcopies._joined(nodes, stars, 0.8).collect()) == [(1, 2), (1, 3), (2, 3)]
    far = spark.createDataFrame([(*r[:3], [(1 << 62) - 1 if r[0] == 3 else 0] * len(r[3]), r[4]) for r in found], nodes.schema)
    assert [tuple(r) for r in nearcopies._joined(far, stars, 0.8).collect()] == [(1, 2)]
