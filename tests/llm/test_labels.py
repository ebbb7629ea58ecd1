"""The two operators that learn from labels."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from duotide.llm import quality, toxicity

from llm_rows import SCHEMA, rows, words


def marked(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = words(rng.randint(5, 200), seed * 1000 + i)
        bad = i % 5 == 0
        for _ in range(rng.randint(2, 6) if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["vilefool", "grotscum", "nastyx" + rng.choice("abcdefgh")]))
        out.append((" ".join(w), int(bad)))
    return out


def test_block_max_is_exact():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(700):
        t = np.sort(rng.choice(60, rng.integers(1, 8), replace=False))
        w = rng.integers(1, 4, len(t)).astype(float)
        vectors.append((t, w / np.linalg.norm(w)))
    index = toxicity.BlockMaxIndex(vectors, 60)
    dense = np.zeros((700, 60))
    for row, (t, w) in zip(dense, vectors, strict=True):
        row[t] = w
    for i in range(0, 700, 7):
        cosine = dense @ dense[i]
        cosine[i] = 0
        kth = np.sort(cosine)[-10]
        want = {j for j in range(700) if cosine[j] > 0 and cosine[j] >= kth - 1e-9}
        near, examples = index.top(*vectors[i], 10, without=i)
        assert set(examples.tolist()) == want and (np.diff(near) <= 1e-12).all()
        assert np.allclose(near, cosine[examples])


def test_examples_of_a_kind_share_blocks():
    rng = np.random.default_rng(5)
    vectors = []
    for i in range(1600):  # four vocabularies in turn, with one rare term each that they have in common
        t = np.sort(np.append(rng.choice(40, 12, replace=False) + 40 * (i % 4), 160 + i // 4))
        w = rng.uniform(1, 2, len(t)) + 5 * (t >= 160)
        vectors.append((t, w / np.linalg.norm(w)))
    index = toxicity.BlockMaxIndex(vectors, 560)
    index.prepare()
    assert index.common == 160 and sorted(index.order.tolist()) == list(range(1600))
    kinds = (index.most.reshape(index.blocks, 160)[:, np.argsort(index.named[:160])] > 0).reshape(index.blocks, 4, 40).any(axis=2)
    assert kinds.sum() < index.blocks + toxicity.KINDS  # few blocks lie where one kind meets the next
    near, examples = index.top(*vectors[7], 25)
    dense = np.zeros((1600, 560))
    for row, (t, w) in zip(dense, vectors, strict=True):
        row[t] = w
    cosine = dense @ dense[7]
    assert examples[0] == 7 and np.allclose(near, np.sort(cosine)[::-1][: len(near)]) and np.array_equal(index.vector(7)[0], vectors[7][0])


def test_words_cut_as_bytes_are_those_of_the_pattern():
    every = "".join(map(chr, [*range(0x250), 0x130, 0x1E9E, 0x2019, 0x20AC, 0x3042, 0xD800, 0x1F600]))
    spaced = " ".join(every)
    for data in ("", "Plain words, twice_2 - ok", "Gr\xfc\xdfe \xe0 l\xc9cole \xb2\xbd\xaa", "it\u2019s \u20ac5 \u201cso\u201d", "\u0130stanbul \u0151rs\u00e9g", "\ud800x", every, every[:256], spaced):
        assert toxicity.words_of(data) == toxicity.WORD.findall(data.lower())


def test_isotonic():
    steps, share = toxicity.isotonic(np.array([0.1, 0.1, 0.2, 0.3, 0.9, 0.9]), np.array([0, 0, 1, 0, 1, 1]))
    assert (np.diff(share) >= 0).all() and (np.diff(steps) > 0).all() and share[0] < 0.5 < share[-1]


def test_toxicity_held_out(spark):
    data = marked(900, 1)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(data)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(data) if i % 3 != 1], "id long, label int")
    model = toxicity.fit(docs, labels)
    got = {r["id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(len(data)) if i % 3 == 1]
    right = sum((got[i]["score"] >= 0.7) == bool(data[i][1]) for i in held)
    assert right >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all(e % 3 != 1 for r in got.values() for e in r["evidence"])


def test_a_copy_of_an_example_without_marks_is_found(spark):
    data = marked(300, 4)
    plain = [i for i, (_, y) in enumerate(data) if not y]
    copies = [(1000 + i, data[i][0]) for i in plain[:40]]
    docs = spark.createDataFrame([*((i, t) for i, (t, _) in enumerate(data)), *copies, (2000, "unheard zzzzqq")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(data)], "id long, label int")
    model = toxicity.fit(docs, labels)
    got = {r["id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i]["evidence"][0] == i - 1000 for i, _ in copies)
    assert got[2000]["evidence"] == [] and 0 < got[2000]["score"] < 0.5


def test_toxicity_corners(spark, awkward, nothing):
    labels = spark.createDataFrame([(12, 1), (12, 0), (13, 0), (None, 1), (3, None)], "id long, label int")
    model = toxicity.fit(awkward, labels)
    got = toxicity.score(awkward, model).collect()
    assert len(got) == awkward.count() and len({r["score"] for r in got if r["id"] in (0, 1, 2)}) == 1
    none = toxicity.fit(awkward, labels.limit(0))
    assert {r["score"] for r in toxicity.score(awkward, none).collect()} == {0.0}
    assert toxicity.score(nothing, model).count() == 0 and toxicity.fit(nothing, labels).vectors.terms == {}


def junk(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = words(rng.randint(20, 120), seed * 500 + i)
        out.append((" ".join(w), 1) if i % 4 else (" ".join(x + rng.choice(["###", "%%%"]) for x in w), 0))
    return out


def test_quality_held_out(spark):
    data = junk(400, 3)
    docs = spark.createDataFrame(rows([t for t, _ in data]), SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(data) if i % 5], "id long, label int")
    got = {r["id"]: r["score"] for r in quality.posteriors(docs, labels).collect()}
    assert all((got[i] >= 0.5) == bool(data[i][1]) for i in range(0, 400, 5))
    kept = quality.keeps(docs, labels)
    assert kept.schema == docs.schema and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, s in got.items() if s >= 0.5)


def test_sparse_sites_shrink_further(spark):
    """One host is all junk, one all good; a path with one document stays near its host."""
    data = [("good plain words in a row here " + str(i), "clean", "big") for i in range(200)] + [("### %%% $$$ ### %%% " + str(i), "dirty", "big") for i in range(200)]
    data += [("good plain words in a row here", "dirty", "small")]
    docs = spark.createDataFrame([(i, *x) for i, x in enumerate(data)], "doc_id long, text string, source string, lang string")
    labels = docs.select(F.col("doc_id").alias("id"), (F.col("source") == "clean").cast("int").alias("label")).where("id < 400")
    model, _ = quality.fit(docs, labels)
    prior = {(r["host"], r["path"]): (r["host_prior"], r["path_prior"]) for r in model.paths.collect()}
    assert prior["clean", "big"][0] > 0.8 > 0.2 > prior["dirty", "big"][0]
    assert prior["dirty", "small"][1] < 0.9  # its one document is good


def test_shrinkage_reads_the_spread(spark):
    even = spark.createDataFrame([(5.0, 10)] * 20, "good double, n long")
    uneven = spark.createDataFrame([(float(10 * (i % 2)), 10) for i in range(20)], "good double, n long")
    assert quality.shrinkage(even, F.lit(0.5)) > 100 * quality.shrinkage(uneven, F.lit(0.5))


def test_quality_corners(spark, awkward, nothing):
    labels = spark.createDataFrame([(12, 1), (13, 0), (None, 0)], "id long, label int")
    got = quality.posteriors(awkward, labels).collect()
    assert len(got) == awkward.count() and all(math.isfinite(r["score"]) for r in got)
    one = quality.keeps(awkward, labels.where("label = 1"))
    assert one.count() == awkward.count()  # nothing to tell apart: nothing is rejected
    assert quality.posteriors(nothing, labels).count() == 0 and quality.keeps(nothing, labels).count() == 0


def test_cells_of_a_column_are_cut_where_they_end():
    import pyarrow as pa

    rows = [np.array(x, "<i4") for x in ([1, 2, 3], [], [7], [5, 6])]
    column = pa.chunked_array([pa.array([r.tobytes() for r in rows[:2]], pa.binary()), pa.array([b"skip", *(r.tobytes() for r in rows[2:])], pa.binary()).slice(1)])
    numbers, at = toxicity.cells(column, "<i4")
    assert [numbers[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [r.tolist() for r in rows]
    numbers, at = toxicity.cells(pa.chunked_array([], pa.binary()), "<u8")
    assert len(numbers) == 0 and at.tolist() == [0]


def test_words_are_looked_up_as_a_whole_with_their_marks():
    long = "mark" + "x" * 70
    words = np.unique(np.array([toxicity.word_key(w) for w in ("plain", "marked", long)], np.uint64))
    terms = {"mark*": (0, 1.5), "marked": (1, 2.5)}
    data = f"plain marked Marked unseen {long}"
    made = toxicity.Vectors(terms, words, np.array([1, 2, 3]), 10)
    found = made.vector(data)
    again = made.vector(data)  # by now from memory
    assert found[0].tolist()[:2] == [0, 1] and len(found[0]) == 5
    assert all(np.array_equal(a, b) for a, b in zip(found, again, strict=True))
    weight = (1 + np.log([3, 2])) * [1.5, 2.5]  # the beginning is in the long word too
    assert np.allclose(found[1][:2] / found[1][0], weight / weight[0])
    assert set(made.marked) == {"marked"} and long not in made.known
    assert made.vector("...") is None
