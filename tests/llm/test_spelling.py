import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from duotide.llm import spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_counts(rows):
    total = Counter()
    for key, body in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", body or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % 97 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            total[word] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def plain_variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return out


def close_words(seed, k, letters="abc", low=5, high=9):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(k)})


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdeéÿ×"])
def test_search_finds_every_near_word_once(letters):
    words = close_words(1, 700, letters) + ["zzzzz", "zzzzzz", "zzzzzzz", "zzzzzzzz", "yzzzz", "zzzzy", "zzyzz"]
    counts = np.array([random.Random(w).randint(3, 9) for w in words])
    both = np.array([True] * len(words) + [False] * len(words))
    found = spelling.partners(words, counts, words * 2, both)
    want = {w: [v for v in words if one_edit(w, v)] for w in words}
    assert dict(zip(found["word"], found["n_near"], strict=True)) == {w: len(v) for w, v in want.items() if v}
    n = dict(zip(words, counts, strict=True))
    for r in found.itertuples():
        assert r.form == min(want[r.word], key=lambda v: (-n[v], v)) and r.form_n == n[r.form]


def test_search_for_words_not_in_the_index():
    words = ["apple", "apply", "maple"]
    found = spelling.partners(words, np.array([5, 5, 5]), ["applé", "ample", "qqqqq"] * 2, np.array([True] * 3 + [False] * 3))
    assert {(r.word, r.n_near, r.form) for r in found.itertuples()} == {("applé", 2, "apple"), ("ample", 1, "apple")}
    assert not len(spelling.partners([], np.array([]), ["apple"], np.array([True])))


@pytest.mark.parametrize("shard_words", [50_000, 40])
def test_shards_agree_with_brute_force(spark, shard_words):
    """With 40 words a shard, many halves are hot and have a grid of shards."""
    words = close_words(2, 900)
    rows = [(w, random.Random(w).randint(3, 30)) for w in words]
    table = spark.createDataFrame(rows, "word string, n long").repartition(3)
    found = {tuple(r) for r in spelling.near_words(table, shard_words).select("word", "n_near", "form", "form_n").collect()}
    n, want = dict(rows), set()
    for w in words:
        near = [v for v in words if one_edit(w, v)]
        if near:
            best = min(near, key=lambda v: (-n[v], v))
            want.add((w, len(near), best, n[best]))
    assert found == want


def test_variants_equal_brute_force(spark):
    rng = random.Random(3)
    stock = close_words(4, 150, "abé", 5, 7) + ["Größe", "GRÖSSE", "größer", "élan×vital", "letter", "letters", "lettre"]
    weights = [1 / (i + 1) for i in range(len(stock))]
    rows = [(i, " ".join(rng.choices(stock, weights, k=rng.randint(0, 90)))) for i in range(300)]
    rows += [(None, "Letters letters LETTERS l3tters"), (None, None), (5, ""), rows[7], rows[7]]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {tuple(r) for r in spelling.variants(table).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = plain_variants(plain_counts(rows))
    assert got == want and len({r for r in want if r[1]}) > 20
    assert any(r[1] != r[2] for r in want if r[1])  # some chain is longer than one step


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i:03d}", f"w{i + 1:03d}") for i in range(45)]
    ends = dict(map(tuple, spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert ends == {w: "w045" for w, _ in chain}


def test_order_of_ties(spark):
    words = ["b", "a", "ab", "aé", "é", "", "abc"]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    best = rows.agg(F.max_by("w", spelling.falling(F.col("w"))), F.min_by("w", spelling.falling(F.col("w")))).first()
    assert tuple(best) == (min(words), max(words))


def test_awkward(awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = {tuple(r) for r in spelling.variants(awkward).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == plain_variants(plain_counts(rows))
    assert spelling.variants(nothing).collect() == []


def test_very_long_words(spark):
    long = "x" * 20_000
    rows = [(i, f"{long} {long}x a{long} {long[:-1]}y other") for i in range(4)]
    got = {r["word"]: r["n_near"] for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    counts = plain_counts(rows)
    assert got[long] == 3 and got[long + "x"] == 2 and set(got) == set(counts)
