import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

public = pytest.importorskip("public_tokenizers")
from duotide.llm import lattice, text  # noqa: E402

PIECES = str(public.path("piece_bpe_32k.model"))


def tokens(t):
    return [w for w in re.split(b"[\x20\x09-\x0d]+", (t or "").encode().lower()) if w] + [b" "]


def every_cut(s, arcs, byte):
    """Probability of a string summed over all its segmentations, written out."""
    if not s:
        return 1.0
    total = math.exp(sum(byte[b] for b in s[0].encode())) * every_cut(s[1:], arcs, byte)
    for k in range(1, len(s) + 1):
        if arcs.get(s[:k]) is not None:
            total += math.exp(arcs[s[:k]]) * every_cut(s[k:], arcs, byte)
    return total


def test_forward_is_the_sum_over_segmentations():
    model = lattice.Lattice(PIECES, {i: i % 97 for i in range(300, 30_000)}, 10)
    for word in ("the", "thering", "größe", "日x", "zq", "▁a", "don't"):
        assert model.marginal(word) == pytest.approx(math.log(every_cut("▁" + word, model.arcs, model.byte)), rel=1e-9)
    assert math.isfinite(model.marginal("x" * 20_000))


def test_scores_are_probabilities():
    """All pieces, bytes and the end share one distribution; control pieces take the rest."""
    model = lattice.Lattice(PIECES, {1000: 50, 2000: 7}, 3)
    total = sum(math.exp(s) for s in model.arcs.values() if s is not None) + sum(map(math.exp, model.byte)) + math.exp(model.end)
    assert 0.99 < total <= 1 + 1e-9


@pytest.mark.parametrize("head", [0, 5, 100_000])
def test_score(awkward, head):
    docs = awkward.withColumn("held", text.remainder("doc_id", 3) == 2)
    rows = [(r["doc_id"], r["text"], bool(r["held"])) for r in docs.collect()]
    seen = Counter(w for _, t, held in rows if not held for w in tokens(t))
    n, v = sum(seen.values()), len(seen)
    got = lattice.score(docs, "held", PIECES, head=head).collect()
    assert len(got) == len(rows)
    by = {r["id"]: r for r in got if r["id"] is not None}
    for i, t, held in rows:
        if i is not None:
            r = by[i]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, len(tokens(t)), sum(seen[w] > 0 for w in tokens(t)), n)
            assert r["base_score"] == pytest.approx(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in tokens(t)), rel=1e-9)
            assert math.isfinite(r["score"]) and r["score"] < 0
    empty = [by[i]["score"] for i in (0, 1, 2)]
    assert empty[0] == empty[1] == empty[2]


def test_head_and_tail_agree(awkward):
    docs = awkward.where("doc_id IS NOT NULL").withColumn("held", F.lit(False))
    a, b = ({r["id"]: r["score"] for r in lattice.score(docs, "held", PIECES, head=h).collect()} for h in (0, 1000))
    assert a == pytest.approx(b, rel=1e-9)


def test_training_text_is_likelier(spark):
    docs = [(i, "the house on the hill" if i % 2 else "house hill on", zlib.crc32(str(i).encode()) % 7 == 2) for i in range(60)]
    docs += [(100, "the house on the hill", True), (101, "zvq xkw qqj wxz vvk", True)]
    got = {r["id"]: r["score"] for r in lattice.score(spark.createDataFrame(docs, "doc_id long, text string, held boolean"), "held", PIECES).collect()}
    assert got[100] > got[101]


def test_nothing(nothing, awkward):
    assert lattice.score(nothing.withColumn("held", F.lit(True)), "held", PIECES).count() == 0
    untrained = lattice.score(awkward.withColumn("held", F.lit(True)), "held", PIECES).collect()
    assert {r["train_tokens"] for r in untrained} == {0} and {r["n_known"] for r in untrained} == {0}
