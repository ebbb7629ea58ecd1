import random
import zlib

import numpy as np
import pytest

public = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from duotide.llm import automaton, packing  # noqa: E402

BYTES, WORDS = (str(public.path(f)) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
MORE = ["a" * 3000, " \n\n x  y\t\tz \r\n", "x y 　 z   ", "it's we'll 'S'S'll don't, can't.", "é é 日本語 12３四", "!!!???...---___" * 30, "ΑΣ ΣΑΣ. ΟΔΟΣ İstanbul ǅ", "<|endoftext|>a <|endoftext|> b<|startoftext|> <|ENDOFTEXT|>, <|endoftext|>.", "\x1c\x1d a\x1fb\x85c"]


def texts():
    rng = random.Random(1)
    make = lambda k, n: "".join(k(rng) for _ in range(rng.randint(1, n)))
    mixed = [make(lambda r: r.choice("abeinrst aA hello'1 9\n.,"), 60) for _ in range(800)]
    wild = [make(lambda r: chr(r.choice([r.randrange(32, 0x500), r.randrange(0x1F300, 0x1F700), r.randrange(0x4E00, 0x9FFF), r.randrange(0x2000, 0x2070)])), 20) for _ in range(400)]
    return MORE + mixed + wild


def test_automaton_is_the_tokenizer():
    own, library = automaton.byte_level(BYTES), Tokenizer.from_file(BYTES)
    for t in texts():
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<u4").tolist() == want
        assert own.decode(own.encode(t)) == library.decode(want, skip_special_tokens=False)


def test_gadgets_give_merge_order():
    """Small vocabularies against merging by rank."""
    rng = random.Random(4)
    for _ in range(40):
        labels, merges, made = [b"a", b"b", b"c"], [], {b"a", b"b", b"c"}
        while len(merges) < 12:
            a, b = rng.randrange(len(labels)), rng.randrange(len(labels))
            if labels[a] + labels[b] in made:
                continue
            merges.append((a, b, len(labels)))
            labels.append(labels[a] + labels[b])
            made.add(labels[-1])
        own = automaton.Automaton(labels, merges)
        for _ in range(60):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
            want = [b"abc".index(x) for x in word]
            for a, b, c in merges:
                i, out = 0, []
                while i < len(want):
                    if want[i : i + 2] == [a, b]:
                        out.append(c)
                        i += 2
                    else:
                        out.append(want[i])
                        i += 1
                want = out
            assert own.encode(word) == want


def test_round_trip(awkward, nothing):
    library = Tokenizer.from_file(BYTES)
    rows = {r["doc_id"]: r["text"] or "" for r in awkward.collect()}
    coded = automaton.encode(awkward, BYTES)
    for r in coded.collect():
        if r["id"] is not None:
            assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(rows[r["id"]], add_special_tokens=False).ids
    for r in automaton.decode(coded, BYTES).collect():
        assert r["id"] is None or r["text"] == rows[r["id"]]
    assert automaton.round_trip(awkward, BYTES).count() == awkward.count()
    assert automaton.encode(nothing, BYTES).count() == 0


def test_words_give_the_tokenizers_ids():
    own, library = packing.word_tokens(WORDS), Tokenizer.from_file(WORDS)
    for t in texts():
        assert np.frombuffer(own.encode([t.encode()])[0], own.kind).tolist() == library.encode(t, add_special_tokens=False).ids


def test_words_by_the_line():
    """Every printable Latin-1 character, alone, repeated and between letters; a word that changes its length is refused."""
    own, library = packing.WordTokens(WORDS), Tokenizer.from_file(WORDS)
    signs = [chr(c) for c in range(33, 256) if chr(c).isprintable()]
    rng = random.Random(3)
    words = [w for c in signs for w in (c, c * 7, f"a{c}b", f"{c}s", f"'{c}", f"{c}'ll")] + ["".join(rng.choices(signs, k=rng.randint(1, 12))) for _ in range(2000)]
    words = [w for w in words if "<|" not in w]
    want = [library.encode(w, add_special_tokens=False).ids for w in words]
    assert [np.frombuffer(x, own.kind).tolist() for x in own.by_line(words)] == want
    assert own.by_line([]) == []
    for odd in ("e\u0301", "\u0130x", "x\u00a0y"):
        assert own.by_line(["plain", odd, "words"]) is None
        got = own.apart(["plain", odd, "words"])
        assert [np.frombuffer(x, own.kind).tolist() for x in got] == [library.encode(w, add_special_tokens=False).ids for w in ("plain", odd, "words")]


def test_hilbert_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = packing.hilbert(grid, bits)
        assert sorted(key.tolist()) == list(range(1 << bits * dims))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("total", [0, 1, 2047, 2048, 2049, 5000, 4096])
def test_tail(total):
    sizes = np.diff(packing.tail_cuts(total, 2048))
    assert sum(sizes) == total % 2048 and all(s & s - 1 == 0 for s in sizes)


def test_pack(awkward, nothing):
    library = Tokenizer.from_file(WORDS)
    rows = awkward.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    want = {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in rows.collect()}
    pieces = sorted(packing.pack(rows, WORDS).collect(), key=lambda r: (r["id"], r["start"]))
    got = {}
    for r in pieces:
        own = got.setdefault(r["id"], [])
        assert r["start"] == len(own) and r["doc_tokens"] == len(want[r["id"]])
        own += np.frombuffer(r["ids"], "<u4").tolist()
        assert r["length"] * 4 == len(r["ids"]) and zlib.crc32(r["ids"]) >= 0
    assert got == want
    at = {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(at) == list(range(len(at))) and all(n == 2048 or n < 2048 and n & n - 1 == 0 for n in at.values())
    assert packing.pack(nothing, WORDS).count() == 0
    assert sum(r["length"] for r in packing.pack(awkward, WORDS).collect() if r["id"] is None) > 2


def test_distinct_words_of_a_slice_are_looked_up_once():
    """A slice's words are told apart in Arrow: what Python handles grows with the distinct ones, not with all."""
    from duotide.llm import packing
    from duotide.llm.catalog import tokenizer

    class Known(dict):
        asked = 0

        def __getitem__(self, word):
            Known.asked += 1
            return super().__getitem__(word)

    texts = [b"", b" \n", b"  Alpha beta,  beta\tGAMMA!\x0b", "ünï beta… <|end|> x...".encode(), b"beta " * 5000, b"\x1c\x85".decode("latin-1").encode(), b"alpha"]
    model = packing.WordTokens(tokenizer("word_bpe_49k.json"))
    want = [b"".join(np.array(model.tokenizer.encode(w.decode(), add_special_tokens=False).ids, model.kind).tobytes() for w in x.split()) for x in texts]
    model.known = Known()
    assert model.encode(texts) == want
    assert Known.asked < 100
    assert model.encode([]) == [] and model.encode([b"", b"   "]) == [b"", b""]
