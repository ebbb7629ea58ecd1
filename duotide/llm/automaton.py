"""Byte-pair encoding by a deterministic automaton over tokens.

The automaton accepts exactly the token sequences that byte-pair merging gives.
It starts as one state with a loop for every byte. The merges, in order, each add
one gadget: for ``a b -> c``, every state with an arc ``a`` whose end has an arc
``b`` gets an arc ``c`` to where ``b`` led, and all arcs ``a`` are led to a copy
of their end that lacks ``b``. Copies share what they did not change, so the
compiled form is a handful of integer arrays, one entry per state or token, not
states x tokens cells; :meth:`Automaton.has_arc` reads an arc from them.

Every state accepts and a text has one accepted sequence, so a path over the whole
word is the encoding. It is found by table look-ups, the longest label first;
decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duotide.llm import text

#: Characters that count as white space when words are split (fixed values).
WHITE = "\t-\r \x85\xa0  -     　"
#: A run without white space with a space before it, or white space; the last of a run of
#: white space stands alone unless the text ends. No word reaches over such a piece.
#: Latin words and the marks after them, the usual case, come apart here, so that "word" and "word," share an entry.
LATIN, MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", ",.;:!?"
PIECE = re.compile(f" ?[{LATIN}]+(?=[{MARKS}]*(?:[{WHITE}]|\\Z))| ?[{MARKS}]+(?=[{WHITE}]|\\Z)| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Split of a piece into words (fixed value, the byte-level pattern).
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries a worker keeps of arcs and of pieces, some 250 bytes each; bounds its memory.
KEPT, KEPT_PIECES = 300_000, 800_000


def byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Automaton:
    """Compiled from labels (bytes of each token) and merges (left, right, result), in order."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]]):
        n = len(labels)
        self.labels = labels
        self.left = np.full(n, -1, np.int32)  # first part of a merged token
        self.born = np.full(n, -2, np.int32)  # merge that adds its arcs; -1: a byte, -2: never
        self.target = np.zeros(n, np.int32)  # state that arcs with this label lead to
        self.parent, self.lacks = [-1], [-1]  # of each state: copied from, without this arc
        self.made = [-1]  # merge at which it was copied
        self.arcs: dict[int, bool] = {}
        for token, label in enumerate(labels):
            if len(label) == 1:
                self.born[token] = -1
        for at, (a, b, c) in enumerate(merges):
            self.gadget(at, a, b, c)
        self.arcs.clear()
        #: Arc by its label; -1 for bytes that only begin one.
        self.begins: dict[bytes, int] = {}
        for token, label in enumerate(labels):
            if self.born[token] >= -1:
                for k in range(1, len(label)):
                    self.begins.setdefault(label[:k], -1)
                if self.begins.get(label, -1) < 0:
                    self.begins[label] = token
        self.left, self.born, self.target = self.left.tolist(), self.born.tolist(), self.target.tolist()

    def gadget(self, at: int, a: int, b: int, c: int) -> None:
        if self.born[a] < -1 or self.born[b] < -1 or not self.has_arc(int(self.target[a]), b):
            return  # no sequence ever has a b: the merge never applies
        ends = int(self.target[b])  # where b leads before the copy
        self.parent.append(int(self.target[a]))
        self.lacks.append(b)
        self.made.append(at)
        self.target[a] = len(self.parent) - 1
        if self.born[c] < -1:
            self.left[c], self.born[c], self.target[c] = a, at, ends

    def has_arc(self, state: int, token: int) -> bool:
        key = state * len(self.labels) + token
        known = self.arcs.get(key)
        if known is None:
            known = self._arc(state, token)
            if len(self.arcs) > KEPT:
                self.arcs.clear()
            self.arcs[key] = known
        return known

    def _arc(self, state: int, token: int) -> bool:
        """An arc was there when its state was copied, or was added with its token, next to an arc for the token's first part."""
        while True:
            if state and self.made[state] > self.born[token]:
                if self.lacks[state] == token:
                    return False
                state = self.parent[state]
            elif self.born[token] == -1:
                return True
            elif self.born[token] < -1:
                return False
            else:
                token = int(self.left[token])

    def encode(self, word: bytes) -> list[int]:
        """Tokens of one word: the labels of the one path that the automaton has for it.

        The longest label is tried first. An arc that led to a dead end is not
        tried again, so the steps are at most positions times labels per position.
        """
        n, begins, target, size, arcs = len(word), self.begins, self.target, len(self.labels), self.arcs
        path: list[int] = []
        todo: list[list[int]] = []
        at, state, dead = 0, 0, None
        while at < n:
            found, end = [], at + 1
            while end <= n and (token := begins.get(word[at:end])) is not None:
                if token >= 0:
                    found.append(token)
                end += 1
            while True:
                while found:
                    token = found.pop()
                    there = arcs.get(state * size + token)
                    if (self.has_arc(state, token) if there is None else there) and not (dead and (at, token) in dead):
                        break
                else:
                    if not path:
                        raise ValueError(f"the vocabulary has no tokens for {word[:60]!r}")
                    token, found = path.pop(), todo.pop()
                    at -= len(self.labels[token])
                    dead = dead or set()
                    dead.add((at, token))
                    state = target[path[-1]] if path else 0
                    continue
                break
            path.append(token)
            todo.append(found)
            at += len(self.labels[token])
            state = target[token]
        return path


class ByteLevel:
    """A byte-level vocabulary file as an automaton, with its word split and special tokens."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte = spec["model"], byte_of_symbol()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*model["vocab"].values(), *special.values()]) + 1
        labels = [b""] * size
        for symbol, token in model["vocab"].items():
            labels[token] = bytes(map(byte.__getitem__, symbol))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab = model["vocab"]
        self.automaton = Automaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.labels = list(labels)
        for content, token in special.items():
            self.labels[token] = content.encode()
        self.special = {k: np.array([v], "<u4").tobytes() for k, v in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.words = regex.compile(WORD)
        self.pieces: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        encode = self.automaton.encode
        ids = [t for word in self.words.findall(piece) for t in encode(word.encode())]
        out = np.array(ids, "<u4").tobytes()
        if len(piece) <= 64:
            if len(self.pieces) >= KEPT_PIECES:
                self.pieces.clear()
            self.pieces[piece] = out
        return out

    def encode(self, data: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, piece = self.pieces.get, self.piece
        if self.cut is None or not any(s in data for s in self.special):
            return b"".join([known(p) or piece(p) for p in PIECE.findall(data)])
        return b"".join([self.special[part] if part in self.special else b"".join([known(p) or piece(p) for p in PIECE.findall(part)]) for part in self.cut.split(data)])

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, one after another; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def byte_level(path: str) -> ByteLevel:
    """One automaton per file and worker."""
    return ByteLevel(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)``: the tokens of each whole text as little-endian 32-bit integers.

    ``path`` must be readable on every executor. A null or empty text has no
    tokens. Strings of special tokens become their ids. Repeated rows and null
    ids stay. No rows: no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = byte_level(path)
        return text.record(id=batch.column("id"), ids=pa.array([model.encode(x) for x in text.strings(batch, "text")], pa.binary()))

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return text.map_batches(rows, run, "id long, ids binary")


def decode(df: DataFrame, path: str) -> DataFrame:
    """``(id, ids) -> (id, text)``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = byte_level(path)
        return text.record(id=batch.column("id"), text=pa.array([model.decode(x or b"") for x in batch.column("ids").to_pylist()], pa.string()))

    return text.map_batches(df.select("id", "ids"), run, "id long, text string")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: encoded and decoded in one pass, without moving the ids."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, out = byte_level(path), []
        for x in text.strings(batch, "text"):
            ids = model.encode(x)
            out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
        return text.record(id=batch.column("id"), **dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), zip(*out, strict=True), strict=True)))

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return text.map_batches(rows, run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
