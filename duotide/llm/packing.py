"""Packing along a space-filling curve.

Each document's hashed token counts are projected to a few dimensions, and the
Hilbert key of that point orders the documents: neighbours on the curve share
vocabulary. Laid end to end in that order, all tokens form one line, cut every
``length`` tokens, so no sequence but those of the tail is short; the tail is
cut at powers of two, which need no padding.

A document's place on the line is a prefix sum over small rows (key, id, length):
range partitions sum their own, and one number per partition reaches the driver.
Tokens move once, to meet their place.
"""

from __future__ import annotations

import json
import os
import sys
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duotide import scratch
from duotide.llm import text

#: Buckets of the hashed vector, dimensions of the curve, bits of each.
BUCKETS, DIMS, BITS = 256, 4, 15
#: Words whose tokens a worker remembers, some 200 bytes each, and the longest such word in bytes.
KEPT, LONGEST = 1_000_000, 64
MARKS = b",.;:!?"
#: New words that are tokenised as one line.
LINE = 128


def cells(strings: pa.LargeStringArray) -> list[bytes]:
    """Bytes of each string, none of them missing."""
    _, places, data = strings.buffers()
    if not len(strings) or data is None:
        return [b""] * len(strings)
    cuts, data = np.frombuffer(places, np.int64)[strings.offset :][: len(strings) + 1].tolist(), data.to_pybytes()
    return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class WordTokens:
    """A tokenizer that lower-cases and drops white space, applied word by word, each distinct word once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: How an id is stored between tasks.
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        if sys.byteorder != "little":
            raise RuntimeError("ids are written as the machine holds them, which must be little-endian")
        self.code = "H" if self.kind == "<u2" else "I"
        self.known: dict[bytes, bytes] = {}
        vocab, suffix = self.tokenizer.get_vocab(), json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix") or ""
        #: How many bytes of text each id stands for: a character of a token is a byte.
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, number in vocab.items():
            self.bytes_of[number] = len(token.removesuffix(suffix))

    def learn(self, words: set[bytes]) -> None:
        """Words as their tokens see them: in lower case, and the marks after a letter are tokens of their own."""
        known = self.known
        # special tokens are told apart by case; of others, only ASCII letters change here
        special = {w for w in words if b"<|" in w}
        plain = list(words - special)
        low = b" ".join(plain).lower().split(b" ") if plain else []
        cores, tails = [x.rstrip(MARKS) for x in low], {}
        for i in [i for i, (c, x) in enumerate(zip(cores, low, strict=True)) if c is not x]:
            if cores[i][-1:].isalnum():
                tails[i] = low[i][len(cores[i]) :]
            else:
                cores[i] = low[i]
        todo = list(special.union(cores, tails.values()).difference(known))
        known.update(zip(todo, self.apart([w.decode() for w in todo]), strict=True))
        known.update([(w, known[c]) for w, c in zip(plain, cores, strict=True) if w != c])
        known.update([(plain[i], known[cores[i]] + known[tail]) for i, tail in tails.items()])

    def apart(self, words: list[str]) -> list[bytes]:
        """Ids of each word. Words that keep their length in bytes are tokenised by the line and cut where their bytes end."""
        # printable Latin-1 is in composed form, has no white space, and changes no length in lower case
        whole = [(w.isascii() or max(w) < "\u0100") and w.isprintable() and "<|" not in w for w in words]
        lines = [w for w, ok in zip(words, whole, strict=True) if ok]
        cut = self.by_line(lines)
        if cut is None:
            whole, cut = [False] * len(words), []
        single = self.tokenizer.encode_batch_fast([w for w, ok in zip(words, whole, strict=True) if not ok], add_special_tokens=False)
        from_line, alone = iter(cut), (array(self.code, e.ids).tobytes() for e in single)
        return [next(from_line if ok else alone) for ok in whole]

    def by_line(self, words: list[str]) -> list[bytes] | None:
        """None if a word does not end where a token does."""
        lines = [" ".join(words[at : at + LINE]) for at in range(0, len(words), LINE)]
        ids = array(self.code)
        for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False):
            ids.extend(e.ids)
        ends = np.cumsum(self.bytes_of[np.frombuffer(ids, self.kind)]) if len(ids) else np.zeros(0, np.int64)
        stops = np.cumsum([len(w.encode()) for w in words], dtype=np.int64)
        at = np.searchsorted(ends, stops)
        if len(words) and (len(ends) == 0 or ends[-1] != stops[-1] or not np.array_equal(ends[at], stops)):
            return None
        data, cuts = ids.tobytes(), ((at + 1) * ids.itemsize).tolist()
        return [data[a:b] for a, b in zip([0, *cuts[:-1]], cuts)] if cuts else []

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, little-endian, in ``kind``."""
        known = self.known
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        every = split.flatten().dictionary_encode()
        distinct = cells(every.dictionary)
        words = set(distinct) - {b""}
        if len(known) + len(words) > KEPT:
            known.clear()
        self.learn(words.difference(known))
        got = [known[w] if w else w for w in distinct]  # a text that begins or ends with white space has empty words there
        for w in words:
            if len(w) > LONGEST:
                known.pop(w, None)
        ids = np.frombuffer(b"".join(got), self.kind)
        size = np.array([len(x) for x in got], np.int64) // ids.itemsize
        number = every.indices.to_numpy()
        sizes = size[number]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat((np.cumsum(size) - size)[number] - ends[:-1], sizes) + np.arange(ends[-1])
        data, cuts = ids[at].tobytes(), (ends[split.offsets.to_numpy()] * ids.itemsize).tolist()
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


@lru_cache(maxsize=1)
def _projection() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((BUCKETS, DIMS))


def points(ids: list[bytes], kind: str) -> np.ndarray:
    """Each document's cell on the grid of the curve; documents without tokens share one."""
    counts = np.zeros((len(ids), BUCKETS))
    for row, data in zip(counts, ids, strict=True):
        hashed = (np.frombuffer(data, kind).astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24)
        row += np.bincount(hashed, minlength=BUCKETS)[:BUCKETS]
    vectors = np.log1p(counts)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    unit = 0.5 + 0.5 * np.tanh(vectors @ _projection())
    return np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position of each integer point (rows) on the Hilbert curve through the grid.

    From the highest bit down, each cube's orientation is undone (reflect or swap
    the lower bits of the axes), then the axes are Gray-decoded and interleaved.
    """
    axes = [np.array(c, np.int64) for c in cells.T]
    dims = len(axes)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(dims):
            far = (axes[i] >> b & 1).astype(bool)
            swap = np.where(far, 0, (axes[0] ^ axes[i]) & low)
            axes[0] ^= np.where(far, low, swap)
            axes[i] ^= swap
    for i in range(1, dims):
        axes[i] ^= axes[i - 1]
    flip = np.zeros_like(axes[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(axes[-1] >> b & 1, (1 << b) - 1, 0)
    key = np.zeros_like(axes[0])
    for b in range(bits - 1, -1, -1):
        for a in axes:
            key = key << 1 | (a ^ flip) >> b & 1
    return key


def tokenised(df: DataFrame, path: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, key, n, ids)``: Hilbert key and tokens of each document, ``end`` last, as small as ids can be stored."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = word_tokens(path)
        last = np.array([end], model.kind).tobytes()
        ids = model.encode(text.raw(batch, "text"))
        key = hilbert(points(ids, model.kind))
        ids = [x + last for x in ids]
        return text.record(id=batch.column("id"), key=key, n=pa.array([len(x) // len(last) for x in ids], pa.int64()), ids=pa.array(ids, pa.binary()))

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return text.map_batches(rows, run, "id long, key long, n long, ids binary")


def tail_cuts(total: int, length: int) -> list[int]:
    """Where the sequences of the tail begin, and the end: powers of two, largest first."""
    at, cuts = total - total % length, []
    while at < total:
        cuts.append(at)
        at += 1 << (total - at).bit_length() - 1
    return [*cuts, total]


def places(rows: DataFrame) -> tuple[DataFrame, int]:
    """``(uid, at)``, the first position of each row on the line, and the line's length."""
    spark = rows.sparkSession
    order = ["key", "id", "uid"]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.select("uid", "id", "key", "n").repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id())
    laid = scratch.materialise(laid, "curve")
    totals = {r["range"]: r["n"] for r in laid.groupBy("range").agg(F.sum("n").alias("n")).collect()}
    before, total = [], 0
    for r in sorted(totals):
        before.append((r, total))
        total += totals[r]
    starts = F.broadcast(spark.createDataFrame(before, "range int, base long"))  # one row a range
    running = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    laid = laid.withColumn("own", F.coalesce(F.sum("n").over(running), F.lit(0)))
    return laid.join(starts, "range").select("uid", (F.col("base") + F.col("own")).alias("at")), total


def pack(df: DataFrame, path: str, length: int = 2048, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces ``(id, start, length, ids, doc_tokens, sequence_id, offset)``; each token lies in exactly one.

    ``ids`` are little-endian unsigned 32-bit integers. A null or empty text is the
    end token alone. Repeated ids are separate documents; a null id is passed through.
    Documents with one key are ordered by id. No rows: no rows.
    """
    rows = scratch.materialise(tokenised(df, path, end, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()), "tokens")
    where, total = places(rows)
    full, cuts = total // length, np.array(tail_cuts(total, length))
    size = length

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc, at, n, ids in zip(*(batch.column(c).to_pylist() for c in ("id", "at", "n", "ids")), strict=True):
            done, wide = 0, np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes()
            while done < n:
                here = at + done
                if here < full * size:
                    sequence, begin, stop = here // size, here // size * size, (here // size + 1) * size
                else:
                    k = int(np.searchsorted(cuts, here, side="right")) - 1
                    sequence, begin, stop = full + k, int(cuts[k]), int(cuts[k + 1])
                take = min(n - done, stop - here)
                out.append((doc, done, take, wide[4 * done : 4 * (done + take)], n, sequence, here - begin))
                done += take
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        names = ("id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
        return text.record(**{name: pa.array(c, kind) for name, kind, c in zip(names, kinds, zip(*out, strict=True), strict=True)})

    met = rows.select("uid", "id", "n", "ids").join(where.hint("shuffle_merge"), "uid").select("id", "at", "n", "ids")
    return text.map_batches(met, run, "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
