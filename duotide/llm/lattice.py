"""Document probability over all segmentations into subwords.

The pieces are those of an existing vocabulary; their unigram scores come from
counting how that vocabulary's own segmentation cuts the training words. A word's
probability is the sum over all its segmentations, by the forward recursion in log
space; a document's is the product over its words and its end.

Words are counted once for the whole corpus, and each distinct word goes through
the lattice once. Scoring sends the most frequent words (a bounded number) to
every task; only the rest of a document's words is joined, so frequent words never
meet in one task. Both add up to the same sums.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duotide import scratch
from duotide.llm import text

#: Stands for the end of a text; no word contains a space.
END = " "
#: Words sent to every task, and distinct words a task counts before it passes them on.
HEAD, HELD = 100_000, 400_000
LOG10 = math.log(10)


@lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def word_counts(df: DataFrame) -> DataFrame:
    """``(data, held_out) -> (word, c, all)``: in training texts and in all, the end of a text being one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = (Counter(), Counter())

        def counted() -> pa.RecordBatch:
            words = list(both[0] | both[1])
            c, held = ([n[w] for w in words] for n in both)
            out = text.record(word=pa.array([w.decode() for w in words], pa.string()), c=pa.array(c, pa.int64()), all=pa.array([x + y for x, y in zip(c, held, strict=True)], pa.int64()))
            for n in both:
                n.clear()
            return out

        for batch in batches:
            for data, held in zip(text.raw(batch, "text"), batch.column("held_out").to_pylist(), strict=True):
                words = data.lower().split()
                words.append(END.encode())
                both[held].update(words)
                if len(both[0]) + len(both[1]) > HELD:
                    yield counted()
        if both[0] or both[1]:
            yield counted()

    return df.mapInArrow(run, "word string, c long, all long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("all").alias("all"))


def piece_counts(words: DataFrame, path: str) -> DataFrame:
    """``(word, c) -> (piece, n)`` by the vocabulary's own segmentation, summed per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[int] = Counter()
        for batch in batches:
            cut = processor(path).encode(batch.column("word").to_pylist(), num_threads=1)
            for ids, c in zip(cut, batch.column("c").to_pylist(), strict=True):
                for i in ids:
                    n[i] += c
        yield text.record(piece=pa.array(list(n), pa.int32()), n=pa.array(list(n.values()), pa.int64()))

    return words.mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))


class Lattice:
    """Unigram scores of an existing vocabulary; every character also has its bytes, so no word is impossible."""

    def __init__(self, path: str, counts: dict[int, int], ends: int):
        sp = processor(path)
        size = sp.get_piece_size()
        total = math.log(sum(counts.values()) + ends + size + 1)
        score = lambda i: math.log(counts.get(i, 0) + 1) - total
        self.end = math.log(ends + 1) - total
        self.byte = [0.0] * 256
        #: Score of each piece; None for text that only begins one.
        self.arcs: dict[str, float | None] = {}
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = score(i)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                for k in range(1, len(piece)):
                    self.arcs.setdefault(piece[:k], None)
                self.arcs[piece] = score(i)

    def marginal(self, word: str) -> float:
        """Natural logarithm of the probability of a word, summed over its segmentations."""
        s = "▁" + word
        n, arcs, byte, exp, log = len(s), self.arcs, self.byte, math.exp, math.log
        into: list[list[float]] = [[] for _ in range(n + 1)]
        into[0].append(0.0)
        for i in range(n):
            came = into[i]
            here = came[0]
            if len(came) > 1:
                here = max(came)
                here += log(sum([exp(x - here) for x in came]))
            into[i] = []
            into[i + 1].append(here + sum([byte[b] for b in s[i].encode()]))
            for j in range(i + 1, n + 1):
                score = arcs.get(s[i:j], 1.0)
                if score is None:
                    continue
                if score == 1.0:  # begins no piece; scores are below zero
                    break
                into[j].append(here + score)
        most = max(into[n])
        return most + log(sum([exp(x - most) for x in into[n]]))


def score(df: DataFrame, held_out: str, path: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)``; scores are log10 probabilities.

    ``held_out`` names a boolean column; such rows are scored but not learnt from.
    A null or empty text is its end alone. Rows with repeated or null ids are
    scored apart. Without training rows every word counts as unseen. No rows: no rows.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(held_out), F.lit(False)).alias("held_out"))
    words = scratch.materialise(word_counts(rows.select("text", "held_out")), "words")
    total = words.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v"), F.sum(F.when(F.col("word") == END, F.col("c"))).alias("ends")).first()
    n, v, ends = total["n"] or 0, total["v"], total["ends"] or 0
    pieces = {r["piece"]: r["n"] for r in piece_counts(words.where((F.col("c") > 0) & (F.col("word") != END)).select("word", "c"), path).collect()}
    norm = math.log10(n + v + 1)
    lattices: list[Lattice] = []

    def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not lattices:
            lattices.append(Lattice(path, pieces, ends))
        lattice = lattices[0]
        own = [(lattice.end if w == END else lattice.marginal(w)) / LOG10 for w in batch.column("word").to_pylist()]
        c = batch.column("c")
        base = [math.log10(x + 1) - norm for x in c.to_pylist()]
        return text.record(word=batch.column("word"), all=batch.column("all"), known=pa.array([int(x > 0) for x in c.to_pylist()], pa.int32()), base=base, lm=own)

    weighed = scratch.materialise(text.map_batches(words, weigh, "word string, all long, known int, base double, lm double"), "weighed")
    top = weighed.orderBy(F.col("all").desc(), "word").limit(head).drop("all").collect()  # bounded by ``head``
    shared = spark.sparkContext.broadcast({r["word"].encode(): (r["known"], r["base"], r["lm"]) for r in top})

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        find, out = shared.value.get, []
        for data in text.raw(batch, "text"):
            tokens = data.lower().split()
            tokens.append(END.encode())
            known = base = lm = 0
            rest = []
            for w, k in Counter(tokens).items():
                if (got := find(w)) is None:
                    rest.append({"word": w.decode(), "k": k})
                else:
                    known += k * got[0]
                    base += k * got[1]
                    lm += k * got[2]
            out.append((len(tokens), known, float(base), float(lm), rest))
        n_tokens, known, base, lm, rest = zip(*out, strict=True)
        kind = pa.list_(pa.struct([("word", pa.string()), ("k", pa.int64())]))
        return text.record(id=batch.column("id"), held_out=batch.column("held_out"), n_tokens=n_tokens, known=pa.array(known, pa.int64()), base=base, lm=lm, rest=pa.array(rest, kind))

    added = text.map_batches(rows, add, "id long, held_out boolean, n_tokens long, known long, base double, lm double, rest array<struct<word:string,k:long>>")
    added = scratch.materialise(added.withColumn("uid", F.monotonically_increasing_id()), "scored")
    tail = added.select("uid", F.inline("rest")).join(weighed.select("word", "known", "base", "lm"), "word")
    k = F.col("k")
    tail = tail.groupBy("uid").agg(F.sum(k * F.col("known")).alias("known_"), F.sum(k * F.col("base")).alias("base_"), F.sum(k * F.col("lm")).alias("lm_"))
    both = lambda c: F.col(c) + F.coalesce(F.col(f"{c}_"), F.lit(0))
    return added.drop("rest").join(tail, "uid", "left").select("id", "held_out", "n_tokens", both("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), both("base").alias("base_score"), both("lm").alias("score"))
