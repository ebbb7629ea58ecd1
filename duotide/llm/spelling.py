"""Spelling variants: words one edit apart, found by search schemes over a bidirectional FM-index.

A word with one error in it has one half without error. So each half of a word is
matched exactly, and from there the search goes across the other half and lets one
error happen. The index holds the shard's words between delimiters and, for every
pattern, its interval of suffix ranks in the text and in the reversed text, so it can
be extended on either side. Ranks come from wavelet matrices, for thousands of
patterns at once.

Words are dealt over shards by what their partners must share, the first or the last
half of the partner, so a word meets only shards that can hold words near it. A half
that very many words share gets a grid of shards of its own: blocks of its words
against blocks of the words looked for. Shards return counts and best partners, never
pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duotide import scratch
from duotide.llm import text

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: One in so many (document, run) pairs loses a letter; shortest word; occurrences of a word.
SLIPS, MIN_CHARS, MIN_COUNT = 97, 5, 3
#: Words of a shard, words looked for together, counted words that a task holds.
SHARD_WORDS, TOGETHER, HELD = 50_000, 4_000, 200_000


def count_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n``: words with their occurrences over all texts; tasks hold a bounded number of counters and merge them before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = defaultdict(int)

        def flush() -> pa.RecordBatch:
            out = text.record(word=pa.array(held.keys(), pa.string()), n=pa.array(held.values(), pa.int64()))
            held.clear()
            return out

        for batch in batches:
            for key, body in zip(batch.column("id").to_pylist(), text.strings(batch, "text"), strict=True):
                own: dict[str, int] = defaultdict(int)
                for run_, n in Counter(RUN.findall(body)).items():
                    own[run_.lower() if run_.isascii() else run_.translate(LOWER)] += n
                start = zlib.crc32(f"{'' if key is None else key}:".encode())
                for token, n in own.items():
                    h = zlib.crc32(token.encode(), start)
                    if h % SLIPS == 0:
                        at = h % len(token)
                        token = token[:at] + token[at + 1 :]  # noqa: PLW2901
                    if len(token) >= min_chars:
                        held[token] += n
                if len(held) >= HELD:
                    yield flush()
        if held:
            yield flush()

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= min_count)


class Wavelet:
    """Ranks of symbols in a sequence: how often each occurs before a place, and how many smaller ones."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.bits, self.n = max(int(size - 1).bit_length(), 1), len(symbols)
        self.zeros, self.ones, s = [], [], symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (s >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(s) - bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])
        # after the last level symbols stand in the order of their reversed bits; where the run of each begins
        self.first = np.searchsorted(reverse_bits(s, self.bits), np.arange(1 << self.bits))

    def narrow(self, lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For one symbol a row: its rank at both ends, and the smaller symbols between them."""
        less = np.zeros(len(lo), np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            a, b = ones[lo], ones[hi]
            up = (c >> (self.bits - 1 - k)) & 1 == 1
            less += np.where(up, (hi - lo) - (b - a), 0)
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + b, hi - b)
        at = self.first[reverse_bits(c, self.bits)]
        return lo - at, hi - at, less

    def branch(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
        """Every symbol between ``lo`` and ``hi`` of each row: (row, symbol, ranks at both ends, smaller symbols between them)."""
        row, c, less = np.arange(len(lo)), np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            a, b = ones[lo], ones[hi]
            below = (hi - lo) - (b - a)
            down, up = below > 0, b > a
            row = np.concatenate([row[down], row[up]])
            less = np.concatenate([less[down], (less + below)[up]])
            c = np.concatenate([2 * c[down], 2 * c[up] + 1])
            lo, hi = np.concatenate([(lo - a)[down], zeros + a[up]]), np.concatenate([(hi - b)[down], zeros + b[up]])
        at = self.first[reverse_bits(c, self.bits)]
        return row, c, lo - at, hi - at, less


def reverse_bits(c: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros_like(c)
    for k in range(bits):
        out |= ((c >> k) & 1) << (bits - 1 - k)
    return out


def rank_rotations(t: np.ndarray, depth: int, size: int) -> np.ndarray:
    """Starts of the rotations of ``t`` in the order of their first ``depth`` symbols, by doubling."""
    bits = max(int(size - 1).bit_length(), 1)
    known = max(1, 62 // bits)
    key = np.zeros(len(t), np.int64)
    for k in range(known):
        key = key << bits | np.roll(t, -k)
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(t), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if known >= depth or rank[order[-1]] == len(t) - 1:
            return order
        key = rank * len(t) + np.roll(rank, -known)
        known *= 2


class Index:
    """A bidirectional FM-index over words, each between delimiters (symbol 0).

    A state of the search is (lo, other, width): where the pattern's rotations begin
    among those of the text and of the reversed text, and how many there are.
    """

    def __init__(self, words: list[str]):
        joined = "\0".join(words) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        self.letters, t = np.unique(points, return_inverse=True)
        self.size, self.words = len(self.letters), words
        depth = max(map(len, words), default=0) + 2
        ends = np.flatnonzero(t == 0)
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=self.size))])
        order = rank_rotations(t, depth, self.size)
        #: word that begins after the delimiter at which a rotation starts
        self.word_at = (np.searchsorted(ends, order) + 1) % max(len(words), 1)
        self.left = Wavelet(t[order - 1], self.size)
        back = t[::-1].copy()
        order = rank_rotations(back, depth, self.size)
        self.right = Wavelet(back[order - 1], self.size)

    def codes(self, word: str) -> np.ndarray:
        """Symbols of a word; letters that no word of the index has get a symbol that never matches (-1)."""
        points = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.letters, points), self.size - 1)
        return np.where(self.letters[at] == points, at, -1)

    def extend(self, wavelet: Wavelet, lo: np.ndarray, other: np.ndarray, width: np.ndarray, c: np.ndarray):
        """Put one symbol before (``left``) or behind (``right``) each pattern; ``lo`` is on the side of ``wavelet``."""
        a, b, less = wavelet.narrow(lo, lo + width, np.maximum(c, 0))
        return self.counts[np.maximum(c, 0)] + a, other + less, np.where(c < 0, 0, b - a)

    def near(self, patterns: list[str], forward: bool) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, word) numbers: words one edit away that share the first half (``forward``) or the last half of the pattern.

        The half is matched from the middle outwards, up to its delimiter; then the
        search turns round and crosses the other half. A letter is left out only at
        the end of a run of equal ones, and none is put in before its equal, so every
        partner is found once.
        """
        if not patterns or not self.words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        first, second = (self.left, self.right) if forward else (self.right, self.left)
        halves, rests = [], []
        for p in patterns:
            c = self.codes(p)
            h = half(len(c), forward)
            halves.append(np.concatenate([c[:h][::-1], [0]]) if forward else np.concatenate([c[len(c) - h :], [0]]))
            rests.append(np.concatenate([c[h:], [0]]) if forward else np.concatenate([c[: len(c) - h][::-1], [0]]))
        own, start, length = flat(halves)
        k = len(patterns)
        lo, other, width = np.zeros(k, np.int64), np.zeros(k, np.int64), np.full(k, self.left.n)
        for s in range(int(length.max())):
            on = np.flatnonzero((s < length) & (width > 0))
            lo[on], other[on], width[on] = self.extend(first, lo[on], other[on], width[on], own[start[on] + s])
        rest, start, length = flat(rests)
        alive = np.flatnonzero(width > 0)
        # the turn: from here the other text's ranks lead
        clean = (alive, np.zeros(len(alive), np.int64), other[alive], lo[alive], width[alive])
        erred = tuple(np.empty(0, np.int64) for _ in range(5))
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        while len(clean[0]) or len(erred[0]):
            after: list[tuple[np.ndarray, ...]] = []
            if len(erred[0]):
                q, j, a, b, w = erred
                a, b, w = self.extend(second, a, b, w, rest[start[q] + j])
                after.append((q, j + 1, a, b, w))
            if len(clean[0]):
                q, j, a, b, w = clean
                want, then = rest[start[q] + j], rest[start[q] + np.minimum(j + 1, length[q] - 1)]
                gone = (want != 0) & (want != then)
                after.append(tuple(x[gone] for x in (q, j + 1, a, b, w)))
                row, c, r0, r1, less = second.branch(a, a + w)
                q, j, a, b, w, want = q[row], j[row], self.counts[c] + r0, b[row] + less, r1 - r0, want[row]
                wrong = (c != want) & (c != 0)
                swap = wrong & (want != 0)
                after.append((q[swap], j[swap] + 1, a[swap], b[swap], w[swap]))
                after.append((q[wrong], j[wrong], a[wrong], b[wrong], w[wrong]))
                same = (c == want) & (c != 0)
                clean = (q[same], j[same] + 1, a[same], b[same], w[same])
            erred = tuple(np.concatenate(x) for x in zip(*after, strict=True))
            erred = tuple(x[erred[4] > 0] for x in erred)
            done = erred[1] == length[erred[0]]
            # ranks in the text tell the word: the pattern begins there with its delimiter
            at = erred[3] if forward else erred[2]
            hits.append((erred[0][done], self.word_at[at[done]]))
            erred = tuple(x[~done] for x in erred)
        return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows end to end, with start and length of each."""
    length = np.array([len(r) for r in rows])
    return np.concatenate(rows), np.cumsum(length) - length, length


NONE_NEAR = pd.DataFrame({"word": pd.Series([], dtype=object), "n_near": pd.Series([], dtype="int64"), "form": pd.Series([], dtype=object), "form_n": pd.Series([], dtype="int64")})


def half(length: int, forward: bool) -> int:
    """Letters in the first half of a word, or in the rest of it."""
    return length // 2 if forward else length - length // 2


def partners(words: list[str], counts: np.ndarray, patterns: list[str], forward: np.ndarray) -> pd.DataFrame:
    """``word, n_near, form, form_n``: of each pattern the words near it in this shard and the best of them.

    Searches backward leave out what the one forward finds, so no partner counts twice.
    """
    index, seen = Index(words), []
    for way in (True, False):
        these = np.flatnonzero(forward == way)
        for lo in range(0, len(these), TOGETHER):
            block = [patterns[i] for i in these[lo : lo + TOGETHER]]
            q, w = index.near(block, way)
            if not way:
                keep = [not words[b].startswith(block[a][: half(len(block[a]), True)]) for a, b in zip(q, w, strict=True)]
                q, w = q[keep], w[keep]
            seen.append(pd.DataFrame({"word": [block[i] for i in q], "form": [words[i] for i in w], "form_n": counts[w]}))
    pairs = pd.concat([NONE_NEAR[["word", "form", "form_n"]], *seen])
    best = pairs.sort_values(["form_n", "form"], ascending=[False, True], kind="stable").groupby("word", sort=False)
    out = best.agg(n_near=("form", "size"), form=("form", "first"), form_n=("form_n", "first")).reset_index()
    return out[["word", "n_near", "form", "form_n"]].astype({"n_near": "int64", "form_n": "int64"})


def near_words(vocabulary: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``word, n_near, form, form_n`` of every word of ``vocabulary(word, n)``, distinct words, that has a near one."""
    size = F.length("word")

    def cut(chars: Column, forward: bool) -> Column:
        return F.substring("word", F.lit(1), chars) if forward else F.substring("word", size - chars + 1, chars)

    def sides(lengths: list[Column]) -> Column:
        """(forward, half) of partners with one of ``lengths``."""
        heads = [F.struct(F.lit(True).alias("forward"), cut(F.floor(n / 2).cast("int"), True).alias("half")) for n in lengths]
        tails = [F.struct(F.lit(False).alias("forward"), cut((n - F.floor(n / 2)).cast("int"), False).alias("half")) for n in lengths]
        return F.inline(F.array_distinct(F.array(*heads, *tails)))

    targets = vocabulary.select("word", "n", sides([size - 1, size, size + 1]))
    patterns = vocabulary.select("word", sides([size]))
    held = targets.groupBy("forward", "half").agg(F.count("*").alias("held"))
    held = scratch.materialise(held, "halves")
    total = held.agg(F.sum("held")).first()[0] or 0
    cores = vocabulary.sparkSession.sparkContext.defaultParallelism
    shards = max(4 * cores, -(-total // shard_words))
    # at most total / shard_words halves are hot, however large the vocabulary
    hot = F.broadcast(held.where(F.col("held") > shard_words).select("forward", "half", F.ceil(F.col("held") / shard_words).cast("int").alias("blocks")))

    def dealt(df: DataFrame, own: Column, others: Column) -> DataFrame:
        """Rows with shard and, of a hot half, the cells of its grid: blocks of words by blocks of patterns."""
        block = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
        df = df.join(hot, ["forward", "half"], "left").withColumns({"hot": F.col("blocks").isNotNull(), "block": F.coalesce(block, F.lit(0))})
        df = df.withColumn("other", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))))
        shard = F.pmod(F.xxhash64("forward", "half"), F.lit(shards))
        key = F.when(F.col("hot"), F.concat_ws("|", F.col("forward").cast("string"), "half", own.cast("string"), others.cast("string")))
        return df.withColumn("shard", F.coalesce(key, shard.cast("string")))

    stored = dealt(targets, F.col("block"), F.col("other")).select("shard", F.col("word").alias("theirs"), "n").distinct()
    asked = dealt(patterns, F.col("other"), F.col("block")).select("shard", F.col("word").alias("ours"), "forward")

    def search(theirs: pd.DataFrame, ours: pd.DataFrame) -> pd.DataFrame:
        if not len(theirs) or not len(ours):
            return NONE_NEAR
        return partners(theirs["theirs"].tolist(), theirs["n"].to_numpy(), ours["ours"].tolist(), ours["forward"].to_numpy())

    found = stored.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(search, "word string, n_near long, form string, form_n long")
    # most occurrences first, then the smallest word
    best = F.max_by(F.struct("form", "form_n"), F.struct("form_n", F.col("turned")))
    found = found.withColumn("turned", falling(F.col("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.*")


def falling(word: Column) -> Column:
    """A key whose order is the reverse of the words'."""
    hexed = F.concat(F.hex(F.encode(word, "UTF-8")), F.lit("~"))
    return F.translate(hexed, "0123456789ABCDEF~", "FEDCBA9876543210~")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every word of ``forms(word, form)``, following forms to the last by doubling.

    A form has at least twice the occurrences of its word, so chains are shorter than
    64 words and six doublings reach their ends; the driver sees one number a round.
    """
    rows = scratch.materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = rows.select(F.col("word").alias("root"), F.col("root").alias("next"))
        far = rows.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        far = scratch.materialise(far, "roots")
        rows = far.drop("moved")
        if far.where("moved").isEmpty():
            return rows


def variants(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_count: int = MIN_COUNT,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    Words are runs of letters with A-Z lower-cased, some with a letter lost (see
    ``SLIPS``), that occur often enough over all texts. ``form`` is the near word with
    most occurrences, the smallest of ties, if it has at least twice the word's own;
    ``root`` the end of the chain of forms. Null and empty texts have no words; an id
    that is null counts as empty text; repeated rows count as often as they come. Very
    long texts and words are taken whole. Other columns are ignored, whatever their
    names. No words: no rows.
    """
    vocabulary = scratch.materialise(count_words(df, id_col, text_col, min_chars, min_count), "vocabulary")
    near = vocabulary.join(near_words(vocabulary, shard_words), "word", "left")
    better = F.col("form_n") >= 2 * F.col("n")
    table = near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(better, F.col("form")).alias("form"), F.when(better, F.col("form_n")).alias("form_n"))
    table = scratch.materialise(table, "forms")
    ends = roots(table.where("form IS NOT NULL"))
    return table.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
