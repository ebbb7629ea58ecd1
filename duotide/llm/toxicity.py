"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

A bounded sample of labelled texts is the memory. Every word of every example is a
term. Words and word beginnings (so that inflected forms share one) that occur with
the label more often than chance allows are marks: terms once more, beside the word
itself, so that texts with the label's words are nearer to each other.

The examples lie in an inverted index in blocks: each term keeps the largest weight
it has in a block, so a query bounds every block's best cosine, visits blocks from
the highest bound down and leaves out those whose bound does not reach the k-th
best. That loses nothing. Queries are bounded and visit blocks together: terms that
many examples have are one matrix product, the others add up their postings. What
comes near the k-th best is computed again in double precision.

The neighbours vote with a weight that falls with distance. A monotone map from
vote to observed share, fitted on the examples with each left out in turn, makes the
vote a probability. Texts that share no word with an example have the share seen
among such examples, with one case of the common share added.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duotide.llm import text

#: Labelled rows that are learnt from at most, and marks that are kept at most, the best ones.
EXAMPLES, TERMS = 20_000, 20_000
#: Beginnings of these lengths may be marks; a mark needs as many positive examples and standard deviations.
BEGINNINGS, LEAST, SIGMAS = (4, 5, 6), 4, 5.0
NEIGHBOURS, BLOCK, EVIDENCE = 25, 64, 3
#: Kinds that examples are told apart by, and examples that are told apart at once.
KINDS, CHUNK = 8, 1024
#: Queries that meet the index together, neighbouring blocks visited at once, share of the examples from which on a term is in the matrix.
TOGETHER, VISIT, COMMON = 256, 32, 1 / 24
#: Words whose terms a worker remembers.
KEPT = 300_000

WORD = re.compile(r"\w+")
#: Word characters beyond Latin-1; of Latin-1, the others as blanks.
BEYOND, BLANKS = re.compile(r"[^\W\x00-\xff]"), bytes(i if WORD.match(chr(i)) else 32 for i in range(256))


def words_of(data: str) -> list[str]:
    """What ``WORD`` finds in the lower-cased text. Without word characters beyond Latin-1, as bytes, which is faster."""
    low = data.lower()
    try:
        cut = low.encode("latin-1")
    except UnicodeEncodeError:
        if BEYOND.search(low):
            return WORD.findall(low)
        cut = low.encode("latin-1", "replace")
    return cut.translate(BLANKS).decode("latin-1").split()


def terms_of(word: str) -> list[str]:
    return [word, *[f"{word[:k]}*" for k in BEGINNINGS if len(word) > k]]


def learnt_terms(examples: DataFrame, positive: int, total: int, limit: int = TERMS) -> dict[str, tuple[int, float]]:
    """``(text, label) -> {term: (number, idf)}``: over-represented with the label, counted once a text."""
    if not positive or positive == total:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, pos = Counter(), Counter()
        for batch in batches:
            for data, label in zip(text.strings(batch, "text"), batch.column("label").to_pylist(), strict=True):
                found = {t for w in set(words_of(data)) for t in terms_of(w)}
                df.update(found)
                if label:
                    pos.update(found)
        yield text.record(term=pa.array(list(df), pa.string()), df=pa.array(list(df.values()), pa.int64()), pos=pa.array([pos[t] for t in df], pa.int64()))

    share = positive / total
    counts = examples.select("text", "label").mapInArrow(run, "term string, df long, pos long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("pos").alias("pos"))
    sigmas = (F.col("pos") - share * F.col("df")) / F.sqrt(share * (1 - share) * F.col("df"))
    best = counts.where((F.col("pos") >= LEAST) & (2 * F.col("pos") >= F.col("df"))).withColumn("sigmas", sigmas).where(F.col("sigmas") >= SIGMAS)
    rows = best.orderBy(F.col("sigmas").desc(), "term").limit(limit).collect()
    return {r["term"]: (i, math.log((1 + total) / (1 + r["df"])) + 1.0) for i, r in enumerate(rows)}


def word_key(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def marks_of(counts: Counter, terms: dict[str, tuple[int, float]]) -> Counter:
    """How often each mark is in a text of these words."""
    seen: Counter = Counter()
    for word, n in counts.items():
        for t in terms_of(word):
            if t in terms:
                seen[terms[t][0]] += n
    return seen


class Vectors:
    """Texts as unit TF-IDF vectors: (terms, ascending; weights). Marks come first, then the words of the examples.

    Words are known by their 64-bit hash. A word that is in no example has no number but its share in the length.
    """

    def __init__(self, terms: dict[str, tuple[int, float]], words: np.ndarray, df: np.ndarray, total: int):
        self.terms, self.words = terms, words  # words: sorted hashes
        self.idf = np.concatenate([[idf for _, idf in terms.values()], np.log((1 + total) / (1 + df)) + 1.0])
        self.unseen = math.log(1 + total) + 1.0
        self.beginnings = [(k, {t[:-1]: i for t, (i, _) in terms.items() if len(t) == k + 1 and t[-1] == "*"}) for k in BEGINNINGS]
        self.known: dict[str, int] = {}
        self.marked: dict[str, list[int]] = {}  # of the known words, those that have marks

    def __len__(self) -> int:
        return len(self.idf)

    def marks(self, word: str) -> list[int]:
        own = [self.terms[word][0]] if word in self.terms else []
        return own + [found[word[:k]] for k, found in self.beginnings if len(word) > k and word[:k] in found]

    def find(self, words: list[str]) -> list[int]:
        """Numbers of the words (-1: in no example)."""
        keys = np.array([word_key(w) for w in words], np.uint64)
        at = np.searchsorted(self.words, keys)
        there = at < len(self.words)
        there[there] = self.words[at[there]] == keys[there]
        return np.where(there, at + len(self.terms), -1).tolist()

    def vector(self, data: str) -> tuple[np.ndarray, np.ndarray] | None:
        """None: no words."""
        seen = Counter(words_of(data))
        if not seen:
            return None
        if len(self.known) >= KEPT:
            self.known.clear()
            self.marked.clear()
        # looked up as a whole: most words are known, and few have marks
        numbers, marks = list(map(self.known.get, seen)), {}
        if None in numbers:
            places = [i for i, number in enumerate(numbers) if number is None]
            words = list(seen)
            new = [words[i] for i in places]
            for i, word, number in zip(places, new, self.find(new), strict=True):
                numbers[i], marked = number, self.marks(word)
                if len(word) <= 64:
                    self.known[word] = number
                    if marked:
                        self.marked[word] = marked
                else:
                    for m in marked:
                        marks[m] = marks.get(m, 0) + seen[word]
        for word in self.marked.keys() & seen.keys():
            for m in self.marked[word]:
                marks[m] = marks.get(m, 0) + seen[word]
        terms, counts = np.array(numbers, np.int64), np.fromiter(seen.values(), float, len(seen))
        there = terms >= 0
        return self.unit(np.append(terms[there], np.array(list(marks), np.int64)), np.append(counts[there], np.array(list(marks.values()), float)), counts[~there])

    def unit(self, terms: np.ndarray, counts: np.ndarray, unseen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(terms)
        terms = terms[order]
        weight = (1.0 + np.log(counts[order])) * self.idf[terms]
        other = np.sort((1.0 + np.log(unseen)) * self.unseen)
        return terms, weight / math.sqrt(float(weight @ weight) + float(other @ other))


class BlockMaxIndex:
    """Exact top-k by cosine over unit vectors."""

    def __init__(self, vectors: Sequence[tuple[np.ndarray, np.ndarray]], n_terms: int):
        df = np.zeros(n_terms, np.int64)
        for at in range(0, len(vectors), CHUNK):
            df += np.bincount(np.concatenate([t for t, _ in vectors[at : at + CHUNK]]), minlength=n_terms)
        # Inside, terms are numbered by falling number of examples: what is looked up often lies together.
        self.named = np.argsort(-df, kind="stable").astype(np.int32)
        self.number = np.empty_like(self.named)
        self.number[self.named] = np.arange(n_terms, dtype=np.int32)
        #: The first so many terms are in the matrix.
        self.common = int(np.count_nonzero(df >= max(2, COMMON * len(vectors))))
        # Examples of a kind lie together and of them those that share their heaviest terms, which keeps block bounds tight.
        kind = self.kinds(vectors)
        order = sorted(range(len(vectors)), key=[(k, t[np.argsort(-w, kind="stable")[:8]].tolist()) for k, (t, w) in zip(kind, vectors, strict=True)].__getitem__)
        self.order, self.n_terms = np.array(order, np.int64), n_terms
        self.blocks = -(-len(order) // BLOCK)
        self.first = np.concatenate([[0], np.cumsum([len(vectors[i][0]) for i in order])]).astype(np.int64)
        self.term, self.weight = np.zeros(self.first[-1], np.int32), np.zeros(self.first[-1])
        for at, i in enumerate(order):
            own = slice(self.first[at], self.first[at + 1])
            self.term[own], self.weight[own] = self.number[vectors[i][0]], vectors[i][1]
        self.places = np.argsort(self.order)
        self.ready = False

    def kinds(self, vectors: Sequence[tuple[np.ndarray, np.ndarray]]) -> list[int]:
        """A kind of each example, as its language may be: the nearest of a few centres in the common terms, fitted on some examples. Only speed depends on it."""

        def dense(some: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
            row, term = np.repeat(np.arange(len(some)), [len(t) for t, _ in some]), self.number[np.concatenate([t for t, _ in some])]
            out, inside = np.zeros((len(some), self.common), np.float32), term < self.common
            out[row[inside], term[inside]] = np.concatenate([w for _, w in some])[inside]
            return out

        if not self.common:
            return [0] * len(vectors)
        rng = np.random.default_rng(0)
        some = dense([vectors[i] for i in rng.permutation(len(vectors))[:CHUNK]])
        some /= np.maximum(np.linalg.norm(some, axis=1, keepdims=True), 1e-9)
        centres, far = some[:1], np.ones(len(some))
        while len(centres) < KINDS and (far := np.minimum(far, np.maximum(1 - some @ centres[-1], 0))).sum() > 1e-3:
            centres = np.append(centres, some[[rng.choice(len(some), p=far / far.sum())]], axis=0)
        for _ in range(8):
            nearest = (some @ centres.T).argmax(axis=1)
            centres = (nearest == np.arange(len(centres))[:, None]).astype(np.float32) @ some
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        return [k for at in range(0, len(vectors), CHUNK) for k in (dense(vectors[at : at + CHUNK]) @ centres.T).argmax(axis=1).tolist()]

    def __getstate__(self) -> dict:
        """Without what ``prepare`` derives."""
        return {k: getattr(self, k) for k in ("order", "places", "n_terms", "blocks", "first", "term", "weight", "named", "number", "common")} | {"ready": False}

    def prepare(self) -> None:
        row = np.repeat(np.arange(len(self.order), dtype=np.int32), np.diff(self.first))
        inside = self.term < self.common
        self.matrix = np.zeros((self.blocks * BLOCK, self.common), np.float32)
        self.matrix[row[inside], self.term[inside]] = self.weight[inside]
        #: Of each common term, the largest weight that it has in each block.
        self.most = self.matrix.reshape(self.blocks, BLOCK, self.common).max(axis=1) if self.common else np.zeros((self.blocks, 0), np.float32)
        #: Of each other term, its examples and weights, as pairs that are copied in one.
        own, self.posted = self.term[~inside], np.empty(np.count_nonzero(~inside), [("row", np.int32), ("weight", np.float32)])
        by_term = np.argsort(own, kind="stable")
        self.posted["row"], self.posted["weight"] = row[~inside][by_term], self.weight[~inside][by_term]
        self.posted_first = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=self.n_terms))]).astype(np.int64)
        self.query = np.zeros(self.n_terms)
        self.ready = True

    def vector(self, example: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.first[at := int(self.places[example])], self.first[at + 1])
        return self.named[self.term[own]].astype(np.int64), self.weight[own]

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        return self.top_of([(terms, weights)], k, [without])[0]

    def top_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query (cosines, examples): the k largest and all others equal to the k-th, best first; cosine above 0 only."""
        if not self.blocks:
            return [(np.zeros(0), np.zeros(0, np.int64)) for _ in queries]
        if not self.ready:
            self.prepare()
        near, dense = np.zeros((len(queries), self.blocks * BLOCK), np.float32), np.zeros((len(queries), self.matrix.shape[1]), np.float32)
        queries = [(self.number[terms], weights) for terms, weights in queries]
        pairs = self.posted.view(np.int64)
        for i, (terms, weights) in enumerate(queries):
            common = terms < self.common
            dense[i, terms[common]] = weights[common]
            rare = terms[~common]
            start, end = self.posted_first[rare], self.posted_first[rare + 1]
            if len(rare):
                size = end - start
                at = np.repeat(start - np.cumsum(size) + size, size)
                at += np.arange(len(at))
                got = pairs.take(at).view(self.posted.dtype)
                near[i] = np.bincount(got["row"], weights=got["weight"] * np.repeat(weights[~common], size), minlength=near.shape[1])
        # what the other terms add is known, so only the common ones are bounded
        bound = near.reshape(len(queries), self.blocks, BLOCK).max(axis=2) + dense @ self.most.T
        left_out = np.full(len(queries), -1, np.int64)
        for i, own in enumerate(without):
            if own >= 0:
                left_out[i] = self.places[own]
        least = np.zeros(len(queries), np.float32)
        best = np.zeros((len(queries), k), np.float32)
        slack = np.float32(3e-5)  # more than single precision loses
        unseen = np.ones((len(queries), self.blocks), bool)
        starts = np.arange(0, self.blocks, VISIT)
        most = np.maximum.reduceat(bound, starts, axis=1)
        for part in np.argsort(-most.max(axis=0), kind="stable").tolist():
            who = np.flatnonzero(most[:, part] >= np.maximum(least - slack, 1e-12))
            if not len(who):
                continue
            blocks = slice(starts[part], min(starts[part] + VISIT, self.blocks))
            rows = slice(blocks.start * BLOCK, blocks.stop * BLOCK)
            unseen[who, blocks] = False
            if len(who) == len(queries):
                near[:, rows] += dense @ self.matrix[rows].T
                got = near[:, rows]
            else:
                got = near[who, rows] + dense[who] @ self.matrix[rows].T
                near[who, rows] = got
            inside = np.flatnonzero((left_out[who] >= rows.start) & (left_out[who] < rows.stop))
            if len(inside):
                near[who[inside], left_out[who[inside]]] = 0.0
                got = near[who, rows]
            both = np.concatenate([best[who], got], axis=1)
            best[who] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            least[who] = best[who].min(axis=1)
        out = []
        for i, (terms, weights) in enumerate(queries):
            score = near[i].reshape(self.blocks, BLOCK)
            score[unseen[i]] = 0.0
            if left_out[i] >= 0:
                near[i, left_out[i]] = 0.0
            at = np.flatnonzero((near[i] > 0) & (near[i] >= least[i] - slack))
            out.append(self.exact(terms, weights, at, k))
        return out

    def exact(self, terms: np.ndarray, weights: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Cosines of the rows in double precision, and of them what ``top_of`` returns."""
        size = self.first[rows + 1] - self.first[rows]
        if not len(rows):
            return np.zeros(0), np.zeros(0, np.int64)
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        own = [slice(a, b) for a, b in zip(self.first[rows].tolist(), self.first[rows + 1].tolist(), strict=True)]
        self.query[terms] = weights
        cosine = np.add.reduceat(np.concatenate([self.weight[x] for x in own]) * self.query.take(np.concatenate([self.term[x] for x in own])), starts)
        self.query[terms] = 0.0
        example = self.order[rows]
        least = np.partition(cosine, len(cosine) - k)[-k] if len(cosine) > k else 0.0
        near = np.flatnonzero((cosine > 0) & (cosine >= least - 1e-9))
        near = near[np.lexsort((example[near], -cosine[near]))]
        return cosine[near], example[near]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (from this vote on, probability), non-decreasing; each step's share has half a case of either label added."""
    steps: list[list[float]] = []  # vote, cases, positive
    for v in np.unique(x):
        here = y[x == v]
        steps.append([float(v), len(here), float(here.sum())])
        while len(steps) > 1 and steps[-2][2] * steps[-1][1] >= steps[-1][2] * steps[-2][1]:
            _, n, p = steps.pop()
            steps[-1][1] += n
            steps[-1][2] += p
    share = np.array([(p + 0.5) / (n + 1) for _, n, p in steps])
    return np.array([s[0] for s in steps]), np.maximum.accumulate(share)


class Model:
    """Everything scoring needs; its size is bounded by the sample and the marks."""

    def __init__(self, vectors: Vectors, ids: list[int], found: list[tuple[np.ndarray, np.ndarray] | None], labels: np.ndarray):
        self.vectors, self.all_labels = vectors, labels
        self.holds = [i for i, v in enumerate(found) if v is not None]
        self.ids, self.labels = [ids[i] for i in self.holds], labels[self.holds]
        self.index = BlockMaxIndex([found[i] for i in self.holds], len(vectors))
        self.scored: dict[bytes, tuple[float, list[int]]] = {}
        self.fitted = (0.0, np.zeros(0), np.zeros(0))  # share without neighbours, steps, their shares
        self.shared: Broadcast | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"scored": {}, "shared": None}

    def left_out(self, examples: list[int]) -> list[tuple[float, bool]]:
        """(vote, whether it has a neighbour) of examples, each by the others."""
        return [(vote, bool(evidence)) for at in range(0, len(examples), TOGETHER) for vote, evidence in self.votes([self.index.vector(i) for i in examples[at : at + TOGETHER]], examples[at : at + TOGETHER])]

    def calibrate(self, votes: np.ndarray, met: np.ndarray) -> Model:
        alone = np.concatenate([np.delete(self.all_labels, self.holds), self.labels[~met]])
        without = (float(alone.sum()) + float(self.all_labels.mean())) / (len(alone) + 1) if len(self.all_labels) else 0.0
        self.fitted = (without, *(isotonic(votes[met], self.labels[met]) if met.any() else (np.zeros(0), np.zeros(0))))
        return self

    def votes(self, vectors: list[tuple[np.ndarray, np.ndarray]], without=None) -> list[tuple[float, list[int]]]:
        out = []
        for cosine, example in self.index.top_of(vectors, NEIGHBOURS, list(without) if without is not None else [-1] * len(vectors)):
            weight = 1.0 / (1.05 - np.minimum(cosine, 1.0))
            share = float(weight @ self.labels[example] / weight.sum()) if len(example) else 0.0
            out.append((round(share, 9), [self.ids[e] for e in example[:EVIDENCE].tolist()]))
        return out

    def scores(self, texts: list[str], without: float, steps: np.ndarray, share: np.ndarray) -> list[tuple[float, list[int]]]:
        keys = [xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in texts]
        got = {k: self.scored[k] for k in keys if k in self.scored}
        new = {k: x for k, x in zip(keys, texts, strict=True) if k not in got}
        vectors = {k: self.vectors.vector(x) for k, x in new.items()}
        asked = [k for k, v in vectors.items() if v is not None]
        got.update((k, (without, [])) for k, v in vectors.items() if v is None)
        for at in range(0, len(asked), TOGETHER):
            part = asked[at : at + TOGETHER]
            for key, (vote, evidence) in zip(part, self.votes([vectors[k] for k in part]), strict=True):
                step = int(np.searchsorted(steps, vote, side="right")) - 1
                got[key] = (float(share[max(step, 0)]), evidence) if evidence and len(share) else (without, evidence)
        if len(self.scored) >= KEPT // 10:
            self.scored.clear()
        self.scored.update(got)
        return [got[k] for k in keys]


def cells(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in all cells of a column of bytes, and where each cell's begin, with the end."""
    whole = pa.concat_arrays([pa.array([], column.type), *column.chunks])
    _, places, data = whole.buffers()
    at = np.frombuffer(places, "<i8" if pa.types.is_large_binary(column.type) else "<i4")[whole.offset :][: len(whole) + 1].astype(np.int64) if len(whole) else np.zeros(1, np.int64)
    return np.frombuffer(data.to_pybytes() if data else b"", np.uint8)[: at[-1]].view(kind), at // np.dtype(kind).itemsize


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples: int = EXAMPLES) -> Model:
    """Learn from at most ``examples`` of the ``labels(id, label)`` rows, drawn by hash of the id.

    Repeated labels of an id count as one, the larger, and of rows that repeat an id
    the largest text is learnt from; null ids and labels are left out. Without
    examples of both labels there are no marks.
    """
    drawn = labels.where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.max("label").alias("label"))
    drawn = drawn.orderBy(F.xxhash64("id"), "id").limit(examples)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id")  # at most ``examples`` rows
    rows = rows.groupBy("id").agg(F.max("text").alias("text"), F.max("label").alias("label"))
    count = rows.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
    terms = learnt_terms(rows, int(count["p"] or 0), count["n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[bytes]] = [[], [], [], []]
            for data in text.strings(batch, "text"):
                counts = Counter(words_of(data))
                marks = marks_of(counts, terms)
                cells = np.array([word_key(w) for w in counts], "<u8"), np.array(list(counts.values()), "<i4"), np.array(list(marks), "<i4"), np.array(list(marks.values()), "<i4")
                for column, cell in zip(columns, cells, strict=True):
                    column.append(cell.tobytes())
            yield text.record(id=batch.column("id"), label=batch.column("label"), words=columns[0], n=columns[1], marks=columns[2], m=columns[3])

    # as Arrow columns: rows would be decoded, pickled and held once more on the driver
    got = rows.select("id", F.col("label").cast("int").alias("label"), "text").mapInArrow(run, "id long, label int, words binary, n binary, marks binary, m binary").toArrow().sort_by("id")
    ids, labelled = got.column("id").to_pylist(), got.column("label").to_numpy().astype(np.int64)
    (flat, at), (n, _), (marks, marked), (m, _) = (cells(got.column(c), kind) for c, kind in (("words", "<u8"), ("n", "<i4"), ("marks", "<i4"), ("m", "<i4")))
    del got
    pa.default_memory_pool().release_unused()
    words = np.unique(flat)
    numbers = np.searchsorted(words, flat).astype(np.int32)
    del flat
    vectors, found = Vectors(terms, words, np.bincount(numbers, minlength=len(words)), len(ids)), []
    for a, b, c, d in zip(at[:-1], at[1:], marked[:-1], marked[1:], strict=True):
        own = np.concatenate([marks[c:d], numbers[a:b] + np.int32(len(terms))])
        found.append(vectors.unit(own, np.concatenate([m[c:d], n[a:b]]).astype(float), np.zeros(0)) if b > a else None)
    del numbers, n, marks, m
    model = Model(vectors, ids, found, labelled)
    del found  # the index holds it all
    # each example's vote by the others, in tasks, since it costs what scoring as many texts does
    spark, n = df.sparkSession, len(model.holds)
    # sent once: what is fitted on the votes goes with the scoring function
    shared = model.shared = spark.sparkContext.broadcast(model)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = shared.value.left_out(batch.column("id").to_pylist())
            yield text.record(id=batch.column("id"), vote=pa.array([v for v, _ in votes], pa.float64()), met=pa.array([m for _, m in votes], pa.bool_()))

    by = sorted(spark.range(0, n, 1, max(1, -(-n // 1000))).mapInArrow(vote, "id long, vote double, met boolean").collect()) if n else []
    return model.calibrate(np.array([r["vote"] for r in by], float), np.array([r["met"] for r in by], bool))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, evidence)``: probability of the label and the ids of the nearest examples.

    A null or empty text has no word. Equal texts have equal scores. Null ids are
    passed through. No rows: no rows.
    """
    shared, fitted = model.shared or df.sparkSession.sparkContext.broadcast(model), model.fitted

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = shared.value.scores(text.strings(batch, "text"), *fitted)
        return text.record(id=batch.column("id"), score=pa.array([s for s, _ in got], pa.float64()), evidence=pa.array([e for _, e in got], pa.list_(pa.int64())))

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return text.map_batches(rows, run, "id long, score double, evidence array<long>")
