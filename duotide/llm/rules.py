"""Quality rules as a short-circuit cascade, cheapest rejection first.

Every rule is a predicate on one text. On a bounded sample each rule's mean
seconds and share of rejections are measured on executors; rules then run in
descending order of rejections per second, and a text leaves at the first that
rejects it. The verdict does not depend on the order, only the work does.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duotide.llm import text

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
BLANKS = b" \t\n\v\f\r"
#: Rows on which costs and selectivities are estimated.
SAMPLE_ROWS = 2000


def count(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


@dataclass
class Doc:
    """One text with what several rules need, computed at most once."""

    data: bytes
    words: list[bytes] = field(init=False)

    def __post_init__(self):
        self.words = self.data.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.data.decode("utf-8", "replace")) - count(self.data, BLANKS)

    @cached_property
    def n_symbols(self) -> int:
        return count(self.data, SYMBOLS)

    @cached_property
    def lines(self) -> tuple[int, int]:
        """Lines with a word, and how many of them equal an earlier one."""
        own = [x for x in self.data.split(b"\n") if x.strip(BLANKS)]
        return len(own), len(own) - len(set(own))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside 3-word windows that the text has twice or more."""
        windows = list(zip(self.words, self.words[1:], self.words[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        seen, covered, end = Counter(windows), 0, 0
        for i, w in enumerate(windows):
            if seen[w] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
        return covered


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Doc], bool]
    #: The same condition in SQL, over the columns of :func:`measures_sql`.
    sql: str


RULES = (
    Rule("symbols", lambda d: 100 * d.n_symbols > 30 * d.n_words, "100 * n_symbols > 30 * n_words"),
    Rule("capitals", lambda d: (up := count(d.data, UPPER)) * 100 > 60 * (up + count(d.data, LOWER)), "100 * n_upper > 60 * (n_upper + n_lower)"),
    Rule("exclamations", lambda d: 100 * d.data.count(b"!") > 40 * d.n_words, "100 * n_exclaim > 40 * n_words"),
    Rule("repeated_lines", lambda d: 100 * d.lines[1] > 50 * d.lines[0], "100 * n_dup_lines > 50 * n_lines"),
    Rule("word_length", lambda d: not 2 * d.n_words <= d.word_chars <= 25 * d.n_words, "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
    Rule("longest_word", lambda d: max(map(len, d.words), default=0) > 2000, "longest > 2000"),
    Rule("commonest_word", lambda d: 100 * max(Counter(d.words).values(), default=0) > 40 * d.n_words, "100 * commonest > 40 * n_words"),
)


def base_failed(doc: Doc) -> bool:
    return doc.n_words < 50 or 100 * doc.n_repeat_words > 50 * doc.n_words


def estimate(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, mean seconds, share rejected) on at most ``rows`` texts drawn at random; an empty table gives zeros."""
    total = df.count()
    share = min(1.0, 1.2 * rows / max(total, 1))
    sample = df.select(F.col(text_col).alias("text")).sample(share, seed=1).limit(rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, hits, seen = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for data in text.raw(batch, "text"):
                seen += 1
                for i, rule in enumerate(rules):
                    doc, start = Doc(data), time.perf_counter()
                    hits[i] += rule.rejects(doc)
                    spent[i] += time.perf_counter() - start
        yield text.record(rule=pa.array(range(len(rules)), pa.int32()), spent=spent, hits=pa.array(hits, pa.int64()), seen=pa.array([seen] * len(rules), pa.int64()))

    rows_ = sample.mapInArrow(measure, "rule int, spent double, hits long, seen long").groupBy("rule").agg(*[F.sum(c).alias(c) for c in ("spent", "hits", "seen")]).collect()
    by = {r["rule"]: r for r in rows_}
    return [(rule.name, by[i]["spent"] / max(by[i]["seen"], 1) if i in by else 0.0, by[i]["hits"] / max(by[i]["seen"], 1) if i in by else 0.0) for i, rule in enumerate(rules)]


def ordered(estimates: list[tuple[str, float, float]], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """Most rejections per second first; ties by name."""
    rank = {name: (-share / max(cost, 1e-9), cost, name) for name, cost, share in estimates}
    return tuple(sorted(rules, key=lambda r: rank[r.name]))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures and verdict of every row: ``id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``.

    A null or empty text has no words and fails the base rules. Equal rows get
    equal verdicts; ids are passed through, null ones too. No rows: no rows.
    """
    cascade = ordered(estimate(df, text_col, rules), rules)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for data in text.raw(batch, "text"):
            doc = Doc(data)
            failed = base_failed(doc)
            kept = not failed and not any(rule.rejects(doc) for rule in cascade)
            out.append((doc.n_words, doc.word_chars, doc.n_symbols, doc.lines[1], doc.n_repeat_words, failed, kept))
        cols = dict(zip("n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split(), zip(*out, strict=True), strict=True))
        return text.record(id=batch.column("id"), **cols)

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return text.map_batches(rows, run, "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def keeps(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows, with all their columns, that pass the base rules and the cascade."""
    cascade = ordered(estimate(df, text_col, rules), rules)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs = map(Doc, text.raw(batch, text_col))
        return batch.filter(pa.array([not base_failed(d) and not any(rule.rejects(d) for rule in cascade) for d in docs]))

    return text.map_batches(df, run, df.schema)


def measures_sql(source: str = "documents") -> str:
    """DuckDB SQL for the measures of ``source(doc_id, text)``; rows are told apart by their position."""
    gap = "[\\x20\\x09-\\x0D]"
    kept = lambda chars: f"length(regexp_replace(t, '[^{chars}]', '', 'g'))"
    return f"""
    src AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {source}),
    split AS MATERIALIZED (
      SELECT rid, doc_id, list_filter(string_split_regex(t, '{gap}+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
             length(regexp_replace(t, '{gap}', '', 'g')) AS word_chars, {kept("#*$%&|<>")} AS n_symbols,
             {kept("A-Z")} AS n_upper, {kept("a-z")} AS n_lower, {kept("!")} AS n_exclaim FROM src),
    word AS (SELECT rid, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS p FROM split),
    win AS (SELECT rid, p, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM word WINDOW o AS (PARTITION BY rid ORDER BY p)),
    twice AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, w, w2, w3) > 1 AS again FROM win WHERE w3 IS NOT NULL),
    covered AS (SELECT DISTINCT rid, p + d AS p FROM twice, (SELECT unnest([0, 1, 2]) AS d) WHERE again),
    repeated AS (SELECT rid, count(*) AS n FROM covered GROUP BY rid),
    common AS (SELECT rid, max(n) AS n FROM (SELECT rid, w, count(*) AS n FROM word GROUP BY rid, w) GROUP BY rid),
    measured AS MATERIALIZED (
      SELECT s.rid, doc_id, len(w)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             len(l) AS n_lines, n_upper, n_lower, n_exclaim, coalesce(c.n, 0) AS commonest,
             coalesce(list_max(list_transform(w, lambda x: strlen(x))), 0) AS longest
      FROM split s LEFT JOIN repeated r USING (rid) LEFT JOIN common c USING (rid)),
    judged AS (
      SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ({" OR ".join(f"({r.sql})" for r in RULES)}) AS kept FROM measured)"""
