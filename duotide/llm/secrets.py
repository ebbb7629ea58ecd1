"""Secret scans with one automaton for all rules.

Rule regexes become one NFA over bytes, subset construction makes it
deterministic, partition refinement minimises it, and the transitions lie in one
integer array whose entries also carry the rules that a step completes. A batch
of texts is one byte buffer cut into lanes after bytes that lead every state back
to the start, so lanes are independent and no match spans two of them; all
lanes step together, one array lookup a byte.

For the automaton a rule's long runs are cut to their first few characters, which
keeps the states in the hundreds. Lanes that hit a rule are then matched exactly,
with the rule's own lengths.
"""

from __future__ import annotations

import re
import re._constants as op
import re._parser as parser
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duotide.llm import text

CASELESS = re.IGNORECASE


@dataclass(frozen=True)
class Rule:
    kind: str
    #: Finds candidates; ``least`` characters of ``group`` make a secret.
    regex: str
    group: int
    least: int
    #: What the automaton looks for: every secret contains a match.
    trigger: str


#: The first three are the base rules.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]"""),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, r"AKIA[A-Z0-9]"),
    Rule("hex", r"[0-9a-f]+", 0, 32, r"[0-9a-f]{8}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, r"\.eyJ[A-Za-z0-9_-]+\."),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, r"gh[pousr]_[A-Za-z0-9]"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 24, r"xox[abprs]-[A-Za-z0-9-]"),
    Rule("payment_key", r"[rs]k_live_[A-Za-z0-9]+", 0, 24, r"[rs]k_live_[A-Za-z0-9]"),
)
BASE = 3


class Nfa:
    """Thompson construction; ``arcs[s]`` is a list of (byte set, target), ``free[s]`` of targets without input."""

    def __init__(self):
        self.arcs: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.arcs.append([])
        self.free.append([])
        return len(self.arcs) - 1

    def add(self, start: int, tree, caseless: bool) -> int:
        """Append what ``tree`` matches after ``start``; the state where it ends."""
        for kind, arg in tree:
            if kind is op.LITERAL:
                start = self.step(start, {arg}, caseless)
            elif kind is op.IN:
                start = self.step(start, {b for what, x in arg for b in ([x] if what is op.LITERAL else range(x[0], x[1] + 1))}, caseless)
            elif kind is op.SUBPATTERN:
                _, flags, _, inner = arg
                start = self.add(start, inner, caseless or bool(flags & CASELESS))
            elif kind is op.BRANCH:
                end = self.state()
                for branch in arg[1]:
                    self.free[self.add(start, branch, caseless)].append(end)
                start = end
            elif kind is op.MAX_REPEAT:
                low, high, inner = arg
                for _ in range(low):
                    start = self.add(start, inner, caseless)
                if high is op.MAXREPEAT:
                    loop, end = self.state(), self.state()
                    self.free[start].append(loop)
                    self.free[self.add(loop, inner, caseless)].append(loop)
                    self.free[loop].append(end)
                    start = end
                else:
                    end = self.state()
                    self.free[start].append(end)
                    for _ in range(high - low):
                        start = self.add(start, inner, caseless)
                        self.free[start].append(end)
                    start = end
            else:
                raise ValueError(f"not supported in a rule: {kind}")
        return start

    def step(self, start: int, chars: set[int], caseless: bool) -> int:
        if caseless:
            chars = chars | {ord(c) for x in chars if x < 128 for c in (chr(x).lower(), chr(x).upper())}
        end = self.state()
        self.arcs[start].append((frozenset(chars), end))
        return end

    def closure(self, states) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)


@dataclass(frozen=True)
class Automaton:
    """``step[state * classes + class]`` holds next state * classes, and from bit ``shift`` on the rules completed."""

    classes: int
    of_byte: np.ndarray
    step: np.ndarray
    shift: int
    resets: np.ndarray
    states: int
    before: int


def determinise(triggers: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(transitions by state and byte class, rules accepted by state, class of each byte), for a match ending anywhere."""
    nfa = Nfa()
    root = nfa.state()
    accept: dict[int, int] = {}
    for k, pattern in enumerate(triggers):
        accept[nfa.add(root, parser.parse(pattern), False)] = 1 << k
    sets = sorted({chars for arcs in nfa.arcs for chars, _ in arcs}, key=sorted)
    member = np.array([[b in s for s in sets] for b in range(256)])
    _, first, of_byte = np.unique(member, axis=0, return_index=True, return_inverse=True)
    begin = nfa.closure([root])
    ids, order, rows = {begin: 0}, [begin], []
    for current in order:  # grows while it is read
        row = []
        for byte in first:
            after = nfa.closure({t for s in current for chars, t in nfa.arcs[s] if byte in chars} | {root})
            if after not in ids:
                ids[after] = len(order)
                order.append(after)
            row.append(ids[after])
        rows.append(row)
    masks = [sum({accept.get(s, 0) for s in states}) for states in order]
    return np.array(rows), np.array(masks), of_byte.ravel()


def minimise(step: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge states that no input tells apart; state 0 stays 0."""
    block = np.unique(masks, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    _, first, name = np.unique(block, return_index=True, return_inverse=True)
    rank = np.argsort(np.argsort(first))  # blocks by their first state
    keep = np.sort(first)
    return rank[name][step[keep]], masks[keep]


@lru_cache(maxsize=4)
def compiled(rules: tuple[Rule, ...] = RULES) -> Automaton:
    step, masks, of_byte = determinise([r.trigger for r in rules])
    before = len(step)
    step, masks = minimise(step, masks)
    n, classes = step.shape
    shift = int(n * classes - 1).bit_length()
    if shift + len(rules) > 62:
        raise ValueError("too many rules or states for one table")
    table = (step * classes).astype(np.int64) | (masks[step].astype(np.int64) << shift)
    table = table.astype(np.int32) if shift + len(rules) < 31 else table
    resets = (step == 0).all(axis=0)[of_byte]
    return Automaton(classes, of_byte.astype(np.uint8), table.ravel(), shift, resets, n, before)


#: Bytes a lane aims at, and bytes of text scanned at once.
LANE, BLOCK = 256, 8 << 20


def hit_lanes(data: np.ndarray, a: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, rules hit) of each lane of the byte buffer in which a rule is completed."""
    cuts = np.flatnonzero(a.resets[data]) + 1
    if len(cuts):
        cuts = cuts[np.unique(cuts // LANE, return_index=True)[1]]
    start = np.unique(np.concatenate([[0], cuts[cuts < len(data)]]))
    end = np.append(start[1:], len(data))
    longest = np.argsort(start - end, kind="stable")
    start, end = start[longest], end[longest]
    length = end - start
    of, at = a.of_byte[data], start.copy()
    state, seen = np.zeros(len(start), a.step.dtype), np.zeros(len(start), a.step.dtype)
    low = a.step.dtype.type((1 << a.shift) - 1)
    active = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")  # lanes with that many bytes
    for k in active:
        got = a.step[state[:k] + of[at[:k]]]
        seen[:k] |= got
        state[:k] = got & low
        at[:k] += 1
    rules = seen >> a.shift
    hit = np.flatnonzero(rules)
    hit = hit[np.argsort(start[hit])]
    return start[hit], end[hit], rules[hit]


def scan(texts: list[bytes], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, rule, end) in bytes, by start, then rule."""
    a = compiled(rules)
    exact = [re.compile(r.regex.encode()) for r in rules]
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < BLOCK):
            size += len(texts[j]) + 1
            j += 1
        joined = b"\n".join(texts[i:j])
        if joined.strip():
            begins = np.cumsum([0] + [len(t) + 1 for t in texts[i : j - 1]])
            for s, e, mask in zip(*hit_lanes(np.frombuffer(joined, np.uint8), a), strict=True):
                for k, rule in enumerate(rules):
                    if mask >> k & 1:
                        for m in exact[k].finditer(joined, s, e):
                            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                                n = int(np.searchsorted(begins, m.start(), side="right")) - 1
                                found[i + n].append((m.start() - int(begins[n]), k, m.end() - int(begins[n])))
        i = j
    return [sorted(f) for f in found]


def in_characters(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets to code points."""
    if not spans or data.isascii():
        return spans
    starts = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    before = lambda at: int(starts[at - 1]) if at else 0
    return [(before(s), k, before(e)) for s, k, e in spans]


def written(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...] = RULES) -> str:
    return ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in spans)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(id, spans)`` for every row; spans is an array of (kind, start, end) in code points, end exclusive.

    Matches of one rule don't overlap, those of different rules may. A null or
    empty text has none. Repeated rows and null ids stay. No rows: no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = text.raw(batch, "text")
        spans = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in in_characters(t, f)] for t, f in zip(texts, scan(texts, rules), strict=True)]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return text.record(id=batch.column("id"), spans=pa.array(spans, kind))

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return text.map_batches(rows, run, "id long, spans array<struct<kind:string,start:long,end:long>>")


def digest(df: DataFrame, base: tuple[str, ...] = tuple(r.kind for r in RULES[:BASE])) -> DataFrame:
    """Counts and hashes of :func:`find`'s rows."""
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    own = F.filter("spans", lambda s: s["kind"].isin(*base))
    return df.select("id", *map(of, base), F.sha2(joined(own), 256).alias("base_sha256"), joined("spans").alias("spans"))


MASK = b"[secret]"


def masked(data: bytes, spans: list[tuple[int, int, int]]) -> bytes:
    """The text with every span, overlapping ones as one, replaced by a mark."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [data[at:s], MASK]
        at = max(at, e)
    return b"".join([*out, data[at:]])


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows with secrets masked in their text, and its length in ``length_col`` where a mask was put."""
    columns = df.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = text.raw(batch, text_col)
        spans = scan(texts, rules)
        if not any(spans):
            return batch
        arrays = dict(zip(columns, batch.columns, strict=True))
        nulls = arrays[text_col].is_null().to_pylist()
        new = [None if null else masked(t, f).decode() for t, f, null in zip(texts, spans, nulls, strict=True)]
        arrays[text_col] = pa.array(new, pa.string())
        if length_col:
            old = arrays[length_col]
            arrays[length_col] = pa.array([len(n) if f else o for n, f, o in zip(new, spans, old.to_pylist(), strict=True)], old.type)
        return pa.RecordBatch.from_arrays(list(arrays.values()), columns)

    return text.map_batches(df, run, df.schema)
