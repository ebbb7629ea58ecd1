"""Main text of web pages by deducing the template that pages of a host share.

Tokens of a page are its elements, told apart by their place (the path of names,
classes and ids above them), and its blocks of text by place. Over a group of pages of one
host every token has an occurrence vector, how often each page has it. Tokens with
one vector form a class. A class with enough support whose tokens come in one order
on every page is valid; valid classes, nested by their paths, are the template. What
pages put between template tokens are slots, and the template's own names, or where
they tell nothing its statistics, say which slots hold the article.

A host is dealt into groups of bounded size by hash, so one host may hold any share
of the pages; a template needs tens of pages, not all.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duotide import scratch

#: Pages a group aims at; share of a group's pages that a class must be on.
GROUP, SUPPORT = 256, 0.5
#: Different main texts that a fixed text is seen beside.
LEAST = 3

#: Characters of a path that are written out; longer ones are known by their hash.
WRITTEN = 4000

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no markup: they end at their own end tag only.
RAW = frozenset("script style textarea title iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: A start tag that closes an open element of the given names, up to the nearest of the others.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
#: Elements that a paragraph may hold.
PHRASES = frozenset("noscript template svg math object select button canvas audio video textarea iframe script style".split())
EDGES = frozenset("html body article main section div nav header footer aside form table td th blockquote figure ul ol li dl".split())

CONTAINERS = frozenset("html body article main section div nav header footer aside form table td th blockquote center".split())
PAGE = frozenset("html body".split())
BESIDE_TAGS = frozenset("head nav footer aside form dialog menu fieldset noscript template svg select option button canvas audio video".split())
BESIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BESIDE_WORDS = frozenset(
    """ad ads adslot advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar sidenav menu nav navbar
    navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe
    subscription signup login share sharing social comment comments reply replies respond discussion disqus reader related recommended
    recommendations widget toolbar pagination pager skip copyright""".split()
)
#: From the surest to the least sure sign of the article.
ARTICLE_WORDS = (frozenset("article post entry story".split()), frozenset("content main body text".split()))


class Path(str):
    """Place of an element: the labels above it and its own. A long one costs no more than a short one, however deep it is."""

    __slots__ = ("above", "depth", "own")

    def __new__(cls, above: Path | None = None, own: str = "") -> Path:
        written = "" if above is None else f"{above}/{own}"
        if len(written) > WRITTEN:
            written = "~" + xxhash.xxh3_128_hexdigest(written.encode("utf-8", "surrogatepass"))
        path = super().__new__(cls, written)
        path.above, path.own, path.depth = above, own, 0 if above is None else above.depth + 1
        return path


@dataclass
class Block:
    path: Path
    text: str
    linked: int


def label(tag: str, attributes: str) -> str:
    """``tag.class...#id@role`` without digits, so that numbered places are one."""
    if not attributes:
        return tag
    out = {"class": "", "id": "", "role": ""}
    for name, *values in ATTRIBUTE.findall(attributes):
        out[name.lower()] = out[name.lower()] or next((v for v in values if v), "")
    classes = sorted({w for c in out["class"].lower().split() if (w := re.sub(r"[^a-z_-]+", "", c))})
    own = re.sub(r"[^a-z_-]+", "", out["id"].lower())
    return tag + "".join(f".{c}" for c in classes) + (f"#{own}" if own else "") + (f"@{out['role'].lower().split()[0]}" if out["role"].split() else "")


class Stack:
    """Open elements, all of them, and where those of each name are, so that broken nesting is closed without a search."""

    def __init__(self):
        self.open: list[tuple[str, Path]] = [("", Path())]
        self.at: defaultdict[str, list[int]] = defaultdict(list)
        self.edges: list[int] = []

    def push(self, name: str, path: Path) -> None:
        self.at[name].append(len(self.open))
        if name in EDGES:
            self.edges.append(len(self.open))
        self.open.append((name, path))

    def last(self, names) -> int:
        """Place of the innermost open element of one of the names; 0: none."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def close(self, depth: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.open) > depth:
            name, _ = self.open.pop()
            self.at[name].pop()
            if name in EDGES:
                self.edges.pop()

    def end(self, name: str) -> None:
        depth, edge = self.last((name,)), self.edges[-1] if self.edges else 0
        if depth and (name in EDGES or depth > edge):
            self.close(depth)

    def start(self, name: str) -> None:
        """Close what a start tag closes."""
        if name in PHRASES:
            return
        closes, until = CLOSES.get(name, ({"p"}, EDGES))
        edge = (self.edges[-1] if self.edges else 0) if until is EDGES else self.last(until - closes)
        if (depth := self.last(closes)) > edge:
            self.close(depth)


def parse(page: str) -> tuple[list[Block], list[Path]]:
    """(text blocks in page order, the path of every element in page order). Broken nesting is closed where it must be."""
    stack = Stack()
    paths: dict[tuple[int, str], Path] = {}  # each place of the page once
    blocks, elements, text = [], [], []
    linked, at, block_path = 0, 0, stack.open[0][1]

    def flush() -> None:
        nonlocal linked, text
        if text and (joined := " ".join("".join(text).split())):
            blocks.append(Block(block_path, joined, linked))
        text, linked = [], 0

    while (m := TOKEN.match(page, at)) is not None:
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if name is None:
            if m[0][0] != "<" or m[0] == "<":
                words = entities.unescape(m[0])
                if not text or not block_path:
                    block_path = stack.open[-1][1]
                text.append(words)
                linked += len(words.strip()) if stack.at.get("a") else 0
            continue
        name = name.lower()
        if closing:
            if name not in INLINE:
                flush()
            stack.end(name)
            continue
        if name not in INLINE:
            flush()
            stack.start(name)
        path = stack.open[-1][1]
        if name not in INLINE:
            own = label(name, attributes)
            if (known := paths.get((id(path), own))) is None:
                known = paths[id(path), own] = Path(path, own)
            path = known
            elements.append(path)
        if name in VOID or attributes.endswith("/"):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        stack.push(name, path)
    flush()
    return blocks, elements


@dataclass(frozen=True)
class Place:
    #: Beside the article: by a tag or role, or by a word in a class or id, which says less.
    beside: bool = False
    by_word: bool = False
    #: How sure a sign of the article is on the path: 0 surest, None no sign.
    sign: int | None = None
    #: Inside an article or main element that only words above say is beside.
    doubtful: bool = False


class Places:
    """What the names on a path say, worked out once per path of a group."""

    def __init__(self):
        self.known: dict[Path, Place] = {}

    def of(self, path: Path) -> Place:
        unknown = []
        while path.depth and path not in self.known:
            unknown.append(path)
            path = path.above
        got = self.known[path] if path.depth else Place()
        for path in reversed(unknown):
            got = self.known[path] = self.inside(got, path.own)
        return got

    def inside(self, above: Place, own: str) -> Place:
        names, _, role = own.partition("@")
        tag, words = re.split(r"[.#]", names, maxsplit=1)[0], set(WORDS.findall(names))
        words.discard(tag)
        if tag in BESIDE_TAGS or role in BESIDE_ROLES or (above.sign is None and tag == "header"):
            return Place(True, False, above.sign, above.doubtful)
        # the page as a whole is not beside itself
        if tag not in PAGE and (words & BESIDE_WORDS or (above.sign is None and "header" in words)):
            return Place(True, above.by_word or not above.beside, above.sign, above.doubtful)
        marks = (tag == "article" or role == "article", tag == "main" or role == "main", bool(words & ARTICLE_WORDS[0]), bool(words & ARTICLE_WORDS[1]))
        found = None if tag in INLINE else next((i for i, x in enumerate(marks) if x), None)
        sign = above.sign if found is None else found if above.sign is None else min(above.sign, found)
        if above.by_word and not above.doubtful and found is not None and found <= 1 and above.sign is None:
            return Place(False, False, sign, True)
        return Place(above.beside, above.by_word, above.sign if above.beside else sign, above.doubtful)


@dataclass
class Template:
    #: Paths of the elements in valid classes, and texts that are in one at their place.
    elements: frozenset[Path]
    fixed: frozenset[tuple[Path, str]]
    #: The sign that says where the article is; None: statistics only.
    sign: int | None

    def slot(self, path: Path) -> Path:
        """The nearest template element around a place."""
        while path.depth and path not in self.elements:
            path = path.above
        return path


def classes(counts: list[Counter]) -> list[list]:
    """Tokens grouped by occurrence vector, for those on enough pages."""
    by_token = defaultdict(list)
    for page, found in enumerate(counts):
        for token, n in found.items():
            by_token[token].append((page, n))
    by_vector = defaultdict(list)
    for token, vector in by_token.items():
        if len(vector) >= max(1, SUPPORT * len(counts)):
            by_vector[tuple(vector)].append(token)
    return list(by_vector.values())


def fixed_texts(pages: list[set[tuple[Path, str]]]) -> set[tuple[Path, str]]:
    """Texts in place that stand beside at least three different main texts, and beside enough of all there are.

    Texts on enough pages may be fixed. What else a page has is its main text; pages without any, or with
    the same, say no more than one page does.
    """
    often = {token for members in classes([Counter(page) for page in pages]) for token in members}
    mains = [frozenset(page - often) for page in pages]
    beside = defaultdict(set)
    for page, main in zip(pages, mains, strict=True):
        if main:
            for token in page & often:
                beside[token].add(main)
    least = max(LEAST, SUPPORT * len(set(mains) - {frozenset()}))
    return {token for token, found in beside.items() if len(found) >= least}


def deduce(pages: list[tuple[list[Block], list[Path]]], places: Places) -> Template:
    """Template of a group of parsed pages; copies of a page count as one."""
    pages = list({(*((b.path, b.text) for b in blocks), None, *elements): (blocks, elements) for blocks, elements in pages}.values())
    firsts = []
    for _, elements in pages:
        first: dict[Path, int] = {}
        for i, path in enumerate(elements):
            first.setdefault(path, i)
        firsts.append(first)
    valid: set[Path] = set()
    for members in classes([Counter(e) for _, e in pages]):
        on = [f for f in firsts if members[0] in f]
        members.sort(key=on[0].__getitem__)
        # one order on every page: a token whose place among the others changes is no template token
        ranks = np.array([np.argsort(np.argsort([f[t] for t in members])) for f in on])
        valid.update(t for t, same in zip(members, (ranks == ranks[0]).all(axis=0), strict=True) if same)
    nested: set[Path] = set()
    for p in sorted(valid, key=lambda p: p.depth):
        if p.depth == 1 or p.above in nested:
            nested.add(p)
    fixed = fixed_texts([{(b.path, b.text) for b in blocks} for blocks, _ in pages])
    told = [got for p in nested if not (got := places.of(p)).beside and got.sign is not None]
    signs = [got.sign for got in told if not got.doubtful] or [got.sign for got in told]
    return Template(frozenset(nested), frozenset(fixed), min(signs, default=None))


def container(path: Path) -> Path:
    """The nearest place around that holds more than a paragraph, heading or list does: its links are judged together."""
    while path.depth and re.split(r"[.#@]", path.own, maxsplit=1)[0] not in CONTAINERS:
        path = path.above
    return path


def extract(blocks: list[Block], template: Template, places: Places) -> str:
    """The page's slots that hold the article, joined."""
    told = [(places.of(b.path), b) for b in blocks]
    sure = any(not got.beside and not got.doubtful and got.sign is not None for got, _ in told)
    # a class like has-sidebar around the article counts only where another article is found
    open_ = [b for got, b in told if not got.beside and not (sure and got.doubtful)]
    if not sure and (doubtful := [b for got, b in told if not got.beside and got.doubtful]):
        open_ = doubtful
    marked = [b for b in open_ if template.sign is not None and (s := places.of(template.slot(b.path)).sign) is not None and s <= template.sign]
    if not marked and (own := min((s for b in open_ if (s := places.of(b.path).sign) is not None), default=None)) is not None:
        marked = [b for b in open_ if places.of(b.path).sign == own]  # a page that is unlike its host's others
    if not marked and template.sign is None:
        own = [b for b in open_ if (b.path, b.text) not in template.fixed]
        length, linked = Counter(), Counter()
        for b in own:
            length[at := container(b.path)] += len(b.text)
            linked[at] += b.linked
        marked = [b for b in own if 2 * linked[at := container(b.path)] <= length[at]]
    return " ".join(b.text for b in marked)


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text)`` for every page.

    A null or empty page has an empty text, and so has one without an article.
    Pages without a host in their url are one host. Repeated pages are extracted
    each. Null ids are passed through. No rows: no rows.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    # written, so that its size is known: while it is small, it is broadcast and pages move once
    groups = scratch.materialise(rows.groupBy("host").agg(F.ceil(F.count("*") / GROUP).alias("groups")), "hosts")
    number = F.pmod(F.xxhash64("id", "url"), F.col("groups")).cast("string")
    # one column, since rows dealt by host alone would count as dealt by host and number
    rows = rows.join(groups, "host").select("id", "url", "html", F.concat_ws(" ", number, "host").alias("group"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        places = Places()
        pages = [parse(x or "") for x in pdf["html"]]
        template = deduce([p for p in pages if p[1]], places)
        return pd.DataFrame({"id": pdf["id"], "url": pdf["url"], "text": [extract(blocks, template, places) for blocks, _ in pages]})

    return rows.groupBy("group").applyInPandas(run, "id long, url string, text string")
