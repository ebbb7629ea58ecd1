"""Near-duplicate vectors: navigable small-world graphs per shard.

Equal vectors become one. The distinct ones are dealt over shards by hash, and each
shard gets a hierarchy of graphs: every level holds a random sixteenth of the one
below, and a search enters at the top and follows links towards the query, keeping a
beam of the best. Blocks of queries meet every shard. A block widens its beams until
an audit, in which some of its queries are compared with the whole shard, finds
enough of their links; queries whose whole beam are links scan the shard instead.
Every link is verified in double precision.

Graphs are files in the shared folder: a block opens them one after another, so
neither graphs nor copies of the queries are shuffled, and a task holds one graph. It
holds the pairs of a few queries at a time and returns, for each query, how many
vectors it found, and a spanning forest of its links, so its output is linear in its
vectors however large the groups are.
"""

from __future__ import annotations

import io
import posixpath
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duotide import scratch
from duotide.llm import text
from duotide.llm.components import components

#: Links of a node; beam while building; nodes inserted together; sample of a level in the one above.
LINKS, BUILD_BEAM, BATCH, THINNING, SMALL = 32, 48, 1024, 16, 64
#: Rows of a shard, shards at least, rows of a query block, queries searched together.
SHARD_ROWS, MIN_SHARDS, QUERY_ROWS, TOGETHER = 30_000, 2, 4096, 512
#: First beam, widest beam, audited queries a block and shard, recall that passes.
BEAM, WIDEST, AUDIT, RECALL = 64, 512, 256, 0.99
#: Queries compared with a whole shard at once, and of them those whose pairs are held at once.
SCANNED, HELD = 256, 32


def select(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Per row, of candidates sorted by similarity (-1: none), up to m that point in different directions; the nearest fill up."""
    out = np.full((len(ids), m), -1, np.int32)
    for lo in range(0, len(ids), 512):
        c, s = ids[lo : lo + 512], sims[lo : lo + 512]
        v = x[c]
        pair = v @ v.transpose(0, 2, 1)
        valid, taken = c >= 0, np.zeros(c.shape, bool)
        near = np.full(c.shape, -2.0, np.float32)
        for j in range(c.shape[1]):
            take = valid[:, j] & (near[:, j] < s[:, j])
            taken[:, j] = take
            near = np.maximum(near, np.where(take[:, None], pair[:, :, j], -2.0))
        rank = np.where(taken, 0, np.where(valid, 1, 2)) * c.shape[1] + np.arange(c.shape[1])
        first = np.argsort(rank, axis=1, kind="stable")[:, :m]
        out[lo : lo + 512, : first.shape[1]] = np.take_along_axis(np.where(valid, c, -1), first, 1)
    return out


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of the best ``width`` nodes reached from ``entry`` for each query, best first; -1: none."""
    b, rows = len(q), np.arange(len(q))
    seen = np.zeros((b, len(links)), bool)
    ids, sims, todo = np.full((b, width), -1, np.int32), np.full((b, width), -2.0, np.float32), np.zeros((b, width), bool)
    ids[:, 0], sims[:, 0], todo[:, 0] = entry, np.einsum("ij,ij->i", x[entry], q), True
    seen[rows, entry] = True
    while True:
        at = np.where(todo, sims, -3.0).argmax(1)
        a = np.flatnonzero(todo[rows, at])
        if not len(a):
            break
        todo[a, at[a]] = False
        near = links[ids[a, at[a]]]
        r, c = np.nonzero((near >= 0) & ~seen[a[:, None], near])
        if not len(r):
            continue
        node, own = near[r, c], a[r]
        seen[own, node] = True
        s = np.einsum("ij,ij->i", x[node], q[own])
        better = s > sims[own].min(1) if width < 16 else s > sims.min(1)[own]
        r, c, node, s = r[better], c[better], node[better], s[better]
        if not len(r):
            continue
        used, back = np.unique(r, return_inverse=True)
        new_ids, new_sims = np.full((len(used), near.shape[1]), -1, np.int32), np.full((len(used), near.shape[1]), -2.0, np.float32)
        new_ids[back, c], new_sims[back, c] = node, s
        a = a[used]
        all_sims = np.concatenate([sims[a], new_sims], 1)
        best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        sims[a] = np.take_along_axis(all_sims, best, 1)
        ids[a] = np.take_along_axis(np.concatenate([ids[a], new_ids], 1), best, 1)
        todo[a] = np.take_along_axis(np.concatenate([todo[a], new_ids >= 0], 1), best, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


class Graph:
    """Levels from the smallest up to all nodes; nodes of a level are the first ones of the next."""

    def __init__(self, x: np.ndarray, levels: list[np.ndarray]):
        self.x, self.levels = x, levels

    @classmethod
    def build(cls, x: np.ndarray) -> Graph:
        """``x``: unit vectors in random order."""
        sizes = [len(x)]
        while sizes[-1] > SMALL:
            sizes.append(sizes[-1] // THINNING)
        graph = cls(x, [])
        for size in reversed(sizes):
            links = np.full((size, LINKS), -1, np.int32)
            done = len(graph.levels[-1]) if graph.levels else 0
            if done:
                links[:done] = graph.levels[-1]
            while done < size:
                upto = min(size, done + min(BATCH, max(done, SMALL)))
                graph.insert(links, done, upto)
                done = upto
            graph.levels.append(links)
        return graph

    def entries(self, q: np.ndarray, skip: int) -> np.ndarray:
        """Where to enter the level ``skip`` from the last."""
        levels = self.levels[: len(self.levels) - skip]
        if not levels:
            return np.zeros(len(q), np.int64)
        at = (q @ self.x[: len(levels[0])].T).argmax(1)
        for links in levels[1:]:
            at = beam(self.x[: len(links)], links, q, at, 8)[0][:, 0]
        return at

    def insert(self, links: np.ndarray, done: int, upto: int) -> None:
        x, q = self.x, self.x[done:upto]
        inner = q @ q.T
        np.fill_diagonal(inner, -2.0)
        few = min(LINKS // 2, len(q) - 1)
        near = np.argpartition(-inner, few - 1, axis=1)[:, :few] if few > 0 else np.zeros((len(q), 0), np.int64)
        ids, sims = (near + done).astype(np.int32), np.take_along_axis(inner, near, 1)
        if done:
            old = beam(x, links[:done], q, self.entries(q, 0) if self.levels else np.zeros(len(q), np.int64), BUILD_BEAM)
            ids, sims = np.concatenate([ids, old[0]], 1), np.concatenate([sims, old[1]], 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        if not ids.shape[1]:
            return
        own = select(x, ids, sims, LINKS // 2)
        links[done:upto, : LINKS // 2] = own
        r, c = np.nonzero(own >= 0)
        to, source = own[r, c], (r + done).astype(np.int32)
        sim = np.einsum("ij,ij->i", x[to], x[source])
        order = np.lexsort((-sim, to))
        to, source = to[order], source[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, count)
        keep = place < LINKS
        extra = np.full((len(nodes), min(int(count.max()), LINKS)), -1, np.int32)
        extra[np.repeat(np.arange(len(nodes)), count)[keep], place[keep]] = source[keep]
        for lo in range(0, len(nodes), 2048):
            part = slice(lo, lo + 2048)
            ids = np.concatenate([links[nodes[part]], extra[part]], 1)
            ids = np.sort(ids, axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = np.where(ids >= 0, np.einsum("ijk,ik->ij", x[ids], x[nodes[part]]), -2.0).astype(np.float32)
            order = np.argsort(-sims, axis=1, kind="stable")
            links[nodes[part]] = select(x, np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), LINKS)

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        got = [beam(self.x, self.levels[-1], part, self.entries(part, 1), width) for part in (q[i : i + TOGETHER] for i in range(0, len(q), TOGETHER))]
        return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


def unit(v: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that squares neither vanish nor overflow."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def scan(q: np.ndarray, x: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (query, node) with cosine of at least ``least``, by comparing them all, in pieces."""
    for i in range(0, len(q), SCANNED):
        near = q[i : i + SCANNED] @ x.T >= least
        for k in range(0, len(near), HELD):
            r, c = np.nonzero(near[k : k + HELD])
            yield r + (i + k), c


def search_or_scan(graph: Graph, exact: np.ndarray, q: np.ndarray, cosine: float, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) pairs verified at ``cosine``, in pieces; those of a query whose beam is all links are scanned for."""
    for i in range(0, len(q), TOGETHER):
        own = q[i : i + TOGETHER]
        near, sims = graph.search(own.astype(np.float32), width)
        slack = cosine - 1e-4
        full = np.flatnonzero(sims[:, -1] >= slack)  # perhaps more links than the beam holds
        sims[full] = -2.0
        r, k = np.nonzero(sims >= slack)
        c = near[r, k]
        good = np.concatenate([np.einsum("ij,ij->i", own[r[j : j + 65536]], exact[c[j : j + 65536]]) >= cosine for j in range(0, len(r), 65536)] or [np.zeros(0, bool)])
        yield r[good] + i, c[good]
        for r, c in scan(own[full], exact, cosine):
            yield full[r] + i, c


def audited_width(graph: Graph, exact: np.ndarray, q: np.ndarray, own: np.ndarray, ids: np.ndarray, cosine: float) -> int:
    """The beam with which some of the queries find enough of their links; ``len(exact)``: scan."""
    some = np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(np.int64))
    truth = (q[some] @ exact.T >= cosine) & (own[some, None] != ids)
    links, width = np.count_nonzero(truth), min(BEAM, len(exact))
    while width <= WIDEST and width < len(exact):
        if not links or sum(np.count_nonzero(truth[r, c]) for r, c in search_or_scan(graph, exact, q[some], cosine, width)) >= RECALL * links:
            return width
        width *= 2
    return len(exact)


def pieces(graph: Graph, exact: np.ndarray, q: np.ndarray, cosine: float, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    return search_or_scan(graph, exact, q, cosine, width) if width < len(exact) else scan(q, exact, cosine)


def links_of(graph: Graph, exact: np.ndarray, q: np.ndarray, own: np.ndarray, ids: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(query, node) pairs verified at ``cosine``, and the beam that passed the audit. ``exact``, ``q``: unit vectors in double."""
    width = audited_width(graph, exact, q, own, ids, cosine)
    found = list(pieces(graph, exact, q, cosine, width))
    return np.concatenate([r for r, _ in found]), np.concatenate([c for _, c in found]), width


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of ``a`` and ``b``, pair by pair; ``root`` has the smallest member of everyone's set."""
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root[:] = root[root]


def meet(graph: Graph, exact: np.ndarray, node: np.ndarray, copies: np.ndarray, q: np.ndarray, own: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """For each query, how many vectors it is linked with, copies counted; a spanning forest of the links, each vector under the smallest of its group."""
    links, every = np.zeros(len(own), np.int64), np.union1d(own, node)
    left, right, root = np.searchsorted(every, own), np.searchsorted(every, node), np.arange(len(every))
    width = audited_width(graph, exact, q, own, node, cosine)
    for r, c in pieces(graph, exact, q, cosine, width):
        apart = own[r] != node[c]
        r, c = r[apart], c[apart]
        links += np.bincount(r, weights=copies[c], minlength=len(own)).astype(np.int64)
        unite(root, left[r], right[c])
    under = np.flatnonzero(root != np.arange(len(every)))
    return links, np.stack([every[under], every[root[under]]], 1)


def _matrix(cells) -> np.ndarray:
    return np.frombuffer(b"".join(cells), "<f8").reshape(len(cells), -1)


def near_duplicates(df: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, n_links, component)`` for every row.

    Vectors that are null, empty, zero or hold a null or non-finite component have
    no links and are their own component. Only vectors of one length are compared.
    Equal vectors are linked; rows that repeat an id count as vectors of their own.
    A row with a null id keeps it; it names no component. No rows: no rows.
    """
    spark = df.sparkSession
    v = F.col("v")
    sound = v.isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = scratch.materialise(rows.withColumn("v", F.when(F.coalesce(sound, F.lit(False)), F.transform(v, lambda x: x + F.lit(0.0)))), "vectors")
    classes = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    classes = classes.withColumn("node", F.monotonically_increasing_id())

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = [np.asarray(x, "<f8").tobytes() for x in batch.column("v").to_pylist()]
        return text.record(node=batch.column("node"), first=batch.column("first"), copies=batch.column("copies"), v=pa.array(packed, pa.binary()))

    classes = scratch.materialise(classes, "classes")
    packed = text.map_batches(classes, pack, "node long, first long, copies long, v binary").withColumn("dim", F.length("v"))
    total = classes.count()
    shards, blocks = max(MIN_SHARDS, -(-total // SHARD_ROWS)), max(1, -(-total // QUERY_ROWS))
    packed = packed.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")).withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.lit(blocks)).cast("int"))
    packed = scratch.materialise(packed, "packed")

    folder = scratch.new_dir(spark, "graphs")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node").sample(frac=1.0, random_state=0)
        exact = unit(_matrix(pdf["v"].tolist()))
        graph = Graph.build(exact.astype(np.float32))
        files, top = scratch.opened(folder)
        files.create_dir(top, recursive=True)
        file, blob = f"{uuid.uuid4().hex}.npz", io.BytesIO()  # a task that is repeated writes another file
        np.savez(blob, exact=exact, node=pdf["node"].to_numpy(), copies=pdf["copies"].to_numpy(), **{f"level{i}": x for i, x in enumerate(graph.levels)})
        with files.open_output_stream(posixpath.join(top, file)) as f:
            f.write(blob.getbuffer())
        return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], "shard": [int(pdf["shard"].iloc[0])], "file": [file]})

    graphs = defaultdict(list)
    for dim, _, file in sorted(map(tuple, packed.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, file string").collect())):  # one row a shard
        graphs[dim].append(file)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = pd.concat(list(batches))
        own, q = block["node"].to_numpy(), unit(_matrix(block["v"].tolist()))
        links = np.zeros(len(own), np.int64)
        files, top = scratch.opened(folder)
        for file in graphs[int(block["dim"].iloc[0])]:
            with files.open_input_file(posixpath.join(top, file)) as f, np.load(f) as z:
                exact, node, copies = z["exact"], z["node"], z["copies"]
                levels = [z[f"level{i}"] for i in range(len(z.files) - 3)]
            found, trees = meet(Graph(exact.astype(np.float32), levels), exact, node, copies, q, own, cosine)
            links += found
            yield pd.DataFrame({"a": trees[:, 0], "b": trees[:, 1], "n": np.zeros(len(trees), np.int64)})
        has = np.flatnonzero(links)
        yield pd.DataFrame({"a": own[has], "b": np.full(len(has), -1), "n": links[has]})

    dealt = packed.repartition(4 * blocks, "dim", "block")  # few blocks share a task
    found = dealt.groupBy("dim", "block").applyInPandas(ask, "a long, b long, n long")
    found = scratch.materialise(found, "links")
    linked = found.where("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    stars = components(found.where("b >= 0").select("a", "b"))
    named = classes.join(linked, "node", "left").join(stars, "node", "left").select("v", "first", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "node").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component"))
    named = named.join(smallest, "root").select("v", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component")
    out = rows.join(named, "v", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))
