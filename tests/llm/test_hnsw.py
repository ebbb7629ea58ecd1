import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from duotide.llm import hnsw


def cloud(seed=0, groups=60, alone=600, dim=24):
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal((alone, dim))]
    for g in range(groups):
        centre = rng.standard_normal(dim)
        out.append(centre + 0.18 * rng.standard_normal((3 + g, dim)))
    return np.concatenate(out)


def truth(x, cosine=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    return near


def test_graph_finds_neighbours():
    x = hnsw.unit(cloud())
    graph = hnsw.Graph.build(x.astype(np.float32))
    assert [len(level) for level in graph.levels][-1] == len(x) and len(graph.levels) > 1
    near, _ = graph.search(x[:400].astype(np.float32), 64)
    best = np.argsort(-(x[:400] @ x.T), axis=1)[:, :10]
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(near[:, :10].tolist(), best.tolist(), strict=True)])
    assert recall > 0.9


def test_beams_widen_until_the_audit_passes():
    x = hnsw.unit(cloud(1))
    graph = hnsw.Graph.build(x.astype(np.float32))
    cut = hnsw.Graph(graph.x, [*graph.levels[:-1], np.where(np.arange(hnsw.LINKS) < 2, graph.levels[-1], -1)])  # a poor graph
    want = truth(x)
    for g, width in ((graph, None), (cut, hnsw.BEAM)):
        r, c, used = hnsw.links_of(g, x, x, np.arange(len(x)), np.arange(len(x)), 0.9)
        found = np.zeros_like(want)
        found[r, c] = True
        np.fill_diagonal(found, False)
        assert not (found & ~want).any() and (found & want).sum() >= 0.97 * want.sum()
        assert width is None or used > width


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node long, shard int").repartition(3)


@pytest.mark.parametrize("shard_rows", [30_000, 400])
def test_links_and_components(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(hnsw, "QUERY_ROWS", 700)
    x = cloud(2).astype(np.float32)
    x = np.concatenate([x, x[:5], x[:5] * 3, x[-1:].repeat(50, 0)])
    got = {r["id"]: r for r in hnsw.near_duplicates(frame(spark, [(i, v.tolist(), 0, 1, 2) for i, v in enumerate(x)])).collect()}
    want = truth(x.astype(float))
    links = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (links <= want.sum(1)).all() and links.sum() >= 0.98 * want.sum()
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min(label[i], label[want[i]].min(initial=label[i])) for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    same = np.mean([got[i]["component"] == label[i] for i in range(len(x))])
    assert same > 0.98


def test_unsound_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0, 0, 0), (2, [], 0, 0, 0), (3, [0.0, 0.0], 0, 0, 0), (4, [nan, 1.0], 0, 0, 0), (5, [inf, 1.0], 0, 0, 0), (6, [None, 1.0], 0, 0, 0)]
    rows += [(7, [1.0, 0.0], 0, 0, 0), (8, [2.0, -0.0], None, 0, 0), (9, [1.0, 0.0, 0.0], 0, 0, 0), (10, [1.0, 0.01], 0, 0, 0), (None, [1.0, 0.0], 0, 0, 0), (7, [1.0, 0.0], 0, 0, 0), (11, [1e30, 0.0], 0, 0, 0), (12, [1e-30, 0.0], 0, 0, 0), (None, None, 0, 0, 0)]
    got = sorted([tuple(r) for r in hnsw.near_duplicates(frame(spark, rows)).collect()], key=str)
    want = [(i, 0, i) for i in (1, 2, 3, 4, 5, 6, 9, None)] + [(i, 6, 7) for i in (7, 7, 8, 10, 11, 12, None)]
    assert got == sorted(want, key=str)


def test_nothing(spark):
    assert hnsw.near_duplicates(frame(spark, [])).count() == 0
    assert hnsw.near_duplicates(frame(spark, [(1, None, 0, 0, 0)])).collect()[0]["component"] == 1


def test_graphs_are_no_cells_of_tables(spark, monkeypatch):
    """Graphs grow with a shard's rows; a table that holds one brings it through the memory of every task that reads it."""
    written, write = [], hnsw.scratch.materialise

    def noted(df, *args, **kwargs):
        written.append(write(df, *args, **kwargs))
        return written[-1]

    monkeypatch.setattr(hnsw.scratch, "materialise", noted)
    x = np.random.default_rng(3).standard_normal((1500, 8)).astype(np.float32)
    assert hnsw.near_duplicates(frame(spark, [(i, v.tolist(), 0, 1, 2) for i, v in enumerate(x)])).count() == 1500
    cells = [t.agg(F.max(F.length(c))).first()[0] for t in written for c, kind in t.dtypes if kind == "binary"]
    assert cells and max(cells) == 64


def test_memory_of_a_large_group(monkeypatch):
    """All 2,000 x 6,000 pairs are links: they would take 190 MB as places alone."""
    rng = np.random.default_rng(4)
    x = hnsw.unit(np.ones(8) + 0.02 * rng.standard_normal((6000, 8)))
    monkeypatch.setattr(hnsw, "BEAM", 16)
    graph = hnsw.Graph(x.astype(np.float32), [np.full((6000, hnsw.LINKS), -1, np.int32)])
    graph.levels[0][:, 0] = np.roll(np.arange(6000), 1)
    node, copies = rng.permutation(10_000)[:6000], rng.integers(1, 4, 6000)
    tracemalloc.start()
    links, trees = hnsw.meet(graph, x, node, copies, x[:2000], node[:2000], 0.9)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (links == copies.sum() - copies[:2000]).all()
    assert sorted(trees[:, 0].tolist()) == sorted(set(node.tolist()) - {node.min()}) and set(trees[:, 1].tolist()) == {node.min()}
    assert most < 100e6
