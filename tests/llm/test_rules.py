import os
from collections import Counter

import duckdb
import pytest

from check import compare
from duotide.llm import catalog, rules

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(t):
    t = t or ""
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", t) if x]
    lines = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, inside = Counter(wins), set()
    for i, x in enumerate(wins):
        if n[x] > 1:
            inside |= {i, i + 1, i + 2}
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside), failed)


def test_measures(awkward):
    got = rules.judge(awkward).collect()
    texts = {r["doc_id"]: r["text"] for r in awkward.collect() if r["doc_id"] is not None}
    assert len(got) == awkward.count()
    for r in got:
        if r["id"] is not None:
            assert tuple(r)[1:7] == plain(texts[r["id"]])
            assert not (r["base_failed"] and r["kept"])


def test_order_does_not_change_the_verdict():
    estimates = [(r.name, 0.001 * (i + 1), 0.5) for i, r in enumerate(rules.RULES)]
    assert [r.name for r in rules.ordered(estimates)] == [r.name for r in rules.RULES]
    flipped = [(r.name, 0.001, 0.1 * i) for i, r in enumerate(rules.RULES)]
    assert [r.name for r in rules.ordered(flipped)] == [r.name for r in reversed(rules.RULES)]


def test_keeps_rows_whole(awkward):
    kept = rules.keeps(awkward)
    assert kept.schema == awkward.schema
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(r["id"] for r in rules.judge(awkward).collect() if r["kept"] and r["id"] is not None)


def test_nothing(nothing):
    assert rules.judge(nothing).count() == 0 and rules.keeps(nothing).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_DIR}/documents.parquet')")
    assert compare(catalog.op2_quality_rules(spark, SF_DIR).toPandas(), con.execute(catalog.OP2_SQL).df()) == "ok"
