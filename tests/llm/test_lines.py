import hashlib
import inspect
from collections import defaultdict

import duckdb
import pandas as pd

from duotide.llm import lines

BLANKS = " \t\n\x0b\x0c\r"
LONG = "A line that is shared by very many Documents ÄÖ"


def plain(rows):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))

    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    last = {k: max(x for x in h if x is not None) for k, h in holders.items() if len(h) >= 5}
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if last.get(key(x), i) == i]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def found(df):
    return sorted([tuple(r) for r in lines.drop_shared_lines(df).select("id", "n_lines", "n_dropped", "text").collect()], key=str)


def by_sql(rows):
    docs = pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": pd.Series([r[1] for r in rows], dtype=object)})
    con = duckdb.connect()
    con.register("documents", docs)
    got = con.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({lines.lines_sql()})").fetchall()
    return sorted(got, key=str)


def hashed(rows):
    return sorted([(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in rows], key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_shared_lines(spark):
    rows = [(i, f"own {i}\n\t {LONG if i % 2 else LONG.upper().replace('Ä', 'ä')} \r\nend\n{LONG}") for i in range(9)]
    rows += [(i, f"{LONG}\n{LONG}\n") for i in range(20, 24)]  # in four documents only when the others differ
    rows += [(i, "B" * 40 + f"\n{'c' * 39}") for i in range(30, 35)]  # 40 code points, and one too short
    rows += [(i, "é" * 40 + "\n" + " " * 50) for i in range(40, 44)]  # held by four
    rows += [(i, "\n\n" + "z" * 40 + "\n") for i in range(50, 55)]
    want = plain(rows)
    assert found(table(spark, rows)) == want and by_sql(rows) == hashed(want)
    assert {r[0] for r in want if r[2] == 0} >= {40, 41, 42, 43, 54, 34, 23}


def test_repeated_rows_null_ids_and_nulls(spark):
    rows = [(1, LONG)] * 4 + [(2, LONG), (3, f"{LONG}\nx"), (3, f"y\n{LONG}"), (None, LONG), (None, f"a\n{LONG}"), (None, None), (4, None), (5, "")]
    assert plain(rows)[0][2] == 0  # held by 1, 2, 3 and the rows without an id: four documents
    assert found(table(spark, rows)) == plain(rows)
    rows += [(0, LONG)]
    want = plain(rows)
    assert found(table(spark, rows)) == want and by_sql(rows) == hashed(want)
    assert {r[3] for r in want if r[0] == 3} == {f"y\n{LONG}", f"{LONG}\nx"} and (None, 1, 1, "") in want


def test_other_thresholds(spark):
    rows = [(i, f"abc\nAbC \nlonger {i}") for i in range(3)]
    got = lines.drop_shared_lines(table(spark, rows), min_chars=3, min_docs=3).select("id", "n_dropped", "text").collect()
    assert sorted(map(tuple, got)) == [(0, 2, "longer 0"), (1, 2, "longer 1"), (2, 0, "abc\nAbC \nlonger 2")]


def test_many_lines_in_one_text(spark):
    long = "\n".join(f"{LONG} number {i % 5000}" for i in range(120_000))
    rows = [(i, f"{long}\nmine {i}") for i in range(6)]
    assert found(table(spark, rows)) == plain(rows)


def test_awkward(awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert found(awkward) == plain(rows) and by_sql(rows) == hashed(plain(rows))
    assert found(nothing) == []


def test_native(spark):
    """No Python on the main path."""
    plan = lines.drop_shared_lines(spark.range(3).selectExpr("id AS doc_id", "'a' AS text"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "RDD"))
    source = inspect.getsource(lines)
    assert "udf" not in source and "mapIn" not in source and ".rdd" not in source and "collect()" not in source
