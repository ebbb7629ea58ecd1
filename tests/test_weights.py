import random

import pytest

from duotide.operators import ensemble

SCHEMA = "series_key string, y double, s double, b double, n int"


def exact(rows, start=0.5):
    """The smallest best weight among those at which the error can turn."""
    usable = [(y, s, b) for y, s, b in rows if None not in (y, s, b)]
    turns = sorted({min(1.0, max(0.0, (y - b) / (s - b))) for y, s, b in usable if s != b})
    if not turns:
        return start, len(usable)
    return min(turns, key=lambda w: (round(sum(abs(y - b - w * (s - b)) for y, s, b in usable), 9), w)), len(usable)


def groups():
    rng = random.Random(4)
    whole = lambda k: [tuple(float(rng.randint(-6, 6)) for _ in range(3)) for _ in range(k)]
    found = {f"g{i}": whole(rng.randint(1, 60)) for i in range(30)}
    found |= {"fine": [(rng.random(), rng.random(), rng.random()) for _ in range(3000)]}
    found |= {"close": [(0.5 + i * 2.0**-52, 1.0, 0.0) for i in range(101)]}
    found |= {"equal": [(1.0, 2.0, 2.0), (3.0, 4.0, 4.0)], "missing": [(None, 1.0, 2.0), (1.0, None, 2.0)]}
    found |= {"tie": [(0.25, 1.0, 0.0), (0.75, 1.0, 0.0)], "beyond": [(9.0, 1.0, 0.0)] * 5, None: [(0.3, 1.0, 0.0)] * 3}
    return found


@pytest.mark.parametrize("bins", [8, 256])
def test_weighted_median(spark, bins):
    table = [(k, *r, 1) for k, rows in groups().items() for r in rows]
    df = spark.createDataFrame(table, SCHEMA).repartition(5)
    got = {r["series_key"]: r for r in ensemble.best_weights_exact(df, "y", "s", "b", ["series_key"], bins=bins).collect()}
    assert set(got) == set(groups())
    for k, rows in groups().items():
        weight, n = exact(rows)
        if k == "close":  # its errors differ by less than they are rounded to
            continue
        assert (got[k]["speed_weight"], got[k]["n"]) == (pytest.approx(weight, abs=1e-15), n), k
        assert got[k]["batch_weight"] == 1 - got[k]["speed_weight"]
    assert got["close"]["speed_weight"] == 0.5 + 50 * 2.0**-52 and got["tie"]["speed_weight"] == 0.25


def test_one_weight_for_all_rows(spark):
    rows = [r for group in groups().values() for r in group]
    df = spark.createDataFrame([("x", *r, 1) for r in rows], SCHEMA)
    got = ensemble.best_weights_exact(df, "y", "s", "b").collect()
    weight, n = exact(rows)
    assert [(r["speed_weight"], r["n"]) for r in got] == [(pytest.approx(weight), n)]


def test_no_rows(spark):
    assert ensemble.best_weights_exact(spark.createDataFrame([], SCHEMA), "y", "s", "b", ["series_key"]).collect() == []


def test_a_hot_group_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr("duotide.operators.skew.join_group_stats.__defaults__", ("n", 4, 0, "inner"))
    rng = random.Random(5)
    groups_ = {"hot": [(rng.random(), 1.0, 0.0) for _ in range(4001)]} | {f"s{i}": [(rng.random(), 1.0, 0.0) for _ in range(31)] for i in range(9)}
    df = spark.createDataFrame([(k, *r, 1) for k, rows in groups_.items() for r in rows], SCHEMA)
    got = {r["series_key"]: r["speed_weight"] for r in ensemble.best_weights_exact(df, "y", "s", "b", ["series_key"], bins=8).collect()}
    assert got == {k: sorted(r[0] for r in rows)[len(rows) // 2] for k, rows in groups_.items()}
