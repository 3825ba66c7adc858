"""Every surveyed query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from kinloom.plans import surveyed

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(f"{r[i]:.6f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(surveyed.SQL))
def test_rows_equal_the_sql(spark, duck, name):
    got = surveyed.QUERIES[name](spark, DATA)
    want = duck.sql(surveyed.SQL[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_stable_matching_has_no_blocking_pair(spark):
    from kinloom.operators.vectors import dominant_matching, stable_matching
    from kinloom.session import Scratch

    sims = {(i, j): ((i * 37 + j * 61) % 101) / 101 + i / 1e4 + j / 1e6 for i in range(8) for j in range(8)}
    df = spark.createDataFrame([(i, j, s) for (i, j), s in sims.items()], "i bigint, j bigint, sim double")
    got = {r.i: r.j for r in stable_matching(Scratch(spark, "t"), df).collect()}
    assert sorted(got) == sorted(got.values()) == list(range(8))
    back = {j: i for i, j in got.items()}
    assert not [(i, j) for (i, j), s in sims.items() if s > sims[i, got[i]] and s > sims[back[j], j]]
    greedy, left, right = 0.0, set(range(8)), set(range(8))
    for (i, j), s in sorted(sims.items(), key=lambda x: -x[1]):
        if i in left and j in right:
            greedy, left, right = greedy + s, left - {i}, right - {j}
    assert abs(sum(r.sim for r in dominant_matching(Scratch(spark, "t"), df).collect()) - greedy) < 1e-9
