"""Groups of near member sets, against all pairs."""

import random

import pytest

from lodechain.operators import grouping


@pytest.mark.parametrize("least,universe,most,cell", [(0.9, 40, 39, 1024), (0.9, 30, 29, 16), (0.5, 12, 6, 8), (1.0, 5, 3, 4)])
def test_merge_overlapping(spark, monkeypatch, least, universe, most, cell):
    """Equal sets, dense and sparse ones, one tile and many; an empty set stays alone."""
    monkeypatch.setattr(grouping, "CELL", cell)
    r = random.Random(universe)
    rows = []
    for i in range(240):
        s = set(r.sample(range(universe), r.randint(1, most)))
        if rows and r.random() < 0.5:  # near one that is there
            s = set(r.choice(rows)[2]) ^ set(r.sample(range(universe), r.randint(0, 2)))
        rows.append((r.choice("xy"), i, sorted(s)))
    root = {i: i for _, i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i, s in rows:
        for k2, j, u in rows:
            o = len(set(s) & set(u))
            if k == k2 and i < j and o and o >= least * (len(s) + len(u) - o):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    got = grouping.merge_overlapping(spark.createDataFrame(rows, "key string, gid long, m array<int>"), "key", "gid", "m", least)
    assert {x.gid: x.root for x in got.collect()} == {i: top(i) for i in root}


def test_no_pairs(spark, monkeypatch):
    """3,000 near sets, equal ones and others, have 4.5 million pairs; the links that are rows grow with the sets."""
    links = []
    monkeypatch.setattr(grouping, "components", lambda e, f=grouping.components: links.append(e.count()) or f(e))
    rows = spark.range(3000).selectExpr("'x' key", "id gid", "filter(sequence(1, 40), x -> x <> id % 3 + 1) m")
    got = grouping.merge_overlapping(rows, "key", "gid", "m", 0.9)
    assert {x.root for x in got.collect()} == {0} and links[0] < 4000
