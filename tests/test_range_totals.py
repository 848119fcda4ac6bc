"""Interval joins as totals, against all pairs."""

import random

import pytest

from lodechain.operators.range_join import range_join_totals


@pytest.mark.parametrize("repeats", [1, 5])
def test_range_join_totals(spark, repeats):
    """Totals of an interval join without its pairs: ids that come back near or far, anchors of one id at several times,
    repeated rows, an anchor's own id among the events, equal times and nulls."""
    r = random.Random(repeats)
    pick = lambda n: [(r.choice([1, 2, None]), r.choice([*range(n), None]), r.randrange(120)) for _ in range(n * repeats)]
    a, b = pick(25), pick(30)
    a += a[:4]
    for before, after in ((6, 18), (0, 0), (5, 0)):
        want = {}
        for k, x, at in a:
            for k2, y, t in b:
                if None not in (k, x, k2, y) and k == k2 and x != y and at - before <= t <= at + after:
                    want.setdefault(x, []).append(y)
        got = range_join_totals(spark.createDataFrame(a, "k long, a long, at long"), spark.createDataFrame(b, "k long, i long, t long"), ["k"], "a", "at", "i", "t", before, after)
        assert {(x.a, x.n, x.total) for x in got.collect()} == {(x, len(set(ys)), sum(ys)) for x, ys in want.items()}
