"""Vectors against a catalogue: no row for each pair, and odd vectors."""

import pytest
from pyspark.sql import functions as F

from lodechain.operators import vectors
from lodechain.plans import registry

#: Queries whose plan must not make a row for each pair.
NAMES = [
    "catalogue_topk_all",
    "confidence_gate_all",
    "confidence_margin_all",
    "family_boost_all",
    "knn_anomaly_all",
    "reciprocal_rank_all",
    "rule_priors_all",
    "technique_mapping_all",
    "confidence_margin",
    "confidence_gate",
    "rule_priors",
    "catalogue_topk",
    "technique_mapping",
    "reciprocal_rank",
    "family_boost",
    "knn_anomaly",
    "technique_distribution_all",
    "technique_distribution",
]


@pytest.mark.parametrize("name", NAMES)
def test_no_row_for_each_pair(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan and "Join Cross" not in plan


def test_odd_vectors(spark):
    """Null vectors, null components and vectors of other lengths have no value and come last; equal vectors go by id, an id that
    stands twice has both rows; values that are no numbers come first."""
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.0]), (2, 0, [1.0, 0.0]), (3, 1, [0.5, None]), (4, 1, None), (5, 2, [1.0, 2.0, 3.0]), (6, None, [0.0, 1.0]), (7, 3, [float("nan"), 1.0])]
    v = spark.createDataFrame(rows, "id long, label int, x array<float>")
    q = v.select(F.col("id").alias("q"), F.col("label").alias("ql"), F.col("x").alias("qe")).where("q in (1, 5)")
    c = v.select(F.col("id").alias("c"), F.col("label").alias("cl"), F.col("x").alias("ce"))
    for score in (None, vectors.Prior()):
        got = [(r.q, r.c, r.sim) for r in vectors.top(q, c, 4, 100, score).collect()]
        assert sorted(str(x) for x in got if x[0] == 1) == sorted(["(1, 7, nan)", "(1, 1, 1.0)", "(1, 2, 1.0)", "(1, 2, 1.0)"])
        assert [(c, s) for q, c, s in got if q == 5 and s is not None] == [(5, 14.0)]
    near = [(r.c, r.sim) for r in vectors.top(q.where("q = 1"), c.where("c < 7"), 4, 100, vectors.Near()).collect()]
    assert sorted(near) == [(1, 0.0), (2, 0.0), (2, 0.0), (6, 2**0.5)]
    others = {r.c for r in vectors.top(q.where("q = 1"), c.where("c < 7"), 2, 100, others=True).collect()}
    assert others == {2}
