"""Queries over whole tables and whole sequences, against plain versions on small tables."""

import numpy as np
import pytest

from lodechain.operators import anomaly, graph, retrieval
from lodechain.plans import registry


@pytest.fixture
def vectors(spark, tmp_path):
    r = np.random.default_rng(7)
    x, label = r.normal(size=(430, 6)), r.integers(0, 9, 430)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x.astype(np.float32)
    folder = str(tmp_path)
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder, x.astype(float), label


@pytest.mark.parametrize("most", [100_000, 150])
def test_all_vectors(spark, vectors, monkeypatch, most):
    """All 430 vectors are queries and all are candidates, in one block and in several."""
    monkeypatch.setattr(retrieval, "MOST", most)
    monkeypatch.setattr(anomaly, "MOST", most)
    folder, x, label = vectors
    rows = lambda name: registry.QUERIES[f"{name}_all"](spark, folder).collect()
    s, n = x @ x.T, len(x)
    order = np.argsort(-s, 1, kind="stable")
    top = {(q, int(c), k + 1) for q in range(n) for k, c in enumerate(order[q, :5])}
    assert {(r.q, r.c, r["rank"]) for r in rows("catalogue_topk")} == top
    p = np.exp(10 * s)
    p /= p.sum(1, keepdims=True)
    got = rows("technique_distribution")
    assert len(got) == n * n and all(abs(r.p - p[r.q, r.c]) < 1e-5 for r in got)
    gap = np.abs(label[:, None] - label[None])
    b = s * np.where(gap == 0, 1.15, np.where(gap == 1, 1.05, 1))
    assert {(r.q, r.c) for r in rows("rule_priors")} == {(q, int(c)) for q in range(n) for c in np.argsort(-b[q], kind="stable")[:5]}
    got, want = {(r.q, r.c): r.score for r in rows("family_boost")}, {}
    for q in range(n):
        for k, c in enumerate(order[q, :20]):
            want[q, int(c)] = s[q, c] * (1 + 0.15 * ((label[order[q, :10]] == label[c]).sum() - 1) if k < 10 else 1)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-4 for k in got)
    got = {r.q: r.margin for r in rows("confidence_margin")}
    assert len(got) == n and all(abs(got[q] - (s[q, order[q, 0]] - s[q, order[q, 1]])) < 2e-5 for q in got)
    others = [[c for c in order[q] if c != q][:10] for q in range(n)]
    first = np.array([next((k + 1 for k, c in enumerate(o) if label[c] == label[q]), 0) for q, o in enumerate(others)])
    got = {r.label: r for r in rows("reciprocal_rank")}
    for g in set(label.tolist()):
        f = first[label == g]
        assert got[g].n == len(f) and abs(got[g].hit1 - (f == 1).mean()) < 1e-5 and abs(got[g].mrr - np.where(f > 0, 1 / np.maximum(f, 1), 0).mean()) < 1e-5
    assert {(r.q, r.c) for r in rows("confidence_gate")} == {(q, int(o[0])) for q, o in enumerate(others) if s[q, o[0]] >= 0.35}
    got = {(r.q, r["rank"]): r for r in rows("technique_mapping")}
    assert len(got) == 5 * n
    for q in range(n):
        e, c = np.exp(10 * (s[q] - s[q].max())) * np.where(gap[q] == 0, 1.15, np.where(gap[q] == 1, 1.05, 1)), np.arange(n)
        lexical = (q + 7 * c) % 11
        e = e if q % 300 == 0 else (0.7 * e / e.max() + 0.3 * lexical / lexical.max()) * e.max()
        o = sorted(c, key=lambda i: (-e[i], -s[q, i], i))
        e[o[:10]] *= 1 + 0.5 * ((q + np.array(o[:10])) % 4) / 10
        o[:10] = sorted(o[:10], key=lambda i: (-e[i], -s[q, i], i))
        family = label[o[:10]] % 5
        e[o[:10]] *= [1 + 0.15 * ((family == f).sum() - 1) for f in family]
        o[:10] = sorted(o[:10], key=lambda i: (-e[i], -s[q, i], i))
        p = e / e.sum()
        for k in range(5):
            r = got[q, k + 1]
            assert r.c == o[k] and abs(r.p - p[o[k]]) < 1e-5 and abs(r.margin - (p[o[0]] - p[o[1]])) < 1e-5
    d = np.sqrt(((x[:, None] - x[None, label < 5]) ** 2).sum(2))
    got = {r.vec_id: r.score for r in rows("knn_anomaly")}
    assert len(got) == n and all(abs(got[q] - np.sort(d[q])[:10].mean()) < 2e-4 for q in got)


def test_communities(spark):
    """Rounds of the most frequent neighbouring label, ties to the smallest."""
    r = np.random.default_rng(3)
    edges = [(int(a), int(b) + 100) for a, b in r.integers(0, 40, (150, 2))] + [(7, 7)]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    label = {k: k for k in near}
    for _ in range(3):
        label = {k: min((-sum(label[x] == v for x in xs), v) for v in {label[x] for x in xs})[1] for k, xs in near.items()}
    got = graph.label_communities(spark.createDataFrame(edges, "a long, b long"), 3)
    assert {x.k: x.root for x in got.collect()} == label
