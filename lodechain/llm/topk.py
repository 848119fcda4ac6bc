"""Operator 10: exact top-k inner products over norm-sorted vectors.

Vectors are rotated onto the eigenvectors of their second-moment matrix (the right singular vectors of the data), so
that the first dimensions carry most of an inner product. Candidates are dealt by descending norm and read in that
order. For a block of candidates a query first takes the partial product over the first dimensions; what the rest can
add is at most the product of the two residual norms (Cauchy-Schwarz). Only candidates whose bound reaches the query's
k-th best score so far get their exact integer product, and a query stops where its norm times the block's largest norm
falls below that score. Queries start from the k-th best score among the longest vectors.

Queries go to the tasks in groups of bounded size; each group is one more pass over the candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodechain.llm.common import trimmed
from lodechain.session import Scratch, cut

#: Queries in a pass are bounded by so many bytes of rotated vectors.
GROUP_BYTES = 64 << 20
SEEDS = 2048
BLOCK = 1024
#: Queries that meet a block of candidates at once.
TILE = 4096
FOUND = "query_id long, vec_id long, score long"


def quantise(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as double; null for a vector that is null, empty, or holds a null or
    non-finite component."""
    x = embedding.cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(good & (F.size(x) > 0), F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _rows(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """Orthonormal directions by descending second moment of all vectors; the matrix is summed in the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((d, d))
        for b in batches:
            x = _rows(b.column(0), d).astype(np.float64)
            m += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(m.ravel())], names=["at", "v"])

    m = np.zeros(d * d)
    for r in vectors.select("x").mapInArrow(trimmed(run), "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        m[r.at] = r.v
    return np.linalg.eigh(m.reshape(d, d))[1][:, ::-1]


class Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, ids: np.ndarray, floor: np.ndarray, k: int):
        self.own, self.floor, self.k = ids, floor.copy(), k
        self.q = np.empty(0, np.int64)
        self.s, self.v = self.q, self.q

    def add(self, q: np.ndarray, s: np.ndarray, v: np.ndarray) -> None:
        good = (s >= self.floor[q]) & (v != self.own[q])
        q, s, v = (np.concatenate([old, new[good]]) for old, new in ((self.q, q), (self.s, s), (self.v, v)))
        order = np.lexsort((v, -s, q))
        q, s, v = q[order], s[order], v[order]
        first = np.searchsorted(q, q, "left")
        rank = np.arange(len(q)) - first
        top = rank < self.k
        self.q, self.s, self.v = q[top], s[top], v[top]
        full = self.k - 1 == rank[top]
        self.floor[self.q[full]] = np.maximum(self.floor[self.q[full]], self.s[full])


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products of integer rows, exact within 64 bits."""
    return np.einsum("ij,ij->i", a, b)


def search_block(best: Best, queries: dict, x: np.ndarray, ids: np.ndarray, turn: np.ndarray, head: int) -> bool:
    """Take in a block of candidates sorted by descending norm; False if no query can gain from it or from any
    shorter vector."""
    y = x @ turn
    norm = np.sqrt((y * y).sum(1))
    slack = 1e-9 * (1 + queries["norm"] * norm[0])
    active = np.flatnonzero(queries["norm"] * norm[0] + slack >= best.floor)
    if not len(active):
        return False
    rest = np.sqrt((y[:, head:] ** 2).sum(1))
    for some in np.split(active, range(TILE, len(active), TILE)):
        bound = queries["turned"][some, :head] @ y[:, :head].T + np.outer(queries["rest"][some], rest)
        qi, ci = np.nonzero(bound + slack[some, None] >= best.floor[some, None])
        for lo in range(0, len(qi), 1 << 16):
            q, c = some[qi[lo : lo + (1 << 16)]], ci[lo : lo + (1 << 16)]
            best.add(q, _exact(queries["x"][q], x[c]), ids[c])
    return True


def prepare(x: np.ndarray, turn: np.ndarray, head: int) -> dict:
    y = x @ turn
    return {"x": x, "turned": y, "norm": np.sqrt((y * y).sum(1)), "rest": np.sqrt((y[:, head:] ** 2).sum(1))}


def _search(vectors: DataFrame, is_query: Column, k: int, d: int, scratch: Scratch) -> list[DataFrame]:
    spark = vectors.sparkSession
    turn, head = rotation(vectors, d), max(1, d // 4)
    ordered = cut(vectors.repartitionByRange(F.col("norm2").desc(), "id").sortWithinPartitions(F.col("norm2").desc(), "id"))
    seeds = ordered.orderBy(F.col("norm2").desc(), "id").limit(SEEDS).collect()
    seed_x, seed_ids = np.array([r.x for r in seeds]).reshape(-1, d), np.array([r.id for r in seeds])
    asked = cut(ordered.where(is_query).groupBy("id").agg(F.min("x").alias("x")))
    groups = -(-asked.count() * d * 24 // GROUP_BYTES)
    out = []
    for g in range(groups):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == g).orderBy("id").collect()
        if not rows:
            continue
        ids, x = np.array([r.id for r in rows]), np.array([r.x for r in rows]).reshape(-1, d)
        start = Best(ids, np.full(len(ids), np.iinfo(np.int64).min), k)
        for lo in range(0, len(ids), 256):
            s = x[lo : lo + 256] @ seed_x.T
            q = np.repeat(np.arange(lo, lo + len(s)), len(seed_ids))
            start.add(q, s.ravel(), np.tile(seed_ids, len(s)))
        shared = spark.sparkContext.broadcast((ids, x, start.floor, turn))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, x, floor, turn = shared.value
            best, queries, live = Best(ids, floor, k), prepare(x, turn, head), True
            for b in batches:
                cand, at = _rows(b.column(1), d), b.column(0).to_numpy()
                for lo in range(0, len(at) if live else 0, BLOCK):
                    live = search_block(best, queries, cand[lo : lo + BLOCK], at[lo : lo + BLOCK], turn, head)
                    if not live:
                        break
            yield pa.RecordBatch.from_arrays([pa.array(ids[best.q]), pa.array(best.v, pa.int64()), pa.array(best.s, pa.int64())], names=["query_id", "vec_id", "score"])

        out.append(scratch.put(ordered.select("id", "x").mapInArrow(trimmed(run), FOUND)))
        shared.destroy()  # one group's queries at a time
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 5, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that ``is_query`` marks (a condition on column ``id``), its
    k largest integer inner products with every other row, ties to the smaller id.

    Vectors that are null or hold null or non-finite components, and rows without an id, take no part. Vectors meet
    those of their own length only. A repeated query id asks once, with its smallest vector; repeated candidates each
    count; a row never meets its own id. An empty table gives an empty result. Other columns are not read. Vectors so long
    that an integer product might not fit into 64 bits are an error.
    """
    good = vectors.select(F.col(id).cast("long").alias("id"), quantise(F.col(embedding)).alias("x")).where("id is not null and x is not null")
    good = good.withColumn("norm2", F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    found, scratch = [], Scratch(vectors.sparkSession, "topk")
    for d, longest in sorted(good.groupBy(F.size("x").alias("d")).agg(F.max("norm2")).collect()):
        if longest >= 2.0**62:
            raise ValueError("inner products of these vectors may exceed 64 bits")
        found += _search(good.where(F.size("x") == d), is_query, k, d, scratch)
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
