"""Retrieval and probability operators: priors, BM25, fusion, family and keyword boosts. Similarities and softmax are in ``vectors``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a catalogue that are held at once (a technique catalogue has hundreds); see ``vectors``.
MOST = 100_000


def rule_prior(score: Column, same_root: Column, same_tactic: Column, root_boost: float = 1.15, tactic_boost: float = 1.05) -> Column:
    return score * F.when(same_root, root_boost).when(same_tactic, tactic_boost).otherwise(1.0)


def bm25(docs: DataFrame, doc: str, tokens: str, query: list[str], k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(doc, score) of documents that hold a query token. Inverse document frequencies are log((N - df + .5) / (df +
    .5)); a negative one is replaced by ``epsilon`` times the mean over the vocabulary."""
    long = docs.select(doc, F.size(tokens).alias("len"), F.explode(tokens).alias("t"))
    stats = docs.agg(F.count("*").alias("N"), F.avg(F.size(tokens)).alias("avgdl"))
    tf = long.groupBy(doc, "len", "t").agg(F.count("*").alias("tf"))
    df = tf.groupBy("t").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(stats)).withColumn("idf", F.log(F.col("N") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = idf.agg(F.avg("idf").alias("mean"))
    wanted = idf.where(F.col("t").isin(query)).crossJoin(F.broadcast(mean)).withColumn("idf", F.when(F.col("idf") < 0, epsilon * F.col("mean")).otherwise(F.col("idf")))
    hit = tf.join(F.broadcast(wanted), "t")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    return hit.groupBy(doc).agg(F.sum(part).alias("score"))


def fuse(dense: Column, lexical: Column, dense_max: Column, lexical_max: Column, weight: float = 0.15) -> Column:
    """((1 - w) * dense / max + w * lexical / max) * dense max; without lexical evidence the dense score as it is."""
    lex = F.when(lexical_max > 0, lexical / lexical_max).otherwise(0.0)
    return F.when(dense_max > 0, ((1 - weight) * dense / dense_max + weight * lex) * dense_max).otherwise(dense)


def keyword_strength(text: Column, signatures: Column) -> Column:
    """0 without a match, else min(0.4 + 0.2 * (matches - 1), 1)."""
    m = F.size(F.filter(signatures, lambda s: text.contains(s)))
    return F.when(m > 0, F.least(0.4 + 0.2 * (m - 1), F.lit(1.0))).otherwise(0.0)


def family_boost(df: DataFrame, key: list[str], rank: str, family: str, score: str, top: int = 10, step: float = 0.15) -> DataFrame:
    """Scores among the first ``top`` rise by ``step`` for each sibling there."""
    inside = F.col(rank) <= top
    siblings = F.sum(F.when(inside, 1).otherwise(0)).over(Window.partitionBy(*key, family))
    return df.withColumn(score, F.when(inside, F.col(score) * (1 + step * (siblings - 1))).otherwise(F.col(score)))


def top_k(df: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("bigint")).where(F.col("rank") <= k)


def mapped(first: DataFrame, key: list[str], technique: str, k: int = 5, signature_weight: float = 0.0, signature_width: int = 10, family_step: float = 0.0, family_width: int = 10) -> DataFrame:
    """(key, rank, technique, similarity, p, margin): the ``k`` likeliest techniques of each key.

    ``first`` has the pairs of each key of greatest weight (``vectors.weighed``), as many as ``k`` and both widths at least, with
    ``similarity``, ``weight``, ``total`` (the sum of the weights of all pairs of the key), ``family`` and ``strength`` (of keyword
    signatures). The first few are raised by signatures and put in order anew among themselves, and so again by
    siblings; p is the share of what results. The margin is the lead of the first in p, 1 where it stands alone. Ties
    go to the higher similarity, then to the smaller technique; null strengths count as none.
    """
    w, e = Window.partitionBy(*key), F.col("__e")
    place = lambda *first: F.row_number().over(w.orderBy(*first, F.col("__e").desc(), F.col("similarity").desc(), technique))
    s = first.withColumn("__e", F.col("weight")).withColumn("__r", place())
    s = s.where(F.col("__r") <= max(k, 2, signature_width, family_width))
    s = s.withColumn("__e", F.when(F.col("__r") <= signature_width, e * (1 + signature_weight * F.coalesce("strength", F.lit(0.0)))).otherwise(e))
    beyond = lambda width: F.when(F.col("__r") > width, F.col("__r")).otherwise(0)
    s = s.withColumn("__r", place(beyond(signature_width)))
    s = family_boost(s, key, "__r", "family", "__e", family_width, family_step)
    s = s.withColumn("__r", place(beyond(family_width))).withColumn("p", e / (F.col("total") + F.sum(e - F.col("weight")).over(w)))
    at = lambda n: F.max(F.when(F.col("__r") == n, F.col("p"))).over(w)
    s = s.withColumn("margin", F.coalesce(at(1) - at(2), F.lit(1.0)))
    return s.where(F.col("__r") <= k).select(*key, F.col("__r").cast("long").alias("rank"), technique, "similarity", "p", "margin")
