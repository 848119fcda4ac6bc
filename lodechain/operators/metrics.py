"""Evaluation of chains and rankings as column functions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodechain.functions.text import root
from lodechain.operators.sequence import jaccard, lcs, order_accuracy, set_scores


def matched_positions(reference: Column, chain: Column, family: bool = True) -> Column:
    """For each reference step the first position of the chain that matches it (by family on demand), else null."""
    name = root if family else (lambda c: c)
    return F.transform(reference, lambda r: F.nullif(F.array_position(F.transform(chain, name), name(r)), F.lit(0)))


def chain_alignment(df: DataFrame, reference: str, chain: str, reference_tactics: str, chain_tactics: str) -> DataFrame:
    """Step coverage, tactic Jaccard, tactic and technique LCS over the reference's length, order accuracy. An empty
    chain scores 0; an empty reference too."""
    r, c = F.col(reference), F.col(chain)
    at = matched_positions(r, c)
    share = lambda n, d: F.when(F.size(d) > 0, n / F.size(d)).otherwise(0.0)
    rt, ct = F.col(reference_tactics), F.col(chain_tactics)
    return df.withColumns(
        {
            "step_coverage": share(F.size(F.filter(at, lambda x: x.isNotNull())), r),
            "tactic_jaccard": jaccard(rt, ct),
            "tactic_lcs": share(lcs(rt, ct), rt),
            "technique_lcs": share(lcs(F.transform(r, root), F.transform(c, root)), r),
            "order_accuracy": order_accuracy(at),
        }
    )


def strict_metrics(df: DataFrame, reference: str, chain: str) -> DataFrame:
    """LCS over the longer length, precision, recall and F1 of steps, strict and by family; an empty chain is a miss."""
    r, c = F.col(reference), F.col(chain)
    longest = F.greatest(F.size(r), F.size(c))
    p, q, f1 = set_scores(r, c)
    _, _, family_f1 = set_scores(F.transform(r, root), F.transform(c, root))
    return df.withColumns({"strict_lcs": F.when(longest > 0, lcs(r, c) / longest).otherwise(0.0), "precision": p, "recall": q, "f1": f1, "family_f1": family_f1, "false_chain": F.size(c) == 0})


def ranking(df: DataFrame, key: list[str], truth: str, candidates: str, k: int = 5, family: bool = False) -> DataFrame:
    """Mean hit@1, hit@k and reciprocal rank by key; rows without candidates are misses."""
    name = root if family else (lambda c: c)
    at = F.coalesce(F.array_position(F.transform(F.col(candidates), name), name(F.col(truth))), F.lit(0))
    mean = lambda c: F.avg(c.cast("double"))
    return df.groupBy(*key).agg(F.count("*").alias("n"), mean(at == 1).alias("hit1"), mean((at >= 1) & (at <= k)).alias("hitk"), F.avg(F.when(at > 0, 1 / at).otherwise(0.0)).alias("mrr"))


def leaderboard(df: DataFrame, method: str, measures: list[str], digits: int = 4) -> DataFrame:
    """Macro averages of each method."""
    return df.groupBy(method).agg(*[F.round(F.avg(m), digits).alias(m) for m in measures])


def override_rate(df: DataFrame, key: list[str], chosen: str, top: str) -> DataFrame:
    """Share of steps whose chosen technique is not the emission's first."""
    return df.groupBy(*key).agg(F.avg((~F.col(chosen).eqNullSafe(F.col(top))).cast("double")).alias("override_rate"))
