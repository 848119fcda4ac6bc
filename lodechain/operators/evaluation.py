"""Scores of groups, chains and alerts against reference answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodechain.functions.text import root


def acceptable_ids(primary: Column, *others: Column) -> Column:
    """A primary id, alternative ids (arrays) and the roots of all of them, each once, in that order; nulls left out."""
    every = F.array_compact(F.concat(F.array(primary), *[F.coalesce(o, F.array().cast("array<string>")) for o in others]))
    return F.array_distinct(F.concat(every, F.transform(every, root)))


def plausible(candidates: Column, acceptable: Column) -> Column:
    """Whether any candidate belongs to the family of an acceptable id."""
    return F.coalesce(F.arrays_overlap(F.transform(candidates, root), F.transform(acceptable, root)), F.lit(False))


def plausible_rank(candidates: Column, acceptable: Column) -> Column:
    """Place (from 1) of the first candidate of an acceptable family, 0 if there is none."""
    families = F.transform(acceptable, root)
    return F.array_position(F.transform(candidates, lambda c: F.array_contains(families, root(c))), True).cast("int")


def purity(groups: DataFrame, by: list[str], true: str, looks_true: str) -> DataFrame:
    """Share of true groups, and among the others the share that looks true; null where there are no others."""
    return groups.groupBy(*by).agg(F.avg(F.col(true).cast("int")).alias("purity"), F.avg(F.when(~F.col(true), F.col(looks_true).cast("int"))).alias("false_plausible"))


def completeness(found: DataFrame, reference: DataFrame, by: list[str], item: str) -> DataFrame:
    """Share of each reference set's distinct items that were found, with both numbers."""
    keys = [*by, item]
    hit = reference.select(*keys).distinct().join(found.select(*keys).distinct().withColumn("__hit", F.lit(1)), keys, "left")
    g = hit.groupBy(*by).agg(F.count("*").alias("n_reference"), F.count("__hit").alias("n_found"))
    return g.withColumn("completeness", F.col("n_found") / F.col("n_reference"))


def next_accuracy(rows: DataFrame, by: list[str], truth: str, ranked: str, k: int = 5) -> DataFrame:
    """Shares of predictions whose first, or one of whose first ``k``, is the truth."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.coalesce(F.get(ranked, F.lit(0)) == F.col(truth), F.lit(False)).cast("int")).alias("top1"),
        F.avg(F.coalesce(F.array_contains(F.slice(ranked, 1, k), F.col(truth)), F.lit(False)).cast("int")).alias("topk"),
    )


def case_score(rows: DataFrame, by: list[str], similarity: str, transition: str) -> DataFrame:
    """Geometric mean of a chain's mean similarity and mean transition."""
    return rows.groupBy(*by).agg(F.sqrt(F.avg(similarity) * F.avg(transition)).alias("case_score"))


def head_to_head(a: DataFrame, b: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both methods' rows of the scenarios that both have."""
    return a.join(b.select(*by).distinct(), by, "left_semi"), b.join(a.select(*by).distinct(), by, "left_semi")


def truth_pairs(truth: DataFrame, predicted: DataFrame, key: str = "group_id", positive: str = "is_tp") -> DataFrame:
    """True positive groups with their predictions; others are left out."""
    return truth.where(F.col(positive)).join(predicted, key)


def alerted_groups(groups: DataFrame, alerts: DataFrame, gid: str, members: str, index: str) -> DataFrame:
    """``gid`` and number of distinct alerts of the groups that hold an alert's event."""
    m = groups.select(gid, F.explode(members).alias(index))
    return m.join(alerts.select(index).distinct(), index).groupBy(gid).agg(F.countDistinct(index).alias("n_alerts"))


def upper_medians(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The value at place n // 2 (from 0) of each sorted group, from counts of equal values."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by)
    place = counted.withColumns({"__to": F.sum("__n").over(w.orderBy(value)), "__all": F.sum("__n").over(w)})
    return place.where(F.col("__to") > F.floor(F.col("__all") / 2)).groupBy(*by).agg(F.min(value).alias("median"))


def gated_alerts(alerts: DataFrame, scores: DataFrame, scenario: str, entity: str, score: str) -> DataFrame:
    """Alerts whose entity has no score, or one at or above its scenario's upper median."""
    known = scores.select(scenario, entity, F.col(score).alias("__score"))
    j = alerts.join(known, [scenario, entity], "left").join(F.broadcast(upper_medians(known, [scenario], "__score")), scenario, "left")
    return j.where(F.col("__score").isNull() | (F.col("__score") >= F.col("median"))).select(*alerts.columns)


def largest(groups: DataFrame, by: list[str], size: str, ties: str, most: int = 20, least: int = 3) -> DataFrame:
    """The ``most`` largest groups of each scenario with ``least`` members or more; ties to the smaller name."""
    w = Window.partitionBy(*by).orderBy(F.col(size).desc(), ties)
    return groups.where(F.col(size) >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def campaign_sequences(rows: DataFrame, by: list[str], tactic: str, item: str, order: list[str]) -> DataFrame:
    """Distinct items of a campaign by the place of their tactic in ``order`` (unknown ones last), then by name."""
    place = F.nullif(F.array_position(F.array(*map(F.lit, order)), F.coalesce(tactic, F.lit("Unknown"))), F.lit(0))
    step = F.struct(F.coalesce(place, F.lit(len(order) + 1)).alias("p"), F.col(item).alias("v"))
    return rows.groupBy(*by).agg(F.transform(F.sort_array(F.collect_set(step)), lambda x: x["v"]).alias("sequence"))
