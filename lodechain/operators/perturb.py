"""Perturbations for robustness studies; deterministic, free of row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(idx: Column, seed: int) -> Column:
    """A number below 1000 that depends on the row's index and the seed only."""
    return (idx * 48271 + seed) % 1000003 % 1000


def random_drop(df: DataFrame, idx: str, share: float, seed: int) -> DataFrame:
    return df.where(draw(F.col(idx), seed) >= round(share * 1000))


def anchor_drop(df: DataFrame, anchors: DataFrame, idx: str, share: float, seed: int) -> DataFrame:
    gone = anchors.where(draw(F.col(idx), seed) < round(share * 1000)).select(idx)
    return df.join(gone, idx, "left_anti")


def burst_drop(df: DataFrame, key: list[str], order: list[str], share: float, at: float) -> DataFrame:
    """Without a contiguous ``share`` of each key's rows that begins after the share ``at``."""
    w = Window.partitionBy(*key)
    d = df.withColumns({"__r": F.row_number().over(w.orderBy(*order)), "__n": F.count("*").over(w)})
    first = F.floor(F.col("__n") * at)
    return d.where(~((F.col("__r") > first) & (F.col("__r") <= first + F.floor(F.col("__n") * share)))).drop("__r", "__n")


def type_drop(df: DataFrame, key: list[str], kind: str, priority: list[str], order: str, share: float) -> DataFrame:
    """Without rows of the kinds in ``priority``, in that order, up to a share of each key's rows."""
    w = Window.partitionBy(*key)
    p = F.nullif(F.array_position(F.array(*map(F.lit, priority)), F.col(kind)), F.lit(0))
    d = df.withColumns({"__p": p, "__budget": F.floor(F.count("*").over(w) * share)})
    d = d.withColumn("__r", F.row_number().over(w.orderBy(F.col("__p").asc_nulls_last(), order)))
    return d.where(F.col("__p").isNull() | (F.col("__r") > F.col("__budget"))).drop("__p", "__budget", "__r")
