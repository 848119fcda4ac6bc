"""Window and sequence operators, sequence metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapse(df: DataFrame, key: list[str], order: list[str], value: list[str]) -> DataFrame:
    """Rows whose value differs from the row before (null equals null)."""
    w = Window.partitionBy(*key).orderBy(*order)
    now, before = F.struct(*value), F.lag(F.struct(*value)).over(w)
    return df.withColumn("__new", F.row_number().over(w).eqNullSafe(1) | ~now.eqNullSafe(before)).where("__new").drop("__new")


def gaps(df: DataFrame, key: list[str], order: list[str], time: str, out: str = "gap") -> DataFrame:
    return df.withColumn(out, F.col(time) - F.lag(time).over(Window.partitionBy(*key).orderBy(*order)))


def bursts(df: DataFrame, key: list[str], time: str, span: int, size: int = 3) -> DataFrame:
    """For each key the first window of ``size`` consecutive events within ``span``: its start and width, and the
    key's number of events. Keys without a burst are absent."""
    w = Window.partitionBy(*key)
    d = df.withColumns({"__w": F.lead(time, size - 1).over(w.orderBy(time)) - F.col(time), "__n": F.count("*").over(w)})
    return d.where(F.col("__w") <= span).groupBy(*key).agg(F.min(time).alias("burst_start"), F.min_by("__w", time).alias("burst_width"), F.first("__n").alias("n_events"))


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays: a fold over rows of the table. Null or empty: 0."""
    a, b = F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit(0), F.size(b) + 1)

    def row(prev: Column, x: Column) -> Column:
        cell = lambda acc, j: F.concat(acc, F.array(F.when(b[j - 1] == x, prev[j - 1] + 1).otherwise(F.greatest(prev[j], F.element_at(acc, -1)))))
        return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(F.lit(0)), cell)

    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(F.element_at(F.aggregate(a, zeros, row), -1))


def edit_distance(a: Column, b: Column, symbols: list[str]) -> Column:
    """Levenshtein distance of two arrays over a fixed alphabet, by way of one character for each symbol."""
    code = F.create_map(*[x for i, s in enumerate(symbols) for x in (F.lit(s), F.lit(chr(0x4E00 + i)))])
    text = lambda c: F.array_join(F.transform(c, lambda s: code[s]), "")
    return F.levenshtein(text(a), text(b))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def order_accuracy(positions: Column) -> Column:
    """Share of consecutive matched references with rising predicted position; one match 1, none 0."""
    p = F.filter(positions, lambda x: x.isNotNull())
    pairs = F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda x, y: (x < y).cast("int"))
    rising = F.aggregate(F.filter(pairs, lambda x: x.isNotNull()), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(p) == 0, 0.0).when(F.size(p) == 1, 1.0).otherwise(rising / (F.size(p) - 1))


def ordered_merge(a: Column, b: Column, k: int) -> Column:
    """Distinct values of two lists in order, the first ``k``."""
    return F.slice(F.array_distinct(F.concat(a, b)), 1, k)


def set_scores(truth: Column, found: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of two sets; 0 where a denominator is 0."""
    both = F.size(F.array_intersect(truth, found))
    p = F.when(F.size(F.array_distinct(found)) > 0, both / F.size(F.array_distinct(found))).otherwise(0.0)
    r = F.when(F.size(F.array_distinct(truth)) > 0, both / F.size(F.array_distinct(truth))).otherwise(0.0)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def auc(df: DataFrame, key: list[str], score: str, positive: str) -> DataFrame:
    """Mann-Whitney AUC of each key with half credit for ties; null where a class is empty."""
    w = Window.partitionBy(*key).orderBy(score)
    tie = Window.partitionBy(*key, score)
    d = df.withColumn("__rank", F.rank().over(w) + (F.count("*").over(tie) - 1) / 2)
    p, n = F.sum(F.when(F.col(positive), 1).otherwise(0)), F.sum(F.when(F.col(positive), 0).otherwise(1))
    wins = F.sum(F.when(F.col(positive), F.col("__rank")).otherwise(0.0)) - p * (p + 1) / 2
    return d.groupBy(*key).agg(F.when((p > 0) & (n > 0), wins / (p * n)).alias("auc"))
