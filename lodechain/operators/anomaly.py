"""Outlier operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodechain.operators import vectors

#: Rows of a benign reference set that are held at once.
MOST = 100_000


def knn_score(rows: DataFrame, benign: DataFrame, id: str, vector: str, k: int = 10) -> DataFrame:
    """(id, score): mean Euclidean distance to the ``k`` nearest benign vectors, which are held in blocks of about ``MOST``. Only
    the k smallest distances of each row are kept while the reference set is scanned; pairs without a distance come last."""
    q = rows.select(F.col(id).alias("q"), F.lit(0).alias("ql"), F.col(vector).alias("qe"))
    c = benign.select(F.col(id).alias("c"), F.lit(0).alias("cl"), F.col(vector).alias("ce"))
    near = vectors.top(q, c, k, MOST, vectors.Near())
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.col("sim").asc_nulls_last()))).where(F.col("r") <= k)
    return best.groupBy(F.col("q").alias(id)).agg(F.avg("sim").alias("score"))


def local_outliers(rows: DataFrame, scenario: str, idx: str, fields: list[str], k: int = 20, contamination: float = 0.1) -> DataFrame:
    """(scenario, idx, outlier): local outlier factor over each scenario's distinct tuples of codes by first
    appearance, standardised; the ``contamination`` share with the highest factors is marked, and marks go back to all
    rows of a tuple. A scenario with at most k tuples has none."""
    w = Window.partitionBy(scenario)
    coded = rows.select(scenario, idx, *[F.col(f).cast("string").alias(f) for f in fields])
    for f in fields:
        coded = coded.withColumn(f"__f{f}", F.min(idx).over(Window.partitionBy(scenario, f)))
    coded = coded.withColumns({f"__c{f}": F.dense_rank().over(w.orderBy(f"__f{f}")) for f in fields})
    codes = [f"__c{f}" for f in fields]
    tuples = coded.select(scenario, *codes).distinct()

    def factors(pdf):
        import numpy as np

        x = pdf[codes].to_numpy(float)
        n = len(x)
        out = np.zeros(n, bool)
        if n > k:
            sd = x.std(0)
            x = (x - x.mean(0)) / np.where(sd > 0, sd, 1)
            near, dist = np.empty((n, k), int), np.empty((n, k))
            for lo in range(0, n, 256):
                d = np.sqrt(((x[lo : lo + 256, None] - x[None]) ** 2).sum(2))
                d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
                near[lo : lo + 256] = np.argsort(d, 1, kind="stable")[:, :k]
                dist[lo : lo + 256] = np.take_along_axis(d, near[lo : lo + 256], 1)
            reach = np.maximum(dist, dist[near, -1])
            density = 1 / (reach.mean(1) + 1e-10)
            lof = density[near].mean(1) / density
            out[np.argsort(-lof, kind="stable")[: int(contamination * n)]] = True
        return pdf.assign(outlier=out)

    kind = ", ".join(f"{c} int" for c in codes)
    marked = tuples.groupBy(scenario).applyInPandas(factors, f"{scenario} {dict(rows.dtypes)[scenario]}, {kind}, outlier boolean")
    return coded.join(marked, [scenario, *codes]).select(scenario, idx, "outlier")
