"""Queries of evaluation metrics and parameter grids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodechain.operators import decode, metrics, sequence
from lodechain.plans.chain_queries import candidate, event_nodes, viterbi_sql
from lodechain.plans.registry import register

PAIRS = """p AS (SELECT o_custkey AS id, list('T' || (o_orderkey % 6) || '.' || (o_orderkey % 2) ORDER BY o_orderkey) AS a, list('T' || (o_orderkey % 5) || '.' || (o_orderkey % 3) ORDER BY o_orderkey DESC) AS b FROM orders GROUP BY 1)"""


def pairs(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    tid = lambda m, n: F.concat(F.lit("T"), (F.col("o_orderkey") % m).cast("string"), F.lit("."), (F.col("o_orderkey") % n).cast("string"))
    named = lambda n, m: F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", tid(n, m).alias("t")))), lambda x: x["t"])
    g = o.groupBy(F.col("o_custkey").alias("id")).agg(named(6, 2).alias("a"), F.reverse(named(5, 3)).alias("b"))
    return g


@register(
    "chain_alignment",
    f"""WITH {PAIRS}, r AS (SELECT id, list_transform(a, lambda x: string_split(x, '.')[1]) AS a, list_transform(b, lambda x: string_split(x, '.')[1]) AS b FROM p), m AS (SELECT *, list_filter(list_transform(a, lambda x: coalesce(list_position(b, x), 0)), lambda x: x > 0) AS pos FROM r)
    SELECT id, round(len(pos) / len(a)::DOUBLE, 6) AS step_coverage, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS tactic_jaccard,
      round(CASE WHEN len(pos) = 0 THEN 0 WHEN len(pos) = 1 THEN 1 ELSE len(list_filter(range(1, len(pos)), lambda i: pos[i] < pos[i + 1])) / (len(pos) - 1)::DOUBLE END, 6)::DOUBLE AS order_accuracy FROM m""",
)
def chain_alignment(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumns({"ta": F.transform("a", lambda x: F.substring_index(x, ".", 1)), "tb": F.transform("b", lambda x: F.substring_index(x, ".", 1))})
    m = metrics.chain_alignment(p, "a", "b", "ta", "tb")
    return m.select("id", *[F.round(c, 6).alias(c) for c in ("step_coverage", "tactic_jaccard", "order_accuracy")])


@register(
    "strict_metrics",
    f"""WITH {PAIRS}, s AS (SELECT id, len(list_intersect(list_distinct(a), list_distinct(b))) AS i, len(list_distinct(a)) AS na, len(list_distinct(b)) AS nb FROM p)
    SELECT id, round(i / nb::DOUBLE, 6) AS precision, round(i / na::DOUBLE, 6) AS recall, round(CASE WHEN i > 0 THEN 2.0 * i / (na + nb) ELSE 0 END::DOUBLE, 6) AS f1, FALSE AS false_chain FROM s""",
)
def strict_metrics(spark, sf_dir):
    m = metrics.strict_metrics(pairs(spark, sf_dir), "a", "b")
    return m.select("id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "false_chain")


@register(
    "ranking_metrics",
    f"""WITH {PAIRS}, m AS (SELECT id % 7 AS g, coalesce(list_position(b, a[1]), 0) AS pos FROM p) SELECT g, count(*) AS n, round(avg((pos = 1)::INT), 6) AS hit1, round(avg((pos BETWEEN 1 AND 3)::INT), 6) AS hitk, round(avg(CASE WHEN pos > 0 THEN 1.0 / pos ELSE 0 END), 6) AS mrr FROM m GROUP BY 1""",
)
def ranking_metrics(spark, sf_dir):
    p = pairs(spark, sf_dir).select((F.col("id") % 7).alias("g"), F.col("a")[0].alias("truth"), "b")
    r = metrics.ranking(p, ["g"], "truth", "b", 3)
    return r.select("g", "n", *[F.round(c, 6).alias(c) for c in ("hit1", "hitk", "mrr")])


@register("override_rate", f"WITH {PAIRS} SELECT id % 7 AS g, round(avg((a[1] IS DISTINCT FROM b[1])::INT), 6) AS override_rate FROM p GROUP BY 1")
def override_rate(spark, sf_dir):
    p = pairs(spark, sf_dir).select((F.col("id") % 7).alias("g"), F.col("a")[0].alias("x"), F.col("b")[0].alias("y"))
    return metrics.override_rate(p, ["g"], "x", "y").select("g", F.round("override_rate", 6).alias("override_rate"))


@register("method_leaderboard", "SELECT l_shipmode AS method, round(avg(x), 4) AS x, round(avg(y), 4) AS y FROM (SELECT l_returnflag AS l_shipmode, l_tax AS x, l_discount AS y FROM lineitem) GROUP BY 1")
def method_leaderboard(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("method"), F.col("l_tax").alias("x"), F.col("l_discount").alias("y"))
    return metrics.leaderboard(li, "method", ["x", "y"])


@register(
    "rule_priority",
    """WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 3 DESC, p_size DESC, p_partkey DESC) AS r FROM part) SELECT p_brand, p_partkey, r AS rank FROM r WHERE r <= 5""",
)
def rule_priority(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    w = Window.partitionBy("p_brand").orderBy((F.col("p_size") % 3).desc(), F.col("p_size").desc(), F.col("p_partkey").desc())
    return p.withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 5").select("p_brand", "p_partkey", "rank")


@register("decode_sweep", " UNION ALL ".join(f"SELECT user_id, {a}::DOUBLE AS alpha, path FROM ({viterbi_sql(a, 3)})" for a in (0.1, 0.5, 0.9)))
def decode_sweep(spark, sf_dir):
    """Best chains of each user's events for several weights of the transitions, in one job."""
    seq = event_nodes(spark, sf_dir, candidate(0, 0.6), candidate(3, 0.3))
    grid = F.array(*[F.struct(F.lit(a).alias("alpha"), F.array_join(decode.viterbi(F.col("nodes"), alpha=a)["path"], ">").alias("path")) for a in (0.1, 0.5, 0.9)])
    return seq.select("user_id", F.inline(grid))


@register("chain_equality", "SELECT count(*) AS n, count(*) FILTER (x) AS same FROM (SELECT o_custkey, min(o_orderpriority) = max(o_orderpriority) AS x FROM orders GROUP BY 1)")
def chain_equality(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("a"), F.max("o_orderpriority").alias("b"))
    return o.agg(F.count("*").alias("n"), F.count(F.when(F.col("a").eqNullSafe(F.col("b")), 1)).alias("same"))


@register(
    "collapsed_pairs",
    """WITH l AS (SELECT conv_id, turn, role, length(text) % 3 AS c, lag(role) OVER w AS r1, lag(length(text) % 3) OVER w AS c1, row_number() OVER w AS rn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn FROM l WHERE rn = 1 OR role IS DISTINCT FROM r1 OR c IS DISTINCT FROM c1""",
)
def collapsed_pairs(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("c", F.length("text") % 3)
    return sequence.collapse(c, ["conv_id"], ["turn"], ["role", "c"]).select("conv_id", "turn")
