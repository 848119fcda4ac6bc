"""Queries of scores against reference answers and of text helpers, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodechain.functions import text as X
from lodechain.operators import evaluation
from lodechain.plans.metric_queries import PAIRS, pairs
from lodechain.plans.registry import register


def t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROOTS = "list_transform({}, lambda x: string_split(x, '.')[1])"


@register("acceptable_ids", f"WITH {PAIRS} SELECT id, len(list_distinct(list_concat(a, b, {ROOTS.format('a')}, {ROOTS.format('b')})))::INTEGER AS n FROM p")
def acceptable_ids(spark, sf_dir):
    return pairs(spark, sf_dir).select("id", F.size(evaluation.acceptable_ids(F.col("a")[0], F.col("a"), F.col("b"))).alias("n"))


@register("plausible_hits", f"WITH {PAIRS} SELECT id, list_has_any({ROOTS.format('a')}, {ROOTS.format('b')}) AS hit, coalesce(list_position(list_transform(b, lambda x: list_contains({ROOTS.format('a')}, string_split(x, '.')[1])), true), 0)::INTEGER AS place FROM p")
def plausible_hits(spark, sf_dir):
    return pairs(spark, sf_dir).select("id", evaluation.plausible(F.col("b"), F.col("a")).alias("hit"), evaluation.plausible_rank(F.col("b"), F.col("a")).alias("place"))


@register("purity_report", "SELECT user_id % 10 AS g, round(avg((event_type = 'error')::INT), 6) AS purity, round(avg((value > 50)::INT) FILTER (event_type <> 'error'), 6) AS false_plausible FROM events GROUP BY 1")
def purity_report(spark, sf_dir):
    e = t(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("g"), (F.col("event_type") == "error").alias("t"), (F.col("value") > 50).alias("p"))
    return evaluation.purity(e, ["g"], "t", "p").select("g", *[F.round(c, 6).alias(c) for c in ("purity", "false_plausible")])


@register("completeness_report", "SELECT o_orderpriority AS g, count(DISTINCT o_custkey) AS n_reference, count(DISTINCT o_custkey) FILTER (o_orderstatus = 'F') AS n_found, round(count(DISTINCT o_custkey) FILTER (o_orderstatus = 'F') / count(DISTINCT o_custkey)::DOUBLE, 6) AS completeness FROM orders GROUP BY 1")
def completeness_report(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), "o_custkey", "o_orderstatus")
    c = evaluation.completeness(o.where("o_orderstatus = 'F'"), o, ["g"], "o_custkey")
    return c.select("g", "n_reference", "n_found", F.round("completeness", 6).alias("completeness"))


@register("next_accuracy", "SELECT o_orderpriority AS g, count(*) AS n, round(avg((o_orderkey % 7 = o_custkey % 7)::INT), 6) AS top1, round(avg((o_orderkey % 7 IN (o_custkey % 7, (o_custkey + 1) % 7, (o_custkey + 2) % 7))::INT), 6) AS topk FROM orders GROUP BY 1")
def next_accuracy(spark, sf_dir):
    ranked = F.array(*[(F.col("o_custkey") + i) % 7 for i in range(6)])
    o = t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), (F.col("o_orderkey") % 7).alias("truth"), ranked.alias("ranked"))
    return evaluation.next_accuracy(o, ["g"], "truth", "ranked", 3).select("g", "n", F.round("top1", 6).alias("top1"), F.round("topk", 6).alias("topk"))


@register("case_scores", "SELECT l_returnflag AS g, round(sqrt(avg(l_tax)) * sqrt(avg(l_discount)), 6) AS case_score FROM lineitem GROUP BY 1")
def case_scores(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_tax").cast("double").alias("l_tax"), F.col("l_discount").cast("double").alias("l_discount"))
    return evaluation.case_score(rows, ["g"], "l_tax", "l_discount").select("g", F.round("case_score", 6).alias("case_score"))


@register("head_to_head", "SELECT m AS method, count(*) AS n FROM (SELECT 'a' AS m FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW') UNION ALL SELECT 'b' FROM orders WHERE o_orderpriority = '5-LOW' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')) GROUP BY 1")
def head_to_head(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    a, b = evaluation.head_to_head(o.where("o_orderpriority = '1-URGENT'"), o.where("o_orderpriority = '5-LOW'"), ["o_custkey"])
    return a.select(F.lit("a").alias("method")).unionByName(b.select(F.lit("b").alias("method"))).groupBy("method").agg(F.count("*").alias("n"))


@register("truth_pairs", "SELECT o_orderkey AS group_id, l_linenumber::INTEGER AS l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def truth_pairs(spark, sf_dir):
    truth = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("group_id"), (F.col("o_orderstatus") == "F").alias("is_tp"))
    found = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").cast("int").alias("l_linenumber"))
    return evaluation.truth_pairs(truth, found).drop("is_tp")


@register("alerted_groups", "SELECT user_id, count(*) AS n_alerts FROM events WHERE event_type = 'error' GROUP BY 1")
def alerted_groups(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    g = e.groupBy("user_id").agg(F.collect_list("event_id").alias("members"))
    return evaluation.alerted_groups(g, e.where("event_type = 'error'"), "user_id", "members", "event_id")


@register("gated_alerts", """WITH s AS (SELECT user_id % 10 AS g, user_id, max(value) AS score FROM events WHERE user_id % 7 <> 0 GROUP BY 1, 2), m AS (SELECT g, list_sort(list(score))[count(*) // 2 + 1] AS median FROM s GROUP BY 1)
    SELECT e.user_id % 10 AS g, e.user_id, e.event_id FROM events e LEFT JOIN s USING (user_id) LEFT JOIN m ON m.g = e.user_id % 10 WHERE event_type = 'error' AND (score IS NULL OR score >= median)""")
def gated_alerts(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("g", F.col("user_id") % 10)
    scores = e.where("user_id % 7 <> 0").groupBy("g", "user_id").agg(F.max("value").alias("score"))
    return evaluation.gated_alerts(e.where("event_type = 'error'").select("g", "user_id", "event_id"), scores, "g", "user_id", "score")


@register("largest_communities", "SELECT c_nationkey, c_mktsegment, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment)::INTEGER AS rank FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) WHERE n >= 3) WHERE rank <= 2")
def largest_communities(spark, sf_dir):
    g = t(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return evaluation.largest(g, ["c_nationkey"], "n", "c_mktsegment", 2, 3)


@register("campaign_sequences", "SELECT g, string_agg(v, '>' ORDER BY p, v) AS sequence FROM (SELECT DISTINCT l_suppkey AS g, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS p, l_linestatus || '/' || l_returnflag AS v FROM lineitem) GROUP BY 1")
def campaign_sequences(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), "l_returnflag", F.concat_ws("/", "l_linestatus", "l_returnflag").alias("v"))
    return evaluation.campaign_sequences(rows, ["g"], "l_returnflag", "v", ["R", "A"]).select("g", F.array_join("sequence", ">").alias("sequence"))


IP = r"regexp_extract(text, '\d+\.\d+\.\d+\.\d+')"


@register("external_ips", rf"""WITH d AS (SELECT doc_id, {IP} AS ip FROM documents WHERE {IP} <> ''), o AS (SELECT doc_id, ip, list_transform(string_split(ip, '.'), lambda x: try_cast(x AS BIGINT)) AS o FROM d)
    SELECT doc_id, ip, len(list_filter(o, lambda x: x > 255)) = 0 AND NOT regexp_matches(ip, '(^|\.)0\d') AND NOT (o[1] IN (0, 10, 127) OR o[1] >= 224 OR (o[1] = 169 AND o[2] = 254) OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) OR (o[1] = 192 AND o[2] = 168)
      OR (o[1] = 192 AND o[2] = 0 AND o[3] IN (0, 2)) OR (o[1] = 198 AND o[2] IN (18, 19)) OR (o[1] = 198 AND o[2] = 51 AND o[3] = 100) OR (o[1] = 203 AND o[2] = 0 AND o[3] = 113)) AS external FROM o""")
def external_ips(spark, sf_dir):
    d = t(spark, sf_dir, "documents").withColumn("ip", F.regexp_extract("text", r"\d+\.\d+\.\d+\.\d+", 0)).where("ip <> ''")
    return d.select("doc_id", "ip", X.external_ip(F.col("ip")).alias("external"))
