"""Queries over the event stream: anchors, groups, windows, caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodechain.operators import grouping, perturb, sequence
from lodechain.operators.range_join import micros, range_join, range_join_totals
from lodechain.plans.registry import register

HOUR = 3_600_000_000
BEFORE, AFTER = 6 * HOUR, 18 * HOUR
SUPPORT = ["click", "purchase"]
E = "(SELECT *, epoch_us(ts) AS t, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.withColumns({"t": micros(F.col("ts")), "k": F.get_json_object("props", "$.k").cast("bigint")})


def big_errors(e: DataFrame) -> DataFrame:
    return grouping.anchors(e, "event_type", [(["error"], {})]).where("value > 200")


@register(
    "behaviour_groups",
    f"""WITH e AS {E}, a AS (SELECT * FROM e WHERE event_type = 'error' AND value > 200)
    SELECT a.event_id AS anchor_idx, a.user_id, array_to_string(list_sort(list(DISTINCT e.event_id)), ',') AS all_idxs,
      count(*) FILTER (e.event_type IN ('click', 'purchase') AND e.event_id <> a.event_id) AS n_support,
      count(DISTINCT e.event_type) FILTER (e.event_type IN ('click', 'purchase')) / 2.0::DOUBLE AS confidence
    FROM a JOIN e ON e.user_id = a.user_id AND e.t BETWEEN a.t - {BEFORE} AND a.t + {AFTER}
    WHERE e.event_type IN ('click', 'purchase') OR e.event_id = a.event_id GROUP BY 1, 2""",
)
def behaviour_groups(spark, sf_dir):
    e = events(spark, sf_dir)
    g = grouping.groups(big_errors(e), e, "user_id", "t", "event_type", "event_id", SUPPORT, BEFORE, AFTER)
    return g.withColumn("all_idxs", F.array_join(F.transform("all_idxs", lambda x: x.cast("string")), ","))


@register(
    "anchor_predicates",
    """SELECT event_id, event_type FROM events WHERE (event_type IN ('error', 'signup') AND contains(lower(props), '"k": 1'))
    OR (event_type = 'view' AND NOT contains(lower(props), '9'))""",
)
def anchor_predicates(spark, sf_dir):
    specs = [(["error", "signup"], {"props": '"K": 1', "note": "x"}), (["view"], {"props": {"not_contains": "9", "contains": "never read"}})]
    return grouping.anchors(events(spark, sf_dir), "event_type", specs).select("event_id", "event_type")


@register("noise_anchors", "SELECT event_id FROM events WHERE event_type = 'error' AND user_id % 10 <> 3")
def noise_anchors(spark, sf_dir):
    e = events(spark, sf_dir)
    return grouping.anchors(e, "event_type", [(["error"], {})], F.col("user_id") % 10 == 3).select("event_id")


@register(
    "interval_join",
    f"""WITH e AS {E} SELECT a.event_id AS signup_id, count(*) AS n, min(b.event_id) AS first_id, sum(b.t - a.t) AS total_us
    FROM e a JOIN e b ON a.user_id = b.user_id AND b.t BETWEEN a.t - {HOUR} AND a.t + {3 * HOUR}
    WHERE a.event_type = 'signup' AND b.event_type = 'view' GROUP BY 1""",
)
def interval_join(spark, sf_dir):
    e = events(spark, sf_dir)
    a = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup_id"), F.col("t").alias("at"))
    b = e.where("event_type = 'view'").select("user_id", "event_id", "t")
    return range_join(a, b, ["user_id"], "at", "t", HOUR, 3 * HOUR).groupBy("signup_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.sum(F.col("t") - F.col("at")).alias("total_us"))


@register(
    "shared_artifact_groups",
    f"""WITH e AS {E} SELECT a.event_id AS anchor_idx, count(DISTINCT b.event_id) AS n_linked, sum(b.event_id)::BIGINT AS id_sum
    FROM e a JOIN e b ON a.k = b.k AND b.t BETWEEN a.t - {BEFORE} AND a.t + {AFTER} AND a.event_id <> b.event_id
    WHERE a.event_type = 'error' AND b.event_type IN ('click', 'view') GROUP BY 1""",
)
def shared_artifact_groups(spark, sf_dir):
    e = events(spark, sf_dir)
    a = e.where("event_type = 'error'").select("k", F.col("event_id").alias("anchor_idx"), F.col("t").alias("at"))
    b = e.where("event_type in ('click', 'view')").select("k", "event_id", "t")
    return range_join_totals(a, b, ["k"], "anchor_idx", "at", "event_id", "t", BEFORE, AFTER).select("anchor_idx", F.col("n").alias("n_linked"), F.col("total").alias("id_sum"))


@register(
    "merge_same_anchor",
    """WITH g AS (SELECT user_id AS anchor_idx, event_type AS technique_id, count(*) % 3 AS confidence, min(event_id) AS ord, list(DISTINCT event_id % 7) AS idx FROM events GROUP BY 1, 2)
    SELECT anchor_idx, first(technique_id ORDER BY confidence DESC, ord) AS technique_id, max(confidence) AS confidence, (SELECT array_to_string(list_sort(list(DISTINCT u)), ',') FROM (SELECT event_id % 7 u FROM events x WHERE x.user_id = g.anchor_idx)) AS all_idxs,
      array_to_string(list_sort(list(technique_id)), ',') AS matched_techniques, count(*) AS merged_count FROM g GROUP BY anchor_idx""",
)
def merge_same_anchor(spark, sf_dir):
    g = events(spark, sf_dir).groupBy(F.col("user_id").alias("anchor_idx"), F.col("event_type").alias("technique_id")).agg((F.count("*") % 3).alias("confidence"), F.min("event_id").alias("ord"), F.collect_set(F.col("event_id") % 7).alias("all_idxs"))
    m = grouping.merge_same_anchor(g)
    return m.withColumns({"all_idxs": F.array_join(F.transform("all_idxs", lambda x: x.cast("string")), ","), "matched_techniques": F.array_join("matched_techniques", ",")})


@register(
    "merge_overlapping_groups",
    f"""WITH RECURSIVE g AS (SELECT DISTINCT event_type AS technique, user_id * 10 + CAST(floor(value / 40) AS BIGINT) % 4 AS gid, event_id % 97 AS m FROM {E}),
    n AS (SELECT technique, gid, count(*) AS n FROM g GROUP BY 1, 2),
    p AS (SELECT a.technique, a.gid AS x, b.gid AS y, count(*) AS c FROM g a JOIN g b USING (technique, m) WHERE a.gid <> b.gid GROUP BY 1, 2, 3),
    ed AS (SELECT p.technique, x, y FROM p JOIN n n1 ON n1.technique = p.technique AND n1.gid = x JOIN n n2 ON n2.technique = p.technique AND n2.gid = y WHERE c >= 0.9 * (n1.n + n2.n - c)),
    r AS (SELECT technique, gid, gid AS node FROM n UNION SELECT r.technique, r.gid, ed.y FROM r JOIN ed ON ed.technique = r.technique AND ed.x = r.node)
    SELECT technique, gid, min(node) AS root FROM r GROUP BY 1, 2""",
)
def merge_overlapping_groups(spark, sf_dir):
    e = events(spark, sf_dir)
    g = e.groupBy(F.col("event_type").alias("technique"), (F.col("user_id") * 10 + F.floor(F.col("value") / 40) % 4).alias("g")).agg(F.collect_set(F.col("event_id") % 97).alias("m"))
    g = g.withColumn("gid", F.concat_ws(":", "technique", F.lpad(F.col("g").cast("string"), 8, "0")))
    out = grouping.merge_overlapping(g, "technique", "gid", "m", 0.9)
    return out.select(F.split("gid", ":")[0].alias("technique"), F.split("gid", ":")[1].cast("bigint").alias("gid"), F.split("root", ":")[1].cast("bigint").alias("root"))


@register("event_histogram", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_histogram(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@register(
    "temporal_stats",
    f"""WITH g AS (SELECT user_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM {E})
    SELECT user_id, min(gap) AS min_gap, max(gap) AS max_gap, sum(gap)::BIGINT AS sum_gap, max(t) - min(t) AS span, count(*) AS n FROM g GROUP BY 1""",
)
def temporal_stats(spark, sf_dir):
    g = sequence.gaps(events(spark, sf_dir), ["user_id"], ["t"], "t")
    return g.groupBy("user_id").agg(F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"), F.sum("gap").alias("sum_gap"), (F.max("t") - F.min("t")).alias("span"), F.count("*").alias("n"))


@register(
    "bursts",
    f"""WITH w AS (SELECT user_id, event_type, t, lead(t, 2) OVER (PARTITION BY user_id, event_type ORDER BY t) - t AS w, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM {E})
    SELECT user_id, event_type, min(t) AS burst_start, arg_min(w, t) AS burst_width, first(n) AS n_events FROM w WHERE w <= {24 * HOUR} GROUP BY 1, 2""",
)
def bursts(spark, sf_dir):
    return sequence.bursts(events(spark, sf_dir), ["user_id", "event_type"], "t", 24 * HOUR)


@register(
    "first_identity",
    """WITH p AS (SELECT *, list_position(['purchase', 'signup', 'click'], event_type) AS pr FROM events)
    SELECT user_id, arg_min(event_id, pr * 100000000 + event_id) AS event_id, arg_min(event_type, pr * 100000000 + event_id) AS event_type FROM p WHERE pr IS NOT NULL GROUP BY 1""",
)
def first_identity(spark, sf_dir):
    e = events(spark, sf_dir)
    p = F.array_position(F.array(*map(F.lit, ("purchase", "signup", "click"))), F.col("event_type"))
    best = F.min(F.struct(p.alias("p"), "event_id", "event_type"))
    return e.where(p > 0).groupBy("user_id").agg(best.alias("b")).select("user_id", "b.event_id", "b.event_type")


@register("distinct_first", "SELECT user_id, event_type, k, min(event_id) AS event_id FROM " + E + " GROUP BY 1, 2, 3")
def distinct_first(spark, sf_dir):
    e = events(spark, sf_dir)
    return grouping.first_n(e, ["user_id", "event_type", "k"], [F.col("event_id")], 1).select("user_id", "event_type", "k", "event_id")


@register(
    "collapse_runs",
    """WITH l AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)
    SELECT user_id, event_id, event_type FROM l WHERE r = 1 OR event_type <> b""",
)
def collapse_runs(spark, sf_dir):
    return sequence.collapse(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["event_type"]).select("user_id", "event_id", "event_type")


@register(
    "stride_cap",
    """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    s AS (SELECT *, greatest(1, n // 20) AS step FROM r) SELECT user_id, event_id FROM s WHERE r % step = 0 AND r // step < 20""",
)
def stride_cap(spark, sf_dir):
    return grouping.stride_cap(events(spark, sf_dir), ["user_id"], [F.col("event_id")], 20).select("user_id", "event_id")


@register(
    "first_per_key",
    "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 5",
)
def first_per_key(spark, sf_dir):
    return grouping.first_n(events(spark, sf_dir), ["user_id"], [F.col("value").desc(), F.col("event_id")], 5).select("user_id", "event_id")


@register(
    "round_robin_cap",
    """WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS turn FROM events)
    SELECT event_id, turn FROM r ORDER BY turn, user_id LIMIT 80""",
)
def round_robin_cap(spark, sf_dir):
    ranked = grouping.round_robin(events(spark, sf_dir), "user_id", [F.col("value").desc(), F.col("event_id")])
    return ranked.orderBy("turn", "user_id").limit(80).select("event_id", F.col("turn").cast("bigint").alias("turn"))


@register(
    "sliding_windows",
    """SELECT user_id, event_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), ',') AS context FROM events""",
)
def sliding_windows(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-9, 0)
    return events(spark, sf_dir).select("user_id", "event_id", F.array_join(F.collect_list("event_type").over(w), ",").alias("context"))


@register(
    "minmax_normalised",
    """SELECT event_id, round((value - min(value) OVER w) / greatest(max(value) OVER w - min(value) OVER w, 1e-9), 6) AS scaled FROM events WINDOW w AS (PARTITION BY event_type)""",
)
def minmax_normalised(spark, sf_dir):
    w = Window.partitionBy("event_type")
    low, high = F.min("value").over(w), F.max("value").over(w)
    return events(spark, sf_dir).select("event_id", F.round((F.col("value") - low) / F.greatest(high - low, F.lit(1e-9)), 6).alias("scaled"))


@register(
    "windowed_rerank",
    """WITH r AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events),
    b AS (SELECT *, value * CASE WHEN event_type = 'purchase' THEN 1.5 ELSE 1 END AS boosted FROM r)
    SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY r > 10, CASE WHEN r <= 10 THEN -boosted ELSE r END, event_id) AS new_rank FROM b""",
)
def windowed_rerank(spark, sf_dir):
    r = grouping.round_robin(events(spark, sf_dir), "user_id", [F.col("value").desc(), F.col("event_id")], "r")
    boosted = F.col("value") * F.when(F.col("event_type") == "purchase", 1.5).otherwise(1.0)
    order = [F.col("r") > 10, F.when(F.col("r") <= 10, -boosted).otherwise(F.col("r").cast("double")), F.col("event_id")]
    return r.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)).cast("bigint").alias("new_rank"))


@register(
    "upper_median",
    "SELECT user_id, list_sort(list(value))[len(list(value)) // 2 + 1] AS med, list_sort(list(value))[CAST(floor(0.9 * (len(list(value)) - 1)) AS BIGINT) + 1] AS p90 FROM events GROUP BY 1",
)
def upper_median(spark, sf_dir):
    v = F.sort_array(F.collect_list("value"))
    pick = lambda i: F.element_at(v, i.cast("int"))
    return events(spark, sf_dir).groupBy("user_id").agg(pick(F.floor(F.size(v) / 2) + 1).alias("med"), pick(F.floor(0.9 * (F.size(v) - 1)) + 1).alias("p90"))


@register("random_drop", "SELECT event_id FROM events WHERE (event_id * 48271 + 11) % 1000003 % 1000 >= 250")
def random_drop(spark, sf_dir):
    return perturb.random_drop(events(spark, sf_dir), "event_id", 0.25, 11).select("event_id")


@register(
    "burst_drop",
    "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE NOT (r > n // 4 AND r <= n // 4 + n // 4)",
)
def burst_drop(spark, sf_dir):
    return perturb.burst_drop(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], 0.25, 0.25).select("event_id")


@register(
    "type_drop",
    """WITH p AS (SELECT event_id, user_id, list_position(['error', 'view'], event_type) AS pr, count(*) OVER (PARTITION BY user_id) // 4 AS budget FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pr IS NULL, pr, event_id) AS r FROM p) SELECT event_id FROM r WHERE pr IS NULL OR r > budget""",
)
def type_drop(spark, sf_dir):
    return perturb.type_drop(events(spark, sf_dir), ["user_id"], "event_type", ["error", "view"], "event_id", 0.25).select("event_id")


@register("anchor_drop", "SELECT event_id FROM events WHERE NOT (event_type = 'error' AND (event_id * 48271 + 7) % 1000003 % 1000 < 500)")
def anchor_drop(spark, sf_dir):
    e = events(spark, sf_dir)
    return perturb.anchor_drop(e, e.where("event_type = 'error'"), "event_id", 0.5, 7).select("event_id")


@register(
    "solo_groups",
    """WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type IN ('error', 'signup')),
    s AS (SELECT *, greatest(1, n // 8) AS step FROM r) SELECT user_id || '_' || event_id AS group_id, event_id AS anchor_idx FROM s WHERE r % step = 0 AND r // step < 8""",
)
def solo_groups(spark, sf_dir):
    e = events(spark, sf_dir).where("event_type in ('error', 'signup')")
    return grouping.stride_cap(e, ["user_id"], [F.col("event_id")], 8).select(F.concat_ws("_", F.col("user_id").cast("string"), F.col("event_id").cast("string")).alias("group_id"), F.col("event_id").alias("anchor_idx"))


@register(
    "outlier_propagation",
    "WITH k AS (SELECT DISTINCT user_id, k FROM " + E + " WHERE value > 150) SELECT event_id FROM " + E + " e WHERE EXISTS (SELECT 1 FROM k WHERE k.user_id = e.user_id AND k.k = e.k)",
)
def outlier_propagation(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.join(e.where("value > 150").select("user_id", "k").distinct(), ["user_id", "k"], "left_semi").select("event_id")


@register(
    "label_upsert",
    """WITH old AS (SELECT event_id, 'kept' AS gt FROM events WHERE event_id % 3 = 0), new AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'new' END AS gt FROM events WHERE event_type = 'error')
    SELECT event_id, coalesce(old.gt, new.gt) AS gt FROM new LEFT JOIN old USING (event_id)""",
)
def label_upsert(spark, sf_dir):
    e = events(spark, sf_dir)
    old = e.where("event_id % 3 = 0").select("event_id", F.lit("kept").alias("old"))
    new = e.where("event_type = 'error'").select("event_id", F.when(F.col("event_id") % 2 == 0, "new").alias("new"))
    return new.join(old, "event_id", "left").select("event_id", F.coalesce("old", "new").alias("gt"))


@register("method_pivot", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, sum(value) FILTER (event_type = 'zzz') AS zzz FROM events GROUP BY 1")
def method_pivot(spark, sf_dir):
    e = events(spark, sf_dir)
    n = e.groupBy("user_id").pivot("event_type", ["click", "error"]).agg(F.count(F.lit(1))).na.fill(0, ["click", "error"])
    return n.withColumn("zzz", F.lit(None).cast("double"))


@register("multi_seed_stats", "SELECT event_type, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, round(stddev_pop(value), 4) AS sdp FROM events GROUP BY 1")
def multi_seed_stats(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_samp("value"), 4).alias("sd"), F.round(F.stddev_pop("value"), 4).alias("sdp"))


@register("weighted_average", "SELECT user_id, round(sum(value * n) / sum(n), 6) AS micro FROM (SELECT user_id, event_type, avg(value) AS value, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def weighted_average(spark, sf_dir):
    g = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.avg("value").alias("v"), F.count("*").alias("n"))
    return g.groupBy("user_id").agg(F.round(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 6).alias("micro"))
