"""Queries over vectors, texts, conversations and the star schema: retrieval, decoding, metrics, rules, graphs."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodechain.functions import text as X
from lodechain.operators import anomaly, chains, decode, graph, retrieval, sequence, sigma, transitions, vectors, vocabulary
from lodechain.plans.registry import register


def t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SIM = """s AS (SELECT q.vec_id AS q, c.vec_id AS c, q.label AS ql, c.label AS cl, list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS sim
  FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0)"""


#: The stated query set; the whole jobs ask with every vector.
ASKED = "vec_id % 100 = 0"


def pairs_of(spark, sf_dir, asked):
    """The vectors that ask, and all vectors as the catalogue."""
    v = t(spark, sf_dir, "embeddings")
    q = v.where(asked).select(F.col("vec_id").alias("q"), F.col("label").alias("ql"), F.col("embedding").alias("qe"))
    return q, v.select(F.col("vec_id").alias("c"), F.col("label").alias("cl"), F.col("embedding").alias("ce"))


def best(spark, sf_dir, k, asked, score=None, others=False):
    """At least the ``k`` best pairs of every vector that asks, of its pairs with all vectors."""
    return vectors.top(*pairs_of(spark, sf_dir, asked), k, retrieval.MOST, score, others)


@register("catalogue_topk", f"WITH {SIM}, r AS (SELECT q, c, round(sim, 4) AS sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, c) AS rank FROM s) SELECT * FROM r WHERE rank <= 5")
def catalogue_topk(spark, sf_dir, asked=ASKED):
    return retrieval.top_k(best(spark, sf_dir, 5, asked), ["q"], [F.col("sim").desc(), F.col("c")], 5).select("q", "c", F.round("sim", 4).alias("sim"), "rank")


@register("technique_distribution", f"WITH {SIM} SELECT q, c, round(exp(10 * sim) / sum(exp(10 * sim)) OVER (PARTITION BY q), 6) AS p FROM s")
def technique_distribution(spark, sf_dir, asked=ASKED):
    return vectors.shares(*pairs_of(spark, sf_dir, asked), retrieval.MOST)


@register(
    "rule_priors",
    f"""WITH {SIM}, p AS (SELECT *, sim * CASE WHEN ql = cl THEN 1.15 WHEN abs(ql - cl) = 1 THEN 1.05 ELSE 1 END AS b FROM s), r AS (SELECT q, c, round(b, 4) AS boosted, row_number() OVER (PARTITION BY q ORDER BY b DESC, c) AS rank FROM p) SELECT * FROM r WHERE rank <= 5""",
)
def rule_priors(spark, sf_dir, asked=ASKED):
    s = best(spark, sf_dir, 5, asked, vectors.Prior()).withColumn("b", retrieval.rule_prior(F.col("sim"), F.col("ql") == F.col("cl"), F.abs(F.col("ql") - F.col("cl")) == 1))
    return retrieval.top_k(s, ["q"], [F.col("b").desc(), F.col("c")], 5).select("q", "c", F.round("b", 4).alias("boosted"), "rank")


@register(
    "family_boost",
    f"""WITH {SIM}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, c) AS r FROM s), f AS (SELECT *, count(*) FILTER (r <= 10) OVER (PARTITION BY q, cl) AS n FROM r)
    SELECT q, c, round(CASE WHEN r <= 10 THEN sim * (1 + 0.15 * (n - 1)) ELSE sim END, 4) AS score FROM f WHERE r <= 20""",
)
def family_boost(spark, sf_dir, asked=ASKED):
    r = retrieval.top_k(best(spark, sf_dir, 20, asked), ["q"], [F.col("sim").desc(), F.col("c")], 20)
    return retrieval.family_boost(r, ["q"], "rank", "cl", "sim").select("q", "c", F.round("sim", 4).alias("score"))


@register(
    "technique_mapping",
    f"""WITH {SIM}, x AS (SELECT *, cl % 5 AS family, CASE WHEN q % 300 = 0 THEN NULL ELSE (q + 7 * c) % 11 END AS lex, ((q + c) % 4) / 10.0 AS strength, exp(10 * (sim - max(sim) OVER (PARTITION BY q))) * CASE WHEN ql = cl THEN 1.15 WHEN abs(ql - cl) = 1 THEN 1.05 ELSE 1 END AS e0 FROM s),
    y AS (SELECT *, CASE WHEN lex IS NULL THEN e0 ELSE (0.7 * e0 / max(e0) OVER (PARTITION BY q) + 0.3 * lex / max(lex) OVER (PARTITION BY q)) * max(e0) OVER (PARTITION BY q) END AS e1 FROM x),
    r1 AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY e1 DESC, sim DESC, c) AS a FROM y), z AS (SELECT *, CASE WHEN a <= 10 THEN e1 * (1 + 0.5 * strength) ELSE e1 END AS e2 FROM r1),
    r2 AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY greatest(a, 10), e2 DESC, sim DESC, c) AS b FROM (SELECT * REPLACE (CASE WHEN a <= 10 THEN 0 ELSE a END AS a) FROM z)),
    f AS (SELECT *, CASE WHEN b <= 10 THEN e2 * (1 + 0.15 * (count(*) FILTER (b <= 10) OVER (PARTITION BY q, family) - 1)) ELSE e2 END AS e3 FROM r2),
    r3 AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN b <= 10 THEN 0 ELSE b END, e3 DESC, sim DESC, c) AS rank, e3 / sum(e3) OVER (PARTITION BY q) AS p FROM f),
    m AS (SELECT *, max(p) FILTER (rank = 1) OVER (PARTITION BY q) - max(p) FILTER (rank = 2) OVER (PARTITION BY q) AS margin FROM r3)
    SELECT q, rank, c, round(sim, 4) AS sim, round(p, 6) AS p, round(margin, 6) AS margin FROM m WHERE rank <= 5""",
)
def technique_mapping(spark, sf_dir, asked=ASKED):
    """The whole mapping: softmax, priors, lexical fusion, signatures, families, shares and margins."""
    lexical = lambda q, c: np.where(q % 300 == 0, np.nan, np.fmod(q + 7 * c, 11))
    first = vectors.weighed(*pairs_of(spark, sf_dir, asked), 10, retrieval.MOST, lexical)
    s = first.withColumns({"family": F.col("cl") % 5, "strength": (F.col("q") + F.col("c")) % 4 / 10})
    m = retrieval.mapped(s, ["q"], "c", signature_weight=0.5, family_step=0.15)
    return m.select("q", "rank", "c", F.round("similarity", 4).alias("sim"), F.round("p", 6).alias("p"), F.round("margin", 6).alias("margin"))


@register(
    "confidence_margin",
    f"WITH {SIM}, r AS (SELECT q, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, c) AS r FROM s) SELECT q, round(max(sim) FILTER (r = 1) - max(sim) FILTER (r = 2), 5) AS margin FROM r GROUP BY q",
)
def confidence_margin(spark, sf_dir, asked=ASKED):
    two = retrieval.top_k(best(spark, sf_dir, 2, asked), ["q"], [F.col("sim").desc(), F.col("c")], 2)
    return two.groupBy("q").agg(F.round(F.max(F.when(F.col("rank") == 1, F.col("sim"))) - F.max(F.when(F.col("rank") == 2, F.col("sim"))), 5).alias("margin"))


@register(
    "reciprocal_rank",
    f"""WITH {SIM}, r AS (SELECT q, ql, cl, row_number() OVER (PARTITION BY q ORDER BY sim DESC, c) AS r FROM s WHERE q <> c), m AS (SELECT q, ql, min(r) FILTER (ql = cl) AS first FROM r WHERE r <= 10 GROUP BY 1, 2)
    SELECT ql AS label, count(*) AS n, round(avg((coalesce(first, 99) = 1)::INT), 6) AS hit1, round(avg((coalesce(first, 99) <= 5)::INT), 6) AS hit5, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM m GROUP BY 1""",
)
def reciprocal_rank(spark, sf_dir, asked=ASKED):
    r = retrieval.top_k(best(spark, sf_dir, 10, asked, others=True), ["q"], [F.col("sim").desc(), F.col("c")], 10)
    m = r.groupBy("q", "ql").agg(F.min(F.when(F.col("ql") == F.col("cl"), F.col("rank"))).alias("f"))
    hit = lambda k: F.round(F.avg((F.coalesce("f", F.lit(99)) <= k).cast("int")), 6)
    return m.groupBy(F.col("ql").alias("label")).agg(F.count("*").alias("n"), hit(1).alias("hit1"), hit(5).alias("hit5"), F.round(F.avg(F.coalesce(1 / F.col("f"), F.lit(0.0))), 6).alias("mrr"))


@register(
    "knn_anomaly",
    """WITH d AS (SELECT a.vec_id, sqrt(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND b.label < 5),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS r FROM d) SELECT vec_id, round(avg(d), 4) AS score FROM r WHERE r <= 10 GROUP BY 1""",
)
def knn_anomaly(spark, sf_dir, rows=ASKED):
    v = t(spark, sf_dir, "embeddings")
    return anomaly.knn_score(v.where(rows), v.where("label < 5"), "vec_id", "embedding").select("vec_id", F.round("score", 4).alias("score"))


@register(
    "auc_by_type",
    """WITH r AS (SELECT user_id % 10 AS g, event_type = 'error' AS pos, rank() OVER (PARTITION BY user_id % 10 ORDER BY value) + (count(*) OVER (PARTITION BY user_id % 10, value) - 1) / 2.0 AS rk FROM events),
    s AS (SELECT g, sum(rk) FILTER (pos) AS w, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM r GROUP BY 1) SELECT g, round((w - p * (p + 1) / 2.0) / (p * n), 6) AS auc FROM s""",
)
def auc_by_type(spark, sf_dir):
    e = t(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("g"), "value", (F.col("event_type") == "error").alias("pos"))
    return sequence.auc(e, ["g"], "value", "pos").select("g", F.round("auc", 6).alias("auc"))


@register(
    "bm25",
    """WITH d AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) > 1) AS ts FROM benchmark), n AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM d), l AS (SELECT item_id, len(ts) AS len, unnest(ts) AS t FROM d),
    tf AS (SELECT item_id, len, t, count(*) AS tf FROM l GROUP BY 1, 2, 3), df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1), idf AS (SELECT t, ln(n - df + 0.5) - ln(df + 0.5) AS idf, a FROM df, n), m AS (SELECT avg(idf) AS m FROM idf)
    SELECT item_id, round(sum(CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / a))), 5) AS score FROM tf JOIN idf USING (t), m WHERE t IN ('the', 'thing', 'heon', 'rest') GROUP BY 1""",
)
def bm25(spark, sf_dir):
    d = t(spark, sf_dir, "benchmark").withColumn("ts", F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) > 1))
    return retrieval.bm25(d, "item_id", "ts", ["the", "thing", "heon", "rest"]).select("item_id", F.round("score", 5).alias("score"))


@register(
    "keyword_signatures",
    """WITH m AS (SELECT doc_id, len(list_filter(['licensed', 'stupid', 'idiot', 'version 2.0'], lambda s: contains(lower(text), s))) AS m FROM documents) SELECT doc_id, CASE WHEN m > 0 THEN round(least(0.4 + 0.2 * (m - 1), 1.0), 2) ELSE 0 END::DOUBLE AS strength FROM m""",
)
def keyword_signatures(spark, sf_dir):
    words = F.array(*map(F.lit, ("licensed", "stupid", "idiot", "version 2.0")))
    return t(spark, sf_dir, "documents").select("doc_id", F.round(retrieval.keyword_strength(F.lower("text"), words), 2).alias("strength"))


@register(
    "transition_matrix",
    """WITH t AS (SELECT unnest(['Reconnaissance', 'Resource Development', 'Initial Access', 'Execution', 'Persistence', 'Privilege Escalation', 'Defense Evasion', 'Credential Access', 'Discovery', 'Lateral Movement', 'Collection', 'Command and Control', 'Exfiltration', 'Impact']) AS name, unnest(range(14)) AS i),
    x AS (SELECT a.name AS s, b.name AS t, b.i - a.i AS d, a.i AS ai, b.i AS bi, a.name IN ('Privilege Escalation', 'Defense Evasion') AS from_any, b.name IN ('Privilege Escalation', 'Defense Evasion') AS to_any,
      a.name || '>' || b.name AS p FROM t a, t b),
    r AS (SELECT *, CASE WHEN s = t THEN 'R1' WHEN s = 'Defense Evasion' AND t = 'Privilege Escalation' THEN 'R8A' WHEN s = 'Impact' OR (s = 'Exfiltration' AND bi <= 6) THEN 'R9'
      WHEN p IN ('Reconnaissance>Resource Development', 'Resource Development>Initial Access', 'Initial Access>Execution', 'Execution>Persistence', 'Execution>Privilege Escalation', 'Execution>Defense Evasion', 'Execution>Credential Access', 'Persistence>Privilege Escalation', 'Privilege Escalation>Defense Evasion', 'Lateral Movement>Collection', 'Collection>Command and Control', 'Command and Control>Exfiltration', 'Exfiltration>Impact') THEN 'R2'
      WHEN s IN ('Credential Access', 'Discovery', 'Lateral Movement') AND t IN ('Credential Access', 'Discovery', 'Lateral Movement') THEN 'R3A' WHEN s IN ('Credential Access', 'Discovery') AND t = 'Collection' THEN 'R3B'
      WHEN NOT from_any AND to_any THEN 'R4' WHEN from_any AND NOT to_any AND d > 0 THEN 'R5' WHEN from_any AND NOT to_any THEN 'R5B' WHEN d BETWEEN 1 AND 2 THEN 'R6' WHEN d > 0 THEN 'R7' WHEN d >= -2 THEN 'R8A' ELSE 'R8B' END AS rule FROM x)
    SELECT s AS source, t AS target, rule, CASE WHEN rule = 'R4' AND t = 'Defense Evasion' THEN 0.7 ELSE map {'R1': 0.5, 'R2': 1.0, 'R3A': 0.9, 'R3B': 0.8, 'R4': 0.8, 'R5': 0.7, 'R5B': 0.4, 'R6': 0.5, 'R7': 0.3, 'R8A': 0.1, 'R8B': 0.05, 'R9': 0.02}[rule] END::DOUBLE AS weight FROM r""",
)
def transition_matrix(spark, sf_dir):
    return transitions.table(spark)


CHAT = "SELECT conv_id, list(role ORDER BY turn) AS s FROM conversations GROUP BY 1"


def chats(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("s"))
    return c.select("conv_id", F.transform("s", lambda x: x["role"]).alias("s"))


@register(
    "sequence_lcs",
    """WITH RECURSIVE c AS (SELECT conv_id, list(role ORDER BY turn) AS a, ['user', 'assistant', 'user', 'system', 'assistant', 'user'] AS b FROM conversations GROUP BY 1),
    dp AS (SELECT conv_id, a, b, 0 AS i, list_transform(range(7), lambda x: 0) AS prev FROM c
      UNION ALL SELECT conv_id, a, b, i + 1, (SELECT list_reduce(list_prepend([0], list_transform(range(1, 7), lambda j: [j])), lambda acc, y: list_append(acc, CASE WHEN b[y[1]] = a[i + 1] THEN prev[y[1]] + 1 ELSE greatest(prev[y[1] + 1], acc[y[1]]) END))) FROM dp WHERE i < len(a))
    SELECT conv_id, CAST(prev[7] AS INTEGER) AS lcs FROM dp WHERE i = len(a)""",
)
def sequence_lcs(spark, sf_dir):
    b = F.array(*map(F.lit, ("user", "assistant", "user", "system", "assistant", "user")))
    return chats(spark, sf_dir).select("conv_id", sequence.lcs(F.col("s"), b).alias("lcs"))


@register(
    "sequence_edit_distance",
    f"WITH c AS ({CHAT}) SELECT conv_id, levenshtein(array_to_string(list_transform(s, lambda x: x[1:1]), ''), 'uauasu')::INTEGER AS distance FROM c",
)
def sequence_edit_distance(spark, sf_dir):
    want = F.array(*map(F.lit, ("user", "assistant", "user", "assistant", "system", "user")))
    return chats(spark, sf_dir).select("conv_id", sequence.edit_distance(F.col("s"), want, ["user", "assistant", "system"]).alias("distance"))


@register(
    "order_accuracy",
    f"""WITH c AS ({CHAT}), p AS (SELECT conv_id, list_filter([nullif(list_position(s, 'system'), 0), nullif(list_position(s, 'user'), 0), nullif(list_position(s, 'assistant'), 0)], lambda x: x IS NOT NULL) AS p FROM c)
    SELECT conv_id, round(CASE WHEN len(p) = 0 THEN 0 WHEN len(p) = 1 THEN 1 ELSE len(list_filter(range(1, len(p)), lambda i: p[i] < p[i + 1])) / (len(p) - 1)::DOUBLE END, 6)::DOUBLE AS accuracy FROM p""",
)
def order_accuracy(spark, sf_dir):
    where = F.array(*[F.nullif(F.array_position("s", r), F.lit(0)) for r in ("system", "user", "assistant")])
    return chats(spark, sf_dir).select("conv_id", F.round(sequence.order_accuracy(where), 6).alias("accuracy"))


@register(
    "chain_novelty",
    """WITH o AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS s FROM orders GROUP BY 1), l AS (SELECT * FROM (VALUES (0, ['1-URGENT', '2-HIGH', '3-MEDIUM']), (1, ['3-MEDIUM', '5-LOW'])) AS l(id, b)),
    j AS (SELECT o_custkey, id, len(s) AS n, len(list_intersect(s, b)) AS m FROM o, l) SELECT o_custkey, round(1 - max(m) / max(n)::DOUBLE, 4) AS novelty, arg_max(id, m * 10 - id) AS nearest FROM j GROUP BY 1""",
)
def chain_novelty(spark, sf_dir):
    o = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("s"))
    library = spark.createDataFrame([(0, ["1-URGENT", "2-HIGH", "3-MEDIUM"]), (1, ["3-MEDIUM", "5-LOW"])], "id int, b array<string>")
    j = o.crossJoin(F.broadcast(library)).withColumn("m", sequence.lcs(F.col("s"), F.col("b")))
    return j.groupBy("o_custkey").agg(F.round(1 - F.max("m") / F.max(F.size("s")), 4).alias("novelty"), F.max_by("id", F.col("m") * 10 - F.col("id")).alias("nearest"))


def candidate(n, p):
    """An event's candidate: the property k names its technique and its tactic."""
    k = F.col("k") + n
    return F.struct(F.concat(F.lit("T"), k.cast("string")).alias("tid"), F.array(*map(F.lit, transitions.TACTICS))[k % 14].alias("tac"), F.lit(p).alias("p"))


def event_nodes(spark, sf_dir, *candidates):
    """Each user's whole sequence of events, an array of candidates for each."""
    k = t(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).select("user_id", "event_id", F.array(*candidates).alias("c"))
    return k.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "c"))), lambda x: x["c"]).alias("nodes"))


def viterbi_sql(alpha, second):
    """Best chain of two candidates an event, step by step; the weights stand by position in one list."""
    w, rest = {(a, b): x for a, b, _, x in transitions.matrix()}, f"{1 - alpha!r}e0"
    flat = "[" + ", ".join(str(0.5 if a == b else w[a, b]) for a in transitions.TACTICS for b in transitions.TACTICS) + "]::DOUBLE[]"
    step = lambda frm, to, e: f"CASE WHEN w[t{frm} * 14 + {to} + 1] > 0.02 THEN v{frm} + {rest} * ln({e}) + {alpha}e0 * ln(w[t{frm} * 14 + {to} + 1]) ELSE '-infinity'::DOUBLE END"
    ka, kb = "n.k % 14", f"(n.k + {second}) % 14"
    pick = lambda x, y, name: f"CASE WHEN {x} > -1e9 AND {x} >= {y} THEN pa || '>T' || {name} WHEN {y} > -1e9 THEN pb || '>T' || {name} ELSE 'T' || {name} END"
    return f"""WITH RECURSIVE e AS (SELECT user_id, json_extract_string(props, '$.k')::INTEGER AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    m AS (SELECT user_id, max(i) AS n FROM e GROUP BY 1),
    d AS (SELECT user_id, i, k % 14 AS ta, (k + {second}) % 14 AS tb, {rest} * ln(0.6) AS va, {rest} * ln(0.3) AS vb, 'T' || k AS pa, 'T' || (k + {second}) AS pb FROM e WHERE i = 1
      UNION ALL SELECT user_id, i, ta, tb, greatest(-1e9, xaa, xba), greatest(-1e9, xab, xbb), {pick("xaa", "xba", "k")}, {pick("xab", "xbb", f"(k + {second})")}
      FROM (SELECT n.user_id, n.i, n.k, {ka} AS ta, {kb} AS tb, pa, pb, {step("a", ka, 0.6)} AS xaa, {step("b", ka, 0.6)} AS xba, {step("a", kb, 0.3)} AS xab, {step("b", kb, 0.3)} AS xbb
        FROM (SELECT *, {flat} AS w FROM d) d JOIN e n ON n.user_id = d.user_id AND n.i = d.i + 1))
    SELECT user_id, CASE WHEN vb > va THEN vb ELSE va END AS score, CASE WHEN vb > va THEN pb ELSE pa END AS path FROM d JOIN m USING (user_id) WHERE i = n"""


@register("viterbi_chain", f"SELECT user_id, round(score, 6) AS score, path FROM ({viterbi_sql(0.5, 5)})")
def viterbi_chain(spark, sf_dir):
    """The best chain of each user's events; two candidates an event."""
    best = event_nodes(spark, sf_dir, candidate(0, 0.6), candidate(5, 0.3)).select("user_id", decode.viterbi(F.col("nodes")).alias("b"))
    return best.select("user_id", F.round("b.score", 6).alias("score"), F.array_join("b.path", ">").alias("path"))


DECODERS = {
    "best": chains.Decoder(),
    "skips": chains.Decoder(skip=2, barred=True),
    "gated": chains.Decoder(gate=("sim", 0.03, 0.1, 0.5, 0.1), repeat=0.8),
    "max_marginal": chains.Decoder("max_marginal"),
    "sum_product": chains.Decoder("sum_product"),
    "guarded": chains.Decoder(bypass=0.75, regret=0.05),
}


@register("chain_decoders")
def chain_decoders(spark, sf_dir):
    """Each user's whole sequence under every decoder; entities by kind of event."""
    side = lambda i: F.create_map(*[x for tac, io in vocabulary.TACTIC_IO.items() for x in (F.lit(tac), F.array(*map(F.lit, io[i])).cast("array<string>"))])
    inputs, outputs = side(0), side(1)
    tactic = F.array(*map(F.lit, transitions.TACTICS))

    def described(n, p):
        tac = tactic[(F.col("k") + n) % 14]
        return F.struct(F.concat(F.lit("T"), (F.col("k") + n).cast("string")).alias("tid"), tac.alias("tac"), (F.lit(p) + F.col("k") / 1000).alias("sim"), F.lit(p).alias("p"), inputs[tac].alias("inputs"), outputs[tac].alias("outputs"), F.lit(None).cast("array<float>").alias("vec"))

    seen = F.when(F.col("event_type") == "click", F.array(F.lit("process"), F.lit("file"))).when(F.col("event_type") == "error", F.array(F.lit("process"), F.lit("user"))).otherwise(F.array(F.lit("process"), F.lit("network"), F.lit("file")))
    node = F.struct(F.array(described(0, 0.6), described(5, 0.3), described(9, 0.1)).alias("candidates"), seen.alias("entities"), F.lit(0.1).alias("margin"))
    e = t(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).select("user_id", "event_id", node.alias("c"))
    dealt = e.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "user_id")  # decoding outweighs its input: these partitions must not be merged
    seq = dealt.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "c"))), lambda x: x["c"]).alias("nodes"))
    return chains.chains(seq, "user_id", "nodes", DECODERS).select("user_id", "option", "score", F.array_join(F.transform("steps", lambda s: s["tid"]), ">").alias("path"))


@register(
    "detection_rules",
    """SELECT page_id, concat_ws(',', CASE WHEN (contains(lower(url), '/fr/') OR contains(lower(url), '/de/')) AND NOT contains(lower(html), 'track(') THEN 'r1' END,
      CASE WHEN starts_with(lower(url), 'http://th') AND (contains(lower(url), 'page=2') OR contains(lower(html), '<nav>')) THEN 'r2' END, CASE WHEN contains(lower(url), 'ref=') AND contains(lower(url), 'page=') THEN 'r3' END) AS hits FROM pages""",
)
def detection_rules(spark, sf_dir):
    rules = [
        sigma.Rule("r1", {"sel": {"url|contains": ["/fr/", "/de/"]}, "filter": {"html|contains": "track("}}, "sel and not filter"),
        sigma.Rule("r2", {"start": {"url|startswith": "http://th"}, "sel_a": {"url|contains": "page=2"}, "sel_b": {"html|contains": "<nav>"}}, "start and 1 of sel_*"),
        sigma.Rule("r3", {"sel": {"url|contains|all": ["ref=", "page="]}}, "all of them"),
        sigma.Rule("r4", {"sel": {"url|contains": "nothing like it"}}, "not sel"),
    ]
    return sigma.match(t(spark, sf_dir, "pages"), rules).select("page_id", F.array_join("hits", ",").alias("hits"))


@register("strip_markup", "SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')))::INTEGER AS n FROM pages")
def strip_markup(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", F.length(X.strip_markup(F.col("html"))).alias("n"))


@register("basenames", "SELECT page_id, string_split(url, '/')[-1] AS name, string_split(string_split(url, '/')[3], '.')[1] AS root FROM pages")
def basenames(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", X.basename(F.col("url"), "/").alias("name"), X.root(F.split("url", "/")[2]).alias("root"))


@register(
    "tokens",
    r"SELECT item_id, len(list_filter(list_transform(string_split_regex(lower(text), '[^a-z0-9._\\/]+'), lambda x: trim(x, '.')), lambda x: length(x) >= 2))::INTEGER AS n FROM benchmark",
)
def tokens(spark, sf_dir):
    return t(spark, sf_dir, "benchmark").select("item_id", F.size(X.tokens(F.col("text"))).alias("n"))


@register("ip_classes", r"SELECT doc_id, regexp_extract(text, '\d+\.\d+\.\d+\.\d+') AS ip, CASE WHEN regexp_matches(regexp_extract(text, '\d+\.\d+\.\d+\.\d+'), '^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)') THEN '[internal_ip]' WHEN starts_with(regexp_extract(text, '\d+\.\d+\.\d+\.\d+'), '127.') THEN '[loopback]' WHEN regexp_matches(regexp_extract(text, '\d+\.\d+\.\d+\.\d+'), '^\d+\.\d+\.\d+\.\d+$') THEN '[external_ip]' ELSE regexp_extract(text, '\d+\.\d+\.\d+\.\d+') END AS class FROM documents WHERE regexp_matches(text, '\d+\.\d+\.\d+\.\d+')")
def ip_classes(spark, sf_dir):
    d = t(spark, sf_dir, "documents").withColumn("ip", F.regexp_extract("text", r"\d+\.\d+\.\d+\.\d+", 0)).where("ip <> ''")
    return d.select("doc_id", "ip", X.ip_class(F.col("ip")).alias("class"))


@register("base64_runs", "WITH r AS (SELECT doc_id, regexp_extract(text, '[A-Za-z0-9+/]{40,}={0,2}') AS run FROM documents) SELECT doc_id, run <> '' AND length(rtrim(run, '=')) % 4 <> 1 AS decodes FROM r")
def base64_runs(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", X.base64_run(F.col("text")).alias("decodes"))


@register("special_characters", "SELECT doc_id, array_to_string(list_filter(['^', '&', '|', '%', '`'], lambda x: contains(text, x)), '') AS found FROM documents")
def special_characters(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.array_join(X.special_characters(F.col("text")), "").alias("found"))


@register("integer_texts", "SELECT p_partkey, p_partkey AS a, CASE WHEN p_partkey % 5 = 0 AND p_partkey > 0 THEN NULL ELSE p_partkey END AS b, floor(p_retailprice)::BIGINT AS c FROM part")
def integer_texts(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    hexed, lead = F.concat(F.lit("0x"), F.hex("p_partkey")), F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("0"), F.col("p_partkey"))).otherwise(F.col("p_partkey").cast("string"))
    return p.select("p_partkey", X.to_int(hexed).alias("a"), X.to_int(lead).alias("b"), X.to_int(F.format_string("%.4f", "p_retailprice")).alias("c"))


@register("registry_paths", "SELECT c_custkey, 'hklm\\soft\\' || c_custkey AS path FROM customer")
def registry_paths(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", X.registry_path(F.concat(F.lit("\\REGISTRY\\MACHINE\\Soft\\"), F.col("c_custkey").cast("string"))).alias("path"))


@register(
    "group_sets",
    """WITH s AS (SELECT l_orderkey, list_distinct(list(l_partkey % 7)) AS a, list_distinct(list(l_suppkey % 7)) AS b FROM lineitem GROUP BY 1)
    SELECT l_orderkey, len(list_distinct(list_concat(a, b)))::INTEGER AS n_union, len(list_intersect(a, b))::INTEGER AS n_both, (len(a) - len(list_intersect(a, b)))::INTEGER AS n_only, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS jaccard FROM s""",
)
def group_sets(spark, sf_dir):
    s = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 7).alias("a"), F.collect_set(F.col("l_suppkey") % 7).alias("b"))
    return s.select("l_orderkey", F.size(F.array_union("a", "b")).alias("n_union"), F.size(F.array_intersect("a", "b")).alias("n_both"), F.size(F.array_except("a", "b")).alias("n_only"), F.round(sequence.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@register(
    "set_scores",
    """WITH s AS (SELECT l_orderkey, list_distinct(list(l_partkey % 5)) AS a, list_distinct(list(l_suppkey % 5)) AS b FROM lineitem GROUP BY 1), p AS (SELECT l_orderkey, len(list_intersect(a, b)) AS i, len(a) AS na, len(b) AS nb FROM s)
    SELECT l_orderkey, round(i / nb::DOUBLE, 6) AS p, round(i / na::DOUBLE, 6) AS r, CASE WHEN i > 0 THEN round(2 * (i / nb::DOUBLE) * (i / na::DOUBLE) / (i / nb::DOUBLE + i / na::DOUBLE), 6) ELSE 0 END::DOUBLE AS f1 FROM p""",
)
def set_scores(spark, sf_dir):
    s = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 5).alias("a"), F.collect_set(F.col("l_suppkey") % 5).alias("b"))
    p, r, f1 = sequence.set_scores(F.col("a"), F.col("b"))
    return s.select("l_orderkey", F.round(p, 6).alias("p"), F.round(r, 6).alias("r"), F.round(f1, 6).alias("f1"))


@register(
    "tactic_confusion",
    """WITH l AS (SELECT l_returnflag AS gt, CASE WHEN l_quantity > 25 THEN 'A' WHEN l_quantity > 12 THEN 'N' ELSE 'R' END AS pred FROM lineitem), x AS (SELECT gt AS tactic, gt = pred AS tp, FALSE AS fp, gt <> pred AS fn FROM l UNION ALL SELECT pred, FALSE, TRUE, FALSE FROM l WHERE gt <> pred)
    SELECT tactic, count(*) FILTER (tp) AS tp, count(*) FILTER (fp) AS fp, count(*) FILTER (fn) AS fn FROM x GROUP BY 1""",
)
def tactic_confusion(spark, sf_dir):
    pred = F.when(F.col("l_quantity") > 25, "A").when(F.col("l_quantity") > 12, "N").otherwise("R")
    n = t(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("gt"), pred.alias("pred")).count()
    hit, c = F.col("gt") == F.col("pred"), F.col("count")
    rows = n.select(F.explode(F.when(hit, F.array(F.struct(F.col("gt").alias("tactic"), c.alias("tp"), F.lit(0).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn")))).otherwise(F.array(F.struct(F.col("gt").alias("tactic"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), c.alias("fn")), F.struct(F.col("pred").alias("tactic"), F.lit(0).cast("long").alias("tp"), c.alias("fp"), F.lit(0).cast("long").alias("fn"))))).alias("x"))
    return rows.groupBy("x.tactic").agg(F.sum("x.tp").alias("tp"), F.sum("x.fp").alias("fp"), F.sum("x.fn").alias("fn"))


@register(
    "parent_fallback",
    """SELECT s_suppkey, coalesce(n.n_name, m.n_name, 'Unknown') AS name FROM supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_suppkey LEFT JOIN nation m ON m.n_nationkey = s.s_nationkey AND s.s_suppkey % 2 = 0""",
)
def parent_fallback(spark, sf_dir):
    s, n = t(spark, sf_dir, "supplier"), F.broadcast(t(spark, sf_dir, "nation"))
    exact = n.select(F.col("n_nationkey").alias("s_suppkey"), F.col("n_name").alias("x")).withColumn("s_suppkey", F.col("s_suppkey").cast("bigint"))
    parent = n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("y"))
    j = s.join(exact, "s_suppkey", "left").join(parent, "s_nationkey", "left")
    return j.select("s_suppkey", F.coalesce("x", F.when(F.col("s_suppkey") % 2 == 0, F.col("y")), F.lit("Unknown")).alias("name"))


@register(
    "truth_join",
    "SELECT o_orderkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, '_FP_') AS gt FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
)
def truth_join(spark, sf_dir):
    c = t(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return t(spark, sf_dir, "orders").join(c, "o_custkey", "left").select("o_orderkey", F.coalesce("c_mktsegment", F.lit("_FP_")).alias("gt"))


@register(
    "lineage_walk",
    """WITH RECURSIVE ed AS (SELECT c_custkey // 2 AS p, c_custkey AS c FROM customer WHERE c_custkey >= 2), st AS (SELECT c_custkey AS s FROM customer WHERE c_acctbal < -900),
    up AS (SELECT s, s AS n, 0 AS h FROM st UNION ALL SELECT s, p, h + 1 FROM up JOIN ed ON c = n WHERE h < 2), dn AS (SELECT s, s AS n, 0 AS h FROM st UNION ALL SELECT s, c, h + 1 FROM dn JOIN ed ON p = n WHERE h < 3)
    SELECT DISTINCT s AS start, n AS node FROM (SELECT s, n FROM up UNION ALL SELECT s, n FROM dn)""",
)
def lineage_walk(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    edges = c.where("c_custkey >= 2").select(F.expr("c_custkey div 2").alias("parent"), F.col("c_custkey").alias("child"))
    return graph.bounded_walk(edges, c.where("c_acctbal < -900").select(F.col("c_custkey").alias("start")))


@register(
    "lineage_one_hop",
    """WITH ed AS (SELECT c_custkey // 2 AS p, c_custkey AS c FROM customer WHERE c_custkey >= 2), m AS (SELECT c_custkey AS node FROM customer WHERE c_acctbal < -900) SELECT node FROM m UNION SELECT p FROM ed JOIN m ON c = node UNION SELECT c FROM ed JOIN m ON p = node""",
)
def lineage_one_hop(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    edges = c.where("c_custkey >= 2").select(F.expr("c_custkey div 2").alias("parent"), F.col("c_custkey").alias("child"))
    return graph.one_hop(edges, c.where("c_acctbal < -900").select(F.col("c_custkey").alias("node")))


@register(
    "tagged_closure",
    """WITH RECURSIVE ed AS (SELECT DISTINCT o_custkey AS a, 1000000 + o_orderkey AS b FROM orders), u AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
    r AS (SELECT DISTINCT o_custkey AS node FROM orders WHERE o_totalprice > 300000 UNION SELECT u.b FROM r JOIN u ON u.a = r.node) SELECT node FROM r""",
)
def tagged_closure(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    ed = o.select(F.col("o_custkey").alias("a"), (1000000 + F.col("o_orderkey")).alias("b")).distinct()
    return graph.tagged_closure(ed, o.where("o_totalprice > 300000").select(F.col("o_custkey").alias("node")).distinct())


@register(
    "provenance_edges",
    """SELECT l_suppkey AS src, l_partkey AS dst, CASE l_returnflag WHEN 'A' THEN 'write' WHEN 'N' THEN 'fork' ELSE 'connect' END AS verb, count(*) AS n, min(l_orderkey) AS first_id FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY 1, 2, 3""",
)
def provenance_edges(spark, sf_dir):
    verb = F.when(F.col("l_returnflag") == "A", "write").when(F.col("l_returnflag") == "N", "fork").otherwise("connect")
    return t(spark, sf_dir, "lineitem").where("l_suppkey <> l_partkey").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), verb.alias("verb")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_id"))


@register("local_outliers")
def local_outliers(spark, sf_dir):
    """Local outlier factors of each user's events over three factorised codes."""
    e = t(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("scenario"), F.col("event_id").alias("idx"), "event_type", F.get_json_object("props", "$.k").alias("k"), (F.floor(F.col("value") / 50)).alias("v"))
    return anomaly.local_outliers(e, "scenario", "idx", ["event_type", "k", "v"])


@register("communities")
def communities(spark, sf_dir):
    ed = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (1000000 + F.col("o_orderkey") % 300).alias("b"))
    return graph.label_communities(ed, 3)


@register(
    "next_item_model",
    """WITH p AS (SELECT user_id, event_type AS cur, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events), c AS (SELECT cur, nxt, count(*) AS n FROM p WHERE nxt IS NOT NULL GROUP BY 1, 2)
    SELECT cur, nxt, n, row_number() OVER (PARTITION BY cur ORDER BY n DESC, nxt) AS rank FROM c""",
)
def next_item_model(spark, sf_dir):
    """Next-item counts of a first-order Markov model."""
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    c = t(spark, sf_dir, "events").select(F.col("event_type").alias("cur"), nxt.alias("nxt")).where("nxt is not null").groupBy("cur", "nxt").agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("cur").orderBy(F.col("n").desc(), "nxt")).cast("bigint"))


@register("cache_keys", "SELECT item_id, substr(sha256(text), 1, 16) AS key FROM benchmark")
def cache_keys(spark, sf_dir):
    return t(spark, sf_dir, "benchmark").select("item_id", F.substring(F.sha2("text", 256), 1, 16).alias("key"))


@register(
    "confidence_gate",
    f"WITH {SIM}, r AS (SELECT q, c, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, c) AS r FROM s WHERE q <> c) SELECT q, c FROM r WHERE r = 1 AND sim >= 0.35",
)
def confidence_gate(spark, sf_dir, asked=ASKED):
    return retrieval.top_k(best(spark, sf_dir, 1, asked, others=True), ["q"], [F.col("sim").desc(), F.col("c")], 1).where("sim >= 0.35").select("q", "c")


@register(
    "ordered_merge",
    """WITH s AS (SELECT conv_id, list(role ORDER BY turn) AS a, list(role ORDER BY turn DESC) AS b FROM conversations GROUP BY 1), u AS (SELECT conv_id, unnest(list_concat(a, b)) AS x, generate_subscripts(list_concat(a, b), 1) AS i FROM s), f AS (SELECT conv_id, x, min(i) AS i FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS r FROM f)
    SELECT conv_id, string_agg(x, ',' ORDER BY i) AS merged FROM r WHERE r <= 2 GROUP BY 1""",
)
def ordered_merge(spark, sf_dir):
    c = chats(spark, sf_dir)
    return c.select("conv_id", F.array_join(sequence.ordered_merge(F.col("s"), F.reverse("s"), 2), ",").alias("merged"))


# The whole jobs: all vectors on both sides. Too slow in SQL; tested against plain versions.
for _query in (catalogue_topk, technique_distribution, technique_mapping, rule_priors, family_boost, confidence_margin, reciprocal_rank, confidence_gate):
    register(f"{_query.__name__}_all")(partial(_query, asked="true"))
register("knn_anomaly_all")(partial(knn_anomaly, rows="true"))
