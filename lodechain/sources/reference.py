"""Small reference inputs: anchor rules, catalogue, campaigns, detection rules, annotations; and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodechain.operators.sigma import Rule

FIRST_TACTIC_ORDER = "Reconnaissance,Resource Development,Initial Access,Execution,Persistence,Privilege Escalation,Defense Evasion,Credential Access,Discovery,Lateral Movement,Collection,Command and Control,Exfiltration,Impact".split(",")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Technique catalogue: ID, name, description and the list of tactics; columns are found by name, ignoring case."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    by = {c.lower(): c for c in raw.columns}
    find = lambda *names: next((F.col(f"`{by[c]}`") for n in names for c in by if n in c), F.lit(None).cast("string"))
    tactics = F.filter(F.transform(F.split(find("tactic"), "[,;]"), F.trim), lambda x: x != "")
    return raw.select(F.col(f"`{by['id']}`").alias("technique_id"), find("name").alias("name"), find("description").alias("description"), tactics.alias("tactics"))


def single_tactic(catalogue: DataFrame, earliest: bool = False) -> DataFrame:
    """One tactic for each technique: the first listed, or the earliest of the kill chain."""
    order = F.array(*map(F.lit, FIRST_TACTIC_ORDER))
    first = F.array_min(F.transform("tactics", lambda t: F.struct(F.array_position(order, t).alias("p"), t.alias("t"))))["t"] if earliest else F.try_element_at("tactics", F.lit(1))
    return catalogue.select("technique_id", F.coalesce(first, F.lit("Unknown")).alias("tactic"))


def read_campaigns(spark: SparkSession, path: str, tactics: DataFrame) -> DataFrame:
    """(campaign, techniques, tactics): layers' techniques with a positive score, and their tactics in order of first
    sight; layers without either are dropped."""
    raw = spark.read.json(path, multiLine=True, pathGlobFilter="*-enterprise-layer.json")
    t = raw.select(F.col("name").alias("campaign"), F.posexplode("techniques").alias("i", "t")).where("t.score > 0")
    j = t.select("campaign", "i", F.col("t.techniqueID").alias("technique_id")).join(F.broadcast(tactics), "technique_id")
    g = j.groupBy("campaign").agg(F.array_sort(F.collect_list(F.struct("i", "technique_id", "tactic"))).alias("s"))
    return g.select("campaign", F.transform("s", lambda x: x["technique_id"]).alias("techniques"), F.array_distinct(F.transform("s", lambda x: x["tactic"])).alias("tactics"))


def read_rules(texts: list[str], require_attack_tag: bool = True) -> list[Rule]:
    """Detection rules from YAML texts; those that do not parse, are deprecated, or lack a detection, a condition or a
    technique tag are left out. A list of conditions is joined by "or"."""
    import re

    import yaml

    out = []
    for text in texts:
        try:
            r = yaml.safe_load(text)
        except yaml.YAMLError:
            continue
        if not isinstance(r, dict) or r.get("status") == "deprecated" or not isinstance(r.get("detection"), dict):
            continue
        detection = dict(r["detection"])
        condition = detection.pop("condition", None)
        condition = " or ".join(f"({c})" for c in condition) if isinstance(condition, list) else condition
        if not condition or (require_attack_tag and not any(re.fullmatch(r"attack\.t\d{4}(\.\d{3})?", str(t).lower()) for t in r.get("tags") or [])):
            continue
        out.append(Rule(str(r.get("id") or r.get("title")), {k: v for k, v in detection.items() if isinstance(v, (dict, list))}, str(condition), str(r.get("level", "medium"))))
    return sorted(out, key=lambda r: r.id)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Labelled groups of annotation files (scenario, group fields); unlabelled ones are left out."""
    raw = spark.read.json(path, multiLine=True)
    return raw.select("scenario", F.explode("groups").alias("g")).select("scenario", "g.*").where("gt_is_true_positive is not null")


def keep_labels(template: DataFrame, existing: DataFrame, key: str = "group_id") -> DataFrame:
    """``template`` with the labels (columns gt_*) of ``existing`` where those have any."""
    labels = [c for c in existing.columns if c.startswith("gt_")]
    old = existing.where("gt_is_true_positive is not null").select(key, *[F.col(c).alias(f"__{c}") for c in labels])
    j = template.join(old, key, "left")
    return j.withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) if c in template.columns else F.col(f"__{c}") for c in labels}).drop(*[f"__{c}" for c in labels])


def pending(scenarios: DataFrame, done: DataFrame, key: str = "scenario") -> DataFrame:
    """Scenarios without results yet."""
    return scenarios.join(done.select(key).distinct(), key, "left_anti")


def with_cached(prompts: DataFrame, cache: DataFrame, prompt: str = "prompt", model: str = "model") -> DataFrame:
    """``prompts`` with the cached ``reply`` of the same content key and model; null is a miss."""
    keyed = prompts.withColumn("cache_key", F.substring(F.sha2(prompt, 256), 1, 16))
    return keyed.join(cache.select("cache_key", model, "reply"), ["cache_key", model], "left")
