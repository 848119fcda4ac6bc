"""Feature documents of behaviour groups, their sanitised form, and the text made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodechain.functions.text import base64_run, basename, first_filled, ip_class, mask_numbers

# Event ids of network events; marks of registry persistence, of files that are noise, and of obfuscation.
NETWORK = (3, 22, 5154, 5155, 5156, 5157, 5158)
PERSISTENT = (
    "currentversion\\run", "currentversion\\runonce", "currentcontrolset\\services", "userinitmprlogonscript", "ms-settings\\shell\\open\\command", "hklm\\security",
    "control\\lsa", "winlogon", "image file execution options", "appinit_dlls", "active setup", "policies\\explorer\\run",
)
NOISE_FILES = ("__psscriptpolicytest_", "moduleanalysiscache")
OBFUSCATED = ("-enc ", "-encodedcommand", "-ec ", "frombase64string", "tobase64string", "invoke-expression", " iex ", "[convert]::", "[reflection.assembly]", "amsiutils", "amsiinitialized")
# Rewrites of paths, in this order.
HOME = r"(?iU)c:\\users\\[^\\]+"
PATHS = [
    (HOME + r"\\appdata\\local\\temp", "%TEMP%"), (HOME + r"\\appdata\\roaming", "%APPDATA%"), (HOME + r"\\desktop", r"%USERPROFILE%\\Desktop"), (HOME, "%USERPROFILE%"),
    (r"(?iU)\b\w[\w\-.]*\.dmp\b", "[memory_dump].dmp"), (r"(?iU)\b\w[\w\-.]*\.bat\b", "[batch_script].bat"), (r"(?iU)\b\w[\w\-.]*\.ps1\b", "[powershell_script].ps1"),
    (r"(?iU)\b\w[\w\-.]*\.vbs\b", "[vbscript].vbs"), (r"(?iU)\b\w[\w\-.]*\.hta\b", "[hta_script].hta"),
]


def obfuscated(c: Column) -> Column:
    low = F.lower(c)
    marked = F.exists(F.array(*map(F.lit, OBFUSCATED)), lambda m: low.contains(m))
    return F.coalesce(marked | base64_run(c) | c.contains("^^^"), F.lit(False))


def sanitise_path(c: Column) -> Column:
    for pattern, to in PATHS:
        c = F.regexp_replace(c, pattern, to)
    return c


def sanitise_command(c: Column) -> Column:
    return mask_numbers(sanitise_path(c))


def sanitise_registry(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)HKU\\S(-\d+){7}\\", r"HKCU\\")


def extract(members: DataFrame) -> DataFrame:
    """Feature documents from (group_id, anchor_time, event columns): one row a group, arrays of structs in event
    order. Groups without events are absent."""
    order = F.col("event_idx")
    keep = lambda cond, s: F.array_sort(F.collect_list(F.when(cond, F.struct(order.alias("idx"), s.alias("v")))))
    values = lambda c: F.transform(c, lambda x: x["v"])
    eid = F.col("EventID")
    parent, child = basename(first_filled(F.col("ParentImage"), F.col("ParentProcessName"))), basename(first_filled(F.col("Image"), F.col("NewProcessName")))
    spawn = F.struct(parent.alias("parent"), child.alias("child"), F.lit("spawn").alias("relation"))
    access = F.struct(basename(F.col("SourceImage")).alias("parent"), basename(F.col("TargetImage")).alias("child"), F.lit("access").alias("relation"))
    command = F.col("CommandLine")
    net = F.struct(first_filled(F.col("DestinationIp"), F.col("DestinationHostname")).alias("dst"), F.col("DestinationPort").try_cast("double").cast("int").alias("port"), F.when(F.col("Protocol") == "6", "TCP").when(F.col("Protocol") == "17", "UDP").otherwise(F.upper("Protocol")).alias("protocol"))
    signal = F.exists(F.array(*map(F.lit, PERSISTENT)), lambda m: F.lower("TargetObject").contains(m))
    noise_file = F.exists(F.array(*map(F.lit, NOISE_FILES)), lambda m: F.lower("TargetFilename").contains(m))
    g = members.groupBy("group_id").agg(
        keep(eid.isin(1, 4688) & child.isNotNull(), spawn).alias("spawns"),
        keep((eid == 10) & (F.col("SourceImage") != F.col("TargetImage")), access).alias("accesses"),
        keep(command.isNotNull(), command).alias("commands"),
        keep(F.col("ScriptBlockText").isNotNull(), F.substring("ScriptBlockText", 1, 2000)).alias("scripts"),
        keep(eid.isin(*NETWORK), net).alias("connections"),
        keep(eid.isin(13, 14) & signal, F.col("TargetObject")).alias("registry_signals"),
        F.count(F.when(eid.isin(13, 14) & ~signal, 1)).alias("registry_noise_count"),
        keep((eid == 11) & ~noise_file, F.col("TargetFilename")).alias("dropped_files"),
        keep(eid == 23, F.col("TargetFilename")).alias("deleted_files"),
        F.max(eid.isin(1102, 104)).alias("log_cleared"),
        F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.count("*").alias("n_events"),
    )
    arrays = ("spawns", "accesses", "commands", "scripts", "connections", "registry_signals", "dropped_files", "deleted_files")
    g = g.withColumns({a: values(F.col(a)) for a in arrays})
    g = g.withColumns({"process_chains": F.array_distinct(F.concat("spawns", "accesses")), "commands": F.array_distinct("commands")})
    return g.withColumns({"has_obfuscation": F.exists("commands", obfuscated), "entity_types": entity_types()}).drop("spawns", "accesses")


def entity_types() -> Column:
    some = lambda c: F.size(c) > 0
    parts = [(some("process_chains") | some("commands"), "process"), (some("registry_signals"), "registry"), (some("dropped_files") | some("deleted_files"), "file"), (some("connections"), "network")]
    return F.array_compact(F.array(*[F.when(c, n) for c, n in parts]))


def sanitise(features: DataFrame) -> DataFrame:
    """Feature documents without what identifies a machine or user."""
    return features.withColumns(
        {
            "commands": F.transform("commands", sanitise_command),
            "scripts": F.transform("scripts", sanitise_command),
            "dropped_files": F.transform("dropped_files", sanitise_path),
            "deleted_files": F.transform("deleted_files", sanitise_path),
            "registry_signals": F.transform("registry_signals", sanitise_registry),
            "connections": F.transform("connections", lambda c: c.withField("dst", ip_class(c["dst"]))),
        }
    )


def to_text(features: DataFrame, out: str = "description") -> DataFrame:
    """A description in fixed order with bounded lists; a stock sentence where nothing is known."""
    listed = lambda c, n, f: F.transform(F.slice(c, 1, n), f)
    parts = F.concat(
        listed("process_chains", 10, lambda p: F.concat(F.coalesce(p["parent"], F.lit("?")), F.when(p["relation"] == "access", " accessed ").otherwise(" spawned "), F.coalesce(p["child"], F.lit("?")))),
        listed("commands", 5, lambda c: F.concat(F.lit("command: "), F.substring(c, 1, 200))),
        listed("registry_signals", 8, lambda r: F.concat(F.lit("registry: "), r)),
        listed("dropped_files", 5, lambda f: F.concat(F.lit("file: "), f)),
        listed("connections", 5, lambda c: F.concat(F.lit("network: "), F.coalesce(c["dst"], F.lit("?")))),
    )
    text = F.array_join(parts, ". ")
    return features.withColumn(out, F.when(text == "", "Activity without further detail").otherwise(text))


def temporal(members: DataFrame, time: str = "time") -> DataFrame:
    """Gaps between a group's events in seconds: least, most, mean (3 places), span, and density of spans over 1 s."""
    w = Window.partitionBy("group_id").orderBy(time, "event_idx")
    us = F.unix_micros(time)
    g = members.withColumn("__g", (us - F.lag(us).over(w)) / 1e6)
    span = (F.max(us) - F.min(us)) / 1e6
    return g.groupBy("group_id").agg(F.round(F.min("__g"), 3).alias("min_gap"), F.round(F.max("__g"), 3).alias("max_gap"), F.round(F.avg("__g"), 3).alias("mean_gap"), F.round(span, 3).alias("span"), F.when(span >= 1, F.round(F.count("*") / span, 3)).alias("density"))
