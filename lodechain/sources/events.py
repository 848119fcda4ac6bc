"""Endpoint event sources: JSON lines in two layouts to one schema of core columns and a map of the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodechain.functions.text import first_filled, message_pairs, to_int

#: Core columns that operators read; all other keys go to ``extra`` (fixed values: field names of the log format).
CORE = [
    "EventID", "Hostname", "Channel", "SourceName", "Message", "ProcessGuid", "ParentProcessGuid", "SourceProcessGUID", "TargetProcessGUID", "TargetProcessGuid",
    "Image", "NewProcessName", "ParentImage", "ParentProcessName", "SourceImage", "TargetImage", "ImageLoaded", "Application", "CommandLine", "ScriptBlockText",
    "User", "Domain", "UserSid", "IntegrityLevel", "LogonId", "SubjectUserName", "SubjectLogonId", "TargetUserName", "TargetObject", "Details", "TargetFilename", "PipeName", "QueryName",
    "GrantedAccess", "EventType", "DestinationIp", "SourceIp", "DestinationPort", "SourcePort", "DestinationHostname", "Protocol", "ProcessId", "NewProcessId", "ParentProcessId", "ObjectName", "ServiceName",
]
#: Top-level keys of the nested layout and their names in the flat one (fixed values).
RENAMED = {"event_id": "EventID", "computer_name": "Hostname", "log_name": "Channel", "source_name": "SourceName", "message": "Message", "process_id": "ExecutionProcessID", "thread_id": "ThreadID", "record_number": "RecordNumber", "level": "Severity", "task": "Category"}
TIMES = ("@timestamp", "TimeCreated", "EventTime")
FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "M/d/yyyy h:mm:ss a")
PIDS = ("ProcessId", "NewProcessId", "ParentProcessId")


def _overriding(low: Column, high: Column) -> Column:
    """Both maps as one; the second wins."""
    return F.map_concat(F.map_filter(low, lambda k, v: ~F.map_contains_key(high, k)), high)


def flat_fields(line: Column) -> Column:
    """The fields of one JSON object as a map of strings; null for blank lines, malformed JSON and values that are no
    object. The nested layout (``event_id`` without ``EventID``) gives its ``event_data`` keys, overridden by the
    renamed top-level ones."""
    empty = F.create_map().cast("map<string,string>")
    top = F.when(F.trim(line).startswith("{"), F.from_json(line, "map<string,string>", {"mode": "PERMISSIVE"}))
    top = F.when(F.is_valid_json(line) if hasattr(F, "is_valid_json") else F.try_parse_json(line).isNotNull(), top)
    inner = F.coalesce(F.from_json(top["event_data"], "map<string,string>"), empty)
    renames = F.create_map(*[x for k, v in RENAMED.items() for x in (F.lit(k), F.lit(v))])
    outer = F.transform_keys(F.map_filter(top, lambda k, v: k != "event_data"), lambda k, v: F.coalesce(renames[k], k))
    nested = F.map_contains_key(top, F.lit("event_id")) & ~F.map_contains_key(top, F.lit("EventID"))
    return F.when(nested, _overriding(inner, outer)).otherwise(top)


def parse_time(c: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in FORMATS], c.try_cast("timestamp"))


def normalise(lines: DataFrame) -> DataFrame:
    """Events of (scenario, line_no, value): core columns, ``extra``, ``time``, integer process ids, ``logon_id`` and
    ``event_idx``, the row's position in its scenario by time (nulls last), then line. Fields found in a message's text
    fill in for absent ones only."""
    spark = lines.sparkSession
    f = lines.select("scenario", "line_no", flat_fields(F.col("value")).alias("f")).where("f is not null")
    parsed = F.map_filter(message_pairs(F.col("f")["Message"]), lambda k, v: ~k.rlike("^[0-9]*$") & ~F.array_contains(F.map_values("f"), v))
    f = f.withColumn("f", _overriding(F.coalesce(parsed, F.create_map().cast("map<string,string>")), F.map_filter("f", lambda k, v: v.isNotNull())))
    core = [F.col("f")[c].alias(c) for c in CORE if c != "EventID"]
    known = F.array(*map(F.lit, CORE))
    out = f.select("scenario", "line_no", to_int(F.col("f")["EventID"]).cast("int").alias("EventID"), *core, F.map_filter("f", lambda k, v: ~F.array_contains(known, k)).alias("extra"), first_filled(*[F.col("f")[t] for t in TIMES]).alias("__time"))
    out = out.withColumn("time", parse_time(F.col("__time"))).drop("__time")
    out = out.withColumns({f"{p}_int": to_int(F.col(p)) for p in PIDS})
    logon = F.when(F.col("EventID") == 1, F.col("LogonId")).when(F.col("EventID").isin(4688, 4689), F.col("SubjectLogonId"))
    out = out.withColumn("logon_id", F.nullif(F.lower(logon), F.lit("0x0")))
    w = Window.partitionBy("scenario").orderBy(F.col("time").asc_nulls_last(), "line_no")
    assert spark is not None
    return out.withColumn("event_idx", (F.row_number().over(w) - 1).cast("long"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """All scenarios below ``path`` in one job; a file is a scenario. Lines are numbered by their place in the file:
    the reader keeps a file's lines in order within a split, so the pair of split and row orders them."""
    lines = spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("scenario"), (F.col("_metadata.file_block_start")).alias("__s"), F.monotonically_increasing_id().alias("__i"), "value")
    return normalise(lines.withColumn("line_no", F.col("__s") * F.lit(1 << 20) + (F.col("__i") % F.lit(1 << 33))).drop("__s", "__i"))
