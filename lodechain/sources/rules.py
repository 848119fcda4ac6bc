"""Rule files, and the tables and reports that a run leaves behind."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def load_rules(spark: SparkSession, folder: str) -> list[dict]:
    """All rules of ``folder``/*.json in order of file name, on any file system that Spark reads. Rules are configuration
    of bounded size; a file that is no JSON object is an error."""
    files = spark.read.text(f"{folder.rstrip('/')}/*.json", wholetext=True).selectExpr("input_file_name() AS name", "value").collect()
    rules = [json.loads(f.value) for f in sorted(files, key=lambda f: f.name.rsplit("/", 1)[-1])]
    if not all(isinstance(r, dict) for r in rules):
        raise ValueError("a rule file must hold one JSON object")
    return rules


def anchor_specs(rule: dict) -> list[tuple[str | None, list, dict]]:
    """(channel, event ids, filters) of a rule's anchor: one for each of its ``conditions``, whose channel and filters
    take precedence over the anchor's own, or one for the anchor itself."""
    anchor = rule.get("anchor") or {}
    ids = lambda x: [i for i in (x if isinstance(x, list) else [x]) if i is not None]
    parts = anchor.get("conditions") or [{}]
    return [(p.get("channel", anchor.get("channel")), ids(p.get("event_id", anchor.get("event_id"))), (anchor.get("filters") or {}) | (p.get("filters") or {})) for p in parts]


def write_events(events: DataFrame, path: str, by: str = "scenario") -> None:
    """The normalised event table as Parquet, a folder for each scenario."""
    events.write.mode("overwrite").partitionBy(by).parquet(path)


def write_json(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Feature documents, mappings, chains or evaluations as JSON lines; nulls are kept as such."""
    w = rows.write.mode("overwrite").option("ignoreNullFields", "false")
    (w.partitionBy(by) if by else w).json(path)


def write_report(rows: DataFrame, path: str, order: list[str]) -> None:
    """A report table as CSV with a header, in files and rows of ascending ``order``."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("header", "true").csv(path)
