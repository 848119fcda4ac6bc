"""Operator 9: secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a file is content-addressed by the SHA-256 of its text. A ledger holds the (blob, rule version) pairs
that were scanned and what was found. A scan picks one carrier for each blob whose pair the ledger lacks, reads that
carrier's text only, adds to the ledger, and joins findings back to every path and version of the blob.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodechain.llm.common import text_key
from lodechain.llm.spans import Kind, listed, number, with_spans
from lodechain.session import cut

BASE = [
    Kind("assign", r"""(?=[PpSsTtAa])(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""", lambda g: F.length(g) >= 8, 1),
    Kind("access", r"AKIA[A-Z0-9]{12,}+"),
    Kind("hex", r"(?<![0-9a-f])[0-9a-f]{32,}+"),
]
ADDED = [
    Kind("pem", r"-----BEGIN (?:[A-Z0-9]++ )*+PRIVATE KEY-----"),
    Kind("forge", r"gh[pousr]_[A-Za-z0-9]{36,}+"),
]


#: Versions to pass over that may be broadcast.
FEW = 200_000


def rule_version(rules: list[Kind]) -> str:
    """Changes whenever a pattern does."""
    return hashlib.sha256("\n".join(f"{k.name} {k.pattern} {k.group}" for k in rules).encode()).hexdigest()[:16]


def scan_blobs(versions: DataFrame, ledger: DataFrame | None = None, rules: list[Kind] | None = None, path: str = "path", text: str = "text") -> DataFrame:
    """New ledger rows (blob, rule_version, spans) for the blobs of ``versions`` that ``ledger`` has not seen under
    these rules. A null text is the empty blob. Of each unseen blob one version, the carrier, is scanned. The versions to
    pass over (seen, or not the carrier) are broadcast behind a check of their number, and then no text is moved; where
    they are more, the carriers' texts are joined by a shuffle."""
    rules = rules or BASE + ADDED
    version = rule_version(rules)
    rows = versions.select(F.coalesce(F.xxhash64(path), F.lit(0)).alias("k"), text_key(F.col(text)).alias("blob"), F.col(text).alias("t"))
    carriers = rows.groupBy("blob").agg(F.min("k").alias("k"))
    if ledger is not None:
        carriers = carriers.join(ledger.where(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    carriers = cut(carriers)
    passed = cut(rows.select("k", "blob").join(carriers, ["k", "blob"], "left_anti").distinct())
    unseen = rows.join(F.broadcast(passed), ["k", "blob"], "left_anti") if passed.count() <= FEW else rows.join(carriers.hint("shuffle_hash"), ["k", "blob"])
    found = with_spans(unseen, "t", rules).select("blob", "spans")
    return found.groupBy("blob").agg(F.first("spans").alias("spans")).select("blob", F.lit(version).alias("rule_version"), "spans")


def join_paths(versions: DataFrame, ledger: DataFrame, text: str = "text", rules: list[Kind] | None = None) -> DataFrame:
    """``versions`` with ``blob`` and its ``spans`` from the ledger (empty where nothing was found)."""
    version = rule_version(rules or BASE + ADDED)
    hits = ledger.where((F.col("rule_version") == version) & (F.size("spans") > 0)).select("blob", "spans")
    kind = hits.schema["spans"].dataType
    out = versions.withColumn("blob", text_key(F.col(text))).drop("spans").join(hits, "blob", "left")
    return out.withColumn("spans", F.coalesce("spans", F.array().cast(kind)))


def scan(versions: DataFrame, ledger: DataFrame | None = None, path: str = "path", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """One round: the versions with their findings, and the ledger with the new rows added (both for the default
    rules). Repeated rows keep their findings; a null path is a path like others; texts are read whole; an empty table
    gives an empty result and the old ledger; only ``path`` and ``text`` are read."""
    new = cut(scan_blobs(versions, ledger, path=path, text=text))
    whole = new if ledger is None else ledger.unionByName(new)
    return join_paths(versions.select(path, text), whole, text), whole


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind_order"] < len(BASE))


def digest(found: DataFrame, path: str) -> DataFrame:
    """The counts, the digest of the base spans, and all spans of each path."""
    spans = F.col("spans")
    return found.select(path, *[number(spans, k.name).alias(f"n_{k.name}") for k in BASE], F.sha2(listed(base_only(spans)), 256).alias("base_sha256"), listed(spans).alias("spans"))
