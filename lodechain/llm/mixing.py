"""Operator 4: mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Weights are whole numbers of slots in a period of ``period`` slots; a slot takes one block of documents of one source.
The j-th block (from 1) of a source with a slots a period is released at slot floor((j - 1) * period / a) and due by
ceil(j * period / a). Of the released blocks the one that is due first goes next. The weights fill the period exactly,
so every block meets its window and after any number of slots each source is less than one block from its share. The
schedule repeats with the period, so only one period is planned; documents are placed by arithmetic.

Each source's documents are put in a pseudo-random order by a hash of their id. The stream goes on until every source
has been used whole; shorter sources begin anew (``epoch`` counts from 0). No document is left out.
"""

from __future__ import annotations

import heapq
import json
from math import ceil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodechain.session import cut

#: Rows of one source that are ranked together.
BUCKET_ROWS = 1024


def quotas(counts: dict[str, int], weights: dict[str, float] | None, period: int, exponent: float) -> dict[str, int]:
    """Slots a period of each source: proportional to ``weights`` or, without them, to count ** exponent; largest
    remainders, one slot at least; with more sources than slots the period grows to their number. A source that ``weights`` lacks, or gives 0, counts as the smallest."""
    period = max(period, len(counts))
    share = {s: float((weights or {}).get(s, 0.0)) if weights else n**exponent for s, n in counts.items()}
    total = sum(share.values()) or 1.0
    exact = {s: v / total * period for s, v in share.items()}
    slots = {s: max(1, int(v)) for s, v in exact.items()}
    for s in sorted(slots, key=lambda s: (slots[s] - exact[s], s)) * 2:
        if sum(slots.values()) >= period:
            break
        slots[s] += 1
    while sum(slots.values()) > period:
        slots[max(slots, key=lambda s: (slots[s] > 1, slots[s] - exact[s], slots[s], s))] -= 1
    return slots


def plan(slots: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block, slot) of one period: earliest deadline first among released blocks."""
    period = sum(slots.values())
    waiting = [(0, s, 0) for s in sorted(slots)]
    ready: list[tuple[int, str, int]] = []
    heapq.heapify(waiting)
    out = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // slots[s]), s, j))
        _, s, j = heapq.heappop(ready)
        out.append((s, j, t))
        if j + 1 < slots[s]:
            heapq.heappush(waiting, ((j + 1) * period // slots[s], s, j + 1))
    return out


def _literal(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from the driver, built by Spark's own JSON reader function."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, block: int = 16, period: int = 1000, exponent: float = 0.7, source: str = "source", doc_id: str = "doc_id", repeat: bool = True) -> DataFrame:
    """``docs`` with ``position`` (from 0, its place in the mixed stream), ``slot``, ``block`` (of its source) and
    ``epoch``; a document has a row for each time the stream uses it.

    A null source is a source by itself. Repeated rows and null ids are documents like others; texts are not read. An
    empty table gives an empty stream. The plan holds ``period`` slots or one for each source, if these are more. The
    last round of a source may be cut short where the stream ends. Without ``repeat`` a source that is used up drops
    out: each document has one row, and the places of further rounds stay empty. Columns named like the outputs are
    replaced.
    """
    made = ("position", "slot", "block", "epoch")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in made]
    whole = docs.select(F.struct(*kept).alias("row"), F.col(source).alias("source"), F.col(doc_id).alias("doc_id"))
    return _schedule(whole, weights, block, period, exponent, repeat).select("row.*", *made)


def _schedule(docs: DataFrame, weights: dict[str, float] | None, block: int, period: int, exponent: float, repeat: bool) -> DataFrame:
    """``row`` with its places, from (row, source, doc_id)."""
    spark, source, doc_id, made = docs.sparkSession, "source", "doc_id", ("position", "slot", "block", "epoch")
    rows = docs.withColumns({"__s": F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null")), "__h": F.xxhash64(doc_id, source)})
    counts = {r["__s"]: r["count"] for r in rows.groupBy("__s").count().collect()}
    slots = quotas(counts, weights and {f"={s}": w for s, w in weights.items()}, period, exponent) if counts else {}
    steps, period = plan(slots), sum(slots.values()) or period
    where = {(s, j): t for s, j, t in steps}
    last = lambda s: (b := ceil(counts[s] / block) - 1) // slots[s] * period + where[s, b % slots[s]]
    end = 1 + max(map(last, counts), default=-1)
    sources = _literal(spark, [{"__s": s, "__n": n, "__a": slots[s], "__buckets": ceil(n / BUCKET_ROWS)} for s, n in counts.items()], "__s string, __n long, __a long, __buckets long")
    slot_of = _literal(spark, [{"__s": s, "__j": j, "__at": t} for s, j, t in steps], "__s string, __j long, __at long")
    dealt = rows.join(F.broadcast(sources), "__s").withColumn("__b", F.pmod("__h", F.col("__buckets")))
    sizes = dealt.groupBy("__s", "__b").agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.partitionBy("__s").orderBy("__b")) - F.col("__c")
    offsets = cut(sizes.select("__s", "__b", before.alias("__before")))
    inside = Window.partitionBy("__s", "__b").orderBy("__h", F.col(doc_id).asc_nulls_first())
    ranked = dealt.withColumn("__r", F.row_number().over(inside) - 1).join(offsets, ["__s", "__b"]).withColumn("__r", F.col("__r") + F.col("__before"))
    rounds = F.floor((F.lit(end) / period * F.col("__a") + 1) * block / F.col("__n")) + 1
    first = F.lit(0).cast("long")
    used = ranked.withColumn("epoch", F.explode(F.sequence(first, rounds)) if repeat else first)
    index = F.col("epoch") * F.col("__n") + F.col("__r")
    placed = used.withColumns({"block": F.floor(index / block), "__o": index % block}).withColumn("__j", F.col("block") % F.col("__a"))
    placed = placed.join(F.broadcast(slot_of), ["__s", "__j"]).withColumn("slot", F.floor(F.col("block") / F.col("__a")) * period + F.col("__at")).where(F.col("slot") < end)
    return placed.withColumn("position", F.col("slot") * block + F.col("__o")).select("row", *made)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = 16, period: int = 1000, exponent: float = 0.7, source: str = "source", doc_id: str = "doc_id", repeat: bool = True) -> DataFrame:
    """``docs`` in the order of the mixed stream: files and rows within them ascend by position. All columns stay as
    they are, whatever their names; nulls, repeats and empty tables are as in ``schedule``."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source).alias("source"), F.col(doc_id).alias("doc_id"))
    placed = _schedule(whole, weights, block, period, exponent, repeat)
    return placed.repartitionByRange("position").sortWithinPartitions("position").select("row.*")
