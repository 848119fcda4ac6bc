"""Rule-anchored behaviour groups: anchors, supporting events, confidence, merging and caps."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodechain.operators.graph import components
from lodechain.operators.range_join import range_join
from lodechain.session import cut

#: Sets that are compared with each other at once are about twice as many; their members, so many at a time.
CELL, WIDE = 1024, 1024

#: Keys of a rule filter that describe it and test nothing (fixed values).
DESCRIPTIVE = ("note", "direction_note")


def rule_predicate(filters: dict) -> Column:
    """AND over fields. A string is a substring test, a list any of several; a dict tests its first operator only:
    contains, contains_any, endswith, in, not_contains. ``equals`` and unknown operators, numbers and booleans pass.
    Values compare trimmed and lower-cased; a blank or null value fails all but tests that always pass and
    not_contains."""
    tests = []
    for name, want in filters.items():
        if name in DESCRIPTIVE:
            continue
        v = F.nullif(F.lower(F.trim(F.col(name).cast("string"))), F.lit(""))
        has = lambda s, v=v: v.contains(str(s).lower())
        if isinstance(want, str):
            test = has(want)
        elif isinstance(want, list):
            test = reduce(Column.__or__, map(has, want), F.lit(False))
        elif isinstance(want, dict):
            op, arg = next(iter(want.items()))
            many = arg if isinstance(arg, list) else [arg]
            if op == "not_contains":
                tests.append(reduce(Column.__and__, [F.coalesce(~has(a), F.lit(True)) for a in many]))
                continue
            test = {"contains": lambda: reduce(Column.__or__, map(has, many)), "contains_any": lambda: reduce(Column.__or__, map(has, many)), "endswith": lambda: reduce(Column.__or__, [v.endswith(str(a).lower()) for a in many]), "in": lambda: v.isin([str(a).lower() for a in many])}.get(op, lambda: F.lit(True))()
        else:
            test = F.lit(True)
        tests.append(F.coalesce(test, F.lit(False)))
    return reduce(Column.__and__, tests, F.lit(True))


def anchors(events: DataFrame, kind: str, specs: list[tuple[list, dict]], noise: Column | None = None) -> DataFrame:
    """Events that any (kinds, filters) spec picks and that are no noise; each event once."""
    picked = reduce(Column.__or__, [F.col(kind).isin(kinds) & rule_predicate(filters) for kinds, filters in specs])
    return events.where(picked if noise is None else picked & ~F.coalesce(noise, F.lit(False)))


def groups(anchor: DataFrame, events: DataFrame, host: str, time: str, kind: str, idx: str, supporting: list[str], before: int, after: int) -> DataFrame:
    """One row for each anchor: all member indices, the number of supporting ones, and the share of supporting kinds seen to two
    places (1.0 where no kind supports)."""
    a = anchor.select(F.col(host), F.col(idx).alias("anchor_idx"), F.col(time).alias("__at"))
    e = events.select(F.col(host), F.col(idx).alias("__i"), F.col(time).alias("__t"), F.col(kind).alias("__k"))
    near = range_join(a, e, [host], "__at", "__t", before, after)
    supports = F.col("__k").isin(supporting) & (F.col("__i") != F.col("anchor_idx"))
    return near.where(supports | (F.col("__i") == F.col("anchor_idx"))).groupBy("anchor_idx", host).agg(
        F.sort_array(F.collect_set("__i")).alias("all_idxs"),
        F.count(F.when(supports, 1)).alias("n_support"),
        (F.round(F.size(F.collect_set(F.when(F.col("__k").isin(supporting), F.col("__k")))) / F.lit(len(set(supporting))), 2) if supporting else F.lit(1.0)).alias("confidence"),
    )


def merge_same_anchor(found: DataFrame) -> DataFrame:
    """Groups of one anchor as one: the first of the most confident stands for all, indices are united."""
    best = F.max_by(F.struct("technique_id", "confidence"), F.struct("confidence", -F.col("ord")))
    return found.groupBy("anchor_idx").agg(best.alias("rep"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("all_idxs")))).alias("all_idxs"), F.array_sort(F.collect_set("technique_id")).alias("matched_techniques"), F.count("*").alias("merged_count")).select(
        "anchor_idx", F.col("rep.technique_id").alias("technique_id"), F.col("rep.confidence").alias("confidence"), "all_idxs", "matched_techniques", "merged_count"
    )


def merge_overlapping(found: DataFrame, key: str, gid: str, members: str, least: float = 0.5) -> DataFrame:
    """(gid, root): groups of one ``key`` whose member sets have a Jaccard of ``least`` (above 0) or more, closed transitively.

    Equal sets are one set first. Two different sets can only be near enough if both have ``least`` / (1 - ``least``) members,
    and if they share one of the rarest members of each (prefix filter). Sets that share such a member are compared in
    tiles, which give a spanning forest of the links that they find, so that neither pairs nor links are rows."""
    sets = found.select(key, gid, F.size(members).alias("n"), F.array_sort(F.array_distinct(F.filter(members, lambda x: x.isNotNull()))).alias("m")).where(F.size("m") > 0)
    rep = sets.groupBy(key, "n", "m").agg(F.min(gid).alias("rep"))
    same = sets.where(F.size("m") >= least * (2 * F.col("n") - F.size("m"))).join(rep, [key, "n", "m"]).select(F.col(gid).alias("a"), F.col("rep").alias("b"))
    few = 1e-9
    large = cut(rep.where(F.col("n") + few >= (least / (1 - least) if least < 1 else float("inf"))).withColumn("s", F.xxhash64(key, "rep", "m")))
    one = large.select(key, "rep", "n", "s", F.explode("m").alias("t"))
    often = one.groupBy(key, "t").agg(F.count("*").alias("often"))
    first = one.join(often, [key, "t"]).withColumn("__r", F.row_number().over(Window.partitionBy(key, "rep", "s").orderBy("often", "t")))
    # how many of its rarest members a set must have looked at; a set without a null has n members
    first = first.where((F.col("__r") <= F.col("n") - F.ceil(least * F.col("n") - few) + 1) & (F.col("often") > 1))
    side = F.ceil(F.col("often") / CELL).cast("int")
    place = F.pmod("s", side).cast("int")
    cells = first.select(key, "t", "rep", "s", F.explode(F.transform(F.sequence(F.lit(0), side - 1), lambda j: F.struct(F.least(place, j).alias("i"), F.greatest(place, j).alias("j")))).alias("c"))
    tiles = cells.join(large.select(key, "rep", "s", "n", "m"), [key, "rep", "s"]).repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, "t", "c")
    kind = dict(found.dtypes)[gid]
    mine = {x: f"__{i}" for i, x in enumerate((key, "t", "c", "rep", "n", "m"))}
    tiles = tiles.select(*[F.col(x).alias(y) for x, y in mine.items()]).sortWithinPartitions("__0", "__1", "__2")
    linked = tiles.select(F.xxhash64("__0", "__1", "__2").alias("tile"), "__3", "__4", "__5").mapInArrow(_links(least), f"a {kind}, b {kind}")
    roots = components(same.union(linked)).withColumnRenamed("k", gid)
    return found.select(gid).join(roots, gid, "left").select(gid, F.coalesce("root", gid).alias("root"))


def _links(least: float):
    """Rows of tiles, one behind the other, to the edges of a spanning forest of each tile's links."""

    def forest(ids: pa.Array, n: np.ndarray, members: pa.Array) -> pa.RecordBatch:
        sizes = pc.list_value_length(members).to_numpy()
        codes = members.flatten().dictionary_encode()
        row, code = np.repeat(np.arange(len(n)), sizes), codes.indices.to_numpy().astype(np.int64)
        often = np.bincount(code, minlength=len(codes.dictionary)) > 1  # what one set has is not shared
        row, code = row[often[code]], (np.cumsum(often) - 1)[code[often[code]]]
        shared = np.zeros((len(n), len(n)), np.float32)
        for lo in range(0, int(often.sum()), WIDE):  # members, so many at a time
            some = (code >= lo) & (code < lo + WIDE)
            x = np.zeros((len(n), WIDE), np.float32)
            x[row[some], code[some] - lo] = 1
            shared += x @ x.T
        near = shared >= least * (n[:, None] + n[None] - shared.astype(np.float64))
        left, a, b = np.ones(len(n), bool), [], []
        while left.any():  # breadth first; every set is met once
            start = int(left.argmax())
            left[start], front = False, [start]
            while front:
                at = front.pop()
                new = np.flatnonzero(near[at] & left)
                left[new] = False
                a += [at] * len(new)
                b += new.tolist()
                front += new.tolist()
        return pa.RecordBatch.from_arrays([ids.take(pa.array(a, pa.int64())), ids.take(pa.array(b, pa.int64()))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def ended() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            return forest(t.column(1).combine_chunks(), t.column(2).to_numpy().astype(np.float64), t.column(3).combine_chunks())

        for b in batches:
            tile = b.column(0).to_numpy()
            starts = np.flatnonzero(np.append(True, tile[1:] != tile[:-1])) if len(tile) else []
            for lo, hi in zip(starts, [*starts[1:], len(tile)], strict=True):
                if held and held[-1].column(0)[-1].as_py() != tile[lo]:
                    yield ended()
                held.append(b.slice(int(lo), int(hi - lo)))
        if held:
            yield ended()

    return run


def stride_cap(df: DataFrame, key: list[str], order: list[Column], cap: int) -> DataFrame:
    """Every max(1, n // cap)-th row of each key, at most ``cap``."""
    w = Window.partitionBy(*key)
    d = df.withColumns({"__n": F.count("*").over(w), "__r": F.row_number().over(w.orderBy(*order)) - 1})
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / cap))
    return d.where((F.col("__r") % step == 0) & (F.floor(F.col("__r") / step) < cap)).drop("__n", "__r")


def first_n(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def round_robin(df: DataFrame, key: str, order: list[Column], rank: str = "turn") -> DataFrame:
    """Rank of each row within its key: ordering by (rank, key) takes the i-th best of every key in turn."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
