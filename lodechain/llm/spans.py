"""Pattern matches with code-point positions, in built-in column functions only.

Spark gives the matches of a pattern and the pieces between them; positions are prefix sums of their lengths. The sums
are taken in blocks, so that a text with n matches costs about n * sqrt(n) steps at worst instead of n * n.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodechain.llm.common import fresh

BLOCK = 64


@dataclass(frozen=True)
class Kind:
    """A kind of span. ``pattern`` is a Java pattern that never backtracks over a run; ``keep`` tests a match (its
    text, or that of ``group``); a match that fails is dropped and the search goes on behind it."""

    name: str
    pattern: str
    keep: object = None
    group: int = 0


def running(lengths: Column) -> Column:
    """Inclusive prefix sums of an integer array."""
    append = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))
    empty = F.array().cast("array<int>")
    small = F.aggregate(lengths, empty, append)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    ends = F.aggregate(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)), empty, append)
    before = F.concat(F.array(F.lit(0)), ends)
    large = F.flatten(F.zip_with(blocks, F.slice(before, 1, F.greatest(F.size(before) - 1, F.lit(0))), lambda b, at: F.transform(F.aggregate(b, empty, append), lambda x: x + at)))
    return F.when(F.size(lengths) <= BLOCK, small).otherwise(large)


def _kept(i: int, k: Kind, v: str, e: str, g: str) -> Column:
    """The matches of one kind that pass its test, as structs."""
    rows = F.arrays_zip(F.col(v).alias("v"), F.col(e).alias("e"), F.col(g).alias("g"))
    if k.keep:
        rows = F.filter(rows, lambda r: k.keep(r["g"]))
    return F.transform(rows, lambda r: F.struct((r["e"] - F.length(r["v"])).alias("start"), F.lit(i).alias("kind_order"), r["e"].alias("end"), F.lit(k.name).alias("kind"), r["v"].alias("value")))


def with_spans(df: DataFrame, text: str, kinds: list[Kind], out: str = "spans") -> DataFrame:
    """``df`` with an array of structs (start, kind_order, end, kind, value) of all matches that pass, by start, then
    kind. A null or empty text has none; a column named like the output is replaced, all others stay, whatever their
    names. Narrow; stays in the JVM."""
    t = F.col(text)
    names = [fresh(df, f"v{i}", f"p{i}", f"g{i}", f"e{i}") for i in range(len(kinds))]
    made: dict[str, Column] = {}
    none = F.array().cast("array<string>")
    for k, (v, p, g, _) in zip(kinds, names, strict=True):
        hit = F.coalesce(t.rlike(k.pattern), F.lit(False))
        made[v] = F.when(hit, F.regexp_extract_all(t, F.lit(k.pattern), F.lit(0))).otherwise(none)
        made[p] = F.when(hit, F.split(t, k.pattern, -1)).otherwise(none)
        if k.group:
            made[g] = F.when(hit, F.regexp_extract_all(t, F.lit(k.pattern), F.lit(k.group))).otherwise(none)
    df = df.withColumns(made)
    df = df.withColumns({e: running(F.zip_with(F.slice(p, 1, F.size(v)), F.col(v), lambda a, b: F.length(a) + F.length(b))) for v, p, _, e in names})
    found = [_kept(i, k, v, e, g if k.group else v) for i, (k, (v, _, g, e)) in enumerate(zip(kinds, names, strict=True))]
    return df.withColumn(out, F.array_sort(F.concat(*found))).drop(*[n for four in names for n in four])


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def number(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
