"""Operator 7: quality classifier from an interpolated modified Kneser-Ney n-gram model.

The model is over the characters of trusted texts, of order ``ORDER``; a quarter of the trusted documents is held out
of the counts to set the thresholds. Tasks sum the n-grams of what they read, and the counts are sharded by n-gram.
Lower orders count distinct left extensions. Discounts come from the counts of counts, and each order's probabilities
from joins of the count tables with their contexts' totals and with the next lower order.

For scoring, the model is dealt into shards by the two symbols before an n-gram's last one: all n-grams and contexts that
the score of one position can need lie in one shard (orders 1 and 2 in each). A shard is a file of hash tables in the
shared folder. A task joins the n-grams of a few MB of text with one shard after the other, so it never holds more than
a shard, and neither the model nor document rows pass the driver or a shuffle. A position scores by the longest n-gram
that the model has, with back-off weights for the rest. A document is kept unless its perplexity exceeds a high
quantile of the held-out trusted texts of its language.

Frequent characters are one symbol each; any other character is two, its code point's high and low bits, so that each
text has a sequence of symbols of its own.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodechain.llm.common import runs, trimmed
from lodechain.llm.tokenfile import new_folder
from lodechain.session import Scratch

ORDER = 5
BITS = 12  # of a symbol
START, END = 0, 1
#: Characters that are one symbol, and the first of the symbols for the high bits of any other.
OWN = 3500
LEAD = 3 + OWN
#: Entries (n-grams and contexts) of a shard.
SHARD = 1_000_000
#: Bytes of text that a task scores at once.
AT_ONCE = 4 << 20
#: Ids or languages that may be broadcast.
FEW = 500_000
BLOCK = 1 << 20
_SPACE = re.compile(r"\s+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PAIR = (1 << 2 * BITS) - 1


def _points(text: str | None) -> np.ndarray:
    return np.frombuffer(_SPACE.sub(" ", text or "").strip().encode("utf-32-le", "surrogatepass"), np.uint32)


def symbols(points: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    s = numbers[points].astype(np.int64)
    odd = s < 0
    if not odd.any():
        return s
    out = np.repeat(s, 1 + odd)
    at = np.flatnonzero(odd) + np.arange(odd.sum())
    out[at], out[at + 1] = LEAD + (points[odd] >> 12), points[odd] & 0xFFF
    return out


def grams(texts: list[str | None], numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All n-grams of some texts as 60-bit integers, where each text's begin, and each text's number of characters with
    the end, which counts; starts do not."""
    parts, starts, chars, at = [], [], [], 0
    for t in texts:
        p = _points(t)
        s = symbols(p, numbers)
        parts += [np.full(ORDER - 1, START), s, np.full(1, END)]
        starts.append(at)
        chars.append(len(p) + 1)
        at += len(s) + 1
    a = np.concatenate(parts)
    g = np.zeros(len(a) - ORDER + 1, np.int64)
    for j in range(ORDER):
        g = g << BITS | a[j : len(a) - ORDER + 1 + j]
    inside = np.ones(len(g), bool)  # windows that reach into the next text's starts
    ends = np.cumsum([len(x) for x in parts[1::3]]) + np.arange(1, len(texts) + 1) * ORDER
    for e in ends[:-1]:
        inside[e - ORDER + 1 : e] = False
    return g[inside], np.array(starts), np.array(chars, np.int64)


def _groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t or "")
        if size >= BLOCK:
            yield group
            group, size = [], 0
    if group:
        yield group


def alphabet(trusted: DataFrame) -> np.ndarray:
    """Symbol of each code point, -1 for those of two symbols: the ``OWN`` most frequent characters of all trusted texts
    have one of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                at, n = np.unique(_points(t), return_counts=True)
                total[at] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cp", "n"])

    counted = trusted.select("t").mapInArrow(trimmed(run), "cp long, n long").groupBy("cp").agg(F.sum("n").alias("n"))
    own = [r.cp for r in counted.orderBy(F.col("n").desc(), "cp").limit(OWN).collect()]
    numbers = np.full(0x110000, -1, np.int16)
    numbers[own] = np.arange(3, 3 + len(own))
    return numbers


def _counts(trusted: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group in _groups(b.column(0).to_pylist()):
                g, n = np.unique(grams(group, shared.value)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n)], names=["g", "c"])

    return trusted.select("t").mapInArrow(trimmed(run), "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Those of modified Kneser-Ney for counts 1, 2 and more; 1/2 where the counts of counts do not give any."""
    n = {r.c: r.n for r in counts.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), i - 0.05) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def train(trusted: DataFrame, numbers: np.ndarray, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(probabilities, back-offs): (n, g, v) with natural logarithms, by order n and n-gram g; a back-off belongs to
    the context of an n-gram of order n."""
    shared = trusted.sparkSession.sparkContext.broadcast(numbers)
    counts = {ORDER: scratch.put(_counts(trusted, shared))}
    for n in range(ORDER - 1, 0, -1):
        higher = counts[n + 1]
        counts[n] = scratch.put(higher.groupBy(F.col("g").bitwiseAND((1 << BITS * n) - 1).alias("g")).agg(F.count("*").alias("c")))
    lower, probabilities, offs = None, [], []
    for n in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(counts[n])
        c = F.col("c")
        d = F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        rows = counts[n].withColumn("x", F.shiftright("g", BITS))
        contexts = rows.groupBy("x").agg((F.sum(d) / F.sum("c")).alias("off"), F.sum("c").alias("total"))
        rows = rows.join(contexts, "x").withColumn("own", (c - d) / F.col("total"))
        if lower is None:
            rows = rows.withColumn("p", F.col("own") + F.col("off") / (1 << BITS))
        else:
            rows = rows.withColumn("s", F.col("g").bitwiseAND((1 << BITS * (n - 1)) - 1)).join(lower.select(F.col("g").alias("s"), F.col("p").alias("q")), "s")
            rows = rows.withColumn("p", F.col("own") + F.col("off") * F.col("q"))
        lower = scratch.put(rows.select("g", "p"))
        probabilities.append(lower.select(F.lit(n).alias("n"), "g", F.log("p").alias("v")))
        offs.append(contexts.select(F.lit(n).alias("n"), F.col("x").alias("g"), F.log("off").alias("v")))
    union = lambda all_: all_[0] if len(all_) == 1 else all_[0].unionByName(union(all_[1:]))
    return scratch.put(union(probabilities)), scratch.put(union(offs))


class Table:
    """A vectorised hash table from integers to floats: open addressing with linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] == -1
            slot, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slot], self.values[slot] = keys[left[put]], values[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            at, left = (at[rest] + 1) & ((1 << self.bits) - 1), left[rest]

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        """One that was built before."""
        made = cls.__new__(cls)
        made.bits, made.keys, made.values = len(keys).bit_length() - 1, keys, values
        return made

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _ODD >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where absent), and which were found."""
        out, good = np.zeros(len(keys)), np.zeros(len(keys), bool)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]], good[left[hit]] = self.values[at[hit]], True
            on = ~hit & (there != -1)
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out, good


class Model:
    """Scores n-grams by back-off; tables, for each order, of n-grams and of contexts."""

    def __init__(self, p: dict[int, Table], off: dict[int, Table]):
        self.p, self.off = p, off

    def score(self, g: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(g)), np.arange(len(g))
        for n in range(ORDER, 0, -1):
            key = g[left] & ((1 << BITS * n) - 1)
            v, found = self.p[n].find(key)
            out[left[found]] += v[found]
            left, key = left[~found], key[~found]
            if not len(left):
                return out
            out[left] += self.off[n].find(key >> BITS)[0]
        out[left] -= math.log(1 << BITS)
        return out


def shard_of(pair, shards: int):
    """The shard of the two symbols before the last; the same for columns and arrays."""
    mixed = (pair * 2654435761) % (1 << 32)
    return (mixed / 256).cast("long") % shards if not isinstance(pair, np.ndarray) else mixed // 256 % shards


def write_shards(p: DataFrame, off: DataFrame, folder: str, scratch: Scratch) -> list[str]:
    """Write the model's shards as files of hash tables; gives their names in order of shard."""
    shards = max(1, math.ceil((p.count() + off.count()) / SHARD))
    every = F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))
    mine = lambda pair: F.explode(F.when(F.col("n") < 3, every).otherwise(F.array(shard_of(pair, shards)))).alias("shard")
    rows = p.select(mine(F.shiftright("g", BITS).bitwiseAND(_PAIR)), "n", "g", "v").unionByName(off.select(mine(F.col("g").bitwiseAND(_PAIR)), (-F.col("n")).alias("n"), "g", "v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def write():
            path = f"{folder}/{now:06d}-{uuid.uuid4().hex}"
            n, g, v = (np.concatenate(x) for x in zip(*held, strict=True))
            fs, at = pyarrow.fs.FileSystem.from_uri(path)
            with fs.open_output_stream(at) as f:
                head, parts = {}, []
                for kind in (*range(1, ORDER + 1), *range(-ORDER, 0)):
                    table = Table(g[n == kind], v[n == kind])
                    head[kind] = (sum(len(x) for x in parts), len(table.keys))
                    parts += [table.keys, table.values]
                about = json.dumps(head).encode().ljust(1024)
                f.write(about)
                for x in parts:
                    f.write(x.tobytes())
            return pa.RecordBatch.from_pylist([{"shard": now, "path": path}], pa.schema([("shard", pa.int64()), ("path", pa.string())]))

        now, held = None, []
        for b in batches:
            shard, n, g, v = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for s in np.unique(shard).tolist():
                if s != now:
                    if held:
                        yield write()
                    now, held = s, []
                held.append((n[shard == s], g[shard == s], v[shard == s]))
        if held:
            yield write()

    files = scratch.put(rows.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(trimmed(run), "shard long, path string"))
    found = dict(files.collect())
    return [found.get(s, "") for s in range(shards)]


@lru_cache(maxsize=1)
def read_shard(path: str) -> Model:
    """A shard's tables, memory-mapped where the folder is local."""
    if not path:
        return Model(*({n: Table(np.empty(0, np.int64), np.empty(0)) for n in range(1, ORDER + 1)} for _ in range(2)))
    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        raw = np.memmap(at, np.uint8, "r")
    else:
        with fs.open_input_file(at) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    tables = {}
    for kind, (begin, size) in json.loads(bytes(raw[:1024])).items():
        keys, values = (raw[1024 + 8 * (begin + i * size) :][: 8 * size] for i in (0, 1))
        tables[int(kind)] = Table.of(keys.view(np.int64), values.view(np.float64))
    return Model({n: tables[n] for n in range(1, ORDER + 1)}, {n: tables[-n] for n in range(1, ORDER + 1)})


def scores(rows: DataFrame, numbers: np.ndarray, paths: list[str]) -> DataFrame:
    """(k, perplexity, chars) of each row's whole text, by joining its n-grams with the shards one after the other."""
    shared = rows.sparkSession.sparkContext.broadcast((numbers, paths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, paths = shared.value
        for whole in batches:
            for lo, hi in runs(whole.column(1), AT_ONCE):
                b = whole.slice(lo, hi - lo)
                g, starts, chars = (list(x) for x in zip(*[grams(t, numbers) for t in _groups(b.column(1).to_pylist())], strict=True))
                sizes = [len(x) for x in g]
                starts = np.concatenate([s + at for s, at in zip(starts, np.cumsum([0, *sizes[:-1]]).tolist(), strict=True)])
                g, chars = np.concatenate(g), np.concatenate(chars)
                if len(paths) == 1:
                    value = np.concatenate([read_shard(paths[0]).score(x) for x in np.split(g, range(BLOCK, len(g), BLOCK))])
                else:
                    value, which = np.zeros(len(g)), shard_of(g >> BITS & _PAIR, len(paths))
                    for s in np.unique(which).tolist():
                        at = np.flatnonzero(which == s)
                        value[at] = read_shard(paths[s]).score(g[at])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.exp(-np.add.reduceat(value, starts) / chars)), pa.array(chars)], names=["k", "perplexity", "chars"])

    return rows.select("k", "t").mapInArrow(trimmed(run), "k long, perplexity double, chars long")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, prior: float = 48.0, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "quality") -> DataFrame:
    """doc_id, lang, perplexity, threshold and ``keep`` of each row of ``docs``.

    Trusted are the documents whose ``label`` is 1. A quarter of them, by a hash of the id, is held out of the counts;
    all others are counted. The threshold of a language is the ``quantile`` of its held-out documents' perplexities; a
    language without any (also null) takes that of all held-out documents, and without those everything is kept. Null
    and empty texts have the perplexity of an immediate end; each text is judged as if ``prior`` characters of its
    language's median perplexity stood beside it, so that very short texts are not dropped by chance; the threshold is
    the quantile of what is judged. Repeated rows each have a result, equal for equal texts; an empty table gives an
    empty result; other columns of ``docs`` are not read; a text may be as long as a cell can hold.
    """
    spark = docs.sparkSession
    scratch, kept = Scratch(spark, "quality"), Scratch(spark, "perplexity")
    trusted_ids = scratch.put(labels.where(F.col(label) == 1).select(F.col(doc_id).alias("id")).where("id is not null").distinct())
    few = trusted_ids.count() <= FEW
    rows = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.xxhash64(doc_id, text).alias("k"), F.col(text).alias("t"))
    held = F.pmod(F.xxhash64("id"), F.lit(4)) == 0
    learnt = trusted_ids.where(~held)
    trusted = rows.where("t is not null").join(F.broadcast(learnt) if few else learnt, "id", "left_semi")
    numbers = alphabet(trusted)
    paths = write_shards(*train(trusted, numbers, scratch), new_folder(spark, "shards"), scratch)
    scored = scratch.put(scores(rows, numbers, paths).dropDuplicates(["k"]))
    narrow = rows.drop("t").join(scored, "k").drop("k")
    known = trusted_ids.where(held).withColumn("trusted", F.lit(True))
    narrow = kept.put(narrow.join(F.broadcast(known) if few else known, "id", "left"))
    trusted_rows = narrow.where("trusted")
    middle = F.percentile_approx("perplexity", 0.5, 10_000).alias("middle")
    none = [(None,)]
    (whole,) = trusted_rows.agg(middle).first() or none[0]
    by_lang = kept.put(trusted_rows.where("lang is not null").groupBy("lang").agg(middle))
    few_languages = by_lang.count() <= FEW
    # a short text tells little: it is judged as if ``prior`` characters of median perplexity stood beside it
    typical = F.coalesce("middle", F.lit(whole).cast("double"))
    judged = F.exp((F.col("chars") * F.log("perplexity") + prior * F.log(typical)) / (F.col("chars") + prior))
    judge = lambda df: df.join(F.broadcast(by_lang) if few_languages else by_lang, "lang", "left").withColumn("judged", judged)
    top = F.percentile_approx("judged", quantile, 10_000).alias("threshold")
    (limit,) = judge(trusted_rows).agg(top).first() or none[0]
    limits = kept.put(judge(trusted_rows).where("lang is not null").groupBy("lang").agg(top))
    scratch.drop()
    out = judge(narrow).join(F.broadcast(limits) if few_languages else limits, "lang", "left").withColumn("threshold", F.coalesce("threshold", F.lit(limit).cast("double")))
    return out.withColumn("keep", F.coalesce(F.col("judged") <= F.col("threshold"), F.lit(True))).select(F.col("id").alias(doc_id), F.col("lang"), "perplexity", "threshold", "keep")
