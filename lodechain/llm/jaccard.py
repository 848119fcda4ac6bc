"""Operator 5: exact n-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct five-word shingles. Equal sets form a class and one row stands for it. All
shingles have one global order, rare ones first. If two sets have the overlap that the threshold asks for, the first
|x| - ceil(t * |x|) + l of each share at least l shingles, for every l. Each document takes the l whose prefix is
cheapest by estimated candidate cost: a longer prefix reads more postings but a candidate must then match l times. A
pair is a candidate when its shared prefix shingles, counted up to the smaller l of the two, reach that l; candidates
are verified on their texts.

Order: exact counts of 32-bit fingerprints over all classes, summed in ranges of fingerprints. Only what is bounded
goes to the tasks: the most frequent fingerprints (``MOST`` at most, with the power of two of their count) and a bitmap
of fixed size that tells which fingerprints were seen twice. Shingles seen once come first, then those seen more often,
then frequent ones by power; ties are in order of hash. Any order gives the same result.

Components: turn by turn each document is verified against one partner, drawn from its postings, until hardly any are
linked; only pairs whose components still differ are then joined in full. So no group of near copies is expanded into all its pairs.
Turns ask in alternation for the postings' most central set, which most near copies of one text link with, and for a drawn one.

What is left are outliers of such groups, too far from all others. The closer two sizes are, the more two sets must share and
the shorter are the prefixes that must meet. So before the full join, a set drops out against partners of a class of size when
too few of its shingles, up to where those prefixes end, lie in postings that other components of that class share; and sets
meet only where their sketches, parities of shingles by hash, differ in no more bits than similar sets can. Both are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodechain.llm.common import runs, trimmed
from lodechain.session import Scratch

WORDS = 5
#: Threshold as a fraction, NUM / DEN.
NUM, DEN = 80, 100
RANGES = 1024
LOW = 22  # bits of a fingerprint within a range
BITS_OFF = 5  # fingerprints that share a bit of the bitmap: 2 ** BITS_OFF
MOST = 1 << 20
LONGEST = 8
#: Cost of verifying a candidate, in postings read.
VERIFY = 50.0
#: Ids that may be broadcast; beyond it they are joined by a shuffle.
FEW = 500_000
#: Fingerprints that a task counts at once, and bytes of text that it reads at once.
FLUSH = 1_000_000
AT_ONCE = 2 << 20
#: Sets of a posting and class of size that meet in one task.
MEETING = 128
#: 64-bit integers of a sketch.
SKETCH = 8
#: Documents are verified against one partner each, turn by turn, two at least, until a turn links fewer than one in so
#: many of those whose postings are still shared by several components; the rest is then joined in full.
FEW_LINKED = 40

_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base, np.uint64))])


_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 64, 256, np.uint64)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_table: list[np.ndarray] = [_powers(_BASE, 1 << 17), _powers(pow(_BASE, -1, 1 << 64), 1 << 17)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of lower-cased bytes: differences of a running polynomial with random coefficients
    for the bytes, shifted back to the word's start. Long texts are taken in blocks of whole words."""
    b = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[b], prepend=True, append=True))
    starts, ends = edge[0::2], edge[1::2]
    out, i = [], 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + (1 << 17), "right")))
        size = int(ends[j - 1] - lo)
        if size <= 1 << 17:
            power, back = _table
        else:
            power, back = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE[b[lo : ends[j - 1]]] * power[:size], out=total[1:])
        at, to = starts[i:j] - lo, ends[i:j] - lo
        out.append(_mixed((total[to] - total[at]) * back[at]))
        i = j
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's five-word shingles (A-Z lower-cased; words are what stands between
    ASCII white space). Fewer words: the whole sequence as one. None: empty."""
    a = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(a):
        return a
    n = len(a) - WORDS + 1
    if n > 0:
        h = a[:n] * _STEP[0]
        for j in range(1, WORDS):
            h += a[j : n + j] * _STEP[j]
    else:
        h = np.array([(a * _STEP[: len(a)]).sum() + np.uint64(len(a))], np.uint64)
    return np.unique(_mixed(h))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether DEN * |a & b| >= NUM * |a | b|."""
    if not len(a) or not len(b):
        return False
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return DEN * both >= NUM * (len(a) + len(b) - both)


def least_overlap(n):
    """Smallest overlap with any partner: ceil(NUM / DEN * n)."""
    return -(-NUM * n // DEN)


def _pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``AT_ONCE`` bytes of a column of texts."""
    for b in batches:
        for lo, hi in runs(b.column(column), AT_ONCE):
            yield b.slice(lo, hi - lo)


def _sets(rows: DataFrame) -> DataFrame:
    """(k, doc_id, n, c): c is the 128-bit hash of the set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches, 2):
            sets = [shingles(t) for t in b.column(2).to_pylist()]
            made = [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=["k", "doc_id", "n", "c"])

    return rows.mapInArrow(trimmed(run), f"k long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, c binary")


def _count_blobs(tokens: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """For each range: sorted distinct fingerprints as gaps, and their counts up to 255."""
    fp, n = np.unique(np.concatenate(tokens), return_counts=True)
    cuts = np.searchsorted(fp, np.arange(RANGES + 1, dtype=np.uint64) << np.uint64(LOW))
    low, n = (fp & np.uint32((1 << LOW) - 1)).astype(np.uint32), np.minimum(n, 255).astype(np.uint8)
    for r in range(RANGES):
        i, j = cuts[r], cuts[r + 1]
        if j > i:
            gaps = np.diff(low[i:j], prepend=np.uint32(0))
            wide = gaps.max() > 65535
            yield r, bytes([int(wide)]) + gaps.astype(np.uint32 if wide else np.uint16).tobytes() + n[i:j].tobytes()


def _read_blob(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = 5 if blob[0] else 3
    m = (len(blob) - 1) // size
    gaps = np.frombuffer(blob, np.uint32 if blob[0] else np.uint16, m, 1)
    return np.cumsum(gaps, dtype=np.int64), np.frombuffer(blob, np.uint8, m, 1 + m * (size - 1))


def _statistics(rows: DataFrame, scratch: Scratch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bitmap of fingerprints seen twice; the most frequent fingerprints, sorted; powers of two of their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            found = list(_count_blobs(held)) if size else []
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names=["r", "blob"])

        for b in _pieces(batches, 0):
            for t in b.column(0).to_pylist():
                held.append((shingles(t) >> np.uint64(32)).astype(np.uint32))
                size += len(held[-1])
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, dense = None, [], 0, None

        def row():
            nonlocal dense
            if dense is None:  # few: by sorting
                at, n = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.argsort(at, kind="stable")
                at, first = np.unique(at[order], return_index=True)
                n = np.add.reduceat(n[order].astype(np.int64), first)
            else:
                fold()
                at = np.flatnonzero(dense)
                n = dense[at]
            seen = np.zeros(1 << (LOW - BITS_OFF), bool)
            seen[at[n >= 2] >> BITS_OFF] = True
            at, n = at[n >= 4], n[n >= 4]
            power = np.log2(n).astype(np.uint8)
            dense = None
            return pa.RecordBatch.from_pylist([{"r": now, "bits": np.packbits(seen).tobytes(), "fp": (at | now << LOW).astype(np.uint32).tobytes(), "power": power.tobytes(), "hist": np.bincount(power, minlength=64).tolist()}], pa.schema([("r", pa.int32()), ("bits", pa.binary()), ("fp", pa.binary()), ("power", pa.binary()), ("hist", pa.list_(pa.int64()))]))

        def fold():
            nonlocal dense, size
            dense = np.zeros(1 << LOW, np.int64) if dense is None else dense
            for at, n in held:
                dense[at] += n
            held.clear()
            size = 0

        for b in batches:
            for r, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if r != now:
                    if now is not None:
                        yield row()
                    now, size = r, 0
                    held.clear()
                held.append(_read_blob(blob))
                size += len(held[-1][0])
                if size >= FLUSH:
                    fold()
        if now is not None:
            yield row()

    blobs = rows.select("t").mapInArrow(trimmed(count), "r int, blob binary")
    sums = scratch.put(blobs.repartition("r").sortWithinPartitions("r").mapInArrow(trimmed(total), "r int, bits binary, fp binary, power binary, hist array<long>"))
    hist = np.zeros(64, np.int64)
    for p, n in sums.select(F.posexplode("hist")).groupBy("pos").sum("col").collect():
        hist[p] = n
    least = next(p for p in range(2, 65) if hist[p:].sum() <= MOST)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for fp, power in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p = np.frombuffer(power, np.uint8)
                kept.append((np.frombuffer(fp, np.uint32)[p >= least].tobytes(), p[p >= least].tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in kept], pa.binary()), pa.array([x for _, x in kept], pa.binary())], names=["r", "bits", "fp", "power"])

    bits, fps, powers = np.zeros((RANGES, 1 << (LOW - BITS_OFF - 3)), np.uint8), [], []
    for r in sorted(sums.mapInArrow(trimmed(frequent), "r int, bits binary, fp binary, power binary").collect()):
        bits[r.r] = np.frombuffer(r.bits, np.uint8)
        fps.append(np.frombuffer(r.fp, np.uint32))
        powers.append(np.frombuffer(r.power, np.uint8))
    empty = [np.empty(0, np.uint32)]
    return bits.ravel(), np.concatenate(fps or empty), np.concatenate(powers or [np.empty(0, np.uint8)])


def prefix(s: np.ndarray, bits: np.ndarray, fps: np.ndarray, powers: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, tuple[int, int]]:
    """A set's prefix shingles that can have partners, their levels, the set's own l, and the place in the global order
    where the prefix ends. A level tells a shingle's place in the set: the prefix for l matches ends with level l."""
    fp = (s >> np.uint64(32)).astype(np.uint32)
    spot = fp >> np.uint32(BITS_OFF)
    twice = (bits[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8)) & 1
    power = twice.astype(np.uint8)
    if len(fps):
        at = np.searchsorted(fps, fp)
        at[at == len(fps)] = 0
        hit = fps[at] == fp
        power[hit] = powers[at[hit]]
    n = len(s)
    first = n - least_overlap(n) + 1
    order = np.argsort(power, kind="stable")[: first + LONGEST - 1]  # s ascends, so ties are in order of hash
    shared = power[order] > 0
    cost = np.cumsum(np.where(shared, np.exp2(power[order].astype(np.float64)), 0.0))
    ells = np.arange(1, len(order) - first + 2)
    read = cost[first - 1 :]
    ell = int(np.argmin(read + VERIFY * read / ells)) + 1
    used = order[: first + ell - 1]
    level = np.arange(len(used)) - first + 2
    end = int(power[used[-1]]), int(s[used[-1]]) - (1 << 63)
    return s[used][shared[: len(used)]], level[shared[: len(used)]], ell, end


def _entries(rows: DataFrame, shared) -> DataFrame:
    """(h, k, n, level, ell, end_power, end_hash) of all prefix shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches, 1):
            h, k, n, level, ell, power, end = [], [], [], [], [], [], []
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(t)
                found, lv, e, (ep, eh) = prefix(s, *shared.value) if len(s) else (s, s, 0, (0, 0))
                m = len(found)
                if m:
                    h.append(found.view(np.int64))
                    level.append(lv)
                    for out, x in ((k, key), (n, len(s)), (ell, e), (power, ep), (end, eh)):
                        out.append(np.full(m, x))
            made = [pa.array(np.concatenate(x) if x else [], kind) for x, kind in ((h, pa.int64()), (k, pa.int64()), (n, pa.int32()), (level, pa.int32()), (ell, pa.int16()), (power, pa.int16()), (end, pa.int64()))]
            yield pa.RecordBatch.from_arrays(made, names=["h", "k", "n", "level", "ell", "end_power", "end_hash"])

    return rows.select("k", "t").mapInArrow(trimmed(run), "h long, k long, n int, level int, ell short, end_power short, end_hash long")


def _among(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``rows`` semi- or anti-joined with distinct row keys; these are broadcast behind a check of their number."""
    return rows.join(F.broadcast(ids) if ids.count() <= FEW else ids, "k", how)


def _verified(pairs: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of row keys whose texts are similar."""
    pairs = scratch.put(pairs)
    ids = scratch.put(pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct())
    texts = scratch.put(_among(rows.select("k", "t"), ids, "left_semi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, shingles(None)
        for b in batches:
            for lo, hi in runs(b.column(2), AT_ONCE):
                p, good = b.slice(lo, hi - lo), []
                for a, x, y in zip(p.column(0).to_pylist(), p.column(2).to_pylist(), p.column(3).to_pylist(), strict=True):
                    if a != last:
                        last, first = a, shingles(x)
                    good.append(similar(first, shingles(y)))
                yield from pa.table([p.column(0), p.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_())).to_batches()

    both = pairs.join(texts.withColumnsRenamed({"k": "b", "t": "tb"}), "b").join(texts.withColumnsRenamed({"k": "a", "t": "ta"}), "a")
    return scratch.put(both.select("a", "b", "ta", "tb").mapInArrow(trimmed(run), "a long, b long"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(k, root): for every node of ``edges`` (a, b) the smallest node that it reaches, by minimum labels and pointer
    jumping; the number of rounds is logarithmic in practice, and each is written to the shared folder."""
    both = scratch.put(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    labels = scratch.put(both.groupBy(F.col("a").alias("k")).agg(F.least(F.min("b"), F.min("a")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("k").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("k")).agg(F.min("r").alias("r"))
        lower = labels.join(near, "k").select("k", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        up = labels.select(F.col("k").alias("root"), F.col("root").alias("above"))
        new = scratch.put(lower.join(up, "root", "left").select("k", "old", F.least("root", F.coalesce("above", "root")).alias("root")))
        labels = new.select("k", "root")
        if new.where("root <> old").isEmpty():
            return labels


def _length_ok(a: str, b: str):
    return (F.col(a) * DEN >= F.col(b) * NUM) & (F.col(b) * DEN >= F.col(a) * NUM)


def _known(entries: DataFrame, labels: DataFrame | None, scratch: Scratch) -> DataFrame:
    """The entries with their components (``root``), those of postings only that more than one component shares."""
    known = entries.withColumn("root", F.col("k")) if labels is None else entries.join(labels, "k", "left").withColumn("root", F.coalesce("root", "k"))
    several = known.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("h")
    return scratch.put(known.join(several, "h", "left_semi"))


def _overlap(n, m):
    """Smallest overlap of similar sets of sizes ``n`` and ``m``."""
    return F.ceil((n + m) * NUM / (NUM + DEN))


def _last_level(n, m, ell):
    """Up to this level a set of size ``n`` shares ``ell`` shingles at least with the like prefix of a similar set of size ``m``:
    the prefix is shorter than that for any partner by what the two must share beyond the least overlap."""
    return ell - _overlap(n, m) + F.ceil(n * NUM / DEN)


def _candidate(met: DataFrame) -> DataFrame:
    """The pairs (a, b) of met postings (columns of both sides, numbered) that may be similar.

    A pair must share l prefix shingles up to the last level for its sizes, l being the smaller of the two. Of the two
    prefixes, let x's end first in the global order: whatever they share beyond the shared prefix shingles lies in x's
    rest, so those must be as many as the pair's least overlap, 4 / 9 of both sizes, exceeds that rest.
    """
    ell = F.least("ell1", "ell2")
    rest = lambda i: F.ceil(F.col(f"n{i}") * NUM / DEN) - F.col(f"ell{i}")
    ends_first = F.struct("end_power1", "end_hash1") <= F.struct("end_power2", "end_hash2")
    least = _overlap(F.col("n1"), F.col("n2")) - F.when(ends_first, rest(1)).otherwise(rest(2))
    met = met.where(_length_ok("n1", "n2")).select("k1", "k2", _in_level().cast("int").alias("in_level"), ell.alias("ell"), least.alias("least"))
    counted = met.groupBy("k1", "k2").agg(F.count("*").alias("shared"), F.sum("in_level").alias("in_level"), F.first("ell").alias("ell"), F.first("least").alias("least"))
    return counted.where((F.col("in_level") >= F.col("ell")) & (F.col("shared") >= F.col("least"))).select(F.col("k1").alias("a"), F.col("k2").alias("b"))


def _in_level():
    """Whether a shingle of a met pair lies in the prefixes that its sizes ask for, on both sides."""
    last = lambda i, j: _last_level(F.col(f"n{i}"), F.col(f"n{j}"), F.least("ell1", "ell2"))
    return (F.col("level1") <= last(1, 2)) & (F.col("level2") <= last(2, 1))


_SIDE = ("k", "n", "level", "ell", "end_power", "end_hash")


def _tested(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shared prefix shingles, counted in full, pass the multi-match test."""
    x, y = (members.drop("root").withColumnsRenamed({c: f"{c}{i}" for c in _SIDE}) for i in (1, 2))
    return _candidate(pairs.join(y, F.col("b") == F.col("k2")).join(x, (F.col("a") == F.col("k1")) & (y["h"] == x["h"])))


def _near(members: DataFrame, turn: int, scratch: Scratch) -> DataFrame:
    """One partner (a) for each row key (b) that has one. Each posting names one of its sets, so that similar sets mostly
    agree on a name: in even turns the set that has the fewest shingles before the posting's in the global order, which of
    near copies of one text is the one with the fewest edits; in odd turns the one that a hash of its key, different from turn to
    turn, puts first. Of those named for a document, outside its component and of fitting size, the one that it meets most
    often is proposed. The pair's shared prefix shingles are then counted in full for the multi-match test."""
    before = F.col("level") + F.col("n") - F.ceil(F.col("n") * NUM / DEN) if turn % 2 == 0 else F.lit(0)
    one = F.struct(before.alias("before"), F.xxhash64("k", F.lit(turn)).alias("x"), F.col("k"), F.col("n"), F.col("root"))
    named = members.groupBy("h").agg(F.min(one).alias("p")).select("h", F.col("p.k").alias("a"), F.col("p.n").alias("pn"), F.col("p.root").alias("pr"))
    met = members.join(named, "h").where((F.col("root") != F.col("pr")) & _length_ok("n", "pn")).groupBy("a", F.col("k").alias("b")).count()
    return _tested(scratch.put(met.groupBy("b").agg(F.max_by("a", F.struct("count", "a")).alias("a"))), members)


def _sided(members: DataFrame, scratch: Scratch) -> DataFrame:
    """The members by their own class of size (``own``) and that of possible partners (``class``), as far as such partners
    of other components can exist.

    Sizes are put into classes, each 1 / t times the one before; similar sets are in one class or in neighbours. Of a set's
    shingles only those count whose posting another component of the class shares. The l-th of them in the global order must
    not lie behind the last level for l matches, for each l that all such partners have; their smallest size gives that level. What drops out may take
    others with it, so this is repeated while a tenth goes.
    """
    n, by, left = F.col("n"), Window.partitionBy("k", "class"), None
    size = F.floor(F.log(n.cast("double")) / math.log(DEN / NUM)).cast("int")
    rows = members.select("*", size.alias("own"), F.explode(F.array(size - 1, size, size + 1)).alias("class"))
    while True:
        there = rows.groupBy(F.col("h"), F.col("own").alias("class"), F.col("class").alias("own")).agg(F.min("n").alias("small"), F.max("n").alias("large"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("ell").alias("l"))
        open_ = rows.join(there.hint("merge"), ["h", "own", "class"]).where(((F.col("lo") != F.col("root")) | (F.col("hi") != F.col("root"))) & (F.col("large") * DEN >= n * NUM) & (n * DEN >= F.col("small") * NUM))
        small, ell = F.min(F.greatest("small", F.ceil(n * NUM / DEN))).over(by), F.least("ell", F.min("l").over(by))
        ranked = open_.select(*rows.columns, small.alias("small"), ell.alias("l"), F.row_number().over(by.orderBy("level")).alias("place"))
        late = (F.col("place") <= F.col("l")) & (F.col("level") > _last_level(n, F.col("small"), F.col("place")))
        judged = ranked.select("*", F.max(late).over(by).alias("late"), F.count("*").over(by).alias("all"))
        needed = F.col("level") <= _last_level(n, F.col("small"), F.col("ell"))
        rows = scratch.put(judged.where(~F.col("late") & (F.col("all") >= F.col("l")) & needed).select(*rows.columns))
        before, left = left, rows.count()
        if not left or (before is not None and left * 10 > before * 9):
            return rows


def sketch(s: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's shingles falls into each of 64 * ``SKETCH`` parts, as bits of 64-bit integers. Two sets'
    sketches differ in no more bits than the sets differ in shingles."""
    return np.packbits(np.bincount((s % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1).view(np.int64)


def _sketches(rows: DataFrame) -> DataFrame:
    """(k, s0, s1, ...): the sketch of each text."""
    names = [f"s{i}" for i in range(SKETCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches, 1):
            made = np.array([sketch(shingles(t)) for t in b.column(1).to_pylist()], np.int64).reshape(-1, SKETCH)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x) for x in made.T.copy())], names=["k", *names])

    return rows.select("k", "t").mapInArrow(trimmed(run), ", ".join(f"{c} long" for c in ["k", *names])).distinct()


def _sketches_near():
    """Whether the sketches of a met pair differ in no more bits than similar sets of such sizes differ in shingles."""
    differ = sum((F.bit_count(F.col(f"s{i}1").bitwiseXOR(F.col(f"s{i}2"))) for i in range(SKETCH)), F.lit(0))
    return differ * (NUM + DEN) <= (F.col("n1") + F.col("n2")) * (DEN - NUM)


def _far(members: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """All candidate pairs whose components differ. Sets of a posting meet only if their classes of size do. One component,
    the one with most of a posting's sets, meets all others there but is not dealt with itself; the others' sets are dealt in
    blocks of ``MEETING`` over many tasks. Sets whose sketches differ too much do not meet."""
    rows = _sided(members, scratch).drop("end_power", "end_hash")
    known = scratch.put(_sketches(_among(texts, scratch.put(rows.select("k").distinct()), "left_semi")))
    pair = [F.least("own", "class").alias("lower"), F.greatest("own", "class").alias("upper")]
    held = scratch.put(rows.groupBy("h", "own", "class", "root").count().select("*", *pair))
    most = held.groupBy("h", "lower", "upper").agg(F.max_by("root", F.struct("count", "root")).alias("most"))
    others = F.sum(F.when(F.col("root") != F.col("most"), F.col("count")).otherwise(0))
    blocks = held.join(most, ["h", "lower", "upper"]).groupBy("h", "own", "class").agg(F.first("most").alias("most"), F.ceil(others / MEETING).cast("int").alias("blocks")).where("blocks > 0")
    left = rows.join(blocks, ["h", "own", "class"]).where("root <> most").join(known, "k").withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")).drop("blocks")
    right = rows.select(*[F.col(c).alias({"own": "class", "class": "own"}.get(c, c)) for c in rows.columns]).join(blocks.drop("most"), ["h", "own", "class"]).join(known, "k")
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    left, right = (side.withColumnsRenamed({c: f"{c}{i}" for c in (*_SIDE, *known.columns)} | {"root": f"r{i}"}) for i, side in ((1, left), (2, right)))
    once = (F.col("r1") < F.col("r2")) | (F.col("r2") == F.col("most"))
    met = left.join(right, ["h", "own", "class", "block"]).where(once & _length_ok("n1", "n2") & _in_level() & _sketches_near())
    pairs = met.groupBy(F.col("k1").alias("a"), F.col("k2").alias("b")).agg(F.count("*").alias("shared"), F.first(F.least("ell1", "ell2")).alias("ell")).where("shared >= ell")
    return _tested(scratch.put(pairs.select("a", "b")), members)


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row: the smallest id that is reachable by links between texts whose
    shingle sets have a Jaccard similarity of 0.8 or more.

    Null and empty texts, and texts of white space, have no shingles and link with nothing: their component is their
    own id. Rows with equal sets are linked, repeated rows included; a row without an id gets its class's component
    and never names one. An empty table gives an empty result.
    """
    out = _placed(docs, doc_id, text)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first.doc_id", "doc_id").alias("component_id"))


def _placed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(k, doc_id, n, first) of each row: ``first`` is the (doc_id, k) of its component that is smallest, null where the
    row has no shingles or no row of the component an id."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    rows = docs.select(F.xxhash64(doc_id, text).alias("k"), F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    sets = scratch.put(_sets(rows))
    named = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "k"))).alias("first")
    classes = scratch.put(sets.where("n > 0").groupBy("c").agg(F.min("k").alias("k"), named, F.count("*").alias("f")))
    more = sets.where("n > 0").join(classes.where("f > 1").select("c", F.col("k").alias("one")), "c").where("k <> one").select("k")
    alone = _among(rows, scratch.put(more.distinct()), "left_anti")
    shared = spark.sparkContext.broadcast(_statistics(alone, scratch))
    entries = scratch.put(_entries(alone, shared))
    shared.unpersist()
    members, links, turn, linked = _known(entries, None, scratch), None, 0, True
    while linked or turn < 2:
        found = _verified(_near(members, turn, scratch), alone, scratch)
        links = found if links is None else links.union(found)
        linked = found.count() * FEW_LINKED > members.select("k").distinct().count()
        members = _known(members.drop("root"), components(links, scratch), scratch)
        turn += 1
    far = _verified(_far(members, alone, scratch), alone, scratch)
    placed = classes.join(components(links.union(far), scratch), "k", "left").withColumn("root", F.coalesce("root", "k"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("first"))
    of_class = placed.drop("first").join(smallest, "root").select("c", "first")
    out = Scratch(spark, "components").put(sets.join(of_class, "c", "left").select("k", "doc_id", "n", "first"))
    scratch.drop()
    return out


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: one with the component's id, and of texts that clash on it the one with
    the smallest row key. Rows without shingles or id stay; of repeated rows (equal id and text) one stays. Columns may
    have any names; those of ``docs`` come back unchanged."""
    placed = _placed(docs, doc_id, text).where("n > 0 and doc_id is not null").select("k", (F.col("k") != F.col("first.k")).alias("gone"))
    scratch = Scratch(docs.sparkSession, "kept")
    gone = scratch.put(placed.where("gone").select("k").distinct())
    twice = scratch.put(placed.where("not gone").groupBy("k").count().where("count > 1").select("k"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(F.xxhash64(doc_id, text).alias("k"), whole)
    left = _among(keyed, gone, "left_anti")
    if not twice.isEmpty():
        left = _among(left, twice, "left_anti").union(_among(left, twice, "left_semi").dropDuplicates(["k"]))
    return left.select("row.*")
