"""Operator 2: byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The distinct pre-tokens of a run of texts lie one behind the other in one doubly linked list of parts, which has no
links across pre-tokens. Every adjacent pair that is a vocabulary entry sits in the bucket of its rank; a two-level
bitmap of 256-bit words marks the buckets in use, so the next rank to merge is found by two find-first-set steps. The
rank that comes up is the least of all pre-tokens, so each of them merges in its own order. A large bucket is merged at
once by array operations, a small one part by part from the left; entries whose pair has changed since are stale (the
pair's current rank no longer agrees) and skipped. Where merging a whole bucket could overtake a lower rank that one
of its merges makes, the pre-tokens concerned are encoded by themselves, with heaps as buckets, in O(n log n) for n
bytes. Memory is bounded by ``SLICE`` bytes of text and by the longest text and pre-token.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain, islice, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodechain.llm.common import append_columns, gathered, packed, runs, sums

DEFAULT_VOCAB = "byte_bpe_50k.tiktoken"
#: Bytes of text that are taken together, and of pre-tokens that share a queue.
SLICE = 4 << 20
#: A bucket of so many entries is merged part by part.
SMALL = 20
#: In RE2's syntax, texts in which the pattern's matches may cross the border before a space or around a newline: two of
#: these meet, or there is other white space, or a NUL.
_MEETING = r"[ \n][ \n]|[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x00]"
#: Pieces between borders that are two matches for sure, of which the second may be empty: a word and what follows it.
_WORD = r"^(?P<word> ?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+)(?P<end>[.,;:!?)\]}%&$#*\"]*)$"


class Codec:
    """Encoder and decoder for one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.cut = pattern == public_tokenizers.PATTERN
        self.size = max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([ranks.get(bytes([i]), self.size) for i in range(256)], np.int32)
        pairs = [(ranks[t[:i]] * (self.size + 1) + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs, self.merged = np.array(sorted(pairs), np.int64).reshape(-1, 2).T.copy()
        self.words = self.size // 256 + 1
        self.bits = [1 << i for i in range(max(256, self.words))]

    def _rank(self, left, right) -> np.ndarray:
        """Ranks of pairs of parts; ``size`` where a pair is no entry, or one of them none."""
        key = np.asarray(left, np.int64) * (self.size + 1) + right
        at = np.searchsorted(self.pairs, key)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == key, self.merged[at], self.size).astype(np.int32)

    def encode_pieces(self, raw: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens that begin at ``starts`` in ``raw``, none of them empty, and how many each has."""
        n, none, get, leaf, bits, buckets, top = len(raw), self.size, self.ranks.get, [0] * self.words, self.bits, {}, 0
        part = np.append(self.of_byte[np.frombuffer(raw, np.uint8)], np.int32(none))
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[n], after[starts[1:] - 1], after[n - 1] = n, n, n  # n stands for no part
        before[starts], before[n] = n, n
        current = np.append(self._rank(part[:-1], part[after[:-1]]), np.int32(none))
        merged_away, alone = np.zeros(n + 1, bool), {}
        parts, nexts, lasts, ranks, gone = map(memoryview, (part, after, before, current, merged_away))

        def put(at: np.ndarray, rank: np.ndarray) -> int:
            """Into the buckets of their ranks, those without one left out. Gives the words of the bitmap now in use."""
            used = 0
            order = np.argsort(rank, kind="stable")
            order = order[: np.searchsorted(rank[order], none)]
            at, rank = at[order], rank[order]
            cuts = [*np.flatnonzero(np.diff(rank, prepend=-1)).tolist(), len(rank)]
            for r, i, j in zip(rank[cuts[:-1]].tolist(), cuts[:-1], cuts[1:], strict=True):
                if r in buckets:
                    buckets[r].append(at[i:j])
                else:
                    buckets[r] = [at[i:j]]
                    leaf[r >> 8] |= bits[r & 255]
                    used |= bits[r >> 8]
            return used

        top |= put(np.arange(n, dtype=np.int32), current[:n])
        while top:
            j = (top & -top).bit_length() - 1
            w = leaf[j]
            r = j << 8 | (w & -w).bit_length() - 1
            leaf[j] = w & (w - 1)
            if not leaf[j]:
                top &= top - 1
            found = buckets.pop(r)
            at = np.sort(found[0] if len(found) == 1 else np.concatenate(found))
            if len(at) <= SMALL:
                queue = at.tolist()
                for x, i in enumerate(queue):
                    if ranks[i] != r:
                        continue  # stale
                    mid = nexts[i]
                    nexts[i] = end = nexts[mid]
                    parts[i], ranks[mid], gone[mid] = r, none, True
                    left = lasts[i]
                    if end != n:
                        lasts[end] = i
                        # the part at end reaches to the next one, or to the end of its pre-token
                        low = get(self.tokens[r] + self.tokens[parts[end]], none)
                    else:
                        low = none
                    changed = [(i, low)]
                    if left != n:
                        changed.append((left, get(self.tokens[parts[left]] + self.tokens[r], none)))
                    overtaken = False
                    for p, q in changed:
                        ranks[p] = q
                        if q < none:
                            if q in buckets:
                                buckets[q].append(np.array([p], np.int32))
                            else:
                                buckets[q] = [np.array([p], np.int32)]
                                leaf[q >> 8] |= bits[q & 255]
                                top |= bits[q >> 8]
                            overtaken |= q < r
                    if overtaken and x + 1 < len(queue):  # the rest waits
                        buckets[r] = [at[x + 1 :]]
                        leaf[j] |= bits[r & 255]
                        top |= bits[j]
                        break
                continue
            at = at[current[at] == r]  # drops the stale ones
            if not len(at):
                continue
            mid = after[at]
            linked = mid[:-1] == at[1:]
            if linked.any():  # of a run of pairs that share parts, every other one from the left
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(np.append(False, linked), 0, place))) % 2 == 0]
                mid = after[at]
            end, left = after[mid], before[at]
            touching = np.append(False, end[:-1] == at[1:])
            on_left = self._rank(np.where(touching, r, part[left]), r)
            on_right = self._rank(r, part[end])
            overtaken = (on_left < r) | (on_right < r)
            if overtaken.any():
                piece = np.searchsorted(starts, at, "right") - 1
                for p in np.unique(piece[overtaken]).tolist():
                    if (piece == p).sum() > 1:
                        lo, hi = int(starts[p]), int(starts[p + 1]) if p + 1 < len(starts) else n
                        alone[p] = self.encode_piece(raw[lo:hi])
                        current[lo:hi] = none
                good = current[at] == r
                at, mid, end, left, on_left, on_right = (x[good] for x in (at, mid, end, left, on_left, on_right))
                touching = np.append(False, end[:-1] == at[1:])[: len(at)]
                if not len(at):
                    continue
            part[at], after[at], before[end], current[mid], merged_away[mid] = r, end, at, none, True
            before[n] = n
            on_right[:-1][touching[1:]] = on_left[touching]
            free = ~touching & (left != n)
            changed, rank = np.concatenate([at, left[free]]), np.concatenate([on_right, on_left[free]])
            current[changed] = rank
            top |= put(changed, rank)
        for view in (parts, nexts, lasts, ranks, gone):
            view.release()
        live = ~merged_away[:n]
        counts = np.add.reduceat(live, starts, dtype=np.int64)
        ids = part[:n][live]
        if alone:
            split = np.split(ids, np.cumsum(counts)[:-1])
            for p, own in alone.items():
                split[p], counts[p] = np.array(own, np.int32), len(own)
            ids = np.concatenate(split)
        return ids, counts

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the piece itself if it is an entry, else merges by ascending rank, leftmost first."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        if n < 2:
            return [self.ranks[piece]] if n else []
        get, leaf, bits, buckets, top = self.ranks.get, [0] * self.words, self.bits, {}, 0
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        current = [get(piece[i : i + 2]) for i in range(n)]  # the rank of the pair that begins at a position; None: no pair, or merged away
        current[-1] = None
        for i, r in enumerate(current):
            if r is not None:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    leaf[r >> 8] |= bits[r & 255]
                    top |= bits[r >> 8]
        while top:
            j = (top & -top).bit_length() - 1
            w = leaf[j]
            r = j << 8 | (w & -w).bit_length() - 1
            bucket = buckets[r]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[r]
                leaf[j] = w = w & (w - 1)
                if not w:
                    top &= top - 1
            if current[i] != r:
                continue  # stale
            right = after[i]
            after[i] = end = after[right]
            current[right] = None
            left = before[i]
            if end < n:
                before[end] = i
                changed = ((i, get(piece[i : after[end]])), (left, get(piece[left:end]))) if left >= 0 else ((i, get(piece[i : after[end]])),)
            elif left >= 0:
                changed = ((i, None), (left, get(piece[left:end])))
            else:
                changed = ((i, None),)
            for at, r in changed:
                current[at] = r
                if r is not None:
                    if r in buckets:
                        heappush(buckets[r], at)
                    else:
                        buckets[r] = [at]
                        leaf[r >> 8] |= bits[r & 255]
                        top |= bits[r >> 8]
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def _distinct(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens, one behind the other, and how many each has."""
        pieces = pieces.cast(pa.binary())
        whole = np.fromiter(map(self.ranks.get, pieces.to_pylist(), repeat(self.size)), np.int64, len(pieces))
        size = pc.binary_length(pieces).to_numpy().astype(np.int64)
        known, open_ = np.flatnonzero(whole < self.size), np.flatnonzero((whole == self.size) & (size > 0))
        rest, total, lo = pieces.take(pa.array(open_)), np.append(0, np.cumsum(size[open_])), 0
        ids, lengths = [np.empty(0, np.int32)], np.zeros(len(pieces), np.int64)
        while lo < len(rest):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + SLICE, "right")) - 1)
            made, lengths[open_[lo:hi]] = self.encode_pieces(b"".join(rest[lo:hi].to_pylist()), total[lo:hi] - total[lo])
            ids.append(made)
            lo = hi
        ids.append(whole[known].astype(np.int32))
        lengths[known] = 1
        order = np.concatenate([open_, known])  # as they lie in ids
        start = np.zeros(len(pieces), np.int64)
        start[order] = np.cumsum(lengths[order]) - lengths[order]
        return gathered(np.concatenate(ids), start, lengths, np.arange(len(pieces))), lengths

    def _encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts, one behind the other, and how many each has.

        Where no two white-space characters meet, the pattern's matches never cross the border before a space or
        around a newline, so the text is cut there and each distinct piece divided by the pattern once; other texts go
        through the pattern whole."""
        findall = self.pattern.findall
        simple = ~pc.match_substring_regex(texts, _MEETING).to_numpy(zero_copy_only=False) if self.cut else np.zeros(len(texts), bool)
        between = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts.filter(pa.array(simple)), " ", "\0 "), "\n", "\0\n\0"), "\0")
        n_between = pc.list_value_length(between).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = between.flatten().dictionary_encode()
        halves = pc.extract_regex(coded.dictionary, _WORD)
        one = halves.is_valid()
        several = [findall(p) for p in coded.dictionary.filter(pc.invert(one)).to_pylist()]
        others = [findall(t) for t in texts.filter(pa.array(~simple)).to_pylist()]
        n_others = np.array([len(x) for x in others], np.int64)
        halves, odd = halves.drop_null(), pa.array(chain.from_iterable(chain(several, others)), pa.string())
        sizes = np.append(np.full(len(halves), 2), np.array([len(x) for x in several], np.int64))
        pieces = pa.concat_arrays([halves.field("word"), halves.field("end"), odd]).dictionary_encode()
        ids, length = self._distinct(pieces.dictionary)
        start, place = np.cumsum(length) - length, pieces.indices.to_numpy().astype(np.int64)
        mine, rest = place[: sizes.sum()], place[sizes.sum() :]
        mine[: 2 * len(halves)] = mine[: 2 * len(halves)].reshape(2, -1).T.ravel()  # each word before its end
        inner, inner_len = gathered(ids, start, length, mine), sums(length[mine], sizes)
        one = one.to_numpy(zero_copy_only=False)
        rank = np.empty(len(one), np.int64)
        rank[np.concatenate([np.flatnonzero(one), np.flatnonzero(~one)])] = np.arange(len(one))
        index = rank[coded.indices.to_numpy()]
        every = np.concatenate([gathered(inner, np.cumsum(inner_len) - inner_len, inner_len, index), gathered(ids, start, length, rest)])
        n = np.empty(len(texts), np.int64)
        n[simple], n[~simple] = sums(inner_len[index], n_between), sums(length[rest], n_others)
        if not simple.all():
            order = np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)])
            at = np.empty(len(texts), np.int64)
            at[order] = np.cumsum(n[order]) - n[order]
            every = gathered(every, at, n, np.arange(len(texts)))
        return every, n

    def _encode_long(self, text: str) -> np.ndarray:
        """Ids of one text, a bounded number of its pre-tokens at a time."""
        found, ids = self.pattern.finditer(text), [np.empty(0, np.int32)]
        while part := [m.group() for m in islice(found, SLICE >> 4)]:
            pieces = pa.array(part).dictionary_encode()
            made, length = self._distinct(pieces.dictionary)
            ids.append(gathered(made, np.cumsum(length) - length, length, pieces.indices.to_numpy().astype(np.int64)))
        return np.concatenate(ids)

    def encode_texts(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, one behind the other, and how many each has."""
        parts = [(np.empty(0, np.int32), np.empty(0, np.int64))]
        for lo, hi in runs(texts, SLICE):
            if hi == lo + 1 and pc.binary_length(texts[lo:hi])[0].as_py() > SLICE:
                ids = self._encode_long(texts[lo].as_py())
                parts.append((ids, np.array([len(ids)])))
            else:
                parts.append(self._encode(texts[lo:hi]))
        return np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return self.encode_texts(pa.array([text], pa.string()))[0].astype("<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=4)
def codec(vocab: str = DEFAULT_VOCAB, pattern: str = public_tokenizers.PATTERN) -> Codec:
    """The codec of a vocabulary file (its name in the tokenizer folder, or a path); one for each Python worker."""
    path = vocab if "/" in vocab else public_tokenizers.path(vocab)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return Codec(ranks, pattern)


def encode(df: DataFrame, text: str = "text", vocab: str = DEFAULT_VOCAB, pattern: str = public_tokenizers.PATTERN, ids: str = "ids", n_tokens: str = "n_tokens", decoded: str | None = None) -> DataFrame:
    """``df`` with the ids of each whole text as little-endian unsigned 32-bit integers, and their number; with
    ``decoded``, also with the bytes to which those ids decode, in the same pass.

    Each match of ``pattern`` is encoded by itself; there are no special tokens. A null or empty text has no ids.
    Repeated rows get equal ids, an empty table an empty result, and a text may be as long as a cell can hold. Other
    columns pass unchanged; columns named like the outputs are replaced. Narrow: no shuffle.
    """

    def run(b):
        c = codec(vocab, pattern)
        made, n = c.encode_texts(b[text].fill_null(""))
        out = [packed(made, n), pa.array(n)]
        return [*out, [c.decode(x) for x in out[0].to_pylist()]] if decoded else out

    fields = [T.StructField(ids, T.BinaryType()), T.StructField(n_tokens, T.LongType())]
    return append_columns(df, run, fields + ([T.StructField(decoded, T.BinaryType())] if decoded else []), [text])


def decode(df: DataFrame, ids: str = "ids", vocab: str = DEFAULT_VOCAB, out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that packed ids stand for; null or empty ids give no bytes. Inverse of ``encode``; an empty
    table gives an empty result, and a column named like the output is replaced."""

    def run(b):
        return [[codec(vocab).decode(x or b"") for x in b[ids].to_pylist()]]

    return append_columns(df, run, [T.StructField(out, T.BinaryType())], [ids])
