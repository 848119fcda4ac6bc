"""Chain decoders over sequences of candidate lists: best path with skips, max-marginal, sum-product, and their guards."""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodechain.operators.decode import BLOCKED
from lodechain.operators.transitions import TACTICS, matrix

FLOOR = 1e-6
#: Nodes whose transitions are made at once.
AT_ONCE = 4096
RULE = {(s, t): (r, w) for s, t, r, w in matrix()}
_AT = {name: i for i, name in enumerate(TACTICS)}
_WEIGHT = np.full((15, 15), 0.3)
for (_s, _t), (_r, _w) in RULE.items():
    _WEIGHT[_AT[_s], _AT[_t]] = _w
_BARRED = np.zeros((15, 15), bool)
_BARRED[:14, :14] = [[RULE[s, t][0] == "R9" for t in TACTICS] for s in TACTICS]

#: What ``chains`` reads: a sequence's nodes in order of time.
NODES = "array<struct<candidates:array<struct<tid:string,tac:string,sim:double,p:double,inputs:array<string>,outputs:array<string>,vec:array<float>>>,entities:array<string>,margin:double>>"
STEPS = "array<struct<step:int,node:int,tid:string,tac:string,log_emission:double,tac_from:string,weight:double,rule:string,log_transition:double,skip:int>>"


@dataclass(frozen=True)
class Decoder:
    """``method``: viterbi, max_marginal or sum_product. ``gate`` (by, low, high, alpha below low, alpha above high) sets
    the weight of transitions into each node of a best path by its ``margin`` or by its lead in ``sim``. ``bypass`` takes
    a node's first candidate where its similarity is at least that; ``regret`` takes it where the decoded one gains no
    more than that. Both need a path through every node."""

    method: str = "viterbi"
    alpha: float = 0.5
    beam: int = 5
    skip: int = 0
    decay: float = 0.25
    barred: bool = False
    gate: tuple[str, float, float, float, float] | None = None
    tactical: float = 0.5
    semantic: float = 0.3
    causal: float = 0.2
    sparse: float = 0.3
    repeat: float = 1.0
    bypass: float | None = None
    regret: float | None = None

    def __post_init__(self):
        if self.method not in ("viterbi", "max_marginal", "sum_product") or (self.gate and self.gate[0] not in ("margin", "sim")):
            raise ValueError(f"unknown method or gate: {self.method}, {self.gate}")


class _Sequence:
    """One sequence's nodes as arrays, and the transitions between any two of them. Decoders of one beam share them (``under``);
    transitions between all nodes and those at one distance behind them are made at once."""

    def __init__(self, nodes: list[dict] | None, o: Decoder):
        self.o, self.made = o, {}
        self.nodes = [(i, n, list({c["tid"]: c for c in n["candidates"][: o.beam]}.values())) for i, n in enumerate(nodes or []) if n and n["candidates"]]
        names = sorted({x for _, n, cs in self.nodes for xs in (n["entities"], *(c[s] for c in cs for s in ("inputs", "outputs"))) for x in xs or ()})
        place = {x: i for i, x in enumerate(names)}

        def flags(xs):
            out = np.zeros(len(names))
            out[[place[x] for x in xs or ()]] = 1
            return out

        tactics, techniques = dict(_AT), {}
        self.tac = [np.array([tactics.setdefault(c["tac"], len(tactics)) for c in cs]) for _, _, cs in self.nodes]  # unknown ones from 14 on
        self.tid = [np.array([techniques.setdefault(c["tid"], len(techniques)) for c in cs]) for _, _, cs in self.nodes]
        self.seen = [flags(n["entities"]) for _, n, _ in self.nodes]
        self.inputs, self.outputs = ([np.array([flags(c[s]) for c in cs]) for _, _, cs in self.nodes] for s in ("inputs", "outputs"))
        likely = lambda c: c["sim"] if c["p"] is None else c["p"]
        self.emission = [np.array([math.log(max(likely(c) or 0.0, 1e-9)) for c in cs]) for _, _, cs in self.nodes]
        self.width = max(map(len, self.tid), default=0)
        self.log_decay = math.log(max(o.decay, FLOOR))
        self.vec = [np.array([c["vec"] for c in cs], float) if all(c["vec"] for c in cs) else None for _, _, cs in self.nodes]

    def under(self, o: Decoder) -> _Sequence:
        """The same sequence for another decoder of the same beam."""
        q = copy.copy(self)
        q.o, q.log_decay = o, math.log(max(o.decay, FLOOR))
        return q

    def padded(self) -> tuple[np.ndarray, ...]:
        """Tactics, techniques, inputs and outputs of all candidates, entities of all nodes; missing candidates are zeros."""

        def whole(parts: list[np.ndarray]) -> np.ndarray:
            out = np.zeros((len(parts), self.width, *parts[0].shape[1:]), parts[0].dtype)
            for row, x in zip(out, parts, strict=True):
                row[: len(x)] = x
            return out

        if "padded" not in self.made:
            self.made["padded"] = whole(self.tac), whole(self.tid), whole(self.inputs), whole(self.outputs), np.array(self.seen)
        return self.made["padded"]

    def weights(self, gap: int) -> np.ndarray:
        """Weighted geometric mean of the factors for each pair of candidates of each node s and of node s + ``gap``."""
        o = self.o
        key = ("weights", gap, o.tactical, o.semantic, o.causal, o.sparse, o.repeat)
        if key not in self.made:
            parts = [self._weights(lo, min(lo + AT_ONCE, len(self.nodes) - gap), gap) for lo in range(0, len(self.nodes) - gap, AT_ONCE)]
            self.made[key] = np.concatenate(parts)
        return self.made[key]

    def _weights(self, lo: int, hi: int, gap: int) -> np.ndarray:
        o, (tac, tid, inputs, outputs, seen) = self.o, self.padded()
        s, t = slice(lo, hi), slice(lo + gap, hi + gap)
        a, b = tac[s][:, :, None], tac[t][:, None]
        w = np.maximum(np.where(a == b, 0.5, _WEIGHT[np.minimum(a, 14), np.minimum(b, 14)]), FLOOR)
        total, log = np.full((hi - lo, 1, self.width), o.tactical), o.tactical * np.log(w)
        for i in range(lo, hi):
            if self.vec[i] is not None and self.vec[i + gap] is not None:
                near = np.clip((self.vec[i] @ self.vec[i + gap].T + 1) / 2, FLOOR, 1)
                total[i - lo] += o.semantic
                log[i - lo, : len(near), : near.shape[1]] += o.semantic * np.log(near)
        both = seen[s].any(1) & seen[t].any(1)
        if both.any():
            shared, needs = seen[s] * seen[t], inputs[t].sum(2)
            given = np.maximum((outputs[s] * shared[:, None]) @ inputs[t].transpose(0, 2, 1) / (needs + FLOOR)[:, None], FLOOR)
            cover = shared.sum(1)[:, None] / np.maximum(needs, 1)
            wc = np.where(both[:, None], o.causal * np.where(cover < o.sparse, cover / o.sparse, 1.0), 0.0)[:, None]
            total, log = total + wc, log + wc * np.log(given)
        out = np.where(total < FLOOR, w, np.exp(log / np.maximum(total, FLOOR)))
        return np.where(tid[s][:, :, None] == tid[t][:, None], out * o.repeat, out)

    def logs(self, gap: int, barred: bool) -> list:
        """Logs of ``weights`` as lists; barred steps at minus infinity if asked for."""
        o = self.o
        key = ("logs", gap, barred, o.tactical, o.semantic, o.causal, o.sparse, o.repeat)
        if key not in self.made:
            x = np.log(np.maximum(self.weights(gap), FLOOR))
            if barred:
                tac = np.minimum(self.padded()[0], 14)
                x = np.where(_BARRED[tac[:-gap][:, :, None], tac[gap:][:, None]], -np.inf, x)
            self.made[key] = x.tolist()
        return self.made[key]

    def alpha(self, t: int) -> float:
        o = self.o
        if o.gate is None or o.method != "viterbi":
            return o.alpha
        by, low, high, below, above = o.gate
        sims = [max(c["sim"] or 0.0, 1e-9) for c in self.nodes[t][2][:2]]
        m = (self.nodes[t][1]["margin"] or 0.0) if by == "margin" else sims[0] - (sims[1] if len(sims) > 1 else 0.0)
        return below if m < low else above if m > high else o.alpha


def _collected(v: list[float], total: bool) -> float:
    """The greatest value, or the log of the sum of exponentials; blocked where nothing reaches."""
    top = max(v)
    if top <= BLOCKED:
        return BLOCKED
    return top + math.log(sum(math.exp(x - top) for x in v if x > BLOCKED)) if total else top


def _forward(q: _Sequence, total: bool):
    """Score of each candidate as the end of a path, and (node, candidate) before it, None where nothing leads there."""
    emission = [e.tolist() for e in q.emission]
    first = 1 - q.alpha(0)
    score, back = [[first * e for e in emission[0]]], [[None] * len(emission[0])]
    logs = [q.logs(d + 1, q.o.barred) for d in range(min(q.o.skip, len(emission) - 2) + 1)] if len(emission) > 1 else []
    for t in range(1, len(emission)):
        a = q.alpha(t)
        ways = [(t - 1 - d, i, x + d * q.log_decay, logs[d][t - 1 - d][i]) for d in range(min(q.o.skip, t - 1) + 1) for i, x in enumerate(score[t - 1 - d])]
        scores, before = [], []
        for j, e in enumerate(emission[t]):
            e = (1 - a) * e
            v = [x + e + a * log[j] for _, _, x, log in ways]
            top = max(v)
            scores.append(_collected(v, total))
            before.append(ways[v.index(top)][:2] if top > BLOCKED else None)
        score.append(scores)
        back.append(before)
    return score, back


def _backward(q: _Sequence, total: bool):
    emission, n, a = [e.tolist() for e in q.emission], len(q.nodes), q.o.alpha
    logs = [q.logs(d + 1, q.o.barred) for d in range(min(q.o.skip, n - 2) + 1)] if n > 1 else []
    score = [[]] * n
    score[-1] = [0.0] * len(emission[-1])
    for s in range(n - 2, -1, -1):
        ways = [(x + d * q.log_decay + (1 - a) * e, logs[d][s], j) for d in range(min(q.o.skip, n - 2 - s) + 1) for j, (x, e) in enumerate(zip(score[s + 1 + d], emission[s + 1 + d], strict=True))]
        score[s] = [_collected([x + a * log[i][j] for x, log, j in ways], total) for i in range(len(emission[s]))]
    return score


def _path(q: _Sequence) -> tuple[float, list[tuple[int, int]]]:
    """Score and (node, candidate) of each step."""
    total = q.o.method == "sum_product"
    forward, back = _forward(q, total)
    if q.o.method == "viterbi":
        at = (len(q.nodes) - 1, forward[-1].index(max(forward[-1])))
        best, path = forward[-1][at[1]], []
        while at is not None:
            path.append(at)
            at = back[at[0]][at[1]]
        return best, path[::-1]
    marginal = [[x + y for x, y in zip(f, b, strict=True)] for f, b in zip(forward, _backward(q, total), strict=True)]
    tops = [max(m) for m in marginal]
    return max(0.0, *(x for x in tops if x > BLOCKED), 0.0), [(s, m.index(top) if top > BLOCKED else 0) for s, (m, top) in enumerate(zip(marginal, tops, strict=True))]


def _guarded(q: _Sequence, path: list[tuple[int, int]]) -> list[tuple[int, int]]:
    o = q.o
    if len(path) != len(q.nodes):
        return path
    if o.bypass is not None:
        path = [(s, 0 if max(q.nodes[s][2][0]["sim"] or 0.0, 1e-9) >= o.bypass else i) for s, i in path]
    if o.regret is not None:
        kept: list[tuple[int, int]] = []
        for s, i in path:
            lost = q.emission[s][0] - q.emission[s][i]
            if i and s == 0:
                i = 0 if lost > o.regret else i
            elif i:
                step = q.logs(1, False)[s - 1][kept[-1][1]]
                i = 0 if o.alpha * (step[i] - step[0]) - (1 - o.alpha) * lost <= o.regret else i
            kept.append((s, i))
        path = kept
    return path


def decoded(nodes: list[dict] | None, o: Decoder) -> tuple[float, list[dict]] | tuple[None, None]:
    """Score and steps of one sequence; (None, None) without candidates."""
    return _decoded(_Sequence(nodes, o))


def _decoded(q: _Sequence) -> tuple[float, list[dict]] | tuple[None, None]:
    if not q.nodes:
        return None, None
    score, path = _path(q)
    weights = {g: q.weights(g) for g in {s - r for (r, _), (s, _) in zip(path, path[1:])}}
    path, steps = _guarded(q, path), []
    for n, (s, i) in enumerate(path):
        c = q.nodes[s][2][i]
        step = {"step": n + 1, "node": q.nodes[s][0], "tid": c["tid"], "tac": c["tac"], "log_emission": round(float(q.emission[s][i]), 4), "skip": 0}
        if n:
            r, j = path[n - 1]
            before, w = q.nodes[r][2][j]["tac"], float(weights[s - r][r, j, i])
            rule = "R1" if before == c["tac"] else RULE.get((before, c["tac"]), ("R7",))[0]
            step |= {"tac_from": before, "weight": round(w, 4), "rule": rule, "log_transition": round(math.log(max(w, FLOOR)), 4), "skip": s - r - 1}
        steps.append(step)
    return round(score, 4), steps


def _plain(x: pa.Array) -> list:
    """Python values of nested lists and structs; as ``to_pylist``, but not one scalar after the other."""
    if pa.types.is_list(x.type):
        flat, ends = _plain(x.flatten()), np.cumsum(pc.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False)).tolist()
        out = [flat[lo:hi] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
    elif pa.types.is_struct(x.type):
        names = [f.name for f in x.type]
        out = [dict(zip(names, row, strict=True)) for row in zip(*map(_plain, x.flatten()), strict=True)]
    else:
        return x.to_pylist() if x.null_count and not pa.types.is_string(x.type) else x.to_numpy(zero_copy_only=False).tolist()
    if x.null_count:
        out = [None if gone else v for v, gone in zip(out, x.is_null().to_pylist(), strict=True)]
    return out


def _packed(steps: list[list[dict] | None], kind: pa.DataType) -> pa.Array:
    """Steps as an array of ``kind``, field by field."""
    flat = [x for s in steps for x in s or ()]
    fields = [pa.array([x.get(f.name) for x in flat], f.type) for f in kind.value_type]
    ends = np.cumsum([0, *(len(s or ()) for s in steps)])
    offsets = pa.array(ends, pa.int32(), mask=np.array([*(s is None for s in steps), False]))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, fields=list(kind.value_type)))


def chains(rows: DataFrame, by: str, nodes: str, options: dict[str, Decoder]) -> DataFrame:
    """(by, option, score, steps) of each sequence and each named option, all in one pass.

    A candidate adds (1 - alpha) * log p (its similarity where p is null) and alpha * the log of the transition from the
    candidate before: the weighted geometric mean of the tactic rules, of the vectors' closeness where both nodes have
    them, and of the inputs that the step before gives, the latter less where few entities are shared. A step may pass
    over ``skip`` nodes at log ``decay`` each. The first of equal candidates wins, of candidates with one id the last
    counts. Nodes without candidates are left out; a sequence without any has null score and steps. A node that nothing
    reaches begins the path anew at -1e9. The marginal decoders give 0 or, if that is greater, the greatest marginal. A
    sequence is one row and is held by one task; different sequences are independent."""
    kind = rows.schema[by].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part, out = b.slice(at, 64), []
                for ns in _plain(part.column(1)):
                    made: dict[int, _Sequence] = {}
                    for name, o in options.items():
                        q = made.setdefault(o.beam, made.get(o.beam) or _Sequence(ns, o)).under(o)
                        score, steps = _decoded(q)
                        out.append((name, score, steps))
                names, scores, steps = zip(*out, strict=True)
                keys = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), len(options))))
                yield pa.RecordBatch.from_arrays([keys, pa.array(names), pa.array(scores, pa.float64()), _packed(steps, arrow_steps)], names=["k", "option", "score", "steps"])

    arrow_steps = pa.list_(pa.struct([("step", pa.int32()), ("node", pa.int32()), ("tid", pa.string()), ("tac", pa.string()), ("log_emission", pa.float64()), ("tac_from", pa.string()), ("weight", pa.float64()), ("rule", pa.string()), ("log_transition", pa.float64()), ("skip", pa.int32())]))
    found = rows.select(F.col(by).alias("k"), F.col(nodes).cast(NODES).alias("n")).mapInArrow(run, f"k {kind.simpleString()}, option string, score double, steps {STEPS}")
    return found.withColumnRenamed("k", by)
