"""Tactic transitions: the score of going from one kill-chain phase to another, causal overlap, and fusion."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Phases in kill-chain order, and the weight of each rule.
TACTICS = ["Reconnaissance", "Resource Development", "Initial Access", "Execution", "Persistence", "Privilege Escalation", "Defense Evasion", "Credential Access", "Discovery", "Lateral Movement", "Collection", "Command and Control", "Exfiltration", "Impact"]
WEIGHTS = {"R1": 0.5, "R2": 1.0, "R3A": 0.9, "R3B": 0.8, "R4": 0.8, "R4E": 0.7, "R5": 0.7, "R5B": 0.4, "R6": 0.5, "R7": 0.3, "R8A": 0.1, "R8B": 0.05, "R9": 0.02}

RE, RD, IA, EX, PE, PV, DE, CA, DI, LM, CO, C2, XF, IM = range(14)
#: Main line of an intrusion, and the moves that loop (fixed values).
PRIMARY = {(RE, RD), (RD, IA), (IA, EX), (EX, PE), (EX, PV), (EX, DE), (EX, CA), (PE, PV), (PV, DE), (LM, CO), (CO, C2), (C2, XF), (XF, IM)}
LOOP = {CA, DI, LM}


def rule(a: int, b: int) -> str:
    """The rule that decides the step from phase ``a`` to phase ``b``."""
    if a == b:
        return "R1"
    if a == IM or (a == XF and b <= DE):
        return "R9"
    if (a, b) in PRIMARY:
        return "R2"
    if a in LOOP and b in LOOP:
        return "R3A"
    if a in (CA, DI) and b == CO:
        return "R3B"
    back = a - b
    if a in (PV, DE):
        return "R8A" if (a, b) == (DE, PV) else "R5B" if b < PV else "R5"
    if a != XF and b == DE:
        return "R4E"
    if a != XF and b == PV:
        return "R4"
    if back < 0:
        return "R6" if back == -2 else "R7"
    return "R8A" if back <= 2 else "R8B"


def matrix() -> list[tuple[str, str, str, float]]:
    """(from, to, rule, weight) of all pairs; the two wildcard-in rules share a name."""
    rules = [(a, b, rule(a, b)) for a in range(14) for b in range(14)]
    return [(TACTICS[a], TACTICS[b], r.removesuffix("E"), WEIGHTS[r]) for a, b, r in rules]


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(matrix(), "source string, target string, rule string, weight double")


def weight(a: Column, b: Column) -> Column:
    """Weight of a step between two tactic names; an unknown tactic counts 0.3, a self-loop 0.5."""
    known = F.create_map(*[x for s, t, _, w in matrix() for x in (F.lit(f"{s}>{t}"), F.lit(w))])
    return F.when(a == b, 0.5).otherwise(F.coalesce(known[F.concat_ws(">", a, b)], F.lit(0.3)))


def place(tactic: Column) -> Column:
    """Place of a tactic in kill-chain order from 1, 0 if unknown."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, TACTICS)), tactic), F.lit(0)).cast("int")


def log_weight_at(a: Column, b: Column, barred: float | None = None) -> Column:
    """Log of ``weight``, of two structs (tac, at) that know their tactics' places; minus infinity for weights of
    ``barred`` or less."""
    log = lambda w: float("-inf") if barred is not None and w <= barred else math.log(w)
    flat = F.array(*[F.lit(log(w)) for *_, w in matrix()])
    return F.when(a["tac"] == b["tac"], log(0.5)).when((a["at"] > 0) & (b["at"] > 0), F.get(flat, (a["at"] - 1) * 14 + b["at"] - 1)).otherwise(log(0.3))


def causal(outputs: Column, inputs: Column, shared: Column) -> Column:
    """Share of a step's inputs that the step before gives and both groups touch."""
    return F.size(F.array_intersect(F.array_intersect(outputs, inputs), shared)) / (F.size(inputs) + 1e-6)


def fuse(tactical: Column, causal_: Column, shared_share: Column, w_tac: float = 0.5, w_cau: float = 0.2, low: float = 0.3, floor: float = 1e-6) -> Column:
    """Weighted geometric mean of floored factors; the causal weight shrinks with sparse shared entities."""
    wc = F.when(shared_share < low, w_cau * shared_share / low).otherwise(F.lit(w_cau))
    total = w_tac + wc
    return F.exp((w_tac * F.log(F.greatest(tactical, F.lit(floor))) + wc * F.log(F.greatest(causal_, F.lit(floor)))) / total)
