"""Most likely technique chains: a Viterbi fold over a sequence of candidate lists, in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodechain.operators.transitions import log_weight_at, place

BLOCKED = -1e9


def viterbi(nodes: Column, alpha: float = 0.5, blocked_at: float | None = 0.02) -> Column:
    """struct(score, path) of the best chain through ``nodes``, an array of arrays of struct(tid, tac, p).

    A node's candidate adds (1 - alpha) * log p and alpha * log of the transition weight. The first of equal paths
    wins. Transitions of weight ``blocked_at`` or less are barred; a node that nothing reaches restarts the path and
    scores -1e9. Null for an empty sequence. Every value that is used twice is bound by a lambda, since what a lambda's
    body repeats is computed again.
    """
    described = lambda c: F.struct(c["tid"].alias("tid"), c["tac"].alias("tac"), place(c["tac"]).alias("at"), ((1 - alpha) * F.log(F.greatest(c["p"], F.lit(1e-9)))).alias("e"))
    state = lambda c, v, path: F.struct(c["tac"].alias("tac"), c["at"].alias("at"), v.alias("v"), path.alias("path"))
    found = lambda v, path: F.struct(v.alias("v"), path.alias("path"))
    greater = lambda best, x: F.when(x["v"] > best["v"], x).otherwise(best)
    none = F.array().cast("array<string>")

    def step(prev: Column, node: Column) -> Column:
        def reach(c: Column) -> Column:
            ways = F.transform(prev, lambda p: found(p["v"] + c["e"] + alpha * log_weight_at(p, c, blocked_at), p["path"]))
            return F.aggregate(ways, found(F.lit(BLOCKED), none), greater, lambda b: state(c, b["v"], F.concat(b["path"], F.array(c["tid"]))))

        return F.transform(F.transform(node, described), reach)

    def last(states: Column) -> Column:
        first = found(F.lit(float("-inf")), none)
        return F.aggregate(states, first, lambda b, x: greater(b, found(x["v"], x["path"])), lambda b: F.struct(b["v"].alias("score"), b["path"].alias("path")))

    start = F.transform(F.transform(F.get(nodes, F.lit(0)), described), lambda c: state(c, c["e"], F.array(c["tid"])))
    return F.when(F.size(nodes) > 0, F.aggregate(F.slice(nodes, 2, F.greatest(F.size(nodes) - 1, F.lit(0))), start, step, last))


def bypass(chosen: Column, top: Column, top_similarity: Column, least: float = 0.75) -> Column:
    """The emission's first candidate where its similarity is high enough, else the decoded one."""
    return F.when(top_similarity >= least, top).otherwise(chosen)
