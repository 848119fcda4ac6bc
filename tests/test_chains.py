"""The chain decoders against all paths of small sequences."""

import itertools
import math
import random

import pytest

from lodechain.operators import chains, decode
from lodechain.operators.transitions import TACTICS
from lodechain.operators.vocabulary import TACTIC_IO

KINDS = ["process", "file", "network", "user", "registry"]


def unit(rnd):
    angle = rnd.uniform(0, 2 * math.pi)
    return [math.cos(angle), math.sin(angle)]


def random_nodes(rnd, n, k=3):
    def candidate(i, described):
        tac = rnd.choice([*TACTICS, "Unknown"])
        inputs, outputs = TACTIC_IO.get(tac, ((), ()))
        return {"tid": f"T{i}{rnd.randint(0, 3)}", "tac": tac, "sim": rnd.random(), "p": rnd.uniform(0.01, 0.9), "inputs": list(inputs), "outputs": list(outputs), "vec": unit(rnd) if described else None}

    def candidates(described):
        return [candidate(i, described) for i in range(rnd.randint(1, k))]

    return [{"candidates": candidates(rnd.random() < 0.7), "entities": rnd.sample(KINDS, rnd.randint(0, 5)), "margin": rnd.uniform(0, 0.3)} for _ in range(n)]


def factor(a, b, na, nb, o):
    """One transition by hand."""
    w = 0.5 if a["tac"] == b["tac"] else chains.RULE.get((a["tac"], b["tac"]), ("R7", 0.3))[1]
    logs, weights = [math.log(w)], [o.tactical]
    if a["vec"] and b["vec"]:
        logs.append(math.log(max((a["vec"][0] * b["vec"][0] + a["vec"][1] * b["vec"][1] + 1) / 2, 1e-6)))
        weights.append(o.semantic)
    if na["entities"] and nb["entities"]:
        shared, needs = set(na["entities"]) & set(nb["entities"]), set(b["inputs"])
        logs.append(math.log(max(len(set(a["outputs"]) & needs & shared) / (len(needs) + 1e-6), 1e-6)))
        weights.append(o.causal * min(1.0, len(shared) / max(len(needs), 1) / o.sparse))
    return math.exp(sum(x * y for x, y in zip(logs, weights)) / sum(weights)) * (o.repeat if a["tid"] == b["tid"] else 1)


def all_paths(nodes, o, alpha):
    """(score, ((node, candidate), ...)) of every path from the first node to the last."""
    n = len(nodes)
    for inner in itertools.chain.from_iterable(itertools.combinations(range(1, n - 1), r) for r in range(max(n - 1, 1))):
        at = [0, *inner, n - 1] if n > 1 else [0]
        if any(y - x - 1 > o.skip for x, y in zip(at, at[1:])):
            continue
        for picks in itertools.product(*[range(len(nodes[s]["candidates"])) for s in at]):
            cs = [nodes[s]["candidates"][i] for s, i in zip(at, picks)]
            score = 0.0
            for m, (s, c) in enumerate(zip(at, cs)):
                score += (1 - alpha(s)) * math.log(c["p"])
                if m:
                    if o.barred and chains.RULE.get((cs[m - 1]["tac"], c["tac"]), ("",))[0] == "R9":
                        break
                    score += alpha(s) * math.log(max(factor(cs[m - 1], c, nodes[at[m - 1]], nodes[s], o), 1e-6)) + (s - at[m - 1] - 1) * math.log(o.decay)
            else:
                yield score, tuple(zip(at, picks))


def unique_ids(nodes):
    for n in nodes:
        n["candidates"] = list({c["tid"]: c for c in n["candidates"]}.values())
    return nodes


@pytest.mark.parametrize("skip,barred,repeat,gate", [(0, False, 1.0, None), (2, False, 0.5, None), (1, True, 1.0, None), (1, False, 1.0, ("margin", 0.05, 0.2, 0.4, 0.05)), (0, False, 1.0, ("sim", 0.1, 0.4, 0.7, 0.1))])
def test_best_path(skip, barred, repeat, gate):
    rnd = random.Random(skip + barred)
    o = chains.Decoder(skip=skip, barred=barred, repeat=repeat, gate=gate)
    for _ in range(40):
        nodes = unique_ids(random_nodes(rnd, rnd.randint(1, 5)))

        def alpha(s):
            if gate is None:
                return 0.5
            sims = [c["sim"] for c in nodes[s]["candidates"][:2]] + [0.0]
            m = nodes[s]["margin"] if gate[0] == "margin" else sims[0] - sims[1]
            return gate[3] if m < gate[1] else gate[4] if m > gate[2] else 0.5

        score, steps = chains.decoded(nodes, o)
        best = max(all_paths(nodes, o, alpha), default=None)
        if best is None:
            assert score == decode.BLOCKED
            continue
        assert math.isclose(score, best[0], abs_tol=6e-5)
        assert [(s["node"], s["tid"]) for s in steps] == [(s, nodes[s]["candidates"][i]["tid"]) for s, i in best[1]]
        for a, b in zip(steps, steps[1:]):
            assert b["skip"] == b["node"] - a["node"] - 1 and b["tac_from"] == a["tac"]


@pytest.mark.parametrize("method", ["max_marginal", "sum_product"])
def test_marginals(method):
    rnd = random.Random(5)
    o = chains.Decoder(method=method)
    for _ in range(40):
        nodes = unique_ids(random_nodes(rnd, rnd.randint(1, 5)))
        paths = list(all_paths(nodes, o, lambda s: 0.5))
        _, steps = chains.decoded(nodes, o)
        for s, step in enumerate(steps):
            of = lambda i: [x for x, p in paths if p[s][1] == i]
            fold = max if method == "max_marginal" else lambda xs: math.log(sum(map(math.exp, xs)))
            marginal = [fold(of(i)) for i in range(len(nodes[s]["candidates"]))]
            got = [c["tid"] for c in nodes[s]["candidates"]].index(step["tid"])
            assert math.isclose(marginal[got], max(marginal), abs_tol=1e-9)


def test_guards_and_edges(spark):
    rnd = random.Random(3)
    seqs = [(i, random_nodes(rnd, 6)) for i in range(20)] + [(20, []), (21, None), (22, [{"candidates": [], "entities": None, "margin": None}, {"candidates": [{"tid": "T9", "tac": None, "sim": 0.5, "p": None, "inputs": None, "outputs": None, "vec": [1.0, 0.0]}], "entities": None, "margin": None}])]
    rows = spark.createDataFrame(seqs, f"id long, nodes {chains.NODES}")
    options = {"plain": chains.Decoder(), "bypass": chains.Decoder(bypass=0.0), "regret": chains.Decoder(regret=1e9), "none": chains.Decoder(bypass=2.0, regret=-1e9)}
    got = {(r.id, r.option): r for r in chains.chains(rows, "id", "nodes", options).collect()}
    assert len(got) == 23 * 4
    ids = lambda i, option: [s.tid for s in got[i, option].steps]
    for i, nodes in seqs[:20]:
        assert ids(i, "bypass") == [n["candidates"][0]["tid"] for n in unique_ids(nodes)]
        assert ids(i, "none")[1:] == ids(i, "plain")[1:]  # the first node has a rule of its own
        assert ids(i, "regret")[1:] == ids(i, "bypass")[1:] and ids(i, "regret")[0] == ids(i, "plain")[0]
    assert got[20, "plain"].steps is None and got[21, "plain"].score is None
    assert [(s.node, s.tid) for s in got[22, "plain"].steps] == [(1, "T9")]
