"""Transitions of a sequence are made at once for all decoders."""

import random

import numpy as np
from test_chains import random_nodes

from lodechain.operators import chains


def test_made_once(spark, monkeypatch):
    """The transitions at one distance are made once for all decoders that weigh them alike, in runs of nodes; each
    decoder finds what it finds by itself."""
    monkeypatch.setattr(chains, "AT_ONCE", 3)
    nodes = random_nodes(random.Random(2), 11)
    q, made = chains._Sequence(nodes, chains.Decoder()), []
    monkeypatch.setattr(chains._Sequence, "_weights", lambda self, lo, hi, gap, f=chains._Sequence._weights: made.append((lo, gap)) or f(self, lo, hi, gap))
    options = [chains.Decoder(), chains.Decoder(skip=1, barred=True), chains.Decoder("max_marginal"), chains.Decoder("sum_product", skip=1), chains.Decoder(regret=0.1)]
    shared = [chains._decoded(q.under(o)) for o in options]
    assert len(made) == len(set(made)) == 7  # ten transitions at distance 1 and nine at distance 2, three at a time
    assert shared == [chains.decoded(nodes, o) for o in options]


def test_columns(spark):
    """Nested values with nulls are read as they are, and steps are written so."""
    import pyarrow as pa

    rows = [None, [], [{"a": "x", "b": [1.0, None]}, None], [{"a": None, "b": None}]]
    x = pa.array(rows, pa.list_(pa.struct([("a", pa.string()), ("b", pa.list_(pa.float64()))])))
    assert chains._plain(x) == rows and chains._plain(x.slice(2)) == rows[2:]
    kind = pa.list_(pa.struct([("n", pa.int32()), ("w", pa.float64())]))
    steps = [None, [{"n": 1}], [], [{"n": 2, "w": 0.5}, {"n": 3}]]
    assert chains._packed(steps, kind).to_pylist() == pa.array(steps, kind).to_pylist()
    assert np.all(chains._packed([None], kind).is_null())
