"""Operators on inline rows, against plain Python where there is a reference to compute."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lodechain.functions import text as X
from lodechain.operators import chains, decode, features, graph, grouping, sequence, sigma, transitions
from lodechain.operators.range_join import range_join
from lodechain.sources import events as source
from lodechain.sources import reference


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column).first()[0]


@pytest.mark.parametrize("text,want", [("0x1a", 26), ("26", 26), ("26.0", 26), ("010", None), ("junk", None), ("00", 0), (None, None)])
def test_to_int(spark, text, want):
    assert one(spark, X.to_int(F.col("v")), v=text) == want


@pytest.mark.parametrize("n,want", [(40, True), (41, False), (42, True), (43, True), (44, True), (45, False)])
def test_base64_run(spark, n, want):
    assert one(spark, X.base64_run(F.col("v")), v="A" * n) is want


def test_sanitisers(spark):
    assert one(spark, X.mask_numbers(F.col("v")), v="cmd 1234 /5678 12 -pid=4321 99.1234 777- 888.") == "cmd [PID] /5678 12 -pid=[PID] 99.[PID] 777- 888."
    assert one(spark, X.registry_path(F.col("v")), v="\\REGISTRY\\USER\\S-1-5-21\\Run") == "hkcu\\run"
    assert one(spark, features.sanitise_path(F.col("v")), v="C:\\Users\\bo\\AppData\\Local\\Temp\\a.exe") == "%TEMP%\\a.exe"
    assert one(spark, X.message_pairs(F.col("v")), v="Head\nA: 1\nB=2\nA: 3\ntwo words: 4") == {"A": "3", "B": "2"}


def test_range_join_borders_and_null_keys(spark):
    a = spark.createDataFrame([("h", 100), (None, 100)], "host string, at long")
    e = spark.createDataFrame([("h", 90), ("h", 89), ("h", 130), ("h", 131), (None, 100)], "host string, t long")
    assert sorted(r.t for r in range_join(a, e, ["host"], "at", "t", 10, 30).collect()) == [90, 130]


def test_rule_predicate_quirks(spark):
    e = spark.createDataFrame([(1, "C:\\Foo.EXE"), (2, None), (3, "bar")], "id int, image string")
    ids = lambda f: [r.id for r in e.where(grouping.rule_predicate({"image": f})).orderBy("id").collect()]
    assert ids("foo") == [1]
    assert ids(["foo", "bar"]) == [1, 3]
    assert ids({"equals": "nothing"}) == [1, 2, 3]
    assert ids({"not_contains": "foo"}) == [2, 3]
    assert ids({"endswith": ".exe", "contains": "bar"}) == [1]


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs_and_edit_distance(spark):
    rnd = random.Random(1)
    pairs = [([rnd.choice("abc") for _ in range(rnd.randint(0, 7))], [rnd.choice("abc") for _ in range(rnd.randint(0, 7))]) for _ in range(60)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a array<string>, b array<string>")
    for r in df.select("i", sequence.lcs(F.col("a"), F.col("b")).alias("l"), sequence.edit_distance(F.col("a"), F.col("b"), list("abc")).alias("d")).collect():
        a, b = pairs[r.i]
        assert r.l == plain_lcs(a, b)
        assert abs(len(a) - len(b)) <= r.d <= max(len(a), len(b))


NODES = "array<array<struct<tid:string,tac:string,p:double>>>"


@pytest.mark.parametrize(
    "nodes,barred,path,score",
    [
        ([[("T1059.001", "Execution", 0.5), ("T1003.001", "Credential Access", 0.3)], [("T1003.001", "Credential Access", 0.4), ("T1087", "Discovery", 0.45)], [("T1486", "Impact", 0.6), ("T1021.006", "Lateral Movement", 0.35)]], 0.02, ["T1059.001", "T1003.001", "T1021.006"], -1.38231027629530),
        ([[("T1486", "Impact", 0.6)], [("T1059", "Execution", 0.5)]], 0.02, ["T1059"], -1e9),
        ([[("T1486", "Impact", 0.6)], [("T1059", "Execution", 0.5)]], None, ["T1486", "T1059"], -2.55799790487704),
    ],
)
def test_viterbi_golden(spark, nodes, barred, path, score):
    r = spark.createDataFrame([(nodes,)], f"n {NODES}").select(decode.viterbi(F.col("n"), blocked_at=barred).alias("b")).first().b
    assert r.path == path and math.isclose(r.score, score, rel_tol=1e-12)
    whole = [{"candidates": [{"tid": t, "tac": a, "p": p, "sim": p, "inputs": [], "outputs": [], "vec": None} for t, a, p in n], "entities": [], "margin": 0.0} for n in nodes]
    value, steps = chains.decoded(whole, chains.Decoder(barred=barred is not None))
    assert [s["tid"] for s in steps] == path and math.isclose(value, score, abs_tol=6e-5)


def test_transition_counts():
    counts = {}
    for *_, r, _ in transitions.matrix():
        counts[r] = counts.get(r, 0) + 1
    assert counts == {"R7": 46, "R8B": 34, "R9": 20, "R4": 17, "R1": 14, "R8A": 14, "R5": 14, "R2": 13, "R5B": 10, "R6": 6, "R3A": 6, "R3B": 2}


@pytest.mark.parametrize("condition,want", [("a and not b", [1]), ("1 of them", [1, 2, 3]), ("all of them", [2]), ("not a", [3]), ("(a or b) and b", [2, 3]), ("a and (", []), ("missing", [])])
def test_conditions(spark, condition, want):
    e = spark.createDataFrame([(1, "x"), (2, "xy"), (3, "y"), (4, "z"), (5, None)], "id int, v string")
    rule = sigma.Rule("r", {"a": {"v|contains": "X"}, "b": {"v|contains": "y"}}, condition)
    assert [r.id for r in e.where(sigma.compile_rule(rule)).orderBy("id").collect()] == want


def test_rule_files():
    good = "id: a\ntags: [attack.t1059]\ndetection: {s: {v: x}, condition: [s, not s]}"
    assert [r.condition for r in reference.read_rules([good, "id: b\ndetection: {s: {v: x}, condition: s}", ": : :", "status: deprecated"])] == ["(s) or (not s)"]


def test_components_and_walk(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    roots = {r.k: r.root for r in graph.components(edges).collect()}
    assert {roots[i] for i in range(1, 41)} == {1} and roots[101] == 100
    pc = spark.createDataFrame([(1, 2), (2, 3), (1, 9), (3, 4), (4, 5), (5, 6), (3, 1)], "parent long, child long")
    start = spark.createDataFrame([(3,)], "start long")
    assert {r.node for r in graph.bounded_walk(pc, start).collect()} == {1, 2, 3, 4, 5, 6}  # 9 is below 1, which was met upwards


def test_jsonl(spark, tmp_path):
    lines = [
        json.dumps({"EventID": 1, "TimeCreated": "2020-01-01T00:00:02Z", "ProcessId": "0x1a", "Hostname": "h", "LogonId": "0X0", "Odd": "o", "Message": "Head\nImage: a.exe\nOdd2: o"}),
        "{bad", "", "5", "[1]",
        json.dumps({"event_id": 3, "computer_name": "n", "event_data": {"Image": "in", "computer_name": "no"}, "@timestamp": "2020-01-01T00:00:01Z"}),
    ]
    (tmp_path / "s.json").write_text("\n".join(lines))
    rows = source.read_jsonl(spark, str(tmp_path)).orderBy("event_idx").collect()
    assert [(r.EventID, r.Hostname, r.Image, r.ProcessId_int, r.logon_id) for r in rows] == [(3, "n", "in", None, None), (1, "h", "a.exe", 26, None)]
    assert rows[1].extra["Odd"] == "o" and "Odd2" not in rows[1].extra


def test_features(spark):
    schema = "group_id string, event_idx long, time timestamp, EventID int, " + ", ".join(f"{c} string" for c in source.CORE if c != "EventID")
    base = {c: None for c in source.CORE}
    rows = [
        base | {"EventID": 1, "ParentImage": "C:\\a\\cmd.exe", "Image": "C:\\b\\p.exe", "CommandLine": "p -enc AAA 1234"},
        base | {"EventID": 3, "Image": "p.exe", "DestinationIp": "10.0.0.8", "DestinationPort": "443", "Protocol": "6"},
        base | {"EventID": 13, "TargetObject": "HKU\\S-1-5-21-1-2-3-4\\Software\\CurrentVersion\\Run"},
    ]
    import datetime

    data = [("g", i, datetime.datetime(2020, 1, 1, 0, 0, i), r["EventID"], *[r[c] for c in source.CORE if c != "EventID"]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, schema)
    f = features.to_text(features.sanitise(features.extract(df))).first()
    assert f.has_obfuscation and f.entity_types == ["process", "registry", "network"]
    assert f.connections[0].dst == "[internal_ip]" and f.description.startswith("cmd.exe spawned p.exe. command: p -enc AAA [PID]")
    assert features.temporal(df).first().span == 2.0
