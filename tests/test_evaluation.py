"""Rule files, sinks and text helpers on planted cases."""

import json

import pytest
from pyspark.sql import functions as F

from lodechain.functions import text as X
from lodechain.operators import sigma, vocabulary
from lodechain.sources import rules


def one(spark, column, v):
    return spark.createDataFrame([(v,)], "v string").select(column.alias("x")).first().x


@pytest.mark.parametrize("ip,external", [("8.8.8.8", True), ("10.1.2.3", False), ("172.32.0.1", True), ("203.0.113.9", False), ("224.0.0.1", False), ("fe80::1%eth0", False), ("2606:4700::11", True), ("::1", False), ("300.1.1.1", False), ("host", False), (None, False)])
def test_external_ip(spark, ip, external):
    assert one(spark, X.external_ip(F.col("v")), ip) is external


def test_json_helpers(spark):
    assert one(spark, X.json_fields(F.col("v")), '[{"Field": "a", "Description": "b"}, {"Field": "c"}]') == "a: b; c"
    assert one(spark, X.json_fields(F.col("v")), "plain") == "plain" and one(spark, X.json_fields(F.col("v")), '{"a": 1}') == ""
    assert json.loads(one(spark, X.json_object(F.col("v")), 'so: ```json\n{"a": [1, 2,],}\n``` end')) == {"a": [1, 2]}
    assert one(spark, X.json_object(F.col("v")), "no braces") is None
    v = one(spark, X.hash_vector(F.col("v")), "abc")
    assert len(v) == 16 and abs(sum(x * x for x in v) - 1) < 1e-12


def test_rules_and_sinks(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r/b.json").write_text(json.dumps({"id": "b", "anchor": {"channel": "S", "event_id": 1, "filters": {"x": "1", "y": "2"}}}))
    (tmp_path / "r/a.json").write_text(json.dumps({"id": "a", "anchor": {"channel": "S", "event_id": [1, 2], "filters": {"x": "1"}, "conditions": [{"event_id": 7, "filters": {"x": "3"}}, {"channel": "T"}]}}))
    found = rules.load_rules(spark, str(tmp_path / "r"))
    assert [r["id"] for r in found] == ["a", "b"]
    assert rules.anchor_specs(found[0]) == [("S", [7], {"x": "3"}), ("T", [1, 2], {"x": "1"})] and rules.anchor_specs(found[1]) == [("S", [1], {"x": "1", "y": "2"})]
    df = spark.createDataFrame([("s1", 2, None), ("s2", 1, "v")], "scenario string, n int, v string")
    rules.write_events(df, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).where("scenario = 's2'").first().v == "v"
    rules.write_json(df, str(tmp_path / "j"))
    assert sorted(r.n for r in spark.read.json(str(tmp_path / "j")).collect()) == [1, 2]
    rules.write_report(df, str(tmp_path / "c"), ["n"])
    assert [r.n for r in spark.read.option("header", True).csv(str(tmp_path / "c")).orderBy("n").collect()] == ["1", "2"]


@pytest.mark.parametrize("condition,held", [("a and missing", False), ("a or missing", True), ("them", True), ("(a", True), ("a b", True), ("not missing and a", True), ("2 of them", True), ("all of them", False), ("1 of", False), ("not b", True)])
def test_conditions(spark, condition, held):
    rule = sigma.Rule(id="r", detection={"a": {"v": "x"}, "b": {"v": "y"}}, condition=condition)
    assert one(spark, sigma.compile_rule(rule), "x") is held


def test_noise_in_any_image(spark):
    noise = next(iter(vocabulary.NOISE_IMAGES))
    df = spark.createDataFrame([("C:\\x\\tool.exe", f"C:\\w\\{noise}"), ("tool.exe", " "), (None, None)], "Image string, SourceImage string")
    assert [r[0] for r in df.select(vocabulary.noise_anchor("Image", "SourceImage")).collect()] == [True, False, False]
