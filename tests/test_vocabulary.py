"""Operators that apply fixed values."""

from pyspark.sql import functions as F

from lodechain.operators import vocabulary as V


def test_log_sources_and_noise(spark):
    e = spark.createDataFrame([(1, "Sysmon", "C:\\Windows\\SvcHost.exe"), (4104, "PowerShell", None), (None, "x", "a.exe")], "EventID int, Channel string, Image string").withColumn("SourceName", F.lit(None).cast("string"))
    n = lambda s: e.where(V.log_source(s)).count()
    assert (n({}), n({"product": "linux"}), n({"category": "process_creation"}), n({"category": "odd"}), n({"service": "powershell"}), n({"category": "ps_script", "service": "sysmon"})) == (3, 0, 1, 3, 1, 0)
    assert e.where(V.noise_anchor("Image")).count() == 1
    assert (len(V.NOISE_IMAGES), len(V.CATEGORY_EVENTS), len(V.SERVICE_CHANNEL), len(V.DATA_COMPONENTS)) == (39, 26, 36, 54)


def test_technique_io(spark):
    c = spark.createDataFrame([("T1", '[{"Data Component": "Process Creation (DC0032)"}, {"Data Component": "File Access (DC1)"}, {"Data Component": "odd"}]')], "technique_id string, log_sources string")
    io = V.technique_io(c)
    assert [(r.inputs, r.outputs) for r in io.collect()] == [(["file"], ["process"])]
    steps = spark.createDataFrame([("T1", "Impact"), ("T2", "Discovery"), ("T3", "odd")], "technique_id string, tactic string")
    assert {r.technique_id: (r.inputs, r.outputs) for r in V.with_io(steps, io).collect()} == {"T1": (["file"], ["process"]), "T2": (["process"], ["process"]), "T3": ([], [])}
