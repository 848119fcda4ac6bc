"""Streaming windows give what the batch functions give once all files are read."""

from pyspark.sql import functions as F

from lodechain.streaming import windows

SF = "/root/testdata/sf0.001"


def test_windows_and_interval_join(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    got = run(windows.windowed_counts(stream, ["event_type"], "ts", "1 day"), "counts", "complete")
    want = windows.windowed_counts(batch, ["event_type"], "ts", "1 day")
    assert sorted(got.collect()) == sorted(want.collect())
    pair = windows.anchored_pairs(stream.where("event_type = 'error'"), stream, "user_id", "ts", "1 hour", "3 hours", "60 days")
    found = run(pair.select("anchor_id", "event_id"), "pairs", "append")
    a, e = batch.where("event_type = 'error'").alias("a"), batch.alias("e")
    on = F.expr("a.user_id = e.user_id AND e.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts + INTERVAL 3 HOURS")
    assert sorted(found.collect()) == sorted(a.join(e, on).select(F.col("a.event_id").alias("anchor_id"), F.col("e.event_id")).collect())
    assert windows.sessions(batch, ["user_id"], "ts", "6 hours").agg(F.sum("n")).first()[0] == batch.count()
