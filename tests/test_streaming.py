"""Streams over the events table as files."""

from pyspark.sql import functions as F

from siltstone.streaming import jobs


def source(spark, sf, folder):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).limit(400).repartition(2)
    e.write.mode("overwrite").parquet(folder)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder), e


def test_windows_equal_the_batch(spark, sf, tmp_path):
    stream, batch = source(spark, sf, f"{tmp_path}/in")
    q = jobs.tumbling(jobs.event_time(stream, late="100 days"), "ts", "6 hours", ["event_type"], "value").writeStream.format("memory").queryName("win").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = {(r["start"], r["event_type"]): r["n"] for r in jobs.tumbling(batch, "ts", "6 hours", ["event_type"], "value").collect()}
    assert {(r["start"], r["event_type"]): r["n"] for r in spark.table("win").collect()} == want


def test_alerts(spark, sf, tmp_path):
    stream, batch = source(spark, sf, f"{tmp_path}/in")
    seen = []
    reference = batch.withColumn("event_type", F.lit("other"))
    q = jobs.watch(stream, reference, "event_type", lambda n, x: seen.append((n, x))).option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert seen and all(x > 0.2 for _, x in seen)
