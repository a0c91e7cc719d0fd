from pyspark.sql import functions as F

from offerlake.session import scratch_path
from offerlake.streaming.ingest import stream_ingest


def test_files_arriving_over_time_are_merged_once(spark, sf_small):
    events = spark.read.parquet(f"{sf_small}/events.parquet")
    landing, target, ckpt = scratch_path(spark, "landing"), scratch_path(spark, "target"), scratch_path(spark, "ckpt")
    cut1 = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    cut2 = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    first = events.filter(F.col("ts") < cut1)
    second = events.filter(F.col("ts") >= cut2)  # overlaps the first batch (at-least-once delivery)
    first.coalesce(1).write.mode("append").parquet(landing)
    stream_ingest(spark, landing, events.schema, target, "event_id", ckpt, order="ts")
    after_first = spark.read.parquet(target)
    assert after_first.count() == first.count()
    second.coalesce(1).write.mode("append").parquet(landing)
    stream_ingest(spark, landing, events.schema, target, "event_id", ckpt, order="ts")
    after_second = spark.read.parquet(target)
    ids = [r.event_id for r in after_second.select("event_id").collect()]
    assert len(ids) == len(set(ids)) == events.count()
