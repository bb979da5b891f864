import time

from pyspark.sql import functions as F

from petrel.schema import EVENT_OBJECT
from petrel.sources.rows import from_dicts
from petrel.streaming.support import deduplicated, start_metrics


def test_metrics_of_a_stream(spark, tmp_path):
    rows = [{"activity": "a", "object_type": "X|Y", "timestamp": "2024-01-01T00:00:00", "event_id": "1"}, {"activity": "n/a", "object_type": "X", "timestamp": "2024-01-01T00:00:00"}]
    from_dicts(spark, rows, "m").write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(EVENT_OBJECT).parquet(str(tmp_path / "in"))
    seen = []
    q = start_metrics(events, lambda df, _: seen.append([r.asDict() for r in df.collect()]), str(tmp_path / "state"))
    for _ in range(120):
        if seen or q.exception():
            break
        time.sleep(0.5)
    q.stop()
    assert seen and seen[0][0]["otc"] == 2 and seen[0][0]["oid"] == 1.0


def test_dedup_of_a_stream(spark, tmp_path):
    rows = [{"activity": "a", "object_type": "X", "timestamp": "2024-01-01T00:00:00", "event_id": "1"}] * 3
    from_dicts(spark, rows, "m").write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(EVENT_OBJECT).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    q = deduplicated(events).writeStream.format("memory").queryName("deduplicated").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("deduplicated").count() == 1
