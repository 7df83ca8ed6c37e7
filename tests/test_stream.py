from pyspark.sql import functions as F

from quillgraph.streaming import sync


def test_landed_once(spark, tmp_path):
    rows = lambda ids, day: spark.createDataFrame([(i, f"2024-01-{day:02d} 0{i % 10}:00:00", 1.0) for i in ids], "event_id long, t string, value double").select("event_id", F.to_timestamp("t").alias("ts"), "value")
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    rows([1, 2, 2, 3], 1).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: sync.file_stream(spark, source, "*.parquet", rows([], 1).schema, 1)
    sync.land(stream(), folder, "event_id")
    landed = lambda: sorted(r["event_id"] for r in spark.read.parquet(f"{folder}/rows").collect())
    assert landed() == [1, 2, 3]
    rows([3, 4], 1).coalesce(1).write.mode("append").parquet(source)  # 3 comes again in another file
    sync.land(stream(), folder, "event_id")
    assert landed() == [1, 2, 3, 4]
    sync.land(stream(), folder, "event_id")  # nothing new
    assert landed() == [1, 2, 3, 4]
    rows([5], 9).coalesce(1).write.mode("append").parquet(source)
    sync.land(stream(), folder, "event_id")
    rows([6], 1).coalesce(1).write.mode("append").parquet(source)  # days behind the watermark
    sync.land(stream(), folder, "event_id")
    assert landed() == [1, 2, 3, 4, 5]
