from pyspark.sql import functions as F

from lexmill.streaming import windows


def events_of(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def stream(spark, sf_dir, tmp_path):
    source = events_of(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))


def run(frame, tmp_path, mode, name):
    q = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return frame.sparkSession.table(name).collect()


def test_tumbling_stream_equals_batch(spark, sf_dir, tmp_path):
    live = run(windows.tumbling(windows.late_after(stream(spark, sf_dir, tmp_path), "40 days"), "1 hour"), tmp_path, "complete", "tumbling_windows")
    batch = windows.tumbling(events_of(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "1 hour").collect()
    assert {(r.start, r.events) for r in live} == {(r.start, r.events) for r in batch}


def test_ring_buffers_keep_the_last_events(spark, sf_dir, tmp_path):
    live = run(windows.ring_buffers(stream(spark, sf_dir, tmp_path), 5), tmp_path, "update", "ring_buffers")
    batch = {}
    for r in events_of(spark, sf_dir).orderBy("ts", "event_id").collect():
        batch.setdefault(r.user_id, []).append(r.event_id)
    assert {r.user_id: list(r.event_ids) for r in live} == {u: e[-5:] for u, e in batch.items()}


def test_circuit_breakers(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:{i:02d}", 1 if i < 6 else 2, "error" if i != 3 else "view", 1.0) for i in range(12)]
    source = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    source.write.parquet(str(tmp_path / "in"))
    live = run(windows.circuit_breakers(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")), 5), tmp_path, "update", "breakers")
    assert {r.user_id: (r.failures, r.open) for r in live} == {1: (2, False), 2: (6, True)}
