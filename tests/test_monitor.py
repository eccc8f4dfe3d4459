"""Runs as a stream with timers: a run goes stale although nothing more comes from it."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sourceloom.streaming import events, monitor


def at(minute):
    return datetime(2026, 1, 1) + timedelta(minutes=minute)


def watched(spark, tmp_path, batches, **options):
    """Reports after each batch of (research, stage, minute), a file a batch."""
    schema = "id long, research_id string, stage string, level string, message string, created_at timestamp"
    for i, rows in enumerate(batches):
        spark.createDataFrame([(n, r, s, "info", "m", at(m)) for n, (r, s, m) in enumerate(rows)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    keep = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    monitor.use_state_store(spark)
    try:
        out = []
        for i in range(len(batches)):
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/{{{','.join(map(str, range(i + 1)))},x}}")
            q = monitor.watch_runs(stream, late="0 seconds", **options).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
            assert q.awaitTermination(120) and q.exception() is None
            rows = spark.read.parquet(f"{tmp_path}/out").collect()
            out.append(sorted((r.research_id, r.kind, r.stage, (r["at"] - at(0)).total_seconds() / 60) for r in rows))
        return out
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", keep)


def test_a_run_goes_stale_without_a_further_event(spark, tmp_path):
    """Reports are appended; state and timers live on in the checkpoint from one start of the query to the next."""
    first, second, third, last = watched(spark, tmp_path, [
        [("a", "planning", 0), ("b", "pending", 0), ("b", "planning", 1), ("c", "completed", 1)], [("b", "collecting", 8), ("b", "planning", 9), ("c", "planning", 8)],
        [("a", "collecting", 12), ("b", "odd", 12), ("b", "failed", 13), ("b", "completed", 13)], [("d", "pending", 40)],
    ])
    assert first == [("a", "stage", "planning", 0), ("b", "stage", "pending", 0), ("b", "stage", "planning", 1), ("c", "ended", "completed", 1)]
    # a is quiet by b's events alone; b, quiet for seven minutes, comes in the same batch as the time that passed
    assert ("a", "stale", "planning", 6) in second and ("b", "stage", "collecting", 8) in second and not any(r[0] == "b" and r[2] == "planning" and r[3] == 9 for r in second)
    assert {("a", "alive", "planning", 12), ("a", "stage", "collecting", 12)} <= set(third) and sum(r[0] == "b" and r[1] == "ended" for r in third) == 1
    assert ("a", "stale", "collecting", 18) in last and ("d", "stage", "pending", 40) in last
    assert not any(r[0] == "c" and r[1] != "ended" for r in last)  # a straggler of an ended run changes nothing
