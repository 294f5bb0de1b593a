"""Streams give what the batch operators give."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from auditlake.operators import timeline
from auditlake.session import table
from auditlake.streaming import events as E


def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def source(spark, data, tmp_path, parts=3):
    events = table(spark, data, "events")
    for k in range(parts):
        events.where(F.pmod("event_id", F.lit(parts)) == k).coalesce(1).write.parquet(str(tmp_path / f"in/{k}.d"))
    return events, spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*.d"))


def test_windows_match_batch(spark, data, tmp_path):
    events, stream = source(spark, data, tmp_path, 1)
    got = {tuple(r) for r in run(E.request_windows(E.with_event_time(stream), "user_id"), "w1", "complete").collect()}
    want = {tuple(r) for r in E.request_windows(events.withColumn("ts", F.col("ts").cast("timestamp")), "user_id").collect()}
    assert got == want and got


def test_sessions_match_batch(spark, data, tmp_path):
    events, stream = source(spark, data, tmp_path, 1)
    got = run(E.open_sessions(E.with_event_time(stream), "user_id"), "s1", "complete").count()
    assert got == timeline.sessions(events, "user_id", "ts").count()


def test_backoff_matches_batch(spark, data, tmp_path):
    events, stream = source(spark, data, tmp_path, 1)
    bad = F.col("event_type") == "error"
    got = {tuple(r) for r in run(E.backoff_state(stream.withColumn("bad", bad), "user_id", "ts", "event_id", "bad"), "b1").select("event_id", "failures", "backoff_ms", "blocked").collect()}
    want = {tuple(r) for r in timeline.failure_runs(events, "user_id", ["ts", "event_id"], bad).select("event_id", "failures", "backoff_ms", "blocked").collect()}
    assert got == want


def test_keyed_table(spark, data, tmp_path):
    events, stream = source(spark, data, tmp_path)
    path = str(tmp_path / "table")
    kept = E.KeyedTable(path, ["user_id"], ["ts", "event_id"], 8)
    q = stream.select("user_id", "event_id", "ts").writeStream.foreachBatch(kept.write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in kept.read(spark).select("user_id", "event_id").collect()}
    best = events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    assert got == {tuple(r) for r in best.collect()}
    rows = events.select("user_id", "event_id", "ts")
    kept.write(rows.limit(0), 0)  # an old batch again changes nothing
    assert {tuple(r) for r in kept.read(spark).select("user_id", "event_id").collect()} == got
    one = rows.orderBy("ts").limit(1).withColumns({"ts": F.lit("2999-01-01").cast("timestamp_ntz"), "event_id": F.lit(-1).cast("long")})
    before = json.loads((tmp_path / "table/manifest.json").read_text())["folders"]
    kept.write(one, 90)
    kept.write(one.limit(0), 91)
    after = json.loads((tmp_path / "table/manifest.json").read_text())
    assert sum(before[b] != after["folders"][b] for b in before) == 1 and after["batch"] == 91  # only one bucket is rewritten
    kept.write(one, 92)
    assert -1 in {r.event_id for r in kept.read(spark).collect()} and not Path([f for b, f in before.items() if f not in after["folders"].values()][0]).exists()
    assert [r.event_id for r in kept.read(spark, "300 seconds", F.lit("2999-01-01 00:04:00").cast("timestamp_ntz")).collect()] == [-1]


def test_routed_messages(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "user_id long, what string")
    (row,) = E.routed(df, "user_id", F.lit("2025-01-01")).collect()
    assert row.key == "1" and json.loads(row.value) == {"user_id": 1, "what": "a", "sent_at": "2025-01-01"}
