"""Streaming twins of the operators over time: windows, sessions, back-off state, progress, and keyed sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from auditlake.operators.records import latest
from auditlake.operators.timeline import BACKOFF


def with_event_time(events: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Events with ``ts`` as a time that a watermark can follow; rows later than that are dropped by what follows."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def request_windows(events: DataFrame, key: str, ts: str = "ts", minutes: int = 15) -> DataFrame:
    """(key, began, requests) of tumbling windows; append mode emits a window when the watermark has passed it."""
    return events.groupBy(key, F.window(ts, f"{minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("requests")).select(key, F.col("w.start").alias("began"), "requests")


def open_sessions(events: DataFrame, key: str, ts: str = "ts", idle_minutes: int = 30) -> DataFrame:
    """(key, began, ended, events) of sessions; a gap of ``idle_minutes`` or more ends one."""
    s = F.session_window(ts, f"{idle_minutes} minutes")
    return events.groupBy(key, s.alias("s")).agg(F.count(F.lit(1)).alias("events"), F.max(ts).alias("ended")).select(key, F.col("s.start").alias("began"), "ended", "events")


def without_repeats(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each event once within the watermark's delay."""
    return events.dropDuplicatesWithinWatermark(list(keys))


def backoff_state(events: DataFrame, key: str, ts: str, event_id: str, failed: str) -> DataFrame:
    """(key, event_id, failures, backoff_ms, blocked) of every event, from the state of its key.

    Events of a micro-batch are taken in the order of time and id; state is one number a key, dropped after an
    hour without events.
    """
    first, times, most = BACKOFF

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        failures = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values([ts, event_id])
        counted = []
        for bad in rows[failed]:
            failures = failures + 1 if bad else 0
            counted.append(failures)
        state.update((failures,))
        state.setTimeoutDuration(3_600_000)
        out = pd.DataFrame({key: keys[0], event_id: rows[event_id].to_numpy(), "failures": counted})
        out["backoff_ms"] = [min(first * times ** min(n, 10), most) if n else 0 for n in counted]
        out["blocked"] = [n > 10 or b >= most for n, b in zip(counted, out["backoff_ms"], strict=True)]
        yield out

    kind = dict(events.dtypes)
    return events.groupBy(key).applyInPandasWithState(
        step, f"`{key}` {kind[key]}, `{event_id}` {kind[event_id]}, failures long, backoff_ms long, blocked boolean", "failures long", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def routed(events: DataFrame, key: str, sent: Column | None = None) -> DataFrame:
    """(key, value): events as messages of their user's channel, ready for a keyed log, with the time of sending; events of nobody go nowhere."""
    stamped = events.where(F.col(key).isNotNull()).withColumn("sent_at", F.current_timestamp() if sent is None else sent)
    return stamped.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


class KeyedTable:
    """The last version of every key in a parquet table that batches bring up to date.

    Keys are hashed into buckets; a batch rewrites the buckets that it touches and nothing else. Which folder holds
    a bucket says a manifest, which a rename replaces as a whole, so a batch that runs again or ends half-way
    leaves a table that is right. Folders that a batch has replaced are deleted by the next one, when no reader of the old
    manifest should be left.
    """

    def __init__(self, path: str, keys: Sequence[str], by: Sequence[str], buckets: int = 64) -> None:
        self.path, self.keys, self.by, self.buckets = path, list(keys), list(by), buckets

    def _manifest(self, spark) -> dict:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest.json")
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return {"batch": -1, "folders": {}, "replaced": []}
        return json.loads(spark.read.text(f"{self.path}/manifest.json", wholetext=True).first()[0])

    def _publish(self, spark, manifest: dict) -> None:
        fs = spark._jvm.org.apache.hadoop.fs
        conf = spark._jsc.hadoopConfiguration()
        draft, final = fs.Path(f"{self.path}/draft.json"), fs.Path(f"{self.path}/manifest.json")
        stream = draft.getFileSystem(conf).create(draft, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        rename = getattr(fs, "Options$Rename")
        options = spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        fs.FileContext.getFileContext(draft.getFileSystem(conf).getUri(), conf).rename(draft, final, options)

    def write(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch: takes a batch in, once."""
        spark = batch.sparkSession
        manifest = self._manifest(spark)
        if manifest["batch"] >= number:
            return
        rows = batch.withColumn("__bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")).persist()
        touched = sorted(r[0] for r in rows.select("__bucket").distinct().collect())
        if not touched:
            rows.unpersist()
            self._publish(spark, manifest | {"batch": number})
            return
        old = [manifest["folders"][str(b)] for b in touched if str(b) in manifest["folders"]]
        merged = rows
        for part in ([spark.read.parquet(*old)] if old else []):
            merged = merged.unionByName(part.withColumn("__bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")))
        folder = f"{self.path}/version-{number}"
        latest(merged, ["__bucket", *self.keys], self.by).write.mode("overwrite").partitionBy("__bucket").parquet(folder)
        rows.unpersist()
        folders = manifest["folders"] | {str(b): f"{folder}/__bucket={b}" for b in touched}
        self._publish(spark, {"batch": number, "folders": folders, "replaced": old})
        for gone in manifest["replaced"]:
            where = spark._jvm.org.apache.hadoop.fs.Path(gone)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    def read(self, spark, ttl: str | None = None, now: Column | None = None) -> DataFrame:
        """The table as it is; with ``ttl``, an interval, only keys whose first ``by`` column is younger than that."""
        rows = spark.read.parquet(*sorted(self._manifest(spark)["folders"].values()))
        if ttl is None:
            return rows
        return rows.where(F.col(self.by[0]) > (F.current_timestamp() if now is None else now) - F.expr(f"INTERVAL {ttl}"))
