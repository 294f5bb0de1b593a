"""Logic over time: failure runs and back-off, sessions, request windows, concurrency, progress, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.rounding import half_up
from auditlake.operators.ordered import CHUNK, chunked, ranked, scan

#: Milliseconds and factor of the back-off.
BACKOFF = (2000, 2, 30000)
RETRY = (5000, 2, 3)
#: Fixed value: requests of a client that a window of a quarter of an hour takes.
REQUEST_LIMIT = 200


def remaining_seconds(elapsed_ms: Column, progress: Column) -> Column:
    """Seconds left at the pace so far; 0 before the start and when done."""
    p = F.greatest(F.coalesce(progress, F.lit(0)), F.lit(1))
    return F.when(elapsed_ms.isNull() | (progress >= 100), 0).otherwise(half_up((elapsed_ms * 100.0 / p - elapsed_ms) / 1000)).cast("long")


#: Percent at which the phases of a crawl begin, and how many they have.
PHASES = {"sitemaps": (0, 30), "children": (30, 20), "saving": (50, 20), "pages": (50, 50)}


def phase_progress(phase: str, done: Column, total: Column) -> Column:
    """Percent of a crawl after ``done`` of a phase's ``total`` steps, halves up; the phase's begin where it has none."""
    begin, share = PHASES[phase]
    return F.when(total > 0, F.lit(begin) + half_up(done / total * share)).otherwise(F.lit(begin)).cast("long")


def emitted(place: Column, total: Column) -> Column:
    """Whether a page's progress is told: every 25th page, and the first and the last of its batch."""
    size = F.least(F.lit(100), F.ceil(total / 10.0))
    return (place % 25 == 0) | ((place - 1) % size == 0) | (place % size == 0) | (place == total)


def failure_runs(events: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """``events`` with consecutive failures so far, the back-off in ms that they cause, and whether the key is blocked.

    Failures since the last success are all failures so far less those up to that success; both are running values,
    so no key is sorted in one task. An unknown outcome is a success.
    """
    first, times, most = BACKOFF
    chunks = chunked(events.withColumn("__bad", F.coalesce(failed, F.lit(False))), key, order)
    summed = scan(chunks, key, order, {"__sum": ("sum", F.col("__bad").cast("long"))})
    since = scan(summed, key, order, {"__base": ("max", F.when(~F.col("__bad"), F.col("__sum")))})
    counted = since.withColumn("failures", (F.col("__sum") - F.coalesce("__base", F.lit(0))).cast("long"))
    backoff = F.when(F.col("failures") > 0, F.least(F.lit(first) * F.pow(F.lit(times), F.least("failures", F.lit(10))), F.lit(most))).otherwise(0).cast("long")
    return counted.withColumn("backoff_ms", backoff).withColumn("blocked", (F.col("failures") > 10) | (F.col("backoff_ms") >= most)).drop("__bad", "__sum", "__base", CHUNK)


def sessions(events: DataFrame, key: str, ts: str, idle_minutes: int = 30) -> DataFrame:
    """(key, session, began, ended, events): a session ends when nothing follows for more than ``idle_minutes``."""
    moments = events.groupBy(key, ts).agg(F.count(F.lit(1)).alias("n"))
    before = scan(chunked(moments, key, [ts]), key, [ts], {"__before": ("max", F.col(ts))}, exclusive=True)
    gap = F.col(ts) - F.col("__before") > F.expr(f"INTERVAL {idle_minutes} MINUTES")
    numbered = scan(before, key, [ts], {"session": ("sum", F.when(gap, 1).otherwise(0).cast("long"))})
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("began"), F.max(ts).alias("ended"), F.sum("n").alias("events"))


def over_limit(events: DataFrame, key: str, ts: str, most: int, minutes: int = 15) -> DataFrame:
    """(key, began, requests): fixed windows, aligned to the epoch, with more than ``most`` requests."""
    return events.groupBy(key, F.window(ts, f"{minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("requests")).where(F.col("requests") > most).select(key, F.col("w.start").alias("began"), "requests")


def concurrency(spans: DataFrame, began: str, ended: str, keys: list[str]) -> DataFrame:
    """(*keys, moment, active): how many spans are open after each change; spans without an end never close."""
    ups = spans.where(F.col(began).isNotNull()).select(*keys, F.col(began).alias("moment"), F.lit(1).alias("d"))
    downs = spans.where(F.col(began).isNotNull() & F.col(ended).isNotNull()).select(*keys, F.col(ended).alias("moment"), F.lit(-1).alias("d"))
    changes = ups.unionByName(downs).groupBy(*keys, "moment").agg(F.sum("d").alias("d")).withColumn("__of", F.struct(*keys))
    return scan(chunked(changes, "__of", ["moment"]), "__of", ["moment"], {"active": ("sum", F.col("d"))}).select(*keys, "moment", "active")


def latest_state(events: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """``events`` with the last known value of each column so far (null values change nothing)."""
    known = scan(chunked(events.select(key, *order, *columns), key, order), key, order, {f"__{c}": ("last", F.col(c)) for c in columns})
    return known.select(key, *order, *[F.col(f"__{c}").alias(c) for c in columns])


def error_class(message: Column) -> Column:
    m = F.lower(message)
    return (
        F.when(m.contains("rate limit") | m.contains("429") | m.contains("too many requests"), "rate_limit")
        .when(m.contains("timeout") | m.contains("timed out"), "timeout")
        .when(m.contains("403") | m.contains("forbidden"), "forbidden")
        .when(m.isNotNull(), "general")
    )


def retry_delay(attempt: Column, limited: Column) -> Column:
    """Milliseconds before an attempt, doubled where the rate was limited; null beyond the last attempt."""
    first, times, most = RETRY
    return F.when(attempt <= most, (F.lit(first) * F.pow(F.lit(times), attempt) * F.when(limited, 2).otherwise(1)).cast("long"))


def paced(requests: DataFrame, domain: str, ts: str, gap_ms: int = 2000) -> DataFrame:
    """(domain, ts, scheduled): the earliest times at which a domain's requests can run, ``gap_ms`` apart.

    scheduled_k = max over i <= k of (ts_i + (k - i) * gap), a running maximum; no sequential state is needed.
    """
    chunks = chunked(requests.select(domain, ts), domain, [ts])
    gap = gap_ms * 1000
    numbered = ranked(chunks, domain, [ts]).withColumn("__k", F.col("k") - 1)
    led = scan(numbered, domain, [ts], {"__lead": ("max", F.unix_micros(F.col(ts).cast("timestamp")) - F.col("__k") * gap)})
    return led.select(domain, ts, F.timestamp_micros(F.col("__lead") + F.col("__k") * gap).cast("timestamp_ntz").alias("scheduled"))
