"""Per-key results when a few keys hold most rows: multi-level tree aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A column name no input has; clashing names of the input don't matter as inputs are first projected.
_NODE = "__node__"
#: Chunks that an input task is reckoned with: tasks read files of bounded size, so more than this many times ``chunk_rows`` rows don't occur.
_CHUNKS_A_TASK = 32


@dataclass(frozen=True)
class State:
    """One mergeable aggregate.

    ``local`` builds the state from rows, ``merge`` combines states, ``final`` turns the last state into the
    result. ``local`` is a Spark aggregate over input rows, ``merge`` one over state values.
    """

    name: str
    local: Column
    merge: str = "sum"
    final: str | None = None


_MERGES = {"sum": F.sum, "min": F.min, "max": F.max, "hll": F.hll_union_agg}


def rounds_for(chunks: int, fan_in: int) -> int:
    """Merge rounds before the last one: each leaves at most 1/fan_in of the partials of a key."""
    rounds = 0
    while chunks > fan_in:
        chunks = -(-chunks // fan_in)
        rounds += 1
    return rounds


def tree_aggregate(df: DataFrame, keys: Sequence[str], states: Sequence[State], fan_in: int = 32, chunk_rows: int = 1 << 22, tasks: int | None = None) -> DataFrame:
    """Aggregate by ``keys`` so that no task receives all partials of a hot key.

    Every input task is a chunk, and one of more than ``chunk_rows`` rows is several; a chunk is combined where
    it is read (one state a key and chunk). States then merge in rounds: round r groups by (key, chunk //
    fan_in^r), so a reducer gets at most ``fan_in`` states of a key, and the logarithmic number of rounds follows
    from the number of input tasks alone (a task counts as _CHUNKS_A_TASK chunks). Keys are null-safe (null is a group of its own), an empty input gives
    no rows, repeated rows count each, and the other columns' names don't matter. ``tasks`` is the number of input
    tasks, for inputs that come out of a shuffle (asking Spark for it would run that shuffle).
    """
    if fan_in < 2:
        raise ValueError("fan_in must be 2 or more")
    row_in_task = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    chunk = F.spark_partition_id().cast("long") * _CHUNKS_A_TASK + F.floor(row_in_task / F.lit(chunk_rows)).cast("long") % _CHUNKS_A_TASK
    level = df.withColumn(_NODE, chunk).groupBy(*keys, _NODE).agg(*[s.local.alias(s.name) for s in states])
    merged = [_MERGES[s.merge](s.name).alias(s.name) for s in states]
    if tasks is None:
        tasks = df.rdd.getNumPartitions()
    for _ in range(rounds_for(max(1, tasks) * _CHUNKS_A_TASK, fan_in)):
        level = level.withColumn(_NODE, F.floor(F.col(_NODE) / F.lit(fan_in))).groupBy(*keys, _NODE).agg(*merged)
    result = level.groupBy(*keys).agg(*merged)
    return result.select(*keys, *[(F.expr(s.final) if s.final else F.col(s.name)).alias(s.name) for s in states])


def key_counts(pages: DataFrame, fields: Sequence[str], fan_in: int = 32) -> DataFrame:
    """(field, key_value, n): rows of every value of every field, null values included, in one read."""
    stacked = pages.select(F.posexplode(F.array(*[F.col(f).cast("string") for f in fields])).alias("pos", "key_value"))
    counted = tree_aggregate(stacked, ["pos", "key_value"], [State("n", F.count(F.lit(1)))], fan_in)
    names = F.array(*[F.lit(f) for f in fields])
    return counted.select(F.element_at(names, F.col("pos") + 1).alias("field"), "key_value", "n")


def hot_keys(pages: DataFrame, fields: Sequence[str], share: float = 0.03, fan_in: int = 32) -> DataFrame:
    """(field, key_value) held by at least ``share`` of all rows; null is no value, an empty table has none."""
    counts = key_counts(pages, fields, fan_in)
    total = pages.agg(F.count(F.lit(1))).scalar()  # read from the files' metadata
    return counts.where(F.col("key_value").isNotNull() & (F.col("n") >= total * F.lit(share))).select("field", "key_value")


def site_profile(pages: DataFrame, key: str, fan_in: int = 32) -> DataFrame:
    """One row a value of ``key`` with page counts, failures, score and time range, by tree aggregation.

    Null keys form one group; null measures are skipped as in SQL aggregates. ``urls`` is exact: urls are first
    made distinct by (key, url), which spreads a hot key over its urls.
    """
    source = pages.select(key, "url", "status_code", "seo_score", "word_count", "crawled_at")
    states = [
        State("pages", F.count(F.lit(1))),
        State("failures", F.sum(F.when(F.col("status_code") >= 400, 1).otherwise(0))),
        State("score_sum", F.sum("seo_score")),
        State("score_n", F.count("seo_score")),
        State("words", F.sum("word_count")),
        State("first_crawl", F.min("crawled_at"), "min"),
        State("last_crawl", F.max("crawled_at"), "max"),
    ]
    measures = tree_aggregate(source, [key], states, fan_in)
    distinct = source.where(F.col("url").isNotNull()).groupBy(key, "url").agg(F.lit(1).alias("one"))
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    urls = tree_aggregate(distinct, [key], [State("urls", F.count(F.lit(1)))], fan_in, tasks=tasks).withColumnRenamed(key, "__k")
    return measures.join(urls, measures[key].eqNullSafe(urls["__k"]), "left").select(
        key,
        "pages",
        "failures",
        F.coalesce("urls", F.lit(0)).cast("long").alias("urls"),
        F.when(F.col("score_n") > 0, F.round(F.col("score_sum") / F.col("score_n"), 6)).alias("avg_score"),
        "words",
        "first_crawl",
        "last_crawl",
    )
