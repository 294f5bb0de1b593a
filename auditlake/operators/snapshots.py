"""Changes between consecutive full snapshots, by digests of content-defined chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.session import written

_OUT = "snapshot_no int, row_key string, change string"
_LOW = (1 << 32) - 1


def row_digest(columns: Sequence[str], seed: int) -> Column:
    """64-bit digest of typed values; a mask of the nulls keeps (null, 'a') and ('a', null) apart."""
    mask = F.concat_ws("", *[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    return F.xxhash64(F.lit(seed), mask, *[F.col(c) for c in columns])


def chunk_digests(rows: DataFrame) -> DataFrame:
    """(chunk, snapshot_no, digest, once): digest of the multiset of a chunk's rows; once is true if all were delivered at one time.

    A digest is the number of rows and the sums of the halves of their 128-bit digests, so it is combined where rows
    are read and doesn't depend on their order.
    """
    halves = [F.sum(h).alias(f"s{i}{k}") for i, c in enumerate((F.xxhash64(F.lit(5), "k1", "k2", "d1", "d2"), F.xxhash64(F.lit(6), "k2", "d2", "k1", "d1"))) for k, h in enumerate((c.bitwiseAND(_LOW), F.shiftrightunsigned(c, 32)))]
    summed = rows.groupBy("chunk", "snapshot_no").agg(*halves, F.count(F.lit(1)).alias("n"), F.count("delivered").alias("timed"), F.min("delivered").alias("low"), F.max("delivered").alias("high"))
    once = (F.col("timed") == 0) | ((F.col("timed") == F.col("n")) & (F.col("low") == F.col("high")))
    return summed.select("chunk", "snapshot_no", F.struct("n", "s00", "s01", "s10", "s11").alias("digest"), once.alias("once"))


def unmatched_chunks(digests: DataFrame, numbers: Sequence[int]) -> DataFrame:
    """(chunk, snapshot_no, at, as_new, as_old): the chunks of each snapshot that differ from the snapshot before (as_new) or after (as_old)."""
    places = F.array(*[F.lit(n) for n in numbers])
    gathered = digests.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct(F.array_position(places, F.col("snapshot_no")).cast("int").alias("at"), "snapshot_no", "digest", "once"))).alias("all"))

    def differs(x: Column, step: int) -> Column:
        return ~F.exists("all", lambda y: (y.at == x.at + step) & (y.digest == x.digest) & y.once & x.once)

    flagged = gathered.select("chunk", F.explode(F.transform("all", lambda x: F.struct(x.snapshot_no.alias("snapshot_no"), x.at.alias("at"), ((x.at > 1) & differs(x, -1)).alias("as_new"), ((x.at < len(numbers)) & differs(x, 1)).alias("as_old")))).alias("c"))
    return flagged.select("chunk", "c.*").where("as_new or as_old")


def snapshot_changes(snapshots: DataFrame, key: str, number: str = "snapshot_no", delivered: str = "delivered_at", chunk_keys: int = 16) -> DataFrame:
    """(snapshot_no, row_key, change) between each delivered snapshot and the delivered one before it.

    Snapshots are thought of as sorted by the hash of their key and cut into chunks where the leading bits of that hash change (about
    every ``chunk_keys`` keys), so a chunk's borders depend on keys alone. Chunk digests are aggregated where rows
    are read, before any row is shuffled; chunks of equal digest in both snapshots are discarded, and only rows of
    the others are joined by key. Where few chunks differ their list is broadcast by its size, and rows of matching chunks never
    leave their task. Equality is by 128-bit digests of all columns but ``number`` and ``delivered``, null being a
    value. Of rows delivered again the last delivery counts (ties: the larger digest); a chunk with several delivery times is
    always looked into. A null key is a key of its own, rows of a null number are
    ignored, extra columns count as values, and an empty table or a single snapshot gives no rows. The distinct
    snapshot numbers with their row counts (one a delivery of the whole table) are the only data sent to the driver.
    """
    names = [c for c in snapshots.columns if c not in (number, delivered)]
    values = [c for c in names if c != key]
    sizes = snapshots.where(F.col(number).isNotNull()).groupBy(F.col(number).cast("int").alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()
    numbers = sorted(r.s for r in sizes)
    if len(numbers) < 2:
        return snapshots.sparkSession.createDataFrame([], _OUT)
    bits = max(0, (max(r.n for r in sizes) // max(1, chunk_keys)).bit_length())
    rows = snapshots.where(F.col(number).isNotNull()).select(
        F.col(number).cast("int").alias("snapshot_no"),
        F.col(key).cast("string").alias("row_key"),
        row_digest([key], 1).alias("k1"),
        row_digest([key], 2).alias("k2"),
        row_digest(values or [key], 3).alias("d1"),
        row_digest(values or [key], 4).alias("d2"),
        F.col(delivered).cast("timestamp_ntz").alias("delivered"),
    )
    rows = rows.withColumn("chunk", F.shiftrightunsigned("k1", 64 - bits) if bits else F.lit(0).cast("long"))
    unmatched = written(unmatched_chunks(chunk_digests(rows), numbers), "chunks")
    # Copies collapse before the shuffle, so a key delivered very often stays small.
    last = rows.join(unmatched, ["chunk", "snapshot_no"]).groupBy("row_key", "k1", "k2", "at").agg(F.max(F.struct("delivered", "d1", "d2")).alias("last"), F.any_value("as_new").alias("as_new"), F.any_value("as_old").alias("as_old"))
    keyed = last.groupBy("row_key", "k1", "k2").agg(F.array_sort(F.collect_list(F.struct("at", F.col("last.d1").alias("d1"), F.col("last.d2").alias("d2"), "as_new", "as_old"))).alias("all"))

    def classified(x: Column, i: Column) -> Column:
        before, after = F.get("all", i - 1), F.get("all", i + 1)
        follows = F.coalesce(before.at == x.at - 1, F.lit(False))
        return F.array(
            F.when(x.as_new & ~follows, F.struct(x.at.alias("at"), F.lit("added").alias("change"))),
            F.when(x.as_new & follows & ((before.d1 != x.d1) | (before.d2 != x.d2)), F.struct(x.at.alias("at"), F.lit("changed").alias("change"))),
            F.when(x.as_old & F.coalesce(after.at != x.at + 1, F.lit(True)), F.struct((x.at + 1).alias("at"), F.lit("removed").alias("change"))),
        )

    changes = keyed.select("row_key", F.explode(F.array_compact(F.flatten(F.transform("all", classified)))).alias("c"))
    return changes.select(F.element_at(F.array(*[F.lit(n) for n in numbers]), F.col("c.at")).alias("snapshot_no"), "row_key", "c.change")
