"""Running values within a key, for keys that hold any share of the rows: scans over chunks of ordered rows.

Rows are range-partitioned by key and order, so a hot key lies in many chunks. A scan runs within each chunk; what the
chunks before it add up to is carried in by a join with one row a key and chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.session import written

#: The chunk of a row; no input has a column of this name.
CHUNK = "__chunk__"

_RUNNING = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}


def chunked(rows: DataFrame, key: str, order: Sequence[str], chunks: int | None = None) -> DataFrame:
    """``rows`` with the number of their chunk; rows of equal key and order are in one chunk. Written once, as the borders must not move.

    Spark sizes the chunks unless their number is given.
    """
    ranged = rows.repartitionByRange(*([chunks] if chunks else []), key, *order)
    return written(ranged.withColumn(CHUNK, F.spark_partition_id()), "chunked")


def _combined(kind: str, before: Column, within: Column) -> Column:
    if kind == "sum":
        return F.coalesce(before, F.lit(0)) + F.coalesce(within, F.lit(0))
    return F.greatest(before, within) if kind == "max" else F.coalesce(within, before)


def scan(chunks: DataFrame, key: str, order: Sequence[str], values: dict[str, tuple[str, Column]], exclusive: bool = False) -> DataFrame:
    """``chunks`` (of chunked()) with running values by ``order`` within each key: name -> (sum, max or last value that isn't null; of what).

    ``exclusive`` leaves the row itself out. Null keys are a key of their own; among rows of equal order any
    comes first, so ``order`` should tell rows apart where that matters.
    """
    inputs = {f"__in_{n}": c for n, (_, c) in values.items()}
    rows = chunks.withColumns(inputs)

    def total(name: str, kind: str) -> Column:
        c = F.col(f"__in_{name}")
        whole = {"sum": F.sum(c), "max": F.max(c), "last": F.max_by(c, F.when(c.isNotNull(), F.struct(*order)))}[kind]
        return whole.alias(f"__all_{name}")

    states = rows.groupBy(F.col(key).alias("__key"), F.col(CHUNK).alias("__at")).agg(*[total(n, k) for n, (k, _) in values.items()])
    earlier = Window.partitionBy("__key").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    carried = states.select("__key", "__at", *[_RUNNING[k](F.col(f"__all_{n}")).over(earlier).alias(f"__before_{n}") for n, (k, _) in values.items()])
    within = Window.partitionBy(key, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    running = rows.withColumns({f"__run_{n}": _RUNNING[k](F.col(f"__in_{n}")).over(within) for n, (k, _) in values.items()})
    joined = running.join(carried, F.col(key).eqNullSafe(F.col("__key")) & (F.col(CHUNK) == F.col("__at")))
    return joined.select(*chunks.columns, *[_combined(k, F.col(f"__before_{n}"), F.col(f"__run_{n}")).alias(n) for n, (k, _) in values.items()])


def ranked(chunks: DataFrame, key: str, order: Sequence[str], rank: str = "k", count: str | None = None) -> DataFrame:
    """``chunks`` with the place of each row in its key, from 1, and the number of the key's rows."""
    placed = scan(chunks, key, order, {rank: ("sum", F.lit(1).cast("long"))})
    if count is None:
        return placed
    counts = chunks.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias(count))
    return placed.join(counts, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")
