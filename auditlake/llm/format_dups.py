"""Problem 3: records equal but for white space, letter case, punctuation and field order."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.codes import codepoints, fold_table, mix, rolling_hashes
from auditlake.session import spread, written

_U = np.uint64


def entries(fields: str | None) -> list[tuple[str, str]]:
    """Names and values of a JSON object as texts; another text is one value without a name."""
    if fields is None:
        return []
    try:
        pairs = json.loads(fields, object_pairs_hook=lambda x: x, parse_int=str, parse_float=str, parse_constant=str, strict=False)
    except ValueError:
        return [("", fields)]
    if not isinstance(pairs, list) or not all(isinstance(p, tuple) for p in pairs):
        return [("", fields)]
    return [(k, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for k, v in pairs]


def same_ignoring_format(left: Sequence[str | None], right: Sequence[str | None]) -> np.ndarray:
    """Of each pair of texts whether they are equal but for what is neither letter nor digit: two-pointer comparison of all pairs at once.

    A pointer on either side goes from one letter or digit to the next, skipping what lies between; pairs whose
    pointers make as many steps are compared step by step. No canonical text is built. Null equals only null.
    """
    table = fold_table()
    cps, pointers, steps = [], [], []
    for texts in (left, right):
        cp, starts = codepoints(texts)
        at = np.flatnonzero(table[cp])
        cps.append(cp)
        pointers.append(at)
        steps.append(np.diff(np.searchsorted(at, starts)))
    null = [np.fromiter((t is None for t in texts), bool, len(texts)) for texts in (left, right)]
    same = (steps[0] == steps[1]) & (null[0] == null[1])
    a, b = (p[np.repeat(same, n)] for p, n in zip(pointers, steps, strict=True))
    differ = table[cps[0][a]] != table[cps[1][b]]
    same[np.repeat(np.flatnonzero(same), steps[0][same])[differ]] = False
    return same


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        site, url, fields = (batch.column(i).to_pylist() for i in (1, 2, 3))
        parsed = [entries(f) for f in fields]
        counts = np.fromiter(map(len, parsed), np.int64, len(parsed))
        flat = [p for entry in parsed for p in entry]
        out = []
        hashes = [rolling_hashes(x) for x in (site, url, [k for k, _ in flat], [v for _, v in flat])]
        edges = np.append(0, np.cumsum(counts))
        null = np.fromiter((f is None for f in fields), bool, len(fields))
        for k in (0, 1):
            s, u, names, values = (h[k] for h in hashes)
            total = np.zeros(len(flat) + 1, _U)
            # A sum over entries has no order, so the order of fields doesn't matter.
            np.cumsum(mix(names * _U(3) + mix(values + _U(k + 1))), out=total[1:])
            body = total[edges[1:]] - total[edges[:-1]] + null.astype(_U)
            out.append(mix(mix(mix(s) + u) + body + _U(7)).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0]), pa.array(out[1])], ["raw_id", "h1", "h2"])


def _side(fields: Sequence[str | None]) -> tuple[np.ndarray, list[str], list[str]]:
    """Number of entries of each record, and all their names and values, ordered by their hashes within a record."""
    parsed = [entries(f) for f in fields]
    counts = np.fromiter(map(len, parsed), np.int64, len(parsed))
    flat = [p for entry in parsed for p in entry]
    names, values = [k for k, _ in flat], [v for _, v in flat]
    order = np.lexsort((rolling_hashes(values)[0], rolling_hashes(names)[0], np.repeat(np.arange(len(parsed)), counts))).tolist()
    return counts, [names[i] for i in order], [values[i] for i in order]


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        site, url, fields, site0, url0, fields0 = (batch.column(i).to_pylist() for i in range(2, 8))
        equal = same_ignoring_format(site, site0) & same_ignoring_format(url, url0)
        equal &= np.fromiter(((a is None) == (b is None) for a, b in zip(fields, fields0, strict=True)), bool, len(fields))
        # Records whose fields are the same text need no look at their entries.
        rest = np.flatnonzero(equal & np.fromiter((a != b for a, b in zip(fields, fields0, strict=True)), bool, len(fields))).tolist()
        (n, names, values), (n0, names0, values0) = _side([fields[i] for i in rest]), _side([fields0[i] for i in rest])
        fits = n == n0
        left, right = np.flatnonzero(np.repeat(fits, n)).tolist(), np.flatnonzero(np.repeat(fits, n0)).tolist()
        same = same_ignoring_format([names[i] for i in left], [names0[i] for i in right]) & same_ignoring_format([values[i] for i in left], [values0[i] for i in right])
        row = np.repeat(np.flatnonzero(fits), n[fits])
        fits[row[~same]] = False
        equal[np.asarray(rest, np.int64)[~fits]] = False
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(equal)], ["first_raw_id", "raw_id", "equal"])


def _checked(members: DataFrame, source: DataFrame) -> DataFrame:
    """(first_raw_id, raw_id, equal) of (first_raw_id, raw_id): whether the record is equal to that first one."""
    firsts = source.join(members.select(F.col("first_raw_id").alias("raw_id")).distinct(), "raw_id", "left_semi").dropDuplicates(["raw_id"])
    firsts = firsts.select(F.col("raw_id").alias("first_raw_id"), F.col("site").alias("site0"), F.col("url").alias("url0"), F.col("fields").alias("fields0"))
    texts = members.where("raw_id > first_raw_id").join(source, "raw_id").join(firsts, "first_raw_id")
    return written(texts.select("first_raw_id", "raw_id", "site", "url", "fields", "site0", "url0", "fields0").mapInArrow(_verify_batches, "first_raw_id long, raw_id long, equal boolean"), "checked")


def format_duplicates(raw: DataFrame, id_col: str = "raw_id", site: str = "website_url", url: str = "url", fields: str = "fields") -> DataFrame:
    """(first_raw_id, raw_id): each set of equal records' smallest id with each of its other ids.

    Rows are hashed in one stream (skip-and-fold table into two rolling polynomial hashes; entry hashes add up,
    so field order is ignored); only hashes and ids are shuffled for all rows. Rows of a hash that occurs twice
    fetch their texts and are compared, by two-pointer skipping, with the first record of their hash, entries being
    matched by their hashes. Records of one hash that differ (a collision) are compared again with the first of
    those that differ, until none is left. A hot hash is one row on the right side of a join that splits its
    skewed left side; group counts are pre-aggregated. Null equals only null, an empty text
    equals one of punctuation only; ``fields`` that is no JSON object counts as one unnamed value; ties don't
    occur as ids are unique (a repeated row with the same id is dropped); an empty table gives no rows; extra
    columns are ignored.
    """
    source = raw.select(F.col(id_col).cast("long").alias("raw_id"), F.col(site).cast("string").alias("site"), F.col(url).cast("string").alias("url"), F.col(fields).cast("string").alias("fields"))
    hashed = written(spread(source).mapInArrow(_hash_batches, "raw_id long, h1 long, h2 long"), "hashes")
    heads = hashed.groupBy("h1", "h2").agg(F.min("raw_id").alias("first_raw_id"), F.max("raw_id").alias("last")).where("first_raw_id < last").drop("last")
    members = hashed.join(heads, ["h1", "h2"]).select("first_raw_id", "raw_id").distinct()
    checked = _checked(members, source)
    same = checked.where("equal").select("first_raw_id", "raw_id")
    while not (other := checked.where("not equal").select(F.col("first_raw_id").alias("before"), "raw_id")).isEmpty():
        firsts = other.groupBy("before").agg(F.min("raw_id").alias("first_raw_id"))
        checked = _checked(other.join(firsts, "before").select("first_raw_id", "raw_id").distinct(), source)
        same = same.unionByName(checked.where("equal").select("first_raw_id", "raw_id"))
    return same.distinct()


def collapsed(raw: DataFrame, id_col: str = "raw_id") -> DataFrame:
    """(raw_id, copies): one row a set of equal records, the smallest id, with its number of records."""
    pairs = format_duplicates(raw, id_col)
    counts = pairs.groupBy(F.col("first_raw_id").alias("raw_id")).agg(F.count(F.lit(1)).alias("others"))
    gone = pairs.select("raw_id")
    kept = raw.select(F.col(id_col).alias("raw_id")).distinct().join(gone, "raw_id", "left_anti")
    return kept.join(counts, "raw_id", "left").select("raw_id", (F.coalesce("others", F.lit(0)) + 1).cast("long").alias("copies"))
