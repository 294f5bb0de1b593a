"""Problem 6: records that share most of their words, by T-occurrence search over inverted lists."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.codes import mix, word_runs
from auditlake.session import spread, written

_U = np.uint64
#: Word frequencies, and sets of ids, are kept in hashed tables of this fixed size.
TABLE = 1 << 22
#: Expected records on an inverted list; a longer list is met only together with further words.
SHORT_LIST = 100.0
#: Words that a merged list is keyed by at most; a list that is long even then is met in blocks.
MOST_WORDS = 5
#: Records of a list that one task compares with each other; longer lists are dealt out as pairs of such blocks.
BLOCK = 4096
#: Bits of a word's id.
WORD_BITS = 48


def _bit(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.view(_U)) & _U(TABLE - 1)).astype(np.int64)


def word_sets(records: DataFrame, id_col: str, texts: Sequence[str], least_chars: int, least_words: int) -> DataFrame:
    """(id, h1, h2, words): the distinct words of each record with enough of them, as sorted ids, and the set's digest."""
    source = records.select(F.col(id_col).cast("long").alias("id"), *[F.col(t).cast("string").alias(f"t{k}") for k, t in enumerate(texts)])
    for k in range(len(texts)):
        source = source.where(F.length(f"t{k}") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k + 1).to_pylist() for k in range(len(texts))]
            own, _, length, h = word_runs([" ".join(row) for row in zip(*columns, strict=True)])
            keep = length >= least_chars
            own, h = own[keep], h[keep] >> _U(64 - WORD_BITS)
            order = np.lexsort((h, own))
            own, h = own[order], h[order]
            new = np.append(True, (own[1:] != own[:-1]) | (h[1:] != h[:-1]))[: len(own)]
            own, h = own[new], h[new]
            n = np.bincount(own, minlength=batch.num_rows)
            enough = n >= least_words
            picked = enough[own]
            edges = np.append(0, np.cumsum(n[enough]))
            digests = []
            for seed in (1, 2):
                total = np.append(_U(0), np.cumsum(mix(h[picked] + _U(seed << 56)), dtype=_U))
                digests.append(mix(total[edges[1:]] - total[edges[:-1]]).view(np.int64))
            words = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(h[picked].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(enough)), pa.array(digests[0]), pa.array(digests[1]), words], ["id", "h1", "h2", "words"])

    return spread(source).mapInArrow(run, "id long, h1 long, h2 long, words array<long>")


def _gathered(places: DataFrame) -> np.ndarray:
    """A table of TABLE bits from a column of places; at most TABLE numbers reach the driver."""
    bits = np.zeros(TABLE, bool)
    bits[places.distinct().toPandas().iloc[:, 0].to_numpy(np.int64)] = True
    return np.packbits(bits)


def _place(column: str) -> Column:
    return F.pmod(F.xxhash64(F.col(column)), F.lit(TABLE)).cast("int").alias("place")


def word_frequencies(sets: DataFrame) -> np.ndarray:
    """How many records have each word, by hashed place (words of one place count together)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TABLE, np.int32)
        for batch in batches:
            total += np.bincount(_bit(batch.column(0).flatten().to_numpy()), minlength=TABLE).astype(np.int32)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], ["place", "n"])

    rows = sets.select("words").mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).where("n >= 2").select("place", F.least("n", F.lit(1 << 30)).cast("int").alias("n")).toPandas()
    result = np.ones(TABLE, np.int32)
    result[rows["place"].to_numpy(np.int64)] = rows["n"].to_numpy()
    return result


class Signer:
    """Keys under which records of a batch meet.

    Words are ordered from rare to frequent. Of two similar records' common words, the first few (as many as it
    takes until their lists' expected overlap is short) are a key of both: in each record, at most as many words as
    it may lack in the other one stand before them. Rare words are thus keys by themselves (short lists), frequent
    ones only in combination, so no long list is ever merged.
    """

    def __init__(self, frequency: np.ndarray, records: int, threshold: float, smallest: int = 1) -> None:
        self.frequency, self.records, self.threshold, self.smallest = frequency, max(1, records), threshold, smallest

    def keys(self, flat: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, record, and whether the record may be the smaller one under that key."""
        size = np.diff(edges)
        f = self.frequency[_bit(flat)]
        owner = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((flat, f, owner))
        flat, f = flat[order].view(_U), f[order].astype(np.float64)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in np.unique(size).tolist():
            docs = np.flatnonzero(size == n)
            at = edges[docs][:, None] + np.arange(n)[None, :]
            self._descend(flat[at], f[at], docs, n, out)
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        key, doc, small = (np.concatenate(x) for x in zip(*out, strict=True))
        return key.view(np.int64), doc, small

    def _descend(self, words: np.ndarray, f: np.ndarray, docs: np.ndarray, n: int, out: list) -> None:
        t = self.threshold
        lacks = n - math.ceil(t * n - 1e-9)  # words that a record may lack in a smaller or equal one
        lacks = min(lacks, math.floor(n - t / (1 + t) * (n + self.smallest) + 1e-9))  # no other record is smaller than that
        lacks_small = n - math.ceil(2 * t / (1 + t) * n - 1e-9)  # ... in a larger or equal one

        def step(start: int, taken: int, rows: np.ndarray, expected: np.ndarray, key: np.ndarray) -> None:
            for i in range(start, min(n, lacks + taken + 1)):
                now = f[rows, i] if not taken else expected * f[rows, i] / self.records
                longer = mix(key * _U(3) + words[rows, i])
                if taken:
                    done = now <= SHORT_LIST
                    emit = done
                else:
                    done = now <= SHORT_LIST
                    emit = done & (f[rows, i] > 1)  # a word of one record is shared with none
                if taken + 1 == MOST_WORDS:
                    done = emit = np.ones(len(rows), bool)
                if emit.any():
                    k = int(emit.sum())
                    out.append((longer[emit], docs[rows[emit]], np.full(k, i - taken <= lacks_small)))
                rest = ~done
                if rest.any():
                    step(i + 1, taken + 1, rows[rest], now[rest], longer[rest])

        step(0, 0, np.arange(len(docs)), np.zeros(len(docs)), np.zeros(len(docs), _U))


#: Low bits of a signature: a record's size and, in the last one, whether it may be the smaller one; the others are the key.
LOW_BITS = 12
#: Sizes from this on are one size; such records are told apart by their words only.
LARGE = (1 << (LOW_BITS - 1)) - 1


def _sketch(flat: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """64 bits of each record's words; two records differ in at least as many words as bits."""
    bits = _U(1) << (mix(flat.view(_U) + _U(99)) & _U(63))
    return np.bitwise_or.reduceat(bits, edges[:-1]) if len(flat) else np.zeros(0, _U)


def _met(sig: np.ndarray, rid: np.ndarray, sketch: np.ndarray, side: np.ndarray | None, threshold: float) -> np.ndarray:
    """Pairs of ids that meet under a key and may be similar by size and sketch; rows are sorted by signature.

    With ``side``, rows of sides 1 and 2 meet only each other.
    """
    sketch, size, small, key = sketch.view(_U), sig >> 1 & LARGE, (sig & 1) > 0, sig >> LOW_BITS
    new = np.append(True, key[1:] != key[:-1])
    end = np.append(np.flatnonzero(new)[1:], len(key))[np.cumsum(new) - 1]
    differ = (1 - threshold) / (1 + threshold) + 1e-9
    found = []
    at, step = np.arange(len(sig)), 1
    while True:
        at = at[at + step < end[at]]
        if not len(at):
            break
        to = at + step
        na, nb = size[at], size[to]
        low, high = np.minimum(na, nb), np.maximum(na, nb)
        role = np.where(na < nb, small[at], np.where(nb < na, small[to], small[at] & small[to]))
        ok = role & (low >= threshold * high - 1e-9) & (np.bitwise_count(sketch[at] ^ sketch[to]) <= differ * (na + nb))
        ok = (ok | (high == LARGE)) & (rid[at] != rid[to])
        if side is not None:
            ok &= (side[at] == 0) | (side[at] != side[to])
        if ok.any():
            a, b = rid[at[ok]], rid[to[ok]]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
        step += 1
    if not found:
        return np.zeros((0, 2), np.int64)
    pairs = np.concatenate(found)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    return pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(1))]


#: What meets: pairs (a, b); and rows of lists longer than BLOCK, with the number of their block in the list.
_MET = "a long, b long, sig long, block long, id long, sketch long"
_MET_NAMES = [c.split()[0] for c in _MET.split(", ")]


def _meet(threshold: float, block_rows: int):
    """Merges sorted lists as they stream by; a task holds one block of a list at most."""

    def found(rows: list[np.ndarray]) -> pa.RecordBatch:
        p = _met(*rows[:3], rows[3] if len(rows) > 3 else None, threshold)
        none = pa.nulls(len(p), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), none, none, none, none], _MET_NAMES)

    def dealt(rows: list[np.ndarray], block: int) -> pa.RecordBatch:
        sig, rid, sketch = rows
        none = pa.nulls(len(sig), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(sig), pa.array(np.full(len(sig), block)), pa.array(rid), pa.array(sketch)], _MET_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        block, going = 0, None  # blocks dealt out of the list that is going on
        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            if not len(rows[0]):
                continue
            if rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows, strict=True)]
            key = rows[0] >> LOW_BITS
            new = np.append(True, key[1:] != key[:-1])
            starts = np.flatnonzero(new)
            # The last key may go on in the next batch.
            ends = starts[1:]
            size = np.diff(starts)
            long_ = (size > block_rows) | (key[starts[:-1]] == going if going is not None else False)
            keep = np.repeat(~long_, size)
            if keep.any():
                yield found([r[: len(keep)][keep] for r in rows])
            for a, b in zip(starts[:-1][long_].tolist(), ends[long_].tolist(), strict=True):
                block = block if key[a] == going else 0
                for i in range(a, b, block_rows):
                    yield dealt([r[i : min(b, i + block_rows)] for r in rows], block)
                    block += 1
            a = int(starts[-1])
            if key[a] != going:
                block, going = 0, None
            while len(rows[0]) - a > block_rows or (going is not None and len(rows[0]) - a >= block_rows):
                yield dealt([r[a : a + block_rows] for r in rows], block)
                block, going, a = block + 1, key[a], a + block_rows
            rest = [r[a:] for r in rows]
        if rest is not None and len(rest[0]):
            yield dealt(rest, block) if rest[0][0] >> LOW_BITS == going else found(rest)

    return run


class NearDuplicates:
    """Near-duplicate records of a table.

    Records whose texts are null or empty, or that have fewer than ``least_words`` distinct words of at least
    ``least_chars`` letters or digits, don't count. Records of equal word sets are one class, represented by its
    smallest id, and only classes are compared; repeated rows with one id are one record. No pair at or above the
    threshold is lost: keys and sketches never part similar records, and word sets decide in the end. Lists of more than
    BLOCK records are met block by block, each pair of blocks in a task of its own. Word sets are written to the shared folder once.
    """

    def __init__(self, records: DataFrame, id_col: str = "webpage_id", texts: Sequence[str] = ("title", "meta_description"), threshold: float = 0.6, least_chars: int = 4, least_words: int = 12) -> None:
        self.threshold, self.id_col, self.least_words = threshold, id_col, least_words
        self.sets = written(word_sets(records, id_col, texts, least_chars, least_words), "sets")
        self._classes: DataFrame | None = None
        self._pairs: DataFrame | None = None

    def members(self) -> DataFrame:
        """(class_id, id) of the classes of several records."""
        if self._classes is None:
            heads = self.sets.groupBy("h1", "h2").agg(F.min("id").alias("class_id"), F.max("id").alias("last")).where("class_id < last")
            several = heads.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "class_id")
            rows = self.sets.select("id", "h1", "h2")
            self._classes = written(rows.join(several, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).select("class_id", "id", "h1").distinct(), "members")
        return self._classes

    def class_pairs(self) -> DataFrame:
        """(a, b): classes whose sets share at least the threshold of their words, a < b."""
        if self._pairs is None:
            self._pairs = written(self._verified(self._candidates()), "pairs")
        return self._pairs

    def _candidates(self) -> DataFrame:
        spark, threshold = self.sets.sparkSession, self.threshold
        # Records that are surely alone in their class go on at once; the others are met by class first.
        copied = spark.sparkContext.broadcast(_gathered(self.members().select(_place("h1"))))
        placed = self.sets.select("id", "h1", "h2", "words", _place("h1"))

        def part(wanted: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                bits = np.unpackbits(copied.value).astype(bool)
                for batch in batches:
                    mask = bits[batch.column(4).to_numpy()]
                    yield pa.RecordBatch.from_arrays([c.filter(pa.array(mask == wanted)) for c in batch.columns[:4]], ["id", "h1", "h2", "words"])

            return placed.mapInArrow(run, "id long, h1 long, h2 long, words array<long>")

        firsts = part(True).groupBy("h1", "h2").agg(F.min("id").alias("id"), F.min_by("words", "id").alias("words")).select("id", "words")
        classes = part(False).select("id", "words").unionByName(firsts)
        signer = spark.sparkContext.broadcast(Signer(word_frequencies(self.sets), self.sets.count(), threshold, self.least_words))

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(1)
                edges = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)))
                flat = lists.flatten().to_numpy()
                key, doc, small = signer.value.keys(flat, edges)
                sig = key << LOW_BITS | np.minimum(np.diff(edges), LARGE)[doc] << 1 | small
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(batch.column(0).to_numpy()[doc]), pa.array(_sketch(flat, edges)[doc].view(np.int64))], ["sig", "id", "sketch"])

        keyed = classes.mapInArrow(sign, "sig long, id long, sketch long")
        met = written(keyed.repartition(F.shiftright("sig", LOW_BITS)).sortWithinPartitions("sig").mapInArrow(_meet(threshold, BLOCK), _MET), "met")
        hot = met.where("sig is not null")
        pairs = met.where("sig is null").select("a", "b")
        if not hot.isEmpty():
            # Every pair of a long list's blocks is a list of its own, of two blocks at most.
            key = F.shiftright("sig", LOW_BITS).alias("key")
            blocks = hot.groupBy(key).agg((F.max("block") + 1).alias("blocks"))
            other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
            dealt = hot.withColumn("key", key).join(blocks, "key").select("key", "sig", "id", "sketch", "block", other.alias("other"))
            low, high = F.least("block", "other"), F.greatest("block", "other")
            side = F.when(low == high, 0).when(F.col("block") == low, 1).otherwise(2)
            lists = dealt.select(F.shiftleft(F.xxhash64("key", low, high), LOW_BITS).bitwiseOR(F.col("sig").bitwiseAND((1 << LOW_BITS) - 1)).alias("sig"), "id", "sketch", side.alias("side"))
            pairs = pairs.unionByName(lists.repartition(F.shiftright("sig", LOW_BITS)).sortWithinPartitions("sig").mapInArrow(_meet(threshold, 1 << 40), _MET).select("a", "b"))
        return pairs.distinct()

    def _verified(self, candidates: DataFrame) -> DataFrame:
        pairs = written(candidates, "candidates")
        spark = pairs.sparkSession
        wanted = spark.sparkContext.broadcast(_gathered(pairs.select(F.explode(F.array("a", "b")).alias("id")).select(_place("id"))))

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.unpackbits(wanted.value).astype(bool)
            for batch in batches:
                mask = pa.array(bits[batch.column(2).to_numpy()])
                yield pa.RecordBatch.from_arrays([c.filter(mask) for c in batch.columns[:2]], ["id", "words"])

        words = self.sets.select("id", "words", _place("id")).mapInArrow(pick, "id long, words array<long>").dropDuplicates(["id"])
        both = pairs.join(words.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a").join(words.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
        shared = F.size(F.array_intersect("wa", "wb"))
        union = F.size("wa") + F.size("wb") - shared
        return both.where(shared >= F.lit(self.threshold) * union - F.lit(1e-9)).select("a", "b")

    def record_pairs(self) -> DataFrame:
        """(id_a, id_b), a < b: all pairs of similar records, copies included."""
        members = self.members().select("class_id", "id")
        expanded = self.class_pairs()
        for side in ("a", "b"):
            copies = members.select(F.col("class_id").alias(side), F.col("id").alias(f"{side}_id"))
            expanded = expanded.join(copies, side, "left").withColumn(f"{side}_id", F.coalesce(f"{side}_id", side))
        between = expanded.select(F.least("a_id", "b_id").alias(f"{self.id_col}_a"), F.greatest("a_id", "b_id").alias(f"{self.id_col}_b"))
        other = members.select("class_id", F.col("id").alias("id_b"))
        within = members.join(other, "class_id").where("id < id_b").select(F.col("id").alias(f"{self.id_col}_a"), F.col("id_b").alias(f"{self.id_col}_b"))
        return between.unionByName(within)

    def groups(self) -> DataFrame:
        """(id, class_id, group_id, links): every record that counts, its class of equal sets, its group of linked classes, and its class's links.

        Groups are the connected components of classes, named by their smallest id, found by hash-min with
        shortcuts; every round's labels are written to the shared folder.
        """
        edges = self.class_pairs()
        both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y")))
        labels = written(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label"), F.count(F.lit(1)).alias("links")), "labels")
        while True:
            theirs = labels.select(F.col("x").alias("y"), F.col("label").alias("theirs"))
            low = both.join(theirs, "y").groupBy("x").agg(F.min("theirs").alias("low"))
            step = labels.join(low, "x").select("x", F.least("label", "low").alias("near"), "label", "links")
            jump = step.select(F.col("x").alias("near"), F.col("near").alias("far"))
            after = written(step.join(jump, "near", "left").select("x", F.least("near", F.coalesce("far", "near")).alias("label"), F.col("label").alias("old"), "links"), "labels")
            moved = after.where("label < old").limit(1).count()
            labels = after.drop("old")
            if not moved:
                break
        classes = self.members().select("class_id", "id")
        rows = self.sets.select("id").distinct().join(classes, "id", "left").withColumn("class_id", F.coalesce("class_id", "id"))
        joined = rows.join(labels.select(F.col("x").alias("class_id"), "label", "links"), "class_id", "left")
        return joined.select(F.col("id").alias(self.id_col), "class_id", F.coalesce("label", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
