"""Spelling: words that a dictionary doesn't have, with suggestions, confidence and surroundings."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from auditlake.functions.text import context
from auditlake.session import written

#: Words a batch, words a page that are reported, least letters of a word, characters of its surroundings.
BATCH_WORDS, MOST_ERRORS, LEAST_LETTERS, CONTEXT_CHARS = 100, 100, 3, 80
#: Texts that have a word of the corpus' own dictionary, at least.
LEAST_TEXTS = 3
#: Letters up to which all deletions of a word are formed; longer words meet by their pieces.
DELETED_LETTERS = 24


def cleaned(text: Column) -> Column:
    """Without addresses, mail addresses and digits; marks part words as blanks would."""
    t = F.when(text.contains("http"), F.regexp_replace(text, r"https?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+", "")).otherwise(text)
    t = F.when(t.contains("@"), F.regexp_replace(t, r"\S+@\S+\.\S+", "")).otherwise(t)
    return F.regexp_replace(t, r"[0-9]+", "")


def listed_words(text: Column) -> Column:
    """The words of plain letters of a text, lower case, in their order."""
    words = F.regexp_extract_all(cleaned(F.coalesce(text, F.lit(""))), F.lit(rf"(?<![\p{{L}}\p{{N}}_])([a-zA-Z]{{{LEAST_LETTERS},}})(?![\p{{L}}\p{{N}}_])"))
    return F.transform(words, F.lower)


def tokens(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, word): the words of plain letters of every text, lower case, by their place."""
    return pages.select(key, F.posexplode(listed_words(F.col(text))).alias("pos", "word"))


def dictionary(words: DataFrame, key: str, least: int = LEAST_TEXTS) -> DataFrame:
    """(word, n): words of at least ``least`` texts, and of how many."""
    return words.select(key, "word").distinct().groupBy("word").agg(F.count(key).alias("n")).where(F.col("n") >= least)


def unknown_words(words: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, batch, word): unknown words, each once for every BATCH_WORDS words of a text; MOST_ERRORS of a text at most (the report's limit), by batch and word."""
    seen = words.select(key, F.floor(F.col("pos") / BATCH_WORDS).cast("long").alias("batch"), "word").distinct().join(known.select("word"), "word", "left_anti")
    place = F.row_number().over(Window.partitionBy(key).orderBy("batch", "word"))
    return seen.withColumn("__n", place).where(F.col("__n") <= MOST_ERRORS).select(key, "batch", "word")


def _placed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, k, batch, n): the places of a record batch's words; of words that LEAST_TEXTS of its texts have, only how many have them."""
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        lists = texts.flatten()
        sizes, words = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()
        row = np.repeat(np.repeat(np.arange(len(keys)), pc.list_value_length(texts).to_numpy(zero_copy_only=False)), sizes)
        part = (np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // BATCH_WORDS
        encoded = words.dictionary_encode()
        code, most_rows, most_parts = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(keys)), int(part.max(initial=0)) + 1
        places = np.unique((code * most_rows + row) * most_parts + part)
        pairs, part = places // most_parts, places % most_parts
        first = np.diff(pairs, prepend=-1) != 0
        code, row = pairs // most_rows, pairs % most_rows
        n = (first & keys.is_valid().to_numpy(zero_copy_only=False)[row]).astype(np.int64)
        texts_of = np.bincount(code, n, len(encoded.dictionary)).astype(np.int64)
        sure, left = np.flatnonzero(texts_of >= LEAST_TEXTS), texts_of[code] < LEAST_TEXTS
        code, row, part, n = code[left], row[left], part[left], n[left]
        yield pa.RecordBatch.from_arrays(
            [
                encoded.dictionary.take(pa.array(np.concatenate([sure, code]))).cast(pa.string()),
                pa.concat_arrays([pa.nulls(len(sure), keys.type), keys.take(pa.array(row))]),
                pa.concat_arrays([pa.nulls(len(sure), pa.int64()), pa.array(part)]),
                pa.array(np.concatenate([texts_of[sure], n])),
            ],
            ["word", "k", "batch", "n"],
        )


def corpus_unknown(pages: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``unknown_words`` and ``dictionary`` of texts that are their own dictionary.

    Words are counted and their places listed where they are read. A word that LEAST_TEXTS texts of a record batch
    have is known whatever the others have, so only rare words travel with their places, and no text does.
    """
    listed = pages.select(F.col(key).alias("k"), F.array(listed_words(F.col(text))).alias("texts")).where("size(texts[0]) > 0")
    if not pages.select(F.col(key).alias("k")).where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        alone = F.when(F.col("k").isNull(), F.monotonically_increasing_id())
        listed = listed.withColumn("alone", alone).groupBy("k", "alone").agg(F.flatten(F.collect_list("texts")).alias("texts")).select("k", "texts")
    rows = listed.mapInArrow(_placed_words, f"word string, k {pages.schema[key].dataType.simpleString()}, batch long, n long")
    at = F.collect_set(F.when(F.col("batch").isNotNull(), F.struct("k", "batch")))
    counted = rows.groupBy("word").agg(F.sum("n").alias("n"), at.alias("at"))
    counted = written(counted.select("word", "n", F.when(F.col("n") < LEAST_TEXTS, F.col("at")).alias("at")), "dictionary")
    unknown = counted.where(F.col("n") < LEAST_TEXTS).select("word", F.explode("at").alias("at")).select(F.col("at.k").alias(key), "at.batch", "word")
    place = F.row_number().over(Window.partitionBy(key).orderBy("batch", "word"))
    found = unknown.withColumn("__n", place).where(F.col("__n") <= MOST_ERRORS).select(key, "batch", "word")
    return written(found, "unknown"), counted.where(F.col("n") >= LEAST_TEXTS).select("word", "n")


def _pieces(word: str, asked: bool) -> set[str]:
    """Long words within two edits share one of three pieces of either, moved by two letters at most."""
    if len(word) <= DELETED_LETTERS - 2:
        return set()
    keys = set()
    for n in range(len(word) - 2, len(word) + 3) if asked else (len(word),):
        edges = (0, n // 3, 2 * n // 3, n)
        for k in range(3):
            for move in range(-2, 3) if asked else (0,):
                a, b = edges[k] + move, edges[k + 1] + move
                if 0 <= a and b <= len(word):
                    keys.add(f"{n} {k} {word[a:b]}")
    return keys


#: Known words (of KNOWN_KEYS keys each; a block has so many keys, whatever the words' lengths) and asked words that one task compares, asked words that are worth a further task while cores are idle, pairs and hashes at a time.
KNOWN_BLOCK, KNOWN_KEYS, ASKED_BLOCK, ASKED_LEAST, PAIRS, HASHES = 262_144, 32, 1_048_576, 32_768, 250_000, 250_000
#: Known words that a block has at most, about; asked words at a time.
KNOWN_WORDS, ASKED_WORDS = 2_000_000, 65_536
#: Blocks up to which every word goes to all of them; of more, to those that its keys fall into.
FEW_BLOCKS = 8
#: Odd factor of the keys' hash, its inverse; last bits of an index's key, which hold the word's place, and leading ones that its table has.
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_PLACE, _TABLE_BITS = np.uint64((1 << 24) - 1), np.uint64(25)


def _by_length(words: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and code points (a column a word) of the words of each length."""
    if not len(words):
        return {}
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    codes, ends = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]
    if codes.max(initial=0) > 127:
        codes = np.frombuffer(codes.tobytes().decode().encode("utf-32-le"), np.uint32)
        ends = np.concatenate([[0], np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)])
    lengths, starts = np.diff(ends), ends[:-1]
    return {int(n): (at := np.flatnonzero(lengths == n), np.stack([codes[starts[at] + i] for i in range(n)]) if n else np.empty((0, len(at)), np.uint8)) for n in np.unique(lengths)}


def _key_hashes(codes: np.ndarray, deleted: int) -> np.ndarray:
    """Hashes of the words less up to ``deleted`` letters, a row a deletion; equal hashes only make candidates."""
    n, (inverse, inverse2) = len(codes), (np.uint64(x & (1 << 64) - 1) for x in (_INVERSE, _INVERSE * _INVERSE))
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    to = np.zeros((n + 1, codes.shape[1]), np.uint64)
    np.cumsum(mixed * np.array([pow(_FACTOR, i, 1 << 64) for i in range(n)], np.uint64)[:, None], axis=0, out=to[1:])
    rows = [to[n]]
    if deleted:
        rows += [to[i] + inverse * (to[n] - to[i + 1]) for i in range(n)]
    if deleted > 1:
        rows += [to[i] + inverse * (to[j] - to[i + 1]) + inverse2 * (to[n] - to[j + 1]) for i in range(n) for j in range(i + 1, n)]
    return np.stack(rows)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distances of words (a column each) whose lengths differ by two at most; 3 stands for more than two."""
    n, m = len(a), len(b)
    far = np.full(a.shape[1], 3, np.uint8)
    above = {j: np.full(a.shape[1], j, np.uint8) for j in range(min(m, 2) + 1)}
    for i in range(1, n + 1):
        row = {0: np.full(a.shape[1], i, np.uint8)} if i <= 2 else {}
        for j in range(max(1, i - 2), min(m, i + 2) + 1):
            edits = np.minimum(above.get(j, far), row.get(j - 1, far)) + np.uint8(1)
            row[j] = np.minimum(edits, above.get(j - 1, far) + (a[i - 1] != b[j - 1]))
        above = row
    return np.minimum(above.get(m, far), 3)


def _block(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return ((hashes >> np.uint64(16) & _PLACE) * np.uint64(blocks) >> np.uint64(24)).astype(np.int32)


def _piece_block(piece: str, blocks: int) -> int:
    return zlib.crc32(piece.encode()) % blocks


def _hashed(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The first column and the key hashes of some of the words, HASHES at a time."""
    step = max(1, 2 * HASHES // (len(codes) ** 2 + len(codes) + 2))
    for first in range(0, codes.shape[1], step):
        yield first, _key_hashes(codes[:, first : first + step], 2)


def _index(known: dict[int, tuple[np.ndarray, np.ndarray]], block: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the known words in a block, each with the word's place in its last bits, and which leading bits occur."""
    n_keys = sum((n * n + n + 2) // 2 * len(at) for n, (at, _) in known.items() if n <= DELETED_LETTERS)
    keys, filled = np.empty(n_keys // blocks * 5 // 4 + HASHES, np.uint64), 0
    for n, (at, codes) in known.items():
        for first, h in _hashed(codes) if n <= DELETED_LETTERS else ():
            packed = h & ~_PLACE | at[first : first + h.shape[1]].astype(np.uint64)
            packed = packed[_block(h, blocks) == block] if blocks > 1 else packed.ravel()
            if filled + len(packed) > len(keys):
                keys = np.concatenate([keys[:filled], np.empty(filled + len(packed), np.uint64)])
            keys[filled : filled + len(packed)] = packed
            filled += len(packed)
    keys = keys[:filled]
    keys.sort()
    there = np.zeros(1 << int(_TABLE_BITS), bool)
    there[keys >> np.uint64(64) - _TABLE_BITS] = True
    return keys, there


def _met(hashes: np.ndarray, index: tuple[np.ndarray, np.ndarray], bound: int, block: int, blocks: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(column, known place), each pair once: words that share a key of the block; some PAIRS at a time."""
    keys, there = index
    if not len(keys):
        return
    flat = hashes.T.ravel()
    at = np.flatnonzero(_block(flat, blocks) == block) if blocks > 1 else np.arange(len(flat))
    at = at[there[flat[at] >> np.uint64(64) - _TABLE_BITS]]
    asked = flat[at] & ~_PLACE
    starts = np.searchsorted(keys, asked)
    hit = keys[np.minimum(starts, len(keys) - 1)] & ~_PLACE == asked
    word, starts = at[hit] // len(hashes), starts[hit]
    counts = np.searchsorted(keys, asked[hit] | _PLACE, "right") - starts
    ends = np.cumsum(counts)
    first = 0
    while first < len(word):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - counts[first] + PAIRS)))
        last = int(np.searchsorted(word, word[last - 1], "right"))  # all keys of a word stay together
        c = counts[first:last]
        inner = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        places = (keys[np.repeat(starts[first:last], c) + inner] & _PLACE).astype(np.int64)
        pairs = np.unique(np.repeat(word[first:last], c) * bound + places)
        yield pairs // bound, pairs % bound
        first = last


def _nearest(asked: pa.Array, known: pa.Array, block: int = 0, blocks: int = 1) -> np.ndarray:
    """Of every asked word its edit distance (1 or 2) times the number of known words, plus the place of the first known word of the least distance; -1 where none that shares a key of the block is so near."""
    bound = max(1, len(known))
    best = np.full(len(asked), 3 * bound, np.int64)
    groups = _by_length(known)
    lengths, column = np.zeros(bound, np.int32), np.zeros(bound, np.int32)
    for n, (at, _) in groups.items():
        lengths[at], column[at] = n, np.arange(len(at))
    index = _index(groups, block, blocks)
    some = ((begin, n, *group) for begin in range(0, len(asked), ASKED_WORDS) for n, group in _by_length(asked.slice(begin, ASKED_WORDS)).items())
    for begin, n, at, codes in some:
        for first, hashes in _hashed(codes) if n <= DELETED_LETTERS else ():
            for word, place in _met(hashes, index, bound, block, blocks):
                for m in range(max(n - 2, 0), n + 3):
                    same = lengths[place] == m
                    w, k = first + word[same], place[same]
                    if m in groups and len(w):
                        d = _distances(codes[:, w], groups[m][1][:, column[k]])
                        near = (d >= 1) & (d <= 2)
                        np.minimum.at(best, begin + at[w[near]], d[near].astype(np.int64) * bound + k[near])
    own = lambda word, asks: (piece for piece in _pieces(word, asks) if _piece_block(piece, blocks) == block)
    long = lambda words: ((i, words[i].as_py()) for i in np.flatnonzero(pc.greater(pc.utf8_length(words), DELETED_LETTERS - 2).to_numpy(zero_copy_only=False)).tolist())
    pieces: dict[str, list[int]] = {}
    for k, word in long(known):
        for piece in own(word, False):
            pieces.setdefault(piece, []).append(k)
    for i, word in long(asked) if pieces else ():
        for k in {k for piece in own(word, True) for k in pieces.get(piece, ())}:
            a, b = (np.frombuffer(w.encode("utf-32-le"), np.uint32)[:, None] for w in (word, known[k].as_py()))
            d = int(_distances(a, b)[0]) if abs(len(a) - len(b)) <= 2 else 3
            if 1 <= d <= 2:
                best[i] = min(best[i], d * bound + k)
    return np.where(best < 3 * bound, best, -1)


def _suggested(asked: pa.Table, known: pa.Table, block: int, blocks: int) -> pa.Table:
    known = known.sort_by([("n", "descending"), ("word", "ascending")])
    words, each = (pa.concat_arrays([pa.array([], pa.string()), *(c.cast(pa.string()) for c in t["word"].chunks)]) for t in (asked, known))
    best = _nearest(words, each, block, blocks)
    near = np.flatnonzero(best >= 0)
    chosen = pa.array(best[near] % max(1, len(each)))
    return pa.table({"asked": words.take(pa.array(near)), "distance": pa.array(best[near] // max(1, len(each)), pa.int64()), "rare": pa.array(-known["n"].take(chosen).to_numpy(), pa.int64()), "word": each.take(chosen)})


def _own_blocks(words: pa.Array, blocks: int, asks: bool) -> pa.Array:
    """The blocks that the keys of each word fall into."""
    pairs = [np.empty(0, np.int64)]
    words = words.cast(pa.string())
    for n, (at, codes) in _by_length(words).items():
        for first, h in _hashed(codes) if n <= DELETED_LETTERS else ():
            pairs.append(np.unique(at[first : first + h.shape[1]] * blocks + _block(h, blocks)))
        if n > DELETED_LETTERS - 2:
            pairs.append(np.array([i * blocks + _piece_block(piece, blocks) for i in at.tolist() for piece in _pieces(words[i].as_py(), asks)], np.int64))
    found = np.unique(np.concatenate(pairs))
    ends = np.searchsorted(found, np.arange(len(words) + 1) * blocks)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found % blocks, pa.int32()))


def suggestions(words: DataFrame, known: DataFrame) -> DataFrame:
    """(word, suggestion, distance) of distinct words: the known word of the least edit distance (two at most), the most frequent, the first by letters; words without one are left out.

    The keys of words (what is left of them less up to two letters) fall into blocks, and words meet in the blocks
    of their keys, a task each: a block has a bounded number of keys, a word goes to no more blocks than it has
    keys, and only words are shuffled, neither keys nor anything broadcast.
    """
    asked = written(words.select("word").distinct(), "asked")
    letters = F.least(F.length("word"), F.lit(DELETED_LETTERS)).cast("long")
    keys = F.sum(F.expr("1 + n + n * (n - 1) div 2"))
    (n_known, k_known), (n_asked, k_asked) = (df.select(letters.alias("n")).agg(F.count("n"), F.coalesce(keys, F.lit(0))).first() for df in (known, asked))
    blocks = max(1, -(-k_known // (KNOWN_BLOCK * KNOWN_KEYS)))
    while n_known * (1 - (1 - 1 / blocks) ** (k_known / max(1, n_known))) > KNOWN_WORDS:
        blocks += -(-blocks // 4)
    in_block = max(1, min(n_asked, k_asked // blocks))
    cores = words.sparkSession.sparkContext.defaultParallelism
    chunks = max(1, -(-in_block // ASKED_BLOCK), min(-(-cores // blocks), in_block // ASKED_LEAST))

    def placed(df: DataFrame, asks: bool, *columns: Column) -> DataFrame:
        numbers = F.sequence(F.lit(0), F.lit(blocks - 1))
        if blocks > FEW_BLOCKS:
            numbers = F.arrow_udf(lambda w: _own_blocks(w, blocks, asks), ArrayType(IntegerType()))("word")
        chunk = F.pmod(F.xxhash64("word"), F.lit(chunks)).cast("int") if asks else F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
        return df.select("word", *columns, F.explode(numbers).alias("b")).select("*", chunk.alias("c")).repartition(blocks * chunks, "b", "c")

    left, right = placed(asked, True), placed(known, False, F.col("n").cast("long").alias("n"))
    near = left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInArrow(lambda at, a, k: _suggested(a, k, at[0].as_py(), blocks), "asked string, distance long, rare long, word string")
    best = near.groupBy("asked").agg(F.min(F.struct("distance", "rare", "word")).alias("b"))
    return best.select(F.col("asked").alias("word"), F.col("b.word").alias("suggestion"), F.col("b.distance").alias("distance"))


def confidence(word: Column, suggestion: Column, distance: Column) -> Column:
    return F.when(suggestion.isNull() | (suggestion == ""), "low").when(distance <= 1, "high").when((distance <= 2) & (F.length(word) > 4), "medium").otherwise("low")


def explained(pages: DataFrame, key: str, text: str, found: DataFrame, known: DataFrame) -> DataFrame:
    """``errors`` for unknown words that have been found."""
    spelled = found.join(suggestions(found, known), "word", "left")
    both = spelled.join(pages.select(key, F.col(text).alias("__t")), key)
    at = F.instr(F.lower("__t"), F.col("word")).cast("long") - 1
    return both.select(key, "batch", "word", F.coalesce("suggestion", F.lit("")).alias("suggestion"), confidence(F.col("word"), F.col("suggestion"), F.col("distance")).alias("confidence"), at.alias("position"), context(F.col("__t"), F.col("word"), CONTEXT_CHARS).alias("context"))


def errors(pages: DataFrame, key: str, text: str, words: DataFrame, known: DataFrame) -> DataFrame:
    """(key, batch, word, suggestion, confidence, position, context) of every unknown word of the texts.

    Null texts and texts without words have none; position counts characters from 0 to the first place of the
    word in any case, within other words too, -1 if the cleaning has made it; the surroundings are null then.
    """
    return explained(pages, key, text, unknown_words(words, known, key), known)
