"""Problem 9: passages of held-out test items inside documents."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.codes import BASES, codepoints, fold_table, mix, powers
from auditlake.session import spread, written

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_SPACE = np.uint32(32)
_TABLE_BITS = 22
#: Characters that are handled at once; a longer text is cut into overlapping windows of this size.
WINDOW_CHARS = 1 << 20
#: Characters of items that one pass over the documents looks for; larger sets take several passes.
ITEM_CHARS = 1 << 23
#: Folded characters of an item that are searched for at once; a longer item is several overlapping ones.
PIECE_CHARS = 1 << 16


def normalised(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts as folded words with one space between: code points, starts of texts, starts of words, text of each word."""
    cp, starts = codepoints(texts)
    folded = fold_table()[cp]
    where = np.flatnonzero(folded)
    if not len(where):
        return np.zeros(0, np.uint32), np.zeros(len(starts), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.searchsorted(starts, where, "right") - 1
    begins = np.append(True, (np.diff(where) > 1) | (np.diff(owner) > 0))
    # Every word is preceded by a space, the first word of a text too; so words keep apart across texts.
    place = np.arange(len(where)) + np.cumsum(begins)
    out = np.full(len(where) + int(begins.sum()), _SPACE, np.uint32)
    out[place] = folded[where]
    words = place[begins]
    word_owner = owner[begins]
    first_word = np.searchsorted(word_owner, np.arange(len(starts)))
    edges = np.append(words - 1, len(out))
    return out, edges[first_word], words, word_owner


def gram_hashes(cp: np.ndarray, q: int) -> np.ndarray:
    """Hash of every q-gram, q a power of 2, by doubling."""
    h, width = mix(cp), 1
    while width < q:
        h = h[: len(h) - width] * (_BASE ** _U(width)) + h[width:] if len(h) > width else h[:0]
        width *= 2
    return h


def word_grams(cp: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words of one text; exact but for 64-bit collisions."""
    if len(words) < n:
        return np.zeros(0, _U)
    ends = np.append(words[1:] - 1, len(cp))
    total = np.zeros(len(cp) + 1, _U)
    nth = np.zeros(len(cp), np.int64)
    nth[words[0] :] = np.arange(words[0], len(cp)) - np.repeat(words, np.diff(np.append(words, len(cp))))
    np.cumsum(mix(cp) * powers(BASES[0], int(nth.max(initial=0)) + 1)[nth], out=total[1:])
    h = mix(total[ends] - total[words])
    return np.sum(np.lib.stride_tricks.sliding_window_view(h, n) * powers(BASES[0], n)[:n], axis=1, dtype=_U)


@dataclass
class Item:
    item_id: int
    cp: np.ndarray
    words: np.ndarray
    windows: tuple[np.ndarray, np.ndarray]
    grams: np.ndarray
    least: int


class Items:
    """A block of test items with an index of their q-grams."""

    def __init__(self, rows: Sequence[tuple[int, str]], min_words: int, edits: int, q: int) -> None:
        self.min_words, self.edits, self.q = min_words, edits, q
        self.items: list[Item] = []
        hashes, owners, places = [], [], []
        for item_id, text in rows:
            cp, _, words, _ = normalised([text])
            if len(words) < min_words:
                continue  # no passage of it is long enough
            cp, words = cp[1:], words - 1
            ends = np.append(words[1:] - 1, len(cp))
            windows = (words[: len(words) - min_words + 1], ends[min_words - 1 :])
            # q-gram lemma: a passage of n characters within the edit budget keeps n + 1 - q - q * edits q-grams.
            least = max(1, int((windows[1] - windows[0]).min()) + 1 - q - q * edits)
            h = gram_hashes(cp, q)
            hashes.append(h)
            owners.append(np.full(len(h), len(self.items), np.int32))
            places.append(np.arange(len(h), dtype=np.int32))
            self.items.append(Item(int(item_id), cp, words, windows, np.unique(word_grams(cp, words, min_words)), least))
        h = np.concatenate([*hashes, np.zeros(0, _U)])
        order = np.argsort(h, kind="stable")
        self.gram, self.owner, self.place = h[order], np.concatenate([*owners, np.zeros(0, np.int32)])[order], np.concatenate([*places, np.zeros(0, np.int32)])[order]
        self.maybe = np.zeros(1 << _TABLE_BITS, bool)
        self.maybe[h >> _U(64 - _TABLE_BITS)] = True
        self.least = np.array([i.least for i in self.items], np.int64)
        self.longest = max((len(i.cp) for i in self.items), default=0)

    def candidates(self, cp: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int, np.ndarray]]:
        """(text, item, lowest and highest diagonal, windows of the item) of regions that keep enough q-grams in a band."""
        h = gram_hashes(cp, self.q)
        at = np.flatnonzero(self.maybe[h >> _U(64 - _TABLE_BITS)])
        if not len(at) or not len(self.gram):
            return []
        lo, hi = np.searchsorted(self.gram, h[at], "left"), np.searchsorted(self.gram, h[at], "right")
        n = hi - lo
        at = np.repeat(at, n)
        if not len(at):
            return []
        index = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        text = np.searchsorted(starts, at, "right") - 1
        item = self.owner[index].astype(np.int64)
        diagonal = at - starts[text] - self.place[index] + self.longest  # never negative
        width = 2 * (self.edits + 1)
        # A text and item with too few shared q-grams altogether has no such band.
        pair = text * len(self.items) + item
        order = np.argsort(pair, kind="stable")
        pair, diagonal, place = pair[order], diagonal[order], self.place[index][order]
        edges = np.append(np.flatnonzero(np.append(True, pair[1:] != pair[:-1])), len(pair))
        size = np.diff(edges)
        enough = np.repeat(size >= self.least[pair[edges[:-1]] % len(self.items)], size)
        pair, diagonal, place = pair[enough], diagonal[enough], place[enough]
        if not len(pair):
            return []
        found: dict[tuple[int, int], tuple[list[int], np.ndarray]] = {}
        bands = (int(diagonal.max(initial=0)) + width) // width + 1
        # Bands overlap by half: any edits + 1 neighbouring diagonals lie within one of them.
        for shift in (0, width // 2):
            key = pair * bands + (diagonal + shift) // width
            order = np.argsort(key, kind="stable")
            key, places = key[order], place[order]
            edges = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            passing = np.flatnonzero(np.diff(edges) >= self.least[key[edges[:-1]] // bands % len(self.items)])
            for k in passing.tolist():
                (t, i), band = divmod(int(key[edges[k]]) // bands, len(self.items)), int(key[edges[k]]) % bands
                mine = np.unique(places[edges[k] : edges[k + 1]])
                starts_, ends_ = self.items[i].windows
                shared = np.searchsorted(mine, ends_ - self.q, "right") - np.searchsorted(mine, starts_)
                kept = shared >= np.maximum(1, ends_ - starts_ + 1 - self.q * (1 + self.edits))
                if kept.any():
                    low = band * width - shift - self.longest
                    spans, windows = found.setdefault((t, i), ([], np.zeros(len(starts_), bool)))
                    spans.append(low)
                    windows |= kept
        result = []
        for (t, i), (spans, windows) in found.items():
            spans.sort()
            low = high = spans[0]
            for a in spans[1:]:
                if a > high + width:
                    result.append((t, i, low, high + width - 1, windows))
                    low = a
                high = a
            result.append((t, i, low, high + width - 1, windows))
        return result

    def aligned(self, item: Item, text: np.ndarray, low: int, high: int, windows: np.ndarray) -> int | None:
        """Fewest edits of any of the item's kept windows against the text within the diagonals, if within the budget."""
        low, high = low - self.edits, high + self.edits
        band = high - low + 1
        start = item.windows[0][windows]
        length = item.windows[1][windows] - start
        padded = np.concatenate([np.zeros(max(0, -low), np.uint32), text, np.zeros(band + len(item.cp) + 1, np.uint32)])
        offset = max(0, -low)
        steps = int(length.max())
        own = np.append(item.cp, np.full(steps + 1, 1, np.uint32))
        cost = np.zeros((len(start), band), np.int32)
        best = np.full(len(start), 1 << 20, np.int32)
        diagonals = np.arange(band)
        for i in range(steps):
            at = np.clip(start[:, None] + i + low + diagonals[None, :] + offset, 0, len(padded) - 1)
            across = cost + (padded[at] != own[start + i][:, None])
            gap_item = np.concatenate([cost[:, 1:], np.full((len(start), 1), 1 << 20, np.int32)], 1) + 1
            cost = np.minimum(across, gap_item)
            # A gap in the item moves to the right within the row.
            cost = np.minimum.accumulate(cost - diagonals, axis=1) + diagonals
            done = length == i + 1
            best[done] = cost[done].min(axis=1)
            if cost.min() > self.edits:
                break  # costs never fall again
        fewest = int(best.min())
        return fewest if fewest <= self.edits else None

    def search(self, cp: np.ndarray, starts: np.ndarray, words: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item_id, edits, consecutive equal word windows) of verified regions of normalised() texts."""
        out: dict[tuple[int, int], tuple[int, int]] = {}
        grams: dict[int, np.ndarray] = {}
        for t, i, low, high, kept in self.candidates(cp, starts):
            item = self.items[i]
            # Positions count from the space before the first word of a text.
            text = cp[starts[t] : starts[t + 1]]
            if (edits := self.aligned(item, text, low, high, kept)) is None:
                continue
            if t not in grams:
                a, b = np.searchsorted(owner, [t, t + 1])
                grams[t] = word_grams(text, words[a:b] - starts[t], self.min_words)
            windows = int(np.isin(grams[t], item.grams).sum())
            old = out.get((t, item.item_id), (1 << 20, 0))
            out[t, item.item_id] = (min(old[0], edits), max(old[1], windows))
        return [(t, i, e, w) for (t, i), (e, w) in out.items()]


def _folded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """normalised() of one long text, slice by slice: code points and starts of words."""
    parts, words, at, before = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0, 0
    while at < len(text):
        stop = min(len(text), at + WINDOW_CHARS)
        while stop < len(text) and text[stop].isalnum():  # a word is never cut
            stop += 1
        cp, _, starts, _ = normalised([text[at:stop]])
        parts.append(cp)
        words.append(starts + before)
        before += len(cp)
        at = stop
    return np.concatenate(parts), np.concatenate(words)


Piece = tuple[list[int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _pieces(texts: Sequence[str | None], overlap: int) -> Iterator[Piece]:
    """Normalised texts in slices of bounded size. The windows of a very long one overlap by more than the longest passage has, counted in folded characters, so nothing lies across them."""
    owners: list[int] = []
    parts: list[str] = []
    size = 0
    for k, text in enumerate(texts):
        if not text:
            continue
        if len(text) > WINDOW_CHARS:
            cp, words = _folded(text)
            step = max(WINDOW_CHARS, overlap)
            for at in range(0, max(1, len(cp) - overlap), step):
                # A window begins and ends with whole words.
                first, last = np.searchsorted(words, [at, at + step + overlap])
                begin = int(words[first]) - 1 if first < len(words) else len(cp)
                end = int(words[last]) - 1 if last < len(words) else len(cp)
                if begin < end:
                    yield [k], (cp[begin:end], np.array([0, end - begin]), words[first:last] - begin, np.zeros(last - first, np.int64))
            continue
        if size + len(text) > WINDOW_CHARS and parts:
            yield owners, normalised(parts)
            owners, parts, size = [], [], 0
        owners.append(k)
        parts.append(text)
        size += len(text)
    if parts:
        yield owners, normalised(parts)


def _item_pieces(min_words: int):
    """Items as they are, long ones as overlapping pieces of whole words: every passage of ``min_words`` words lies in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, str]] = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(text) <= PIECE_CHARS:
                    out.append((item, text))
                    continue
                cp, words = _folded(text)
                first = 0
                while first < len(words):
                    last = max(int(np.searchsorted(words, words[first] + PIECE_CHARS)), first + min_words)
                    end = int(words[last]) - 1 if last < len(words) else len(cp)
                    out.append((item, cp[words[first] : end].tobytes().decode("utf-32-le", "surrogatepass")))
                    if last >= len(words):
                        break
                    first = last - min_words + 1
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([t for _, t in out], pa.string())], ["i", "t"])

    return run


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", min_words: int = 12, edits: int = 1, q: int = 16) -> DataFrame:
    """(doc_id, item_id, edits, windows): documents with a passage of an item of ``min_words`` words or more.

    Texts are folded to lower-case words with single spaces. Shared q-grams are counted in overlapping bands of
    diagonals; a band that keeps as many as the q-gram lemma demands for ``edits`` edits is aligned within the
    band. ``edits`` is the fewest characters by which a passage differs, ``windows`` the number of the
    document's runs of ``min_words`` words that the item has word for word (0: only with edits).

    Items are held-out tests, collected in blocks of about ITEM_CHARS characters; each block is one pass over the documents, and
    nothing of the documents is shuffled, sampled or cut. Null and empty texts and items of fewer words have no
    passages; very long texts are searched whole, in windows of folded words that overlap by more than an item; repeated rows give equal result rows once; extra columns are ignored.
    """
    rows = items.where(F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).distinct()
    spark = docs.sparkSession
    source = spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.length("text") > 0))
    schema = "doc_id long, item_id long, edits int, windows int"
    rows = written(rows.mapInArrow(_item_pieces(min_words), "i long, t string"), "items")
    blocks = max(1, -(-(rows.agg(F.sum(F.length("t").cast("long"))).first()[0] or 0) // ITEM_CHARS))
    result = None
    for b in range(blocks):
        mine = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        index = spark.sparkContext.broadcast(Items([(r.i, r.t) for r in mine.orderBy("i").collect()], min_words, edits, q))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            block = index.value
            overlap = 2 * (block.longest + edits + 2)
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                found = [(ids[owners[t]], i, e, w) for owners, piece in _pieces(texts, overlap) for t, i, e, w in block.search(*piece)]
                columns = list(zip(*found, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "edits", "windows"])

        part = source.mapInArrow(search, schema)
        result = part if result is None else result.unionByName(part)
    return result.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"), F.max("windows").alias("windows"))


def leaked(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id): documents that repeat at least ``min_words`` consecutive words of an item."""
    return leaks(docs, items, **options).where("windows > 0").select("doc_id", "item_id")
