"""Problem 2: text decoded with a wrong encoding."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Sequence
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.codes import codepoints
from auditlake.session import spread

#: Classes of characters; pairs of them index a table of fixed size, whatever the corpus.
CLASSES = 1024
#: A pair adds to a run if its part of the corpus's mutual information (bits times share of pairs) is below this.
ORDINARY = 1e-4
#: Bits a pair adds or takes at most.
CLIP = 3.0
#: Bits that a repair between one-byte encodings must gain, by changed character and in all.
GAIN_EACH, GAIN_ALL = 2.5, 8.0
#: Bits that each valid UTF-8 sequence counts for a repair, as such sequences hardly ever arise by chance.
VALID = 6.0
#: Bits that a text's runs must reach before it is tested for one one-byte encoding read as another.
DOUBT = 12.0

#: Encodings that text is read with by mistake.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1254", "mac_roman", "cp437", "cp850", "cp866", "koi8-r", "iso8859-2", "iso8859-15", "cp1253", "cp1257", "mac_cyrillic")
#: Fixed values: (read as, in truth) of confusions between one-byte encodings.
CONFUSED = (
    ("cp1252", "cp1251"), ("latin-1", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1252", "koi8-r"),
    ("cp1252", "cp1250"), ("cp1252", "iso8859-2"), ("latin-1", "iso8859-2"), ("iso8859-2", "cp1250"), ("cp1250", "iso8859-2"), ("cp1250", "cp1252"), ("cp1251", "cp1252"), ("cp1251", "cp1250"),
    ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1252", "cp852"), ("cp1252", "cp866"),
    ("mac_roman", "cp1250"), ("mac_roman", "cp1251"), ("cp437", "cp1251"), ("cp1254", "cp1252"), ("cp1253", "cp1252"), ("mac_cyrillic", "cp1251"), ("cp1251", "mac_cyrillic"),
)
#: Encodings of two bytes a character that UTF-8 is read with.
WIDE = ("gbk", "big5", "shift_jis", "euc_kr")

#: Signs that clean texts of any language use.
SIGNS = "–—’‘“”„…«»¿¡™®©°½€→✓≥"

#: Share of a text's letters that accents of Latin reach in no language; and characters in a row that do so by themselves.
FOREIGN_SHARE, FOREIGN_ROW = 0.75, 5

_RUN = re.compile(r"[^\x00-\x7f]+")
_HARD = re.compile("[\x80-\x9f�]")
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xe0[\xa0-\xbf][\x80-\xbf]|[\xf0-\xf4][\x80-\xbf]{3}")
#: Characters that clean texts are expected to hold; and controls, which stand halfway in text that was decoded wrongly twice.
_EXPECTED = re.compile(rf"[{SIGNS}\x80-\u017f\u0192\u02c6\u02dc\u0218-\u021b\u0386-\u03ce\u0401\u0404\u0406\u0407\u0410-\u044f\u0451\u0454\u0456\u0457\u0490\u0491\u2010-\u2026\u2030\u2039\u203a\u20a0-\u20bf\u2116\u2190-\u21ff\u2200-\u22ff\u2600-\u27bf\u3000-\u30ff\u4e00-\u9fff\uac00-\ud7a3\ufe0f\ufeff\U0001f300-\U0001faff]+")
_PLAIN_WORD = re.compile(r"[А-ЯЁ]?[а-яё]+")
#: Signs that may follow a capital in clean text.
_AFTER_CAPITAL = "»”’›…–—\xa0·©®™°"


def _natural(chars: str, before: str, after: str) -> bool:
    """Whether a sequence that could be UTF-8 reads as a piece of clean text: letters of one script and case, or a capital and a sign."""
    first = chars[0]
    if chars.isalpha():
        if len({(c > "\u024f") + (c > "\u03ff") for c in chars}) > 1:
            return False
        if first > "\u03ff":
            return True  # letters of Cyrillic alone could be words in any case
        return chars.islower() or (chars.isupper() and not before.islower()) or (first.isupper() and chars[1:].islower() and not before.isalpha())
    if len(chars) == 2 and first.isupper() and chars[1] in _AFTER_CAPITAL and not after.isalpha():
        return before.isupper() or (first > "\u036f" and not before.islower())
    return False


@lru_cache(1 << 17)
def utf8_shaped(run: str, before: str, after: str) -> str | None:
    """The run read again as UTF-8, if all of it is such sequences of expected characters and clean text has none such.

    This asks nothing of the corpus, so it doesn't matter how often a garbling occurs.
    """
    if len(run) < 2 or _PLAIN_WORD.fullmatch(run):
        return None
    for codec in READ_AS:
        table = _to_bytes(codec)
        raw = bytes(b for b in map(table.get, run) if b is not None)
        if len(raw) < len(run):
            continue
        found = list(_UTF8.finditer(raw))
        if sum(len(m.group()) for m in found) < len(raw):
            continue
        text = raw.decode("utf-8", "replace")
        if not _EXPECTED.fullmatch(text):
            continue
        if len(found) == 1 and (_natural(run, before, after) or "\u0400" <= text <= "\u04ff"):
            continue
        if len(found) > 1 and all(_natural(run[m.start() : m.end()], run[m.start() - 1 : m.start()] or before, run[m.end() : m.end() + 1] or after) for m in found):
            continue
        return text
    return None


def _foreign(text: str) -> list[tuple[int, int]]:
    """Stretches that are another alphabet read as accents and symbols: long ones, or all where they are most of the text."""
    odd = _ODD.findall(text)
    if _TURNED.search(text):
        return [m.span() for m in _CYRILLIC.finditer(text)]
    if _MIXED.search(text):
        return [m.span() for m in _MIXED_WORD.finditer(text)]
    if len(odd) < FOREIGN_ROW:
        return []
    if len(odd) > FOREIGN_SHARE * (sum(c.isalpha() for c in text) or 1):
        return [m.span() for m in _RUN.finditer(text)]
    return [m.span() for m in _ODD_WORD.finditer(text)] if _ODD_ROW.search(text) else []


_ODD = re.compile(rf"(?![{SIGNS}])[\xa0-\u02ff\u2000-\u25ff]")
_ODD_ROW = re.compile(rf"(?:(?![{SIGNS}])[\xa0-\u02ff\u2000-\u25ff]){{{FOREIGN_ROW},}}")
#: Words of such characters only; Cyrillic words whose case is turned over, as one of its encodings read as another gives it.
_ODD_WORD = re.compile(rf"(?<![^\W\d_])(?:(?![{SIGNS}])[\xa0-\u02ff\u2000-\u25ff])+(?![^\W\d_])")
_TURNED = re.compile(r"(?<!\w)[а-яё][А-ЯЁ]{2,}(?!\w)")
_CYRILLIC = re.compile(r"[\u0400-\u04ff]+")
#: Cyrillic letters beside lines, blocks and signs that no word has, or capitals of few words after a small letter: one Cyrillic encoding read as another.
_MIXED = re.compile(r"[\u0400-\u04ff][€ƒ≈∆\u2219√\u2500-\u259f]|[ƒ≈∆\u2219√\u2500-\u259f][\u0400-\u04ff]|(?<!\d)(?<!\d[ \xa0])€[\u0400-\u04ff]|[а-яё][ЁЄЇЎ]")
_MIXED_SIGNS = [ord(c) for c in "°€·№¤"]
_MIXED_WORD = re.compile(r"[\u0400-\u04ff€ƒ≈∆\u2219√\u2500-\u259f]+")


def suspects(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Stretches that are garbled by their shape alone: lost or read as UTF-8 ought not to be; and of another alphabet."""
    hard = []
    for m in _RUN.finditer(text):
        a, b = m.span()
        if _HARD.search(m.group()) or utf8_shaped(m.group(), text[max(0, a - 1) : a], text[b : b + 1]):
            hard.append((a, b))
    return hard, _foreign(text)


@cache
def class_table() -> np.ndarray:
    """Class of each code point: letters to U+024F and Greek and Cyrillic each their own, the rest by block."""
    table = np.full(0x110000, 1023)
    # Blocks of other scripts and signs: (first, class) in ascending order.
    for first, number in ((0x250, 992), (0x300, 993), (0x500, 994), (0x2000, 995), (0x2010, 996), (0x2016, 997), (0x201E, 998), (0x2027, 999), (0x20A0, 1000), (0x2100, 1001), (0x2200, 1002), (0x2300, 1003), (0x2500, 1004), (0x2600, 1005), (0x2700, 1006), (0x2800, 1007), (0x3000, 1008), (0x4E00, 1009), (0xA000, 1010), (0xE000, 1011), (0xF900, 1012), (0xFF00, 1013), (0xFFF0, 1014), (0x10000, 1015)):
        table[first:] = number
    table[:592] = np.arange(592)
    table[0x370:0x500] = 592 + np.arange(0x500 - 0x370)
    return table.astype(np.int32)


@cache
def _to_bytes(codec: str) -> dict[str, int]:
    """Character to byte; bytes without a character stand for the control of the same number, as lenient readers do."""
    table = {}
    for b in range(256):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            table.setdefault(chr(b), b)
    return table


@cache
def _from_byte(codec: str) -> list[str | None]:
    out: list[str | None] = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(None)
    return out


class PairModel:
    """Mutual information and likelihood of adjacent characters in the corpus."""

    def __init__(self, counts: np.ndarray) -> None:
        n = counts.reshape(CLASSES, CLASSES).astype(np.float64)
        total = max(1.0, n.sum())
        left, right = n.sum(1), n.sum(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            pmi = np.log2(n * total / (left[:, None] * right[None, :]))
        information = n / total * np.where(np.isfinite(pmi), np.maximum(pmi, 0.05), 0.0)
        self.run_score = np.clip(np.log2(ORDINARY / np.maximum(information, 1e-12)), -CLIP, CLIP).astype(np.float32).ravel()
        share = (right + 0.5) / (total + 0.5 * CLASSES)
        self.log_next = np.log2((n + 50 * share[None, :]) / (left[:, None] + 50)).astype(np.float32).ravel()
        self.known = np.maximum(left, right) >= max(2.0, total * 2e-7)
        self._seen: dict[tuple[str, str, str], str | None] = {}

    def likelihood(self, text: str) -> float:
        c = class_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        return float(self.log_next[c[:-1] * CLASSES + c[1:]].sum())

    def runs(self, texts: Sequence[str | None]) -> list[tuple[int, int, int, float]]:
        """(text, begin, end, score) of maximum-scoring runs of improbable pairs.

        A running sum of pair scores that starts anew at 0 leaves 0 where a run begins and is highest where it ends.
        """
        cp, starts = codepoints(texts)
        if len(cp) < 2:
            return []
        c = class_table()[cp]
        score = self.run_score[c[:-1] * CLASSES + c[1:]].astype(np.float64)
        score[(cp[:-1] < 128) & (cp[1:] < 128)] = -CLIP  # pairs of plain ASCII never lie
        edges = starts[1:-1]
        score[edges[(edges > 0) & (edges < len(cp))] - 1] = -1e6  # no run crosses texts
        total = np.cumsum(score)
        level = total - np.minimum(np.minimum.accumulate(total), 0)
        up = level > 1e-9
        change = np.flatnonzero(np.diff(np.concatenate([[False], up, [False]]).astype(np.int8)))
        out = []
        for a, b in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
            end = a + int(np.argmax(level[a:b]))
            text = int(np.searchsorted(starts, a, "right")) - 1
            out.append((text, a - int(starts[text]), end + 2 - int(starts[text]), float(level[end])))
        return out

    def _utf8(self, run: str, before: str, after: str) -> str | None:
        """The run read again as UTF-8, if an encoding makes it (or most of it) that."""
        for codec in READ_AS:
            table = _to_bytes(codec)
            raw = bytearray()
            for ch in run:
                b = table.get(ch)
                if b is None:
                    raw = bytearray()
                    break
                raw.append(b)
            if len(raw) < 2:
                continue
            covered = sum(len(m.group()) for m in _UTF8.finditer(raw))
            high = sum(b > 127 for b in raw)
            if not covered or covered < 0.6 * high:
                continue
            fixed, at = [], 0
            for m in _UTF8.finditer(raw):
                fixed.append(run[at : m.start()] + m.group().decode("utf-8", "replace"))
                at = m.end()
            text = "".join(fixed) + run[at:]
            c = class_table()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
            if self.known[c].all() and self.likelihood(before + text + after) + VALID * int(((c < 992) | ((c > 994) & (c < 1009))).any()) * len(_UTF8.findall(raw)) > self.likelihood(before + run + after):
                return text
        for codec in WIDE:
            try:
                text = run.encode(codec).decode("utf-8")
            except UnicodeError:
                continue
            if text != run and self.likelihood(before + text + after) + VALID * len(run) > self.likelihood(before + run + after):
                return text
        return None

    def repaired(self, run: str, before: str, after: str) -> str | None:
        """The run as it was, '' if it can't be restored, or None if it is in order."""
        key = (before[-1:], run, after[:1])
        if key in self._seen:
            return self._seen[key]
        text = self._utf8(run, before[-1:], after[:1]) or utf8_shaped(run, before[-1:], after[:1])
        if text is None and _HARD.search(run):
            text = ""
        if len(self._seen) < 1 << 17:
            self._seen[key] = text
        return text

    def confused(self, text: str, spans: Sequence[tuple[int, int]], mixed: bool = False) -> str | None:
        """The text with the runs read in another one-byte encoding, if that is much likelier; in ``mixed`` ones signs beside Cyrillic letters are letters."""
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.zeros(len(cp), bool)
        for a, b in spans:
            inside[a:b] = True
        signs = _signs()[np.minimum(cp, 0x2FFF)]
        if mixed:
            letter = np.concatenate([[False], (cp >= 0x400) & (cp < 0x500), [False]])
            signs &= ~(np.isin(cp, _MIXED_SIGNS) & (letter[:-2] | letter[2:]))
        at = np.flatnonzero(inside & (cp > 127) & ~signs)
        if len(at) < 2 or cp[at].max() >= 0x2600:
            return None
        c = class_table()[cp]
        edge = np.unique(np.concatenate([at - 1, at]))
        edge = edge[(edge >= 0) & (edge < len(cp) - 1)]
        now = float(self.log_next[c[edge] * CLASSES + c[edge + 1]].sum())
        best, found = 0.0, None
        for table in _confusions():
            new = table[cp[at]]
            if not new.all():
                continue  # a character that this confusion doesn't give
            n = int((new != cp[at]).sum())
            if not n:
                continue
            d = c.copy()
            d[at] = class_table()[new]
            gain = float(self.log_next[d[edge] * CLASSES + d[edge + 1]].sum()) - now
            if gain > max(best, GAIN_ALL, GAIN_EACH * n):
                best = gain
                fixed = cp.copy()
                fixed[at] = new
                found = fixed.tobytes().decode("utf-32-le", "surrogatepass")
        return found

    def examine(self, texts: Sequence[str | None]) -> Iterator[tuple[int, str | None]]:
        """(text, restored) of the texts that were decoded wrongly; restored is None where the whole can't be had."""
        spans: dict[int, list[tuple[int, int, float]]] = {}
        for t, a, b, peak in self.runs(texts):
            spans.setdefault(t, []).append((a, b, peak))
        for t, text in enumerate(texts):
            if text and not text.isascii():
                hard, foreign = suspects(text)
                # What is garbled by its shape opens a run, however ordinary its pairs are in this corpus.
                if hard or foreign:
                    spans[t] = sorted([*spans.get(t, []), *[(a, b, 0.0) for a, b in hard], *[(a, b, DOUBT) for a, b in foreign]])
        for t, found in sorted(spans.items()):
            text = texts[t]
            assert text is not None
            out, at, bad, lost, k, left = [], 0, False, False, 0, []
            # Inverse mappings are tried inside the runs only, on stretches that aren't ASCII.
            for m in _RUN.finditer(text):
                a, b = m.span()
                while k < len(found) and found[k][1] <= a:
                    k += 1
                if k == len(found):
                    break
                if found[k][0] >= b:
                    continue
                fixed = self.repaired(m.group(), text[max(0, a - 1) : a], text[b : b + 1])
                if fixed is None:
                    left.append((a, b))
                    continue
                bad = True
                if fixed == "":
                    lost = True
                    continue
                out.append(text[at:a] + fixed)
                at = b
            if bad:
                whole = "".join(out) + text[at:]
                for _ in range(2):  # decoded wrongly twice or three times
                    again = [(m, self.repaired(m.group(), whole[max(0, m.start() - 1) : m.start()], whole[m.end() : m.end() + 1])) for m in _RUN.finditer(whole)]
                    again = [(m, f) for m, f in again if f]
                    if not again:
                        break
                    for m, f in reversed(again):
                        whole = whole[: m.start()] + f + whole[m.end() :]
                yield t, None if lost or _HARD.search(whole) else whole
            elif left and sum(peak for _, _, peak in found) >= DOUBT:
                mixed = bool(_MIXED.search(text))
                whole = self.confused(text, left, mixed)
                if whole is not None or mixed:  # what no clean text has is garbled, whether or not it can be restored
                    yield t, whole


@cache
def _signs() -> np.ndarray:
    """Typographic signs that clean texts of any language use."""
    table = np.zeros(0x3000, bool)
    table[[ord(c) for c in SIGNS]] = True
    return table


@cache
def _confusions() -> list[np.ndarray]:
    """Of each confusion: the true code point of each code point, 0 where there is none."""
    tables = []
    for codec, truth in CONFUSED:
        table = np.zeros(0x2600, np.uint32)
        back = _from_byte(truth)
        for ch, b in _to_bytes(codec).items():
            true = back[b]
            if ord(ch) < 0x2600 and true is not None and (true.isalpha() or true == ch or true in SIGNS):
                table[ord(ch)] = ord(true)
        tables.append(table)
    return tables


def pair_counts(pages: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Adjacent pairs of character classes over all values of the columns; the driver gets CLASSES^2 numbers at most.

    Pairs in and beside stretches that are garbled by their shape are left out, so the counts are those of clean text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for k in range(batch.num_columns):
                texts = batch.column(k).to_pylist()
                cp, starts = codepoints(texts)
                if len(cp) < 2:
                    continue
                c = class_table()[cp]
                pair = c[:-1] * CLASSES + c[1:]
                keep = np.ones(len(pair), bool)
                keep[starts[1:-1][(starts[1:-1] > 0) & (starts[1:-1] < len(cp))] - 1] = False
                for t, text in enumerate(texts):
                    if text and not text.isascii():
                        for a, b in itertools.chain(*suspects(text)):
                            keep[max(0, int(starts[t]) + a - 1) : int(starts[t]) + b] = False
                total += np.bincount(pair[keep], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["pair", "n"])

    rows = pages.select(*[F.col(c).cast("string") for c in columns]).mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(CLASSES * CLASSES, np.int64)
    counts[rows["pair"].to_numpy(np.int64)] = rows["n"].to_numpy()
    return counts


def garbled(pages: DataFrame, columns: Sequence[str] = ("title", "meta_description"), id_col: str = "webpage_id") -> DataFrame:
    """(id, field, original, restored) of every value that was decoded with a wrong encoding, wholly or in a stretch.

    Adjacent pairs of characters are scored by their part of the corpus's mutual information; maximum-scoring runs
    of improbable pairs are isolated, lost characters and stretches garbled by their shape (UTF-8 read as characters
    that clean text has in no such order, another alphabet read as accents) open a run at any frequency, and inverse mappings (UTF-8 read as some encoding, or one encoding read as
    another) are tried inside those runs only, judged by the same pair statistics. ``restored`` is null where
    characters were lost (replacement characters) or the run can't be mapped back. Null and empty values are
    none, very long values are handled whole, repeated rows each count, an empty table gives no rows, other
    columns are ignored. Counting and testing are each one pass without a shuffle of rows.
    """
    source = spread(pages.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("string").alias(c) for c in columns]))
    counts = source.sparkSession.sparkContext.broadcast(pair_counts(source, columns).astype(np.float32))
    names = list(columns)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PairModel(counts.value)
        for batch in batches:
            ids = batch.column(0)
            for k, name in enumerate(names):
                values = batch.column(k + 1)
                texts = values.to_pylist()
                at = [i for i, t in enumerate(texts) if t and not t.isascii()]
                some = [texts[i] for i in at]
                found = list(model.examine(some)) if some else []
                if found:
                    rows = [at[t] for t, _ in found]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array([name] * len(rows)), pa.array([some[t] for t, _ in found], pa.string()), pa.array([f for _, f in found], pa.string())], ["id", "field", "original", "restored"])

    return source.mapInArrow(test, "id long, field string, original string, restored string").withColumnRenamed("id", id_col)
