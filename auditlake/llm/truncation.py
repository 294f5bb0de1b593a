"""Problem 5: values cut off by field limits or in transfer."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.codes import BASES, codepoints, mix, powers
from auditlake.session import spread, written

_U = np.uint64
#: Odds that a value without a final mark is cut, before its end is looked at: descriptions; anchors, which have no marks; short values.
BASE_ODDS, ANCHOR_ODDS, SHORT_ODDS = 0.25, 0.4, 0.1
#: Values below this length are short.
SHORT = 30
#: Odds from which a value counts as cut.
LEAST_ODDS = 1.5
#: A length is a limit if it has so many times the values without a final mark that its neighbours have, and so many standard deviations more.
LIMIT_TIMES, LIMIT_SIGMAS = 2.0, 4.0
#: Lengths to either side that a length is compared with.
NEIGHBOURS = 5
#: A beginning of words that stands as a word less often than this, by occurrence of those words, is none.
STRAY = 0.001
#: A last word that nothing follows anywhere is still a word of its own if it ends so many other values, by occurrence of the words it begins.
OWN_WORD = 0.1

MARKS = ".!?…。！？"
_ELLIPSIS = re.compile(r"(?:\s*(?:…|\.{2,}))+\s*$")
_FINAL = re.compile(r"[.!?。！？][\"'»”’)\]]*$")
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
_OPEN = re.compile(r"[,;:(\[–—&/-]$")


@cache
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points; and a mask of 1 space, 2 mark, 4 digit, 8 slash, 16 upper case."""
    lower = np.arange(0x110000, dtype=np.uint32)
    kind = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isspace():
            kind[c] = 1
        elif ch.isalpha():
            low = ord(ch.lower()[0])
            if low != c:
                lower[c], kind[c] = low, 16
        elif ch.isdigit():
            kind[c] = 4
    for ch in MARKS:
        kind[ord(ch)] |= 2
    kind[ord("/")] |= 8
    return lower, kind


@cache
def _char_hash() -> np.ndarray:
    return mix(_kinds()[0].astype(_U) + _U(1 << 40))


#: Key of the counts of all words.
TOTAL = 0
_START, _NUMBER, _CAPITAL, _LINK = (_U(x) for x in (17, 19, 23, 29))


class Words:
    """The words of a batch of texts: text, id, whether a mark follows; all as arrays."""

    def __init__(self, texts: Sequence[str]) -> None:
        lower, kinds = _kinds()
        cp, starts = codepoints(texts)
        kind = kinds[cp]
        where = np.flatnonzero((kind & 1) == 0)
        if not len(where):
            self.text, self.id, self.prev, self.ends, self.last = (np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, bool), np.zeros(0, bool))
            return
        owner = np.searchsorted(starts, where, "right") - 1
        first = np.append(True, (np.diff(where) > 1) | (np.diff(owner) > 0))
        begin = np.flatnonzero(first)
        end = np.append(begin[1:], len(where))
        k = kind[where]
        at = np.arange(len(where))
        core = np.maximum.reduceat(np.where(k & 2, -1, at), begin)  # last character that is no mark
        self.ends = core < end - 1
        nth = at - np.repeat(begin, end - begin)
        total = np.zeros(len(where) + 1, _U)
        np.cumsum(_char_hash()[cp[where]] * powers(BASES[1], int(nth.max()) + 1)[nth], out=total[1:])
        h = mix(total[np.maximum(core + 1, begin)] - total[begin])
        self.text = owner[begin]
        opens = np.append(True, (self.text[1:] != self.text[:-1]) | self.ends[:-1])
        digit = np.bitwise_or.reduceat(k & 4, begin) > 0
        slash = np.bitwise_or.reduceat(k & 8, begin) > 0
        capital = ((k[begin] & 16) > 0) & ~opens
        h = np.where(capital, _CAPITAL, h)
        h = np.where(digit, _NUMBER, h)
        self.id = np.where(slash, _LINK, h)
        self.prev = np.where(opens, _START, np.append(_START, self.id[:-1]))
        self.last = np.append(self.text[1:] != self.text[:-1], True)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """64-bit keys of each word's pair with the word before, and of the word itself; never TOTAL."""
        return tuple(np.where(k == TOTAL, 1, k) for k in (mix(self.prev * _U(5) + mix(self.id)).view(np.int64), mix(self.id + _U(7)).view(np.int64)))


def _stripped(text: str) -> tuple[str, bool]:
    """A value without outer space and final ellipsis; and whether it had one."""
    text = text.strip()
    short = _ELLIPSIS.sub("", text)
    return short, short != text


def distinct_texts(values: DataFrame) -> DataFrame:
    """(kind, core, forms): each text once, without outer space and final ellipsis, and the forms it was delivered in.

    Copies of a text are no evidence about it, so all statistics are taken over these rows.
    """
    space = r"[\s\x1c-\x1f\x85\p{Z}]"
    core = F.regexp_replace(F.regexp_replace("text", rf"^{space}+|{space}+$", ""), rf"(?:{space}*(?:…|\.{{2,}}))+{space}*$", "")
    return values.select("kind", core.alias("core"), "text").groupBy("kind", "core").agg(F.collect_set("text").alias("forms"))


def end_counts(texts: DataFrame) -> DataFrame:
    """(key, n0, ends0, n1, ends1): occurrences of each word pair and word, and those that end a sentence or value, of either kind (0, 1); key TOTAL has all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for kind in (0, 1):
                words = Words([raw[i] for i in np.flatnonzero(kinds == kind).tolist()])
                closes = words.ends | words.last
                for keys in (*words.keys(), np.full(len(words.id), TOTAL, np.int64)):
                    if len(keys):
                        key, at, n = np.unique(keys, return_inverse=True, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), kind, np.int32)), pa.array(n.astype(np.int64)), pa.array(np.bincount(at, closes).astype(np.int64))], ["key", "kind", "n", "ends"])

    of = lambda c, kind: F.sum(F.when(F.col("kind") == kind, F.col(c)).otherwise(0)).alias(f"{c}{kind}")
    return texts.select("kind", "text").mapInArrow(count, "key long, kind int, n long, ends long").groupBy("key").agg(of("n", 0), of("ends", 0), of("n", 1), of("ends", 1))


def limit_odds(values: DataFrame) -> DataFrame:
    """(kind, n, limit) of lengths that are field limits, with the odds that a value of that length without a final mark was cut there.

    A limit has far more values without a final mark than the lengths around it (their median): by a factor, and by
    more than chance gives. Values of one word don't count: names have favourite lengths. Every length is judged, by one rule; nothing is collected.
    """
    open_ended = values.where(~F.rtrim("text").rlike(r"[.!?。！？][\"'»”’)\]]*$") & F.trim("text").rlike(r"\s")).groupBy("kind", F.length("text").alias("n")).agg(F.count(F.lit(1)).alias("c"))
    shift = F.explode(F.array(*[F.lit(d) for d in range(-NEIGHBOURS, NEIGHBOURS + 1)]))
    near = open_ended.select("kind", "n", "c", shift.alias("d")).groupBy("kind", (F.col("n") + F.col("d")).alias("n")).agg(
        F.max(F.when(F.col("d") == 0, F.col("c"))).alias("c"), F.collect_list(F.when(F.col("d") != 0, F.col("c"))).alias("around")
    )
    padded = F.array_sort(F.concat("around", F.array_repeat(F.lit(0).cast("long"), 2 * NEIGHBOURS - F.size("around"))))
    usual = (F.get(padded, F.lit(NEIGHBOURS - 1)) + F.get(padded, F.lit(NEIGHBOURS))) / 2
    more = F.col("c") - F.col("usual")
    peaks = near.where("c is not null").select("kind", "n", "c", usual.alias("usual")).where((F.col("c") >= LIMIT_TIMES * F.col("usual")) & (more >= LIMIT_SIGMAS * F.sqrt(F.col("usual") + 1)))
    return peaks.select("kind", "n", F.greatest(F.lit(BASE_ODDS), F.least(F.lit(20.0), more / F.greatest("usual", F.lit(1.0)))).alias("limit"))


def trie_lookup(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, n, whole, longer): of each token, the occurrences of the word that it is, and of the words that it properly begins.

    The vocabulary (word, n) is a trie laid out as its nodes: a node is a beginning of words with the occurrences
    below it. Only nodes at depths that tokens of the same first letter have are built, each by a sum that is
    combined before the shuffle, so no branch of the trie is gathered in one place. Letter case counts.
    """
    depths = tokens.groupBy(F.substring("token", 1, 1).alias("head")).agg(F.collect_set(F.length("token")).alias("depths"))
    words = vocabulary.withColumn("head", F.substring("word", 1, 1)).join(depths, "head")
    nodes = words.select(F.explode(F.filter("depths", lambda d: d <= F.length("word"))).alias("depth"), "word", "n").select(F.substring("word", F.lit(1), F.col("depth")).alias("token"), (F.length("word") == F.col("depth")).alias("whole"), F.col("n").alias("below"))
    nodes = nodes.groupBy("token").agg(*[F.sum(F.when(F.col("whole") == is_word, F.col("below")).otherwise(0)).alias(c) for c, is_word in (("words", True), ("longer", False))])
    return tokens.join(nodes, "token", "left").select("token", "n", F.coalesce("words", F.lit(0)).cast("long").alias("whole"), F.coalesce("longer", F.lit(0)).cast("long").alias("longer"))


def _values(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, record_id, item_no, text, source) of meta descriptions (kind 0) and anchors (kind 1)."""
    first = pages.select(F.lit(0).alias("kind"), F.col("webpage_id").cast("long").alias("record_id"), F.lit(0).alias("item_no"), F.col("meta_description").alias("text"), F.col("source").cast("string").alias("source"))
    second = links.select(F.col("summary_id").cast("long").alias("record_id"), F.col("source").cast("string").alias("source"), F.posexplode("top_anchors_by_backlinks").alias("item_no", "a")).select(
        F.lit(1).alias("kind"), "record_id", "item_no", F.col("a.anchor").alias("text"), "source"
    )
    return spread(first).unionByName(spread(second)).where(F.length(F.trim("text")) > 0)


#: A word between spaces and marks that another word or a final mark follows.
_SPOKEN = r"(?<!\S)[^\p{L}\p{N}\s]*(\p{L}+(?:[’'-]\p{L}+)*)(?=[^\p{L}\p{N}\s]*(?:\s+\S|[.!?。！？][\"'»”’)\]]*$))"
_ENDS = "kind int, core binary, digest binary, length int, core_length int, pair long, word long, alone boolean, token string, small boolean, open_mark boolean"


def _last_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The end of each text without a final mark: keys of its last word, and what it looks like."""
    names = [c.split()[0] for c in _ENDS.split(", ")]
    for batch in batches:
        rows: list[int] = []
        texts: list[str] = []
        raw = batch.column(2).to_pylist()
        for i, value in enumerate(raw):
            text, dotted = _stripped(value)
            if text and (dotted or not _FINAL.search(text)):
                rows.append(i)
                texts.append(text)
        words = Words(texts)
        at = np.flatnonzero(words.last)
        if not len(at):
            continue
        pair, word = words.keys()
        alone = np.append(True, words.text[1:] != words.text[:-1])[at]
        look: tuple[list, ...] = ([], [], [], [], [])
        for text_at in words.text[at].tolist():
            text = texts[text_at]
            tail = text.rsplit(None, 1)[-1]
            token = _EDGE.sub("", tail)
            plain = token.isalpha() or (token.replace("’", "").replace("'", "").replace("-", "").isalpha() and bool(token))
            parts = (len(raw[rows[text_at]]), len(text), token if plain else None, bool(token[:1].islower()), bool(_OPEN.search(text)) and not tail.startswith(("http", "www")))
            for column, part in zip(look, parts, strict=True):
                column.append(part)
        index = pa.array([rows[t] for t in words.text[at].tolist()])
        length, core_length, token, small, open_mark = look
        columns = [batch.column(0).take(index), batch.column(1).take(index), batch.column(3).take(index), pa.array(length, pa.int32()), pa.array(core_length, pa.int32()), pa.array(pair[at]), pa.array(word[at])]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(alone), pa.array(token, pa.string()), pa.array(small), pa.array(open_mark)], names)


def cut_values(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(table_name, record_id, item_no, source, odds) of values that end in a broken word or an unfinished phrase.

    Final marks aside from an ellipsis make a value whole. Of the others the odds of a cut are those of its length
    (higher at field limits, which show as lengths with far more open ends than their neighbours) times how much rarer
    its last word, after the word before it, ends sentences and values in the corpus than words do in general. A
    last word that the corpus doesn't know but that begins a known word is broken off. Statistics cover all values,
    copies of a text once, and verdicts on distinct texts are joined back to all rows;
    pairs, words and the vocabulary stay distributed. Null, empty and blank
    values are none, very long values count whole, repeated rows each count, empty tables give no rows.
    """
    values = _values(pages, links)
    texts = written(distinct_texts(values), "texts")  # it is asked four times
    cores = texts.select("kind", F.col("core").alias("text")).where("text <> ''")
    forms = texts.select("kind", F.unhex(F.md5("core")).alias("core"), F.explode("forms").alias("text"))
    ends = written(forms.withColumn("digest", F.unhex(F.md5("text"))).mapInArrow(_last_words, _ENDS), "ends")
    asked = ends.select(F.explode(F.array("pair", "word", F.lit(TOTAL).cast("long"))).alias("key")).distinct()
    counts = written(end_counts(cores).join(asked, "key", "left_semi"), "counts")
    every = counts.where(F.col("key") == TOTAL).first() or {"n0": 0, "ends0": 0, "n1": 0, "ends1": 0}
    overall = F.when(F.col("kind") == 0, (every["ends0"] + 1) / (every["n0"] + 12)).otherwise((every["ends1"] + 1) / (every["n1"] + 12))
    of_pairs = counts.select(F.col("key").alias("pair"), *[F.col(c).alias(f"p{c}") for c in ("n0", "ends0", "n1", "ends1")])
    of_words = counts.select(F.col("key").alias("word"), *[F.col(c).alias(f"w{c}") for c in ("n0", "ends0", "n1", "ends1")])
    # A value's own end says nothing about itself, so it is left out of the counts. Anchors are short and few, so
    # their single words are judged by their use in descriptions as well.
    others = lambda c: F.greatest(c - 1, F.lit(0)).cast("double")
    of = lambda p, c: F.when(F.col("kind") == 0, F.col(f"{p}{c}0")).otherwise(F.col(f"{p}{c}1") + (F.col(f"{p}{c}0") if p == "w" else F.lit(0)))
    word_rate = (others(of("w", "ends")) + 8 * overall) / (others(of("w", "n")) + 8)
    rate = (others(of("p", "ends")) + 4 * word_rate) / (others(of("p", "n")) + 4)
    odds = overall / F.greatest(rate, F.lit(1e-6))
    limits = limit_odds(forms)
    whole, short = (limits.select("kind", F.col("n").alias(c), F.col("limit").alias(f"{c}_limit")) for c in ("length", "core_length"))
    usual = F.when(F.col("core_length") < SHORT, SHORT_ODDS).when(F.col("kind") == 0, BASE_ODDS).otherwise(ANCHOR_ODDS)
    # A value of one word has begun no phrase that it could leave unfinished; names are often anchors by themselves.
    odds = F.when(F.col("alone"), F.least(odds, F.lit(1.0)) * usual).otherwise(odds * F.coalesce("length_limit", "core_length_limit", usual))
    scored = ends.join(of_pairs, "pair").join(of_words, "word").join(whole, ["kind", "length"], "left").join(short, ["kind", "core_length"], "left")
    scored = scored.select("kind", "core", "digest", "token", "small", "open_mark", odds.alias("odds"))
    tokens = ends.where("token is not null").select("kind", "core", "token").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    # Words of the vocabulary stand before another word or a final mark; last words without one are what is in question.
    spoken = cores.select(F.explode(F.regexp_extract_all("text", F.lit(_SPOKEN))).alias("word"))
    vocabulary = spoken.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    judged = scored.join(trie_lookup(tokens, vocabulary), "token", "left")
    # In a large corpus every beginning stands somewhere as a word, so what counts is how seldom it does; one stray occurrence is none.
    unknown = (F.col("whole") - 1 <= F.col("longer") * STRAY) & (F.col("n") - 1 <= F.col("longer") * OWN_WORD)
    broken = F.coalesce((F.col("longer") > 0) & unknown, F.lit(False))
    strength = F.when(broken & F.col("small"), 1e6).when(broken, 3.0).otherwise(1.0)
    odds = F.when(F.col("open_mark"), F.greatest("odds", F.lit(2.0))).otherwise(F.col("odds") * strength)
    cut = judged.withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS).select("kind", "digest", "odds")
    rows = values.withColumn("digest", F.unhex(F.md5("text"))).drop("text")
    return rows.join(cut, ["kind", "digest"]).select(F.when(F.col("kind") == 0, "webpages").otherwise("backlink_summaries").alias("table_name"), "record_id", "item_no", "source", "odds")


def cut_rates(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(table_name, source, total, cut, rate) of values that aren't blank."""
    name = F.when(F.col("kind") == 0, "webpages").otherwise("backlink_summaries").alias("table_name")
    total = _values(pages, links).groupBy(name, "source").agg(F.count(F.lit(1)).alias("total"))
    cut = cut_values(pages, links).groupBy(F.col("table_name").alias("t"), F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("cut"))
    return total.join(cut, (F.col("table_name") == F.col("t")) & F.col("source").eqNullSafe(F.col("s")), "left").select("table_name", "source", "total", F.coalesce("cut", F.lit(0)).alias("cut"), F.round(F.coalesce("cut", F.lit(0)) / F.col("total"), 6).alias("rate"))
