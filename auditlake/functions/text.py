"""Text expressions: words, readability, grammar patterns, content quality."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from auditlake.functions.rounding import clamp, when

WORD = r"[\p{L}\p{N}_]+"

#: Patterns of grammar errors in the order in which they are tried (case is ignored).
GRAMMAR = (
    r"\b(your)\s+(going|coming|doing)\b",
    r"\b(there)\s+(going|coming|doing)\b",
    r"\b(its)\s+a\b",
    r"\b(could|should|would)\s+of\b",
    r"\.\s*[a-z]",
    r"\bthen\b(?=\s+[a-zA-Z]+er\b)",
    r"\baffect\b(?=\s+on\b)",
    r"\bloose\b(?=\s+(weight|money|game)\b)",
    r"\bi\s",
    r"\s{2,}",
    r"[.!?]{2,}",
)
GRAMMAR_LIMIT = 50


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(F.lower(text), F.lit(WORD)), F.lit(0))


def readability(text: Column) -> Column:
    """Reading ease from words, sentence marks and groups of vowels, within 0 and 100; 50 for texts without words."""
    words = word_count(text)
    sentences = F.greatest(F.regexp_count(text, F.lit(r"[.!?]+")), F.lit(1))
    syllables = F.greatest(F.regexp_count(F.lower(text), F.lit("[aeiouy]+")), F.lit(1))
    ease = F.lit(206.835) - F.lit(1.015) * (words / sentences) - F.lit(84.6) * F.try_divide(syllables, words)
    return F.when(words > 0, clamp(ease, 0.0, 100.0)).otherwise(F.lit(50.0))


def grammar_counts(text: Column) -> Column:
    """Matches of each pattern, as an array."""
    return F.array(*[F.coalesce(F.regexp_count(text, F.lit("(?i)" + p)), F.lit(0)) for p in GRAMMAR])


def soft_limit(counts: Column, limit: int = GRAMMAR_LIMIT) -> Column:
    """The number of matches that are kept: full patterns until the limit is met, then one of each later pattern."""
    return F.aggregate(counts, F.lit(0), lambda kept, c: kept + F.when(kept < limit, F.least(c, F.lit(limit) - kept)).otherwise(F.least(c, F.lit(1))))


#: What is meant instead, and why, by pattern.
GRAMMAR_MEANT = (
    ("you're", "Contraction needed"),
    ("they're", "Contraction needed"),
    ("it's a", "Contraction needed"),
    ("could/should/would have", "Incorrect preposition"),
    (". [Capital]", "Sentence should start with capital"),
    ("than", "Comparison word needed"),
    ("effect", "Noun needed"),
    ("lose", "Verb needed"),
    ("I ", "Capital I needed"),
    (" ", "Extra spaces"),
    (".", "Multiple punctuation"),
)
GRAMMAR_CONTEXT = 50


def grammar_matches(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pattern, position, match, context, suggestion, description) of the errors that soft_limit() keeps; position counts characters from 0."""
    kind = dict(texts.dtypes)[key]
    patterns = [re.compile(p, re.IGNORECASE | re.ASCII) for p in GRAMMAR]
    names = [key, "pattern", "position", "match", "context", "suggestion", "description"]

    def kept(content: str) -> Iterator[tuple]:
        found = 0
        for number, pattern in enumerate(patterns):
            for m in pattern.finditer(content):
                yield number, m.start(), m.group(), content[max(0, m.start() - GRAMMAR_CONTEXT) : m.end() + GRAMMAR_CONTEXT].strip(), *GRAMMAR_MEANT[number]
                found += 1
                if found >= GRAMMAR_LIMIT:
                    break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *r) for i, content in enumerate(batch.column(1).to_pylist()) for r in kept(content or "")]
            index, *columns = zip(*rows, strict=True) if rows else [()] * 7
            kinds = (pa.int32(), pa.int64(), *[pa.string()] * 4)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names)

    return texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, pattern int, position long, match string, context string, suggestion string, description string")


_RUN = re.compile(r"\w+")


def has_low_density(text: str | None) -> bool:
    """Whether one of the ten most frequent words (earlier ones first among ties) is longer than three letters and makes up over 5 %; true for short texts."""
    if text is None or len(text) < 100:
        return True
    words = _RUN.findall(text.lower())
    if len(words) < 50:
        return True
    return any(len(w) > 3 and n * 100.0 / len(words) > 5 for w, n in Counter(words).most_common(10))


@F.arrow_udf(BooleanType())
def low_density(text: pa.Array) -> pa.Array:
    """has_low_density() of a column: a ranking within the row, which would take a shuffle of all words as expressions."""
    return pa.array([has_low_density(t) for t in text.to_pylist()], pa.bool_())


def content_score(words: Column, low_density: Column, ease: Column) -> Column:
    return clamp(F.lit(10.0) - when(words < 300, 5) - when(ease < 30, 2) - when(low_density, 1), 0.0, 10.0)


def quality_score(words: Column, spelling: Column, grammar: Column, ease: Column) -> Column:
    """10 less points for errors a hundred words, short texts and hard reading, plus one for easy reading."""
    per = lambda n: F.coalesce(F.try_divide(n * 100.0, words), F.lit(0.0))
    s, g = per(spelling), per(grammar)
    points = (
        F.lit(10.0)
        - F.when(s > 2, 5.0).when(s > 1, 3.0).when(s > 0.5, 2.0).when(s > 0, 1.0).otherwise(0.0)
        - F.when(g > 1, 4.0).when(g > 0.5, 2.0).when(g > 0, 1.0).otherwise(0.0)
        + F.when(ease >= 60, 1.0).when(ease < 30, -2.0).otherwise(0.0)
        - F.when(words < 100, 3.0).when(words < 300, 1.0).otherwise(0.0)
    )
    return clamp(points, 0.0, 10.0)


def normalised(text: Column) -> Column:
    """Without tags and unusual signs, single spaces, lower case."""
    t = F.regexp_replace(text, r"<[^>]+>", "")
    t = F.regexp_replace(t, r"(?U)\s+", " ")
    t = F.regexp_replace(t, r"(?U)[^\w\s.,!?;:-]", "")
    return F.lower(F.trim(t))


def context(text: Column, word: Column, width: int = 80) -> Column:
    """The surroundings of a word's first occurrence, any case, with dots where text is left out; null if it is absent."""
    half = width // 2
    at = F.instr(F.lower(text), F.lower(word))
    begin = F.greatest(F.lit(1), at - half)
    end = F.least(F.length(text) + 1, at + F.length(word) + half)
    return F.when(
        at > 0,
        F.concat(F.when(begin > 1, "...").otherwise(""), F.substring(text, begin, end - begin), F.when(end <= F.length(text), "...").otherwise("")),
    )
