"""Scores of pages as Catalyst expressions: the analyser's rules (audit_*) and the store's stricter ones (stored_*).

Every score is within 0 and 10; null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions import urls
from auditlake.functions.rounding import clamp, half_even, half_up, when

#: Limits of the rules.
TITLE = (30, 60)
DESCRIPTION = (80, 160)
LEAST_WORDS = 300
LONGEST_URL = 75
#: Weights of the ten components, in the order in which they are added.
WEIGHTS = {"title": 0.1, "meta": 0.1, "content": 0.15, "headings": 0.1, "url": 0.05, "technical": 0.1, "images": 0.05, "links": 0.1, "performance": 0.15, "quality": 0.1}
#: Least score of each grade.
GRADES = ((95, "A+"), (90, "A"), (85, "B+"), (80, "B"), (70, "C"), (60, "D"))


def _len(c: Column) -> Column:
    return F.coalesce(F.length(c), F.lit(0))


def audit_title(title: Column) -> Column:
    n = _len(title)
    shouting = (title == F.upper(title)) & title.rlike(r"\p{Lu}")
    crowded = (F.regexp_count(title, F.lit(r"\|")) > 2) | (F.regexp_count(title, F.lit("-")) > 3)
    score = F.lit(10.0) - when((n > 0) & (n < TITLE[0]), 4) - when(n > TITLE[1], 3) - when(shouting, 1) - when(crowded, 1) - when(~title.rlike(r"\p{L}"), 2)
    return F.when(n == 0, 0.0).otherwise(clamp(score, 0.0, 10.0))


def audit_description(text: Column) -> Column:
    n = _len(text)
    score = F.lit(10.0) - when((n > 0) & (n < DESCRIPTION[0]), 4) - when(n > DESCRIPTION[1], 3) - when(text == F.upper(text), 1) - when(~text.rlike(r"[.!?]$"), 0.5)
    return F.when(n == 0, 0.0).otherwise(clamp(score, 0.0, 10.0))


def audit_url(url: Column) -> Column:
    path = urls.path(url)
    last = urls.last_segment(F.regexp_replace(path, "/+$", ""))
    depth = F.size(F.filter(F.split(path, "/"), lambda s: s != ""))
    score = (
        F.lit(10.0) - when(_len(url) > LONGEST_URL, 3) - when(url.rlike(r"[^a-zA-Z0-9\-._~:/?#\[\]@!$&'()*+,;=%]"), 3) - when(url.contains("?"), 1)
        - when(F.length(last) < 3, 2) - when(url.contains(" "), 2) - when(path.contains("_"), 1) - when(depth > 5, 1)
    )
    return clamp(score, 0.0, 10.0)


def _stored_text(text: Column, limits: tuple[int, int], duplicate: Column, multiple: Column | None) -> Column:
    n = _len(text)
    several = F.lit(0.0) if multiple is None else when(multiple, 4)
    return F.when(n == 0, 0.0).otherwise(clamp(F.lit(10.0) - when(n < limits[0], 3) - when(n > limits[1], 2) - several - when(duplicate, 3), 0.0, 10.0))


def stored_title(title: Column, duplicate: Column, multiple: Column | None = None) -> Column:
    """Points off for a title that is short, long, on other pages as well, or not the page's only one."""
    return _stored_text(title, TITLE, duplicate, multiple)


def stored_description(text: Column, duplicate: Column, multiple: Column | None = None) -> Column:
    return _stored_text(text, DESCRIPTION, duplicate, multiple)


def stored_url(url: Column) -> Column:
    score = F.lit(10.0) - when(_len(url) > LONGEST_URL, 2) - when(url.rlike(r"[^a-zA-Z0-9\-/.]"), 3) - when(url.contains("?"), 2) - when(F.length(urls.last_segment(url)) < 3, 2)
    return clamp(score, 0.0, 10.0)


def stored_content(words: Column, low_density: Column) -> Column:
    return clamp(F.lit(10.0) - when(words < LEAST_WORDS, 4) - when(low_density, 2), 0.0, 10.0)


def heading_score(h1: Column, h2: Column, h3: Column) -> Column:
    """The analyser's: no or several main headings, and lower ones without the one above."""
    return clamp(F.lit(10.0) - when(h1 == 0, 6) - when(h1 > 1, 4) - when(((h2 > 0) & (h1 == 0)) | ((h3 > 0) & (h2 == 0)), 2), 0.0, 10.0)


def stored_headings(h1: Column, lower_first: Column) -> Column:
    return clamp(F.lit(10.0) - when(h1 == 0, 5) - when(h1 > 1, 3) - when(lower_first, 2), 0.0, 10.0)


def stored_technical(canonical: Column, robots: Column) -> Column:
    return clamp(F.lit(10.0) - when(canonical.isNull() | (canonical == ""), 3) - when(robots.isNull() | (robots == ""), 1), 0.0, 10.0)


def _share_points(part: Column, whole: Column, times: float, most: float) -> Column:
    return F.least(F.lit(most), half_up(F.coalesce(F.try_divide(part, whole), F.lit(0.0)) * times).cast("double"))


def stored_images(count: Column, without_alt: Column, large: Column) -> Column:
    return F.when(count == 0, 10.0).otherwise(clamp(F.lit(10.0) - _share_points(without_alt, count, 10, 6) - _share_points(large, count, 8, 4), 0.0, 10.0))


def stored_links(count: Column, broken: Column, plain_http: Column, redirected: Column) -> Column:
    score = F.lit(10.0) - _share_points(broken, count, 20, 10) - _share_points(plain_http, count, 8, 4) - _share_points(redirected, count, 6, 3)
    return F.when(count == 0, 5.0).otherwise(clamp(score, 0.0, 10.0))


def stored_performance(responsive: Column, speed: Column, paint: Column, shift: Column) -> Column:
    score = F.lit(10.0) - when(~responsive, 5) - F.when(speed < 50, 4.0).when(speed < 80, 2.0).otherwise(0.0) - when(paint > 2.5, 1) - when(shift > 0.1, 1)
    return clamp(score, 0.0, 10.0)


def stored_quality(words: Column, spelling: Column, grammar: Column, similarity: Column) -> Column:
    """Errors by hundred words (a page without words has full points off where it has errors), and the likest copy."""
    rate = lambda n: F.when(n == 0, 0.0).otherwise(F.coalesce(F.least(F.lit(1.0), F.try_divide(n * 100.0, words)), F.lit(1.0)))
    off = half_up(rate(spelling) * 5).cast("double") + half_up(rate(grammar) * 4).cast("double") + F.when(similarity > 85, 5.0).when(similarity > 70, 3.0).when(similarity > 50, 1.0).otherwise(0.0)
    return clamp(F.lit(10.0) - off, 0.0, 10.0)


def stored_duplicates(titles: Column, descriptions: Column) -> Column:
    return clamp(F.lit(10.0) - F.least(F.lit(5.0), titles) - F.least(F.lit(5.0), descriptions), 0.0, 10.0)


def total_score(parts: dict[str, Column], stored: bool) -> Column:
    """The weighted sum in percent; the store rounds halves up, the analyser to the even neighbour."""
    total: Column | None = None
    for name, weight in WEIGHTS.items():
        term = parts.get(name, F.lit(0.0)) * F.lit(weight)
        total = term if total is None else total + term
    assert total is not None
    # Sums of tenths carry binary dust; it must not decide a half.
    percent = F.round(total * 10, 9)
    return clamp((half_up(percent) if stored else half_even(percent)).cast("double"), 0.0, 100.0)


def grade(score: Column) -> Column:
    chain = F.when(score >= GRADES[0][0], GRADES[0][1])
    for least, name in GRADES[1:]:
        chain = chain.when(score >= least, name)
    return chain.otherwise("F")


def critical_issues(title: Column, description: Column, h1: Column, broken: Column, responsive: Column, speed: Column) -> Column:
    """Up to six messages, in a fixed order."""
    return F.array_compact(
        F.array(
            F.when(_len(title) == 0, "Missing title tag"),
            F.when(_len(description) == 0, "Missing meta description"),
            F.when(h1 == 0, "Missing H1 tag"),
            F.when(broken > 0, F.concat(broken.cast("string"), F.lit(" broken links"))),
            F.when(~responsive, "Not mobile responsive"),
            F.when(speed < 50, "Very slow page speed"),
        )
    )
