"""Loosely typed records made typed, and keyed tables brought up to date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.rounding import half_up


def safe_number(text: Column) -> Column:
    """The integer a text starts with, else 0; numbers are cut, not rounded."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0).cast("long"))


def safe_text(*values: Column) -> Column:
    """The first value that isn't null, else an empty text."""
    return F.coalesce(*values, F.lit(""))


#: Kinds by the name that the schema of a value begins with; all others are numbers.
_KINDS = {"VOID": "null", "STRING": "string", "BOOLEAN": "boolean", "ARRAY": "array", "OBJECT": "object"}


def kind_of(record: Column, path: str) -> Column:
    """What stands at a path of a parsed record: undefined, null, string, number, boolean, array or object."""
    schema = F.schema_of_variant(F.try_variant_get(record, path, "variant"))
    names = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    return F.coalesce(F.nvl2(schema, F.coalesce(F.try_element_at(names, F.regexp_extract(schema, "^[A-Z]+", 0)), F.lit("number")), F.lit("undefined")), F.lit("undefined"))


def record_text(record: Column, path: str) -> Column:
    """The text at a path: a string as it is, an object's text or else content, a number or true as written, else empty."""
    kind, at = kind_of(record, path), lambda p: F.nullif(F.try_variant_get(record, p, "string"), F.lit(""))
    plain = F.try_variant_get(record, path, "string")
    return (
        F.when(kind == "string", plain)
        .when(kind == "object", F.coalesce(at(f"{path}.text"), at(f"{path}.content"), F.lit("")))
        .when((kind == "number") & (F.try_variant_get(record, path, "double") != 0), plain)
        .when((kind == "boolean") & F.try_variant_get(record, path, "boolean"), "true")
        .otherwise("")
    )


def record_number(record: Column, path: str) -> Column:
    """The number at a path: as it is, or the integer a string starts with, else 0."""
    kind = kind_of(record, path)
    return F.when(kind == "number", F.try_variant_get(record, path, "double")).when(kind == "string", safe_number(F.try_variant_get(record, path, "string")).cast("double")).otherwise(0.0)


def record_flag(record: Column, path: str) -> Column:
    """Whether what stands at a path counts as true: all but nothing, null, false, 0 and the empty text."""
    kind = kind_of(record, path)
    return (
        F.when(kind == "boolean", F.try_variant_get(record, path, "boolean"))
        .when(kind == "number", F.try_variant_get(record, path, "double") != 0)
        .when(kind == "string", F.try_variant_get(record, path, "string") != "")
        .otherwise(kind.isin("array", "object"))
    )


def record_items(record: Column, path: str) -> Column:
    """The array at a path, else an empty one."""
    return F.when(kind_of(record, path) == "array", F.try_variant_get(record, path, "array<variant>")).otherwise(F.array().cast("array<variant>"))


def has_object(record: Column, path: str) -> Column:
    return kind_of(record, path).isin("object", "array")


#: Fields that must be texts, numbers and objects, in the order in which they are looked at.
TEXT_FIELDS = ("title", "metaDescription")
NUMBER_FIELDS = ("titleLength", "metaDescriptionLength", "wordCount", "titleScore", "metaDescriptionScore", "contentScore", "readabilityScore", "urlScore")
OBJECT_FIELDS = ("headingStructure", "images", "links", "technicalSeo", "performance", "contentQuality", "duplicates")


def record_problems(record: Column) -> Column:
    """What a record must have mended before it is scored: messages, in order; mending is what sanitised() does."""
    named = lambda f: F.when(kind_of(record, f"$.{f}").isin("null", "array"), "object").otherwise(kind_of(record, f"$.{f}"))
    wrong = lambda f, kind: F.when(kind_of(record, f"$.{f}") != kind, F.concat(F.lit(f"{f} is "), named(f), F.lit(f", expected {kind}")))
    missing = [F.when(~has_object(record, f"$.{f}"), f"{f} missing or invalid") for f in OBJECT_FIELDS]
    return F.array_compact(F.array(*[wrong(f, "string") for f in TEXT_FIELDS], *[wrong(f, "number") for f in NUMBER_FIELDS], *missing))


#: Where the analyser has what the store names otherwise.
INTENDED = {
    "images": "$.images.totalCount", "image_score": "$.images.score", "link_score": "$.links.score", "paint": "$.performance.webVitals.estimatedLCP", "performance_score": "$.performance.score",
}


def sanitised(rows: DataFrame, record_name: str, keep: Sequence[str], intended: bool = False) -> DataFrame:
    """(*keep, fields): page records with every field typed and filled; issues that a record brings are kept as they are.

    ``record_name`` is the column of parsed records; one that is no JSON object counts as an empty one. ``intended`` reads an analyser's
    record as it was meant: fields that have another name there, which are 0 or false otherwise.
    """
    record = F.col("__record")
    parsed = rows.select(*keep, F.col(record_name).alias("__record"))
    page = F.coalesce(F.nullif(record_text(record, "$.pageUrl"), F.lit("")), record_text(record, "$.url"))
    # What others are derived from is a projection of its own, so it is read from the record once.
    staged = {"__page": page, "__title": record_text(record, "$.title"), "__description": record_text(record, "$.metaDescription"), "__words": record_number(record, "$.wordCount"), "__ease": record_number(record, "$.readabilityScore"), "__h1": record_number(record, "$.headingStructure.h1Count")}
    parsed = parsed.withColumns(staged)
    page, title, description, words, ease, h1 = (F.col(c) for c in staged)
    number = lambda path: record_number(record, path)
    site = F.regexp_replace(F.regexp_extract(page, r"^([a-zA-Z]+://[^/?#]+)", 1), r":\d+$", "")

    def issue(of: str, name: str, default: Column) -> Column:
        return F.when(has_object(record, f"$.{of}"), F.try_variant_get(record, f"$.{of}.{name}", "boolean")).otherwise(default)

    known = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
    columns = {
        "website_url": F.coalesce(F.nullif(record_text(record, "$.websiteUrl"), F.lit("")), F.nullif(site, F.lit("")), F.nullif(page, F.lit("")), F.lit("unknown")), "page_url": known(page, "unknown"),
        "title": title, "title_length": F.length(title), "title_score": number("$.titleScore"), "meta_description": description, "meta_description_length": F.length(description), "meta_description_score": number("$.metaDescriptionScore"),
        "word_count": words, "content_score": number("$.contentScore"), "readability_score": ease, "url_score": number("$.urlScore"),
        "title_too_short": issue("titleIssues", "tooShort", F.length(title) < 30), "title_too_long": issue("titleIssues", "tooLong", F.length(title) > 60), "title_missing": issue("titleIssues", "missing", title == ""),
        "description_too_short": issue("metaDescriptionIssues", "tooShort", F.length(description) < 120), "description_too_long": issue("metaDescriptionIssues", "tooLong", F.length(description) > 160),
        "description_missing": issue("metaDescriptionIssues", "missing", description == ""),
        "content_too_short": issue("contentIssues", "tooShort", words < 300), "low_density": issue("contentIssues", "lowKeywordDensity", F.lit(False)), "hard_to_read": issue("contentIssues", "poorReadability", ease < 60),
        "h1": h1, **{f"h{n}": number(f"$.headingStructure.h{n}Count") for n in range(2, 7)}, "h1_missing": h1 == 0, "h1_multiple": h1 > 1,
        "url_too_long": issue("urlIssues", "tooLong", F.length(page) > 100), "url_special": issue("urlIssues", "containsSpecialChars", page.rlike(r"[^a-zA-Z0-9\-_/.]")), "url_params": issue("urlIssues", "containsParams", page.contains("?")),
        "canonical": record_text(record, "$.technicalSeo.canonicalUrl"), "robots": record_text(record, "$.technicalSeo.robotsDirectives"), "has_canonical": record_flag(record, "$.technicalSeo.canonicalTagExists"),
        "images": number("$.images.count"), "bare_images": F.size(record_items(record, "$.images.altTextMissing")), "image_score": number("$.images.imageScore"),
        "internal_links": number("$.links.internalCount"), "external_links": number("$.links.externalCount"), "broken_links": F.size(record_items(record, "$.links.brokenLinks")), "link_score": number("$.links.linkScore"),
        "responsive": record_flag(record, "$.performance.mobileResponsive"), "page_speed": number("$.performance.pageSpeedScore"), "paint": number("$.performance.coreWebVitals.LCP"), "performance_score": number("$.performance.performanceScore"),
        "duplicate_score": F.coalesce(F.nullif(number("$.duplicates.duplicateScore"), F.lit(0.0)), F.lit(10.0)), "seo_score": number("$.seoScore"), "seo_grade": known(record_text(record, "$.seoGrade"), "F"),
    }
    if intended:
        columns |= {name: number(path) for name, path in INTENDED.items()}
        columns["responsive"] = record_flag(record, "$.performance.mobileOptimized.isResponsive")
    return parsed.select(*keep, *[c.alias(name) for name, c in columns.items()])


def clean_items(items: Column, text: str, number: str, most: int = 10, longest: int = 200) -> Column:
    """The first ``most`` items of an array of structs, then with texts trimmed, without blank ones, cut to ``longest`` characters, unknown numbers 0."""
    trimmed = F.transform(F.slice(items, 1, most), lambda a: F.struct(F.substring(F.trim(a[text]), 1, longest).alias(text), F.coalesce(a[number], F.lit(0)).cast("long").alias(number)))
    return F.coalesce(F.filter(trimmed, lambda a: a[text] != ""), F.array().cast(f"array<struct<{text}:string,{number}:bigint>>"))


def diversity(domains: Column, links: Column) -> Column:
    """Domains by links in hundredths, halves up; 0 without links."""
    return F.when(links > 0, half_up(domains / links * 100) / 100).otherwise(0.0)


def latest(rows: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The last row of each key by ``by`` (nulls first, so a null never wins over a value); ties keep one row.

    Done as an aggregate (max of a struct), so a hot key's rows are combined before the shuffle and no key is
    sorted in one task. Null keys are a key of their own.
    """
    others = [c for c in rows.columns if c not in keys]
    order = F.struct(*[F.struct(F.col(b).isNotNull(), F.col(b)) for b in by])
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("r"))
    return best.select(*keys, "r.*").select(*rows.columns)


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``table`` with the last version of every key, whichever of both sides holds it; the same twice changes nothing."""
    return latest(table.unionByName(changes), keys, by)


def without_expired(rows: DataFrame, status: str, ended: str, now: Column, days: int = 30) -> DataFrame:
    """Rows but those that are completed or failed and ended more than ``days`` days ago; an unknown end keeps a row."""
    gone = F.col(status).isin("completed", "failed") & (F.col(ended) < now - F.expr(f"INTERVAL {days} DAYS"))
    return rows.where(~F.coalesce(gone, F.lit(False)))


def stale(wanted: DataFrame, known: DataFrame, keys: Sequence[str], fetched: str, now: Column, days: int = 7) -> DataFrame:
    """Keys of ``wanted`` that have no row younger than ``days`` days in ``known``."""
    fresh = known.where(F.col(fetched) >= now - F.expr(f"INTERVAL {days} DAYS")).select(*keys).distinct()
    return wanted.select(*keys).distinct().join(fresh, list(keys), "left_anti")


def page_of(rows: DataFrame, sort: str, descending: bool, key: str, page: int, limit: int) -> DataFrame:
    """One page of sorted rows; ``key`` decides among equals, nulls come first ascending and last descending."""
    order = [F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_first(), F.col(key).asc()]
    return rows.orderBy(*order).offset((page - 1) * limit).limit(limit)


def filtered(rows: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows that meet a filter: exact for status_code and has_error, a pattern of any case for content_type and url; other names and null are ignored."""
    for name, value in wanted.items():
        if value is None:
            continue
        if name in ("status_code", "has_error"):
            rows = rows.where(F.col(name) == F.lit(value))
        elif name in ("content_type", "url"):
            rows = rows.where(F.col(name).rlike("(?i)" + str(value)))
    return rows


def first_n(rows: DataFrame, keys: Sequence[str], by: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key; Spark limits each group before the shuffle's sort."""
    w = Window.partitionBy(*keys).orderBy(*by)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")
