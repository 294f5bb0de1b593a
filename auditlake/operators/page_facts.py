"""Measures of parsed pages: expressions over the struct that functions.html emits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import urls
from auditlake.functions.rounding import clamp, first_nonblank, half_even, when

#: Page widths, sizes and times of the rules.
WIDE_IMAGE = 2000
LISTED_LINKS = 150
LISTED_IMAGES = 20
LONG_LINK = 100


def page_title(f: str = "facts") -> Column:
    return first_nonblank(*[F.col(f"{f}.{c}") for c in ("title_tag", "og_title", "tw_title", "h1_text")])


def page_description(f: str = "facts") -> Column:
    return first_nonblank(*[F.col(f"{f}.{c}") for c in ("description", "og_description", "tw_description")])


def heading_counts(f: str = "facts") -> list[Column]:
    def count(n: int) -> Column:
        return F.size(F.filter(F.col(f"{f}.headings"), lambda h: h.level == n)).cast("long").alias(f"h{n}")

    return [count(n) for n in range(1, 7)]


def heading_texts(level: int, f: str = "facts", most: int = 5) -> Column:
    return F.slice(F.transform(F.filter(F.col(f"{f}.headings"), lambda h: h.level == level), lambda h: h.text), 1, most)


def technical_score(f: str = "facts") -> Column:
    """Points off for no canonical address, robots rule, structured data, viewport or character set."""
    missing = lambda c: c.isNull() | (c == "")
    score = (
        F.lit(10.0) - when(missing(F.col(f"{f}.canonical")), 3) - when(missing(F.col(f"{f}.robots")), 1) - when(F.size(f"{f}.ld_types") == 0, 2)
        - when(~F.col(f"{f}.has_viewport"), 2) - when(~F.col(f"{f}.has_charset"), 1)
    )
    return clamp(score, 0.0, 10.0)


def image_measures(f: str = "facts") -> Column:
    images = F.col(f"{f}.images")
    count = lambda test: F.size(F.filter(images, test)).cast("long")
    return F.struct(
        F.size(images).cast("long").alias("total"),
        count(lambda i: i.has_alt).alias("with_alt"),
        count(lambda i: i.sized).alias("with_dimensions"),
        count(lambda i: i.lazy).alias("lazy"),
        count(lambda i: i.responsive).alias("responsive"),
        count(lambda i: i.has_title).alias("with_title"),
        count(lambda i: F.coalesce(i.sized & i.width.isNotNull() & i.height.isNotNull() & ((i.width > WIDE_IMAGE) | (i.height > WIDE_IMAGE)), F.lit(False))).alias("oversized"),
        count(lambda i: F.lower(i.src).rlike(r"\.(webp|avif)")).alias("next_gen"),
        count(lambda i: (i.src != "") & ~F.lower(i.src).rlike("optimized|compressed|webp|avif")).alias("unoptimized"),
    )


def image_score(m: Column) -> Column:
    """Of image_measures(): points off for shares of images without a text, of oversized and of fixed ones."""
    share = lambda n: F.try_divide(n, m.total)
    bare = share(m.total - m.with_alt)
    off = F.when(bare > 0.7, 6.0).when(bare > 0.5, 4.0).when(bare > 0.3, 2.0).otherwise(0.0) + when(share(m.oversized) > 0.3, 2) + when(share(m.responsive) < 0.3, 1)
    return F.when(m.total == 0, 10.0).otherwise(clamp(F.lit(10.0) - off, 0.0, 10.0))


def page_links(base: Column, f: str = "facts") -> Column:
    """The links of a page that lead to pages or files, absolute, in their order: array of (url, rel)."""
    web = F.filter(F.col(f"{f}.links"), lambda a: (a.href != "") & ~a.href.rlike("^(#|javascript:|mailto:|tel:)"))
    return F.transform(web, lambda a: F.struct(F.when(a.href.rlike("^https?://"), a.href).otherwise(urls.resolve(base, a.href)).alias("url"), a.rel.alias("rel")))


def link_measures(base: Column, f: str = "facts") -> Column:
    """Counts of links by kind; empty ones, anchors and scripts don't count, mail and phone links are in the total only."""
    host = F.lower(F.regexp_extract(base, r"^[a-zA-Z]+://([^/?#]+)", 1))
    links, pages = F.col(f"{f}.links"), page_links(base, f)
    netloc = lambda a: F.lower(F.regexp_extract(a.url, r"^[a-zA-Z]+://([^/?#]+)", 1))
    size = lambda array, test: F.size(F.filter(array, test)).cast("long")
    social = lambda a: F.exists(F.array(*[F.lit(h) for h in urls.SOCIAL_HOSTS]), lambda h: netloc(a).contains(h))
    email, phone = size(links, lambda a: a.href.startswith("mailto:")), size(links, lambda a: a.href.startswith("tel:"))
    return F.struct(
        (F.size(pages) + email + phone).cast("long").alias("total"),
        size(pages, lambda a: (netloc(a) == host) | (netloc(a) == "")).alias("internal"),
        size(pages, lambda a: (netloc(a) != host) & (netloc(a) != "")).alias("external"),
        size(pages, social).alias("social"),
        size(pages, lambda a: F.array_contains(F.split(a.rel, r"\s+"), "nofollow")).alias("no_follow"),
        size(pages, lambda a: F.lower(a.url).rlike(r"\.(" + "|".join(urls.FILE_ENDINGS) + ")")).alias("downloads"),
        size(pages, lambda a: F.length(a.url) > LONG_LINK).alias("long"),
        email.alias("email"),
        phone.alias("phone"),
        size(links, lambda a: a.href == "").alias("empty"),
    )


def link_score(m: Column, broken: Column) -> Column:
    """Of link_measures(): points off for the share of broken links, for no links inside and for many outside."""
    share = F.try_divide(broken, m.total)
    off = F.when(share > 0.15, 8.0).when(share > 0.1, 6.0).when(share > 0.05, 3.0).when(share > 0, 1.0).otherwise(0.0)
    off = off + when((m.internal == 0) & (m.external > 0), 2) + when(m.external > m.internal * 3, 1)
    return F.when(m.total == 0, 10.0).otherwise(clamp(F.lit(10.0) - off, 0.0, 10.0))


def checked_links(pages: DataFrame, key: str, links: str) -> DataFrame:
    """(key, place, link): of each page the links among its first LISTED_LINKS that are worth a look; ``links`` is an array of page_links()."""
    listed = pages.select(key, F.posexplode(F.slice(F.col(links), 1, LISTED_LINKS)).alias("place", "a"))
    return listed.select(key, "place", F.col("a.url").alias("link")).where(urls.link_is_checked(F.col("link")))


def link_results(checked: DataFrame, statuses: DataFrame) -> DataFrame:
    """Checked links with the ``kind`` that a table (link, status, problem) of answers gives them; each link was asked once, wherever it stands."""
    answers = statuses.dropDuplicates(["link"])
    return checked.join(answers, "link", "left").withColumn("kind", link_status(F.col("link"), F.col("status"), F.col("problem")))


def link_status(url: Column, status: Column, problem: Column) -> Column:
    """What a link is: plain http (never asked), redirect, broken by client or server, unreachable, or fine."""
    return (
        F.when(url.startswith("http://"), "http")
        .when(status.isin(301, 302, 303, 307, 308), "redirect")
        .when((status >= 400) & (status < 500), "client_error")
        .when(status >= 500, "server_error")
        .when(status.isNull(), F.coalesce(problem, F.lit("unknown_error")))
        .otherwise("ok")
    )


def performance(f: str = "facts") -> Column:
    """Size in KB, what mobile browsers get, blocking style sheets, the estimates that follow from them with their ratings, and the score.

    Scripts and inline styles are pruned before, so they count 0.
    """
    kb = F.col(f"{f}.html_bytes") / 1024
    blocking = F.col(f"{f}.stylesheets") - F.col(f"{f}.print_stylesheets")
    viewport = F.coalesce(F.col(f"{f}.viewport"), F.lit(""))
    responsive = viewport.contains("width=device-width")
    paint, shift = clamp(kb / 100, 1.0, 5.0), clamp(blocking * 0.02, 0.0, 0.25)
    rated = lambda c, good, fair: F.when(c <= good, "good").when(c <= fair, "needs_improvement").otherwise("poor")
    score = (
        F.lit(10.0) - when(~F.col(f"{f}.has_viewport"), 3) - when(~responsive, 2) - F.when(kb > 1000, 2.0).when(kb > 500, 1.0).otherwise(0.0)
        - when(blocking > 5, 1) - when(~F.col(f"{f}.compressed"), 1)
    )
    return F.struct(
        half_even(kb, 2).alias("page_kb"),
        F.col(f"{f}.has_viewport").alias("has_viewport"),
        responsive.alias("responsive"),
        F.col(f"{f}.has_media_queries").alias("has_media_queries"),
        F.col(f"{f}.compressed").alias("compressed"),
        blocking.cast("long").alias("blocking_stylesheets"),
        half_even(paint, 2).alias("largest_paint"),
        half_even(shift, 2).alias("layout_shift"),
        rated(paint, 2.5, 4.0).alias("paint_rating"),
        rated(shift, 0.1, 0.25).alias("shift_rating"),
        clamp(score, 0.0, 10.0).alias("score"),
    )
