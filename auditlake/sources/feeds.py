"""What comes in and goes out as text: robots files, sitemaps, URL lists, backlink responses, JSON records.

Fetching itself is outside the engine: bodies and answers are tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import urls


def robots_sitemaps(robots: DataFrame, site: str, body: str) -> DataFrame:
    """(site, sitemap): the sitemaps that robots files name, once each; lines of any case, only web addresses."""
    lines = robots.select(site, F.explode(F.split(body, r"\r?\n")).alias("line")).where(F.lower("line").startswith("sitemap:"))
    named = lines.select(site, F.trim(F.regexp_replace("line", "(?i)^sitemap:", "")).alias("sitemap"))
    return named.where(F.col("sitemap").startswith("http")).distinct()


def sitemap_probes(sites: DataFrame, site: str) -> DataFrame:
    """(site, sitemap): the usual places of every site's sitemap, as an explode of a literal list."""
    return sites.select(site, F.explode(F.array(*[F.lit(p) for p in urls.SITEMAP_PATHS])).alias("p")).select(site, F.concat(site, "p").alias("sitemap"))


def probed_sitemaps(sites: DataFrame, site: str, answers: DataFrame) -> DataFrame:
    """The probes that answered with 200; ``answers`` has url and status."""
    good = answers.where("status = 200").select(F.col("url").alias("sitemap"))
    return sitemap_probes(sites, site).join(good, "sitemap", "left_semi").select(site, "sitemap")


def sitemap_locs(sitemaps: DataFrame, sitemap: str, xml: str) -> DataFrame:
    """(sitemap, loc): the entries of sitemap files, trimmed, with XML's five entities resolved."""
    loc = F.trim(F.col("l"))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        loc = F.replace(loc, F.lit(entity), F.lit(char))
    return sitemaps.select(sitemap, F.explode(F.regexp_extract_all(xml, F.lit(r"(?s)<loc>(.*?)</loc>"), 1)).alias("l")).select(sitemap, loc.alias("loc"))


def site_verdict(url: Column, status: Column, sitemaps: Column) -> Column:
    """Why a site can't be read, or 'valid'."""
    return (
        F.when(~urls.is_web_url(url), "no web address")
        .when(status.isNull() | (status >= 500), "not reachable")
        .when(F.coalesce(sitemaps, F.lit(0)) < 1, "no sitemap")
        .otherwise("valid")
    )


def url_list(lists: DataFrame, key: str, urls_column: str) -> DataFrame:
    """(key, url): comma-separated lists taken apart; blanks and what has no host are dropped, a missing scheme is added."""
    part = lists.select(key, F.explode(F.split(urls_column, ",")).alias("p")).select(key, F.regexp_replace("p", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "").alias("p")).where("p <> ''")
    full = part.select(key, F.when(F.col("p").rlike("^https?://"), F.col("p")).otherwise(F.concat(F.lit("https://"), "p")).alias("url"))
    return full.where(urls.is_web_url(F.col("url")))


def backlink_response(responses: DataFrame, key: str, body: str) -> DataFrame:
    """(key, problem, backlinks, refdomains): the first summary of each response, or what is wrong with it."""
    parsed = responses.select(key, F.from_json(body, "error string, summary array<struct<backlinks:long, refdomains:long>>").alias("r"))
    first = F.get("r.summary", F.lit(0))
    problem = F.when(F.col("r.error").isNotNull(), F.col("r.error")).when(F.coalesce(F.size("r.summary"), F.lit(0)) < 1, "no summary").when(first.backlinks.isNull(), "no backlinks")
    return parsed.select(key, problem.alias("problem"), first.backlinks.alias("backlinks"), F.when(first.backlinks.isNotNull(), first.refdomains).alias("refdomains"))


def json_records(rows: DataFrame, key: str) -> DataFrame:
    """(key, record): every row as a JSON object; null values are kept as missing names."""
    return rows.select(key, F.to_json(F.struct("*")).alias("record"))


#: Answers after which a page is asked for again, and how often.
RETRIED, RETRIES = (429, 500, 502, 503, 504), 3


def fetched(browser: Column, answers: Column, plain: Column) -> Column:
    """The page and how it was got: the browser's if it isn't empty, else that of the first answer that isn't to be retried, else a plain request's.

    ``answers`` is an array of (status, html) in the order of asking; those after the last retry don't count. Null is empty.
    """
    first = F.get(F.filter(F.slice(answers, 1, RETRIES + 1), lambda a: ~F.coalesce(a.status.isin(*RETRIED), F.lit(False))), F.lit(0))
    full = lambda c: F.nullif(c, F.lit(""))
    requested = F.when(first.status < 400, full(first.html))
    how = F.when(full(browser).isNotNull(), "browser").when(requested.isNotNull(), "request").when(full(plain).isNotNull(), "plain")
    return F.struct(F.coalesce(full(browser), requested, full(plain)).alias("html"), how.alias("how"))
