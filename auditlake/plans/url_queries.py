"""Queries of sources, sinks and URL operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import urls
from auditlake.operators.ordered import chunked, ranked
from auditlake.plans.registry import Registry
from auditlake.session import table
from auditlake.sources import feeds

R = Registry()
_ORIGIN = "nullif(regexp_extract({}, '^([a-zA-Z]+://[^/?#]+)', 1), '')"


@R.query(f"SELECT webpage_id, {_ORIGIN.format('url')} AS site FROM webpages")
def s1_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "webpages").select("webpage_id", urls.origin(F.col("url")).alias("site"))


@R.query(f"SELECT raw_id, regexp_replace({_ORIGIN.format("regexp_replace(url, '^[^a-zA-Z]+', '')")}, ':\\d+$', '') AS site FROM raw_pages")
def s2_origin_without_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_pages").select("raw_id", urls.origin_without_port(F.regexp_replace("url", "^[^a-zA-Z]+", "")).alias("site"))


@R.query(r"SELECT raw_id, coalesce(regexp_matches(url, '^https?://[^/?#\s]+'), false) AS valid FROM raw_pages")
def s3_valid_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_pages").select("raw_id", urls.is_web_url(F.col("url")).alias("valid"))


@R.query(r"""
WITH t AS (SELECT summary_id, CASE WHEN regexp_matches(trim(website_url), '^https?://') THEN trim(website_url) ELSE 'https://' || trim(website_url) END AS u
           FROM (SELECT summary_id, website_url FROM backlink_summaries UNION ALL SELECT -summary_id, regexp_replace(website_url, '^https?://', '') FROM backlink_summaries))
SELECT summary_id, CASE WHEN regexp_extract(u, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) IN ('', '/') AND regexp_matches(u, '^[a-zA-Z]+://[^/?#]+')
  THEN regexp_extract(u, '^([a-zA-Z]+://[^/?#]+)', 1) || '/' ELSE u END AS target FROM t""")
def s4_lookup_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "backlink_summaries").select("summary_id", "website_url")
    bare = links.select((-F.col("summary_id")).alias("summary_id"), F.regexp_replace("website_url", "^https?://", "").alias("website_url"))
    return links.unionByName(bare).select("summary_id", urls.lookup_target(F.col("website_url")).alias("target"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemap entries: the pages of every site below its sitemap, and child sitemaps by first letter of the page's path."""
    pages = table(spark, sf_dir, "webpages").select("website_url", "url")
    sitemap = F.concat("website_url", F.lit("/sitemap.xml"))
    child = F.concat("website_url", F.lit("/sitemap-"), F.substring(F.regexp_replace(urls.path(F.col("url")), "^/", ""), 1, 1), F.lit(".xml"))
    return pages.select(sitemap.alias("sitemap_url"), child.alias("loc")).unionByName(pages.select(child.alias("sitemap_url"), F.col("url").alias("loc"))).distinct()


_ENTRIES = """
e AS (SELECT DISTINCT sitemap_url, loc FROM (
  SELECT website_url || '/sitemap.xml' AS sitemap_url, website_url || '/sitemap-' || substr(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '^/', ''), 1, 1) || '.xml' AS loc FROM webpages
  UNION ALL
  SELECT website_url || '/sitemap-' || substr(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '^/', ''), 1, 1) || '.xml', url FROM webpages))"""


@R.query(f"""WITH {_ENTRIES}
SELECT sitemap_url, loc, CASE WHEN contains(lower(loc), 'sitemap') AND regexp_matches(lower(loc), '\\.xml(\\.gz)?$') THEN 'sitemap' ELSE 'page' END AS kind
FROM e WHERE regexp_matches(loc, '^https?://[^/?#\\s]+')""")
def s5_sitemap_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).withColumn("kind", urls.sitemap_kind(F.col("loc"))).where("kind is not null")


@R.query(f"""WITH {_ENTRIES}, k AS (SELECT *, contains(lower(loc), 'sitemap') AND regexp_matches(lower(loc), '\\.xml(\\.gz)?$') AS child FROM e)
SELECT a.sitemap_url AS parent, a.loc AS child, count(b.loc) AS pages FROM k a JOIN k b ON b.sitemap_url = a.loc AND NOT b.child WHERE a.child GROUP BY 1, 2""")
def s6_sitemap_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = _entries(spark, sf_dir).withColumn("kind", urls.sitemap_kind(F.col("loc")))
    children = kinds.where("kind = 'sitemap'").select(F.col("sitemap_url").alias("parent"), F.col("loc").alias("child"))
    below = kinds.where("kind = 'page'").groupBy(F.col("sitemap_url").alias("child")).agg(F.count("loc").alias("pages"))
    return children.join(below, "child").select("parent", "child", "pages")


@R.query("SELECT url, min(webpage_id) AS first_seen FROM webpages WHERE url IS NOT NULL GROUP BY 1")
def s7_distinct_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "webpages").where("url is not null").groupBy("url").agg(F.min("webpage_id").alias("first_seen"))


_HREFS = ("/a/b", "//cdn.example/x", "?p=2", "#top", "next.html", "https://other.example/y", "mailto:me@site.example", "/a/../b/./c?q=../x", "../up#f", "x/./y/..", "./", "../../../../../../../top")
_HREF_LIST = ", ".join(f"'{h}'" for h in _HREFS)


@R.query(rf"""
WITH h AS (SELECT webpage_id, url AS base, {_ORIGIN.format("url")} AS o, coalesce(nullif(regexp_extract(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '^(.*/)[^/]*$', 1), ''), '/') AS folder, unnest([{_HREF_LIST}]) AS href FROM webpages WHERE url IS NOT NULL)
SELECT webpage_id, href, CASE href
  WHEN '/a/b' THEN o || href WHEN '//cdn.example/x' THEN regexp_extract(base, '^([a-zA-Z]+:)', 1) || href WHEN '?p=2' THEN regexp_replace(base, '[?#].*$', '') || href WHEN '#top' THEN regexp_replace(base, '#.*$', '') || href
  WHEN 'next.html' THEN o || folder || href WHEN '/a/../b/./c?q=../x' THEN o || '/b/c?q=../x' WHEN '../up#f' THEN o || CASE WHEN folder = '/' THEN '/' ELSE regexp_replace(folder, '[^/]+/$', '') END || 'up#f'
  WHEN 'x/./y/..' THEN o || folder || 'x/' WHEN './' THEN o || folder WHEN '../../../../../../../top' THEN o || '/top' ELSE href END AS link FROM h""")
def s8_resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    hrefs = table(spark, sf_dir, "webpages").where("url is not null").select("webpage_id", "url", F.explode(F.array(*[F.lit(h) for h in _HREFS])).alias("href"))
    return hrefs.select("webpage_id", "href", urls.resolve(F.col("url"), F.col("href")).alias("link"))


@R.query(
    r"""WITH l AS (SELECT webpage_id, url AS link FROM webpages UNION ALL SELECT webpage_id, regexp_replace(url, '[?#].*$', '') || '.PDF?x=1' FROM webpages UNION ALL SELECT webpage_id, 'mailto:' || webpage_id FROM webpages)
SELECT webpage_id, link, coalesce(length(link) >= 4 AND NOT regexp_matches(link, '^(mailto:|tel:|javascript:|ftp:|#|data:)')
  AND NOT regexp_matches(regexp_replace(lower(link), '[?#].*$', ''), '\.("""
    + "|".join(urls.FILE_ENDINGS)
    + r""")$'), false) AS checked FROM l"""
)
def s9_checked_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "webpages")
    links = (
        pages.select("webpage_id", F.col("url").alias("link"))
        .unionByName(pages.select("webpage_id", F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit(".PDF?x=1")).alias("link")))
        .unionByName(pages.select("webpage_id", F.concat(F.lit("mailto:"), F.col("webpage_id").cast("string")).alias("link")))
    )
    return links.withColumn("checked", urls.link_is_checked(F.col("link")))


@R.query("""
WITH r AS (SELECT webpage_id, website_url, row_number() OVER (PARTITION BY website_url ORDER BY webpage_id) AS k, count(*) OVER (PARTITION BY website_url) AS n FROM webpages)
SELECT webpage_id, website_url, CAST(floor((k - 1) / least(100, ceil(n / 10.0))) AS BIGINT) AS batch FROM r""")
def s10_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked(chunked(table(spark, sf_dir, "webpages").select("webpage_id", "website_url"), "website_url", ["webpage_id"]), "website_url", ["webpage_id"], "k", "n")
    size = F.least(F.lit(100), F.ceil(F.col("n") / 10.0))
    return rows.select("webpage_id", "website_url", F.floor((F.col("k") - 1) / size).cast("long").alias("batch"))


@R.query("""
WITH a AS (SELECT webpage_id, CASE WHEN webpage_id % 3 = 0 THEN title END AS b, CASE WHEN status_code IN (429, 500, 502, 503, 504) THEN CASE WHEN webpage_id % 2 = 0 THEN meta_description END WHEN status_code < 400 THEN meta_description END AS r, url AS p FROM webpages)
SELECT webpage_id, coalesce(nullif(b, ''), nullif(r, ''), nullif(p, '')) AS html, CASE WHEN nullif(b, '') IS NOT NULL THEN 'browser' WHEN nullif(r, '') IS NOT NULL THEN 'request' WHEN nullif(p, '') IS NOT NULL THEN 'plain' END AS how FROM a""")
def src1_fetch_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to three ways of asking for a page; a server that asks for patience is better at the third time for every other page, at the fifth for the rest."""
    i, answer = F.col("webpage_id"), lambda status: F.struct(status.alias("status"), F.col("meta_description").alias("html"))
    later = F.when(i % 2 == 0, F.array(answer(F.col("status_code")), answer(F.lit(503)), answer(F.lit(200)))).otherwise(F.array(*[answer(F.col("status_code"))] * 4, answer(F.lit(200))))
    pages = table(spark, sf_dir, "webpages").select("webpage_id", feeds.fetched(F.when(i % 3 == 0, F.col("title")), later, F.col("url")).alias("f"))
    return pages.select("webpage_id", "f.html", "f.how")


@R.query("""
SELECT DISTINCT website_url, s AS sitemap FROM (
  SELECT website_url, unnest([website_url || '/sitemap.xml', website_url || '/news.xml']) AS s FROM activities WHERE website_url IS NOT NULL) WHERE starts_with(s, 'http')""")
def src3_robots_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = table(spark, sf_dir, "activities").where("website_url is not null").select("website_url").distinct()
    body = F.concat(F.lit("User-agent: *\nDisallow: /x\nSitemap: "), "website_url", F.lit("/sitemap.xml\nSITEMAP:"), "website_url", F.lit("/news.xml\nsitemap: /relative.xml\n"))
    return feeds.robots_sitemaps(sites.select("website_url", body.alias("body")), "website_url", "body")


@R.query(
    "SELECT a.website_url, a.website_url || p AS sitemap FROM (SELECT DISTINCT website_url FROM activities WHERE website_url IS NOT NULL) a, unnest(["
    + ", ".join(f"'{p}'" for p in urls.SITEMAP_PATHS)
    + "]) t(p) WHERE length(a.website_url || p) % 3 = 0"
)
def src4_probed_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = table(spark, sf_dir, "activities").where("website_url is not null").select("website_url").distinct()
    answers = feeds.sitemap_probes(sites, "website_url").select(F.col("sitemap").alias("url"), F.when(F.length("sitemap") % 3 == 0, 200).otherwise(404).alias("status"))
    return feeds.probed_sitemaps(sites, "website_url", answers)


@R.query(
    "SELECT DISTINCT website_url, website_url || p AS sitemap FROM (SELECT DISTINCT website_url FROM activities WHERE website_url IS NOT NULL) a, unnest(["
    + ", ".join(f"'{p}'" for p in (*urls.SITEMAP_PATHS, "/news.xml"))
    + "]) t(p) WHERE starts_with(website_url, 'http') AND p IN ('/sitemap.xml', '/news.xml') OR p <> '/news.xml' AND length(website_url || p) % 3 = 0"
)
def src4_all_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemaps that a robots file names or that a probe has found, each once."""
    return src3_robots_sitemaps(spark, sf_dir).unionByName(src4_probed_sitemaps(spark, sf_dir)).distinct()


@R.query("SELECT website_url || '/sitemap.xml' AS sitemap_url, url AS loc FROM (SELECT DISTINCT website_url, url FROM webpages WHERE url IS NOT NULL)")
def src5_sitemap_locs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "webpages").where("url is not null").select("website_url", "url").distinct()
    escaped = F.replace("url", F.lit("&"), F.lit("&amp;"))
    # One document a page: a site's whole list in one row would grow with the site.
    xml = F.concat(F.lit("<urlset>\n<url><loc> "), escaped, F.lit(" </loc></url></urlset>"))
    return feeds.sitemap_locs(pages.select(F.concat("website_url", F.lit("/sitemap.xml")).alias("sitemap_url"), xml.alias("xml")), "sitemap_url", "xml")


@R.query(r"""
WITH s AS (SELECT website_url, max(status_code) AS status, count(*) AS sitemaps FROM webpages GROUP BY 1)
SELECT website_url, CASE WHEN NOT coalesce(regexp_matches(website_url, '^https?://[^/?#\s]+'), false) THEN 'no web address' WHEN status IS NULL OR status >= 500 THEN 'not reachable' WHEN sitemaps < 3 THEN 'no sitemap' ELSE 'valid' END AS verdict FROM s""")
def src6_reachable_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = table(spark, sf_dir, "webpages").groupBy("website_url").agg(F.max("status_code").alias("status"), F.count(F.lit(1)).alias("sitemaps"))
    return sites.select("website_url", feeds.site_verdict(F.col("website_url"), F.col("status"), F.when(F.col("sitemaps") < 3, 0).otherwise(F.col("sitemaps"))).alias("verdict"))


@R.query(r"""
WITH l AS (SELECT raw_id, unnest(string_split(url || ', shop.example/x ,,https://', ',')) AS p FROM raw_pages),
m AS (SELECT raw_id, regexp_replace(p, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS p FROM l),
t AS (SELECT raw_id, CASE WHEN regexp_matches(p, '^https?://') THEN p ELSE 'https://' || p END AS u FROM m WHERE p <> '')
SELECT raw_id, u AS url FROM t WHERE regexp_matches(u, '^https?://[^/?#\s]+')""")
def src7_url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "raw_pages").select("raw_id", F.concat("url", F.lit(", shop.example/x ,,https://")).alias("urls"))
    return feeds.url_list(lists, "raw_id", "urls")


@R.query("""
SELECT summary_id, CASE WHEN api_status = 'failed' THEN error_message WHEN summary_id % 7 = 0 THEN 'no summary' WHEN backlinks IS NULL THEN 'no backlinks' END AS problem,
       CASE WHEN api_status = 'failed' OR summary_id % 7 = 0 THEN NULL ELSE backlinks END AS backlinks,
       CASE WHEN api_status = 'failed' OR summary_id % 7 = 0 OR backlinks IS NULL THEN NULL ELSE refdomains END AS refdomains FROM (SELECT * REPLACE (coalesce(error_message, 'failed') AS error_message) FROM backlink_summaries)""")
def src8_backlink_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "backlink_summaries")
    body = (
        F.when(F.col("api_status") == "failed", F.to_json(F.struct(F.coalesce("error_message", F.lit("failed")).alias("error"))))
        .when(F.col("summary_id") % 7 == 0, F.lit('{"summary":[]}'))
        .otherwise(F.to_json(F.struct(F.array(F.struct("backlinks", "refdomains")).alias("summary"))))
    )
    return feeds.backlink_response(links.select("summary_id", body.alias("body")), "summary_id", "body")


@R.query("""SELECT summary_id, json_extract_string(j, '$.website_url') AS website_url, CAST(json_extract(j, '$.backlinks') AS BIGINT) AS backlinks
FROM (SELECT summary_id, to_json({'website_url': website_url, 'backlinks': backlinks}) AS j FROM backlink_summaries)""")
def snk1_json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.json_records(table(spark, sf_dir, "backlink_summaries").select("summary_id", "website_url", "backlinks"), "summary_id")
    back = F.from_json("record", "website_url string, backlinks long")
    return rows.select("summary_id", back.alias("r")).select("summary_id", "r.website_url", "r.backlinks")


QUERIES, SQL = R.QUERIES, R.SQL
