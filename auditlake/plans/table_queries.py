"""Queries over stored tables: records, upserts, listings, statistics, and logic over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.functions.rounding import half_even
from auditlake.operators import records, timeline
from auditlake.operators.ordered import chunked, ranked
from auditlake.operators.skew import State, tree_aggregate
from auditlake.plans.registry import Registry
from auditlake.session import table

R = Registry()
NOW = "2025-06-30 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


# --- Records ----------------------------------------------------------------------------------------------------
@R.query("""
SELECT raw_id, coalesce(json_extract_string(fields, '$.title'), '') AS title, coalesce(try_cast(regexp_extract(json_extract_string(fields, '$.wordCount'), '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0) AS word_count,
       coalesce(try_cast(regexp_extract(json_extract_string(fields, '$.statusCode'), '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0) AS status_code, coalesce(json_extract_string(fields, '$.lang'), json_extract_string(fields, '$.contentType'), '') AS lang FROM raw_pages""")
def n2_typed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = lambda name: F.get_json_object("fields", f"$.{name}")
    return table(spark, sf_dir, "raw_pages").select(
        "raw_id",
        records.safe_text(field("title")).alias("title"),
        records.safe_number(field("wordCount")).alias("word_count"),
        records.safe_number(field("statusCode")).alias("status_code"),
        records.safe_text(field("lang"), field("contentType")).alias("lang"),
    )


def _loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(webpage_id, record): every audit as a loosely typed record: texts in objects, numbers as texts, fields that are missing or of another kind."""
    i = F.col("webpage_id")
    inner = lambda c: F.nullif(F.substring(F.to_json(c), F.lit(2), F.length(F.to_json(c)) - 2), F.lit(""))
    t = F.col("title")
    pieces = [
        F.when(i % 5 == 0, F.concat(F.lit('"title":'), F.to_json(F.struct(t.alias("text"))))).when(i % 5 == 1, F.concat(F.lit('"title":'), F.to_json(F.struct(F.lit("").alias("text"), t.alias("content"))))).otherwise(inner(F.struct("title"))),
        F.when(i % 7 == 0, F.concat(F.lit('"metaDescription":'), (i % 3).cast("string"))).otherwise(inner(F.struct(F.col("meta_description").alias("metaDescription")))),
        F.when(i % 3 == 0, F.concat(F.lit('"wordCount":" '), F.coalesce("word_count", F.lit(0)).cast("string"), F.lit(' words"'))).when(i % 3 == 1, inner(F.struct(F.col("word_count").alias("wordCount")))),
        inner(F.struct(F.col("url").alias("pageUrl"))), F.when(i % 4 == 0, '"titleIssues":{"tooShort":true}'),
        F.when(i % 3 > 0, F.concat(F.lit('"headingStructure":{"h1Count":'), (i % 4).cast("string"), F.lit(',"h2Count":"2x","h3Count":null}'))),
        F.when(i % 6 == 0, '"links":{"brokenLinks":"none","score":7}').when(i % 6 == 1, '"links":{"brokenLinks":[1,{"url":"x"}],"score":3.5,"internalCount":true}').when(i % 6 == 2, '"links":[]'),
        F.when(i % 2 == 1, '"performance":{"mobileResponsive":1,"mobileOptimized":{"isResponsive":false},"webVitals":{"estimatedLCP":2.75},"score":9}').otherwise('"performance":{"mobileResponsive":"","mobileOptimized":{"isResponsive":true}}'),
        inner(F.struct(F.col("seo_grade").alias("seoGrade"))), F.when(i % 8 == 0, '"images":{"totalCount":4,"score":6,"count":1}'), F.when(i % 9 == 0, '"duplicates":{"duplicateScore":"4"}'),
    ]
    whole = F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}"))
    return table(spark, sf_dir, "webpages").select("webpage_id", F.try_parse_json(F.when(i % 50 == 49, "no record").otherwise(whole)).alias("record"))


_LOOSE = r"""
r AS (SELECT webpage_id, webpage_id AS i, webpage_id % 50 = 49 AS bad, * EXCLUDE (webpage_id) FROM webpages),
l AS (SELECT webpage_id, i, bad, CASE WHEN bad THEN '' ELSE coalesce(title, '') END AS t, CASE WHEN bad THEN '' WHEN i % 7 = 0 THEN CASE WHEN i % 3 = 0 THEN '' ELSE CAST(i % 3 AS VARCHAR) END ELSE coalesce(meta_description, '') END AS d,
  CASE WHEN bad OR i % 3 = 2 THEN 0 ELSE coalesce(word_count, 0) END AS w, CASE WHEN bad THEN '' ELSE coalesce(url, '') END AS u, CASE WHEN bad OR i % 3 = 0 THEN 0 ELSE i % 4 END AS h1, CASE WHEN bad THEN 'F' ELSE coalesce(nullif(seo_grade, ''), 'F') END AS g,
  title IS NULL AS no_title, meta_description IS NULL AS no_description, word_count IS NULL AS no_words FROM r)"""
_SAVED = """CASE WHEN u = '' THEN 'unknown' ELSE u END AS page_url, coalesce(nullif(regexp_replace(regexp_extract(u, '^([a-zA-Z]+://[^/?#]+)', 1), ':\\d+$', ''), ''), nullif(u, ''), 'unknown') AS website_url, t AS title, length(t) AS title_length, d AS meta_description, length(d) AS meta_description_length,
 CAST(w AS DOUBLE) AS word_count, CASE WHEN NOT bad AND i % 4 = 0 THEN true ELSE length(t) < 30 END AS title_too_short, CASE WHEN NOT bad AND i % 4 = 0 THEN NULL ELSE t = '' END AS title_missing, length(d) < 120 AS description_too_short, length(d) > 160 AS description_too_long,
 w < 300 AS content_too_short, true AS hard_to_read, CAST(h1 AS DOUBLE) AS h1, CASE WHEN bad OR i % 3 = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END AS h2, h1 = 0 AS h1_missing, h1 > 1 AS h1_multiple, length(u) > 100 AS url_too_long, regexp_matches(u, '[^a-zA-Z0-9\\-_/.]') AS url_special, contains(u, '?') AS url_params,
 CASE WHEN NOT bad AND i % 6 = 1 THEN 2 ELSE 0 END AS broken_links, 0.0::DOUBLE AS internal_links, CASE WHEN NOT bad AND i % 9 = 0 THEN 4.0::DOUBLE ELSE 10.0::DOUBLE END AS duplicate_score, g AS seo_grade"""
_SAVED_NAMES = (
    "page_url website_url title title_length meta_description meta_description_length word_count title_too_short title_missing description_too_short description_too_long content_too_short hard_to_read h1 h2 h1_missing h1_multiple "
    "url_too_long url_special url_params broken_links internal_links duplicate_score seo_grade"
).split()


@R.query(f"WITH {_LOOSE} SELECT webpage_id, {_SAVED}, NOT bad AND i % 2 = 1 AS responsive FROM l")
def n1_sanitised_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.sanitised(_loose(spark, sf_dir), "record", ["webpage_id"]).select("webpage_id", *_SAVED_NAMES, "responsive")


@R.query(f"""WITH {_LOOSE}, v AS (SELECT *, 'undefined' AS un FROM l)
SELECT webpage_id, array_to_string(list_filter([CASE WHEN bad THEN 'title is undefined, expected string' WHEN i % 5 < 2 THEN 'title is object, expected string' WHEN no_title THEN 'title is undefined, expected string' END,
 CASE WHEN bad THEN 'metaDescription is undefined, expected string' WHEN i % 7 = 0 THEN 'metaDescription is number, expected string' WHEN no_description THEN 'metaDescription is undefined, expected string' END,
 'titleLength is undefined, expected number', 'metaDescriptionLength is undefined, expected number', CASE WHEN bad OR i % 3 = 2 OR (i % 3 = 1 AND no_words) THEN 'wordCount is undefined, expected number' WHEN i % 3 = 0 THEN 'wordCount is string, expected number' END,
 {", ".join(f"'{n} is undefined, expected number'" for n in ("titleScore", "metaDescriptionScore", "contentScore", "readabilityScore", "urlScore"))}, CASE WHEN bad OR i % 3 = 0 THEN 'headingStructure missing or invalid' END, CASE WHEN bad OR i % 8 > 0 THEN 'images missing or invalid' END,
 CASE WHEN bad OR i % 6 > 2 THEN 'links missing or invalid' END, 'technicalSeo missing or invalid', CASE WHEN bad THEN 'performance missing or invalid' END, 'contentQuality missing or invalid', CASE WHEN bad OR i % 9 > 0 THEN 'duplicates missing or invalid' END], lambda x: x IS NOT NULL), '; ') AS problems FROM v""")
def n5_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loose(spark, sf_dir).select("webpage_id", F.array_join(records.record_problems(F.col("record")), "; ").alias("problems"))


@R.query(f"""WITH {_LOOSE} SELECT webpage_id, CASE WHEN NOT bad AND i % 8 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS stored_images, CASE WHEN NOT bad AND i % 8 = 0 THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END AS images, CASE WHEN NOT bad AND i % 8 = 0 THEN 6.0::DOUBLE ELSE 0.0::DOUBLE END AS image_score,
 0.0::DOUBLE AS stored_link_score, CASE WHEN bad THEN 0.0::DOUBLE WHEN i % 6 = 0 THEN 7.0::DOUBLE WHEN i % 6 = 1 THEN 3.5::DOUBLE ELSE 0.0::DOUBLE END AS link_score, NOT bad AND i % 2 = 1 AS stored_responsive, NOT bad AND i % 2 = 0 AS responsive, CASE WHEN NOT bad AND i % 2 = 1 THEN 2.75::DOUBLE ELSE 0.0::DOUBLE END AS paint, CASE WHEN NOT bad AND i % 2 = 1 THEN 9.0::DOUBLE ELSE 0.0::DOUBLE END AS performance_score FROM l""")
def n6_mapped_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysers' records as the store keeps them, and as they were meant to be kept."""
    loose = _loose(spark, sf_dir)
    stored = records.sanitised(loose, "record", ["webpage_id"]).select("webpage_id", *[F.col(n).alias(f"stored_{n}") for n in ("images", "link_score", "responsive")])
    meant = records.sanitised(loose, "record", ["webpage_id"], intended=True).select("webpage_id", "images", "image_score", "link_score", "responsive", "paint", "performance_score")
    return stored.join(meant, "webpage_id")


_INTEGERS = ("backlinks", "refdomains", "subnets", "ips", "nofollow_backlinks", "dofollow_backlinks", "inlink_rank", "anchors")
_LISTS = (("top_anchors_by_backlinks", "anchor", "backlinks", 200), ("top_pages_by_backlinks", "url", "backlinks", 500), ("top_pages_by_refdomains", "url", "refdomains", 500))


@R.query("SELECT summary_id, " + ", ".join(f"coalesce({n}, 0) AS {n}" for n in _INTEGERS) + ", " + ", ".join(
    f"coalesce(array_to_string(list_transform(list_filter(list_transform(list_slice({c}, 1, 10), lambda x: {{'t': left(trim(x.{t}), {most}), 'n': coalesce(x.{n}, 0)}}), lambda x: x.t <> ''), lambda x: x.t || '=' || x.n), '|'), '') AS {c}" for c, t, n, most in _LISTS
) + " FROM backlink_summaries")
def n7_clean_backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backlink answers with whole numbers and the three lists cleaned."""
    listed = lambda c, t, n, most: F.array_join(F.transform(records.clean_items(F.col(c), t, n, 10, most), lambda x: F.concat(x[t], F.lit("="), x[n].cast("string"))), "|").alias(c)
    return table(spark, sf_dir, "backlink_summaries").select("summary_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in _INTEGERS], *[listed(*x) for x in _LISTS])


@R.query("""SELECT summary_id, top_anchors_by_backlinks[1].anchor AS dominating_anchor, top_pages_by_backlinks[1].url AS dominating_page,
 CASE WHEN backlinks > 0 THEN floor(refdomains * 1.0::DOUBLE / backlinks * 100 + 0.5) / 100 ELSE 0.0 END AS diversity FROM backlink_summaries""")
def n8_backlink_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "backlink_summaries").select(
        "summary_id",
        F.get("top_anchors_by_backlinks", F.lit(0)).anchor.alias("dominating_anchor"),
        F.get("top_pages_by_backlinks", F.lit(0)).url.alias("dominating_page"),
        records.diversity(F.col("refdomains"), F.col("backlinks")).alias("diversity"),
    )


@R.query("SELECT url, webpage_id, website_url, status_code, received_at FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY received_at DESC NULLS LAST, webpage_id DESC) AS r FROM webpages) WHERE r = 1")
def u1_latest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "webpages").select("url", "webpage_id", "website_url", "status_code", "received_at")
    early, late = rows.where("webpage_id % 2 = 0"), rows.where("webpage_id % 2 = 1")
    return records.upsert(early, late, ["url"], ["received_at", "webpage_id"])


@R.query("""
SELECT sitemap_url, first(website_url) AS website_url, max(seen) AS seen FROM (SELECT website_url || '/sitemap.xml' AS sitemap_url, website_url, crawled_at AS seen FROM webpages) GROUP BY 1""")
def u2_sitemap_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "webpages").select(F.concat("website_url", F.lit("/sitemap.xml")).alias("sitemap_url"), "website_url", F.col("crawled_at").alias("seen"))
    return records.latest(rows, ["sitemap_url"], ["seen"])


@R.query(r"""
WITH n AS (SELECT url, 1 AS url_type, website_url, received_at AS seen FROM webpages UNION ALL SELECT regexp_replace(url, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), 1, regexp_replace(website_url, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), received_at FROM raw_pages)
SELECT url, url_type, website_url, seen FROM (SELECT *, row_number() OVER (PARTITION BY url, url_type ORDER BY seen DESC NULLS LAST, website_url DESC NULLS LAST) AS r FROM n WHERE url IS NOT NULL) WHERE r = 1""")
def u3_url_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page nodes of the sitemap graph: those of stored pages, brought up to date by those of raw ones, by address and type."""
    bare = lambda c: F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "").alias(c)
    node = lambda rows, *columns: rows.where("url is not null").select(columns[0], F.lit(1).alias("url_type"), columns[1], F.col("received_at").alias("seen"))
    stored = node(table(spark, sf_dir, "webpages"), "url", "website_url")
    return records.upsert(stored, node(table(spark, sf_dir, "raw_pages"), bare("url"), bare("website_url")), ["url", "url_type"], ["seen", "website_url"])


@R.query(f"""SELECT DISTINCT website_url, user_id FROM activities b WHERE website_url IS NOT NULL AND user_id IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM backlink_summaries k WHERE k.website_url = b.website_url AND k.user_id = b.user_id AND k.last_fetched >= TIMESTAMP '{NOW}' - INTERVAL 7 DAYS)""")
def u4_stale_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "activities").where("website_url is not null and user_id is not null")
    return records.stale(wanted, table(spark, sf_dir, "backlink_summaries"), ["website_url", "user_id"], "last_fetched", _now())


@R.query("""
WITH w AS (SELECT DISTINCT website_url FROM webpages WHERE website_url IS NOT NULL), b AS (SELECT website_url, max(backlinks) AS backlinks FROM backlink_summaries GROUP BY 1)
SELECT w.website_url, coalesce(b.backlinks, 0) AS backlinks, b.website_url IS NULL AS created FROM w LEFT JOIN b USING (website_url)""")
def u5_found_or_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = table(spark, sf_dir, "webpages").where("website_url is not null").select("website_url").distinct()
    known = table(spark, sf_dir, "backlink_summaries").groupBy("website_url").agg(F.max("backlinks").alias("b"), F.lit(False).alias("c"))
    return sites.join(known, "website_url", "left").select("website_url", F.coalesce("b", F.lit(0)).alias("backlinks"), F.coalesce("c", F.lit(True)).alias("created"))


@R.query(f"SELECT * EXCLUDE (error_messages) FROM activities WHERE NOT coalesce(status IN ('completed', 'failed') AND end_time < TIMESTAMP '{NOW}' - INTERVAL 30 DAYS, false)")
def u7_retained_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.without_expired(table(spark, sf_dir, "activities"), "status", "end_time", _now()).drop("error_messages")


# --- Listings and statistics ------------------------------------------------------------------------------------
@R.query("SELECT webpage_id, user_activity_id FROM webpages w WHERE EXISTS (SELECT 1 FROM activities a WHERE a.activity_id = w.user_activity_id AND a.status = 'completed')")
def q1_pages_of_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "activities").where("status = 'completed'").select(F.col("activity_id").alias("user_activity_id"))
    return table(spark, sf_dir, "webpages").select("webpage_id", "user_activity_id").join(done, "user_activity_id", "left_semi").select("webpage_id", "user_activity_id")


@R.query("SELECT webpage_id, url FROM webpages WHERE status_code = 200 AND has_error = false AND regexp_matches(content_type, '(?i)^text/html') AND regexp_matches(url, '(?i)/SHOP|/products/')")
def q2_filtered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"status_code": 200, "has_error": False, "content_type": "^text/html", "url": "/SHOP|/products/", "unknown": None}
    return records.filtered(table(spark, sf_dir, "webpages"), wanted).select("webpage_id", "url")


@R.query("SELECT webpage_id, seo_score, crawled_at FROM webpages ORDER BY crawled_at DESC NULLS LAST, webpage_id OFFSET 40 LIMIT 20")
def q3_third_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.page_of(table(spark, sf_dir, "webpages").select("webpage_id", "seo_score", "crawled_at"), "crawled_at", True, "webpage_id", 3, 20)


@R.query("SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM webpages WHERE status_code >= 400")
def q4_page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "webpages").where("status_code >= 400").agg(F.count(F.lit(1)).alias("total")).select("total", F.ceil(F.col("total") / 20.0).alias("pages"))


@R.query("SELECT webpage_id, title, url FROM webpages WHERE webpage_id = 17")
def q5_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "webpages").where("webpage_id = 17").select("webpage_id", "title", "url")


@R.query("SELECT website_url, substr(CAST(status_code AS VARCHAR), 1, 1) AS status_class, count(*) AS pages FROM webpages GROUP BY 1, 2")
def q6_status_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "webpages").select("website_url", F.substring(F.col("status_code").cast("string"), 1, 1).alias("status_class"))
    return tree_aggregate(rows, ["website_url", "status_class"], [State("pages", F.count(F.lit(1)))])


@R.query("SELECT content_type, count(*) AS pages FROM webpages GROUP BY 1 ORDER BY pages DESC, content_type NULLS FIRST LIMIT 10")
def q7_content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "webpages").groupBy("content_type").agg(F.count(F.lit(1)).alias("pages")).orderBy(F.desc("pages"), F.asc_nulls_first("content_type")).limit(10)


@R.query("SELECT count(*) AS pages, count(*) FILTER (has_error) AS errors, count(*) FILTER (status_code IS NULL) AS unknown FROM webpages")
def q8_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "webpages").agg(F.count(F.lit(1)).alias("pages"), F.count_if("has_error").alias("errors"), F.count_if(F.col("status_code").isNull()).alias("unknown"))


@R.query("""
SELECT user_id, count(*) AS crawls, count(DISTINCT website_url) AS websites, CAST(coalesce(sum(webpages_successful), 0) AS BIGINT) AS good, CAST(coalesce(sum(webpages_failed), 0) AS BIGINT) AS bad,
 round_even(avg(CASE WHEN coalesce(webpages_successful, 0) + coalesce(webpages_failed, 0) > 0 THEN coalesce(webpages_successful, 0) * 100.0::DOUBLE / (coalesce(webpages_successful, 0) + coalesce(webpages_failed, 0)) ELSE 0 END), 2) AS rate FROM activities GROUP BY 1""")
def q9_user_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = F.coalesce("webpages_successful", F.lit(0)), F.coalesce("webpages_failed", F.lit(0))
    rate = F.when(good + bad > 0, good * 100.0 / (good + bad)).otherwise(0.0)
    return table(spark, sf_dir, "activities").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("crawls"), F.countDistinct("website_url").alias("websites"), F.sum(good).cast("long").alias("good"), F.sum(bad).cast("long").alias("bad"), half_even(F.avg(rate), 2).alias("rate")
    )


@R.query("SELECT count(*) AS summaries, CAST(sum(backlinks) AS BIGINT) AS backlinks, CAST(sum(refdomains) AS BIGINT) AS refdomains, round(avg(inlink_rank), 6) AS avg_rank, max(backlinks) AS most FROM backlink_summaries")
def q10_backlink_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "backlink_summaries").agg(F.count(F.lit(1)).alias("summaries"), F.sum("backlinks").alias("backlinks"), F.sum("refdomains").alias("refdomains"), F.round(F.avg("inlink_rank"), 6).alias("avg_rank"), F.max("backlinks").alias("most"))


@R.query("SELECT website_url, backlinks, refdomains FROM backlink_summaries ORDER BY backlinks DESC NULLS LAST, summary_id LIMIT 5")
def q11_top_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "backlink_summaries").orderBy(F.desc_nulls_last("backlinks"), "summary_id").limit(5).select("website_url", "backlinks", "refdomains")


@R.query("""
WITH a AS (SELECT activity_id, min(start_time) AS start_time, max(end_time) AS end_time, min(status) AS status FROM activities GROUP BY 1)
SELECT summary_id, backlinks, a.start_time, a.end_time, a.status FROM backlink_summaries b LEFT JOIN a ON a.activity_id = b.user_activity_id""")
def q12_summaries_with_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    activity = table(spark, sf_dir, "activities").groupBy(F.col("activity_id").alias("user_activity_id")).agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.min("status").alias("status"))
    return table(spark, sf_dir, "backlink_summaries").join(activity, "user_activity_id", "left").select("summary_id", "backlinks", "start_time", "end_time", "status")


@R.query("""SELECT user_id, activity_id, row_number() OVER (PARTITION BY user_id ORDER BY last_crawl_started DESC NULLS LAST, activity_id) AS place, count(*) OVER (PARTITION BY user_id) AS total
FROM (SELECT user_id, activity_id, max(last_crawl_started) AS last_crawl_started FROM activities GROUP BY 1, 2)""")
def q13_user_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = table(spark, sf_dir, "activities").groupBy("user_id", "activity_id").agg(F.max("last_crawl_started").alias("t"))
    mine = Window.partitionBy("user_id")
    return once.select("user_id", "activity_id", F.row_number().over(mine.orderBy(F.desc_nulls_last("t"), "activity_id")).alias("place"), F.count(F.lit(1)).over(mine).alias("total"))


@R.query("SELECT * EXCLUDE (user_id, error_messages) FROM activities")
def q14_without_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "activities").drop("user_id", "error_messages")


@R.query("""SELECT activity_id, CAST(epoch(end_time) - epoch(start_time) AS BIGINT) AS seconds, CASE WHEN webpages_successful + webpages_failed > 0 THEN round(webpages_successful * 100.0::DOUBLE / (webpages_successful + webpages_failed), 6) ELSE 0.0 END AS rate,
 coalesce(is_sitemap_crawling OR is_webpage_crawling OR is_backlink_fetching OR status = 'processing', false) AS active FROM activities""")
def q15_activity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("webpages_successful") + F.col("webpages_failed")
    active = F.col("is_sitemap_crawling") | F.col("is_webpage_crawling") | F.col("is_backlink_fetching") | (F.col("status") == "processing")
    seconds = F.unix_seconds(F.col("end_time").cast("timestamp")) - F.unix_seconds(F.col("start_time").cast("timestamp"))
    return table(spark, sf_dir, "activities").select("activity_id", seconds.alias("seconds"), F.when(done > 0, F.round(F.col("webpages_successful") * 100.0 / done, 6)).otherwise(0.0).alias("rate"), F.coalesce(active, F.lit(False)).alias("active"))


@R.query(f"""SELECT summary_id, CASE WHEN backlinks > 0 THEN round(dofollow_backlinks * 100.0::DOUBLE / backlinks, 6) ELSE 0.0 END AS follow_share, CAST(floor((epoch(TIMESTAMP '{NOW}') - epoch(last_fetched)) / 3600) AS BIGINT) AS age_hours,
 TIMESTAMP '{NOW}' - INTERVAL 7 DAYS < last_fetched AS fresh FROM backlink_summaries""")
def q16_summary_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.unix_seconds(_now().cast("timestamp")) - F.unix_seconds(F.col("last_fetched").cast("timestamp"))
    return table(spark, sf_dir, "backlink_summaries").select(
        "summary_id", F.when(F.col("backlinks") > 0, F.round(F.col("dofollow_backlinks") * 100.0 / F.col("backlinks"), 6)).otherwise(0.0).alias("follow_share"), F.floor(age / 3600).alias("age_hours"), (_now() - F.expr("INTERVAL 7 DAYS") < F.col("last_fetched")).alias("fresh")
    )


@R.query(f"""
SELECT website_url, summary_id, last_fetched FROM (SELECT *, row_number() OVER (PARTITION BY website_url ORDER BY last_fetched DESC NULLS LAST, summary_id DESC) AS r FROM backlink_summaries WHERE website_url IS NOT NULL)
WHERE r = 1 AND last_fetched >= TIMESTAMP '{NOW}' - INTERVAL 7 DAYS""")
def q17_fresh_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "backlink_summaries").where("website_url is not null").select("website_url", "summary_id", "last_fetched")
    return records.latest(rows, ["website_url"], ["last_fetched", "summary_id"]).where(F.col("last_fetched") >= _now() - F.expr("INTERVAL 7 DAYS"))


@R.query("""SELECT CASE WHEN GROUPING(status_class) = 0 THEN 'status' WHEN GROUPING(content_type) = 0 THEN 'type' ELSE 'all' END AS part, status_class, content_type, count(*) AS pages, count(*) FILTER (has_error) AS errors
FROM (SELECT substr(CAST(status_code AS VARCHAR), 1, 1) AS status_class, content_type, has_error FROM webpages) GROUP BY GROUPING SETS ((status_class), (content_type), ())""")
def q19_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All page statistics in one read, as grouping sets."""
    rows = table(spark, sf_dir, "webpages").select(F.substring(F.col("status_code").cast("string"), 1, 1).alias("status_class"), "content_type", "has_error")
    part = F.when(F.grouping("status_class") == 0, "status").when(F.grouping("content_type") == 0, "type").otherwise("all")
    sets = [[F.col("status_class")], [F.col("content_type")], []]
    return rows.groupingSets(sets, "status_class", "content_type").agg(part.alias("part"), F.count(F.lit(1)).alias("pages"), F.count_if("has_error").alias("errors")).select("part", "status_class", "content_type", "pages", "errors")


@R.query("SELECT source, printf('%.2f%%', avg(CASE WHEN status_code < 400 THEN 100.0 ELSE 0.0 END)) AS success, round(avg(response_time), 6) AS avg_time FROM webpages GROUP BY 1")
def q18_success_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.when(F.col("status_code") < 400, 100.0).otherwise(0.0)
    return table(spark, sf_dir, "webpages").groupBy("source").agg(F.format_string("%.2f%%", F.avg(good)).alias("success"), F.round(F.avg("response_time"), 6).alias("avg_time"))


# --- Time -------------------------------------------------------------------------------------------------------
@R.query(f"""SELECT activity_id, CASE WHEN start_time IS NULL OR progress >= 100 THEN 0 ELSE
 CAST(floor(((epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(start_time)) * 100.0::DOUBLE / greatest(coalesce(progress, 0), 1) - (epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(start_time))) / 1000 + 0.5) AS BIGINT) END AS remaining FROM activities""")
def t1_remaining_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    elapsed = F.unix_millis(_now().cast("timestamp")) - F.unix_millis(F.col("start_time").cast("timestamp"))
    return table(spark, sf_dir, "activities").select("activity_id", timeline.remaining_seconds(elapsed, F.col("progress")).alias("remaining"))


_PLACED = """WITH k AS (SELECT webpage_id, user_activity_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_activity_id) AS n FROM webpages WINDOW w AS (PARTITION BY user_activity_id ORDER BY received_at, webpage_id)),
s AS (SELECT *, least(100, ceil(n / 10.0)) AS size FROM k)"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their place among those of their activity, and the number of those."""
    order = ["received_at", "webpage_id"]
    rows = table(spark, sf_dir, "webpages").select("webpage_id", "user_activity_id", "received_at")
    return ranked(chunked(rows, "user_activity_id", order), "user_activity_id", order, "k", "n")


@R.query(f"{_PLACED} SELECT webpage_id, CAST(50 + floor(k * 1.0::DOUBLE / n * 50 + 0.5) AS BIGINT) AS progress FROM s WHERE k % 25 = 0 OR (k - 1) % size = 0 OR k % size = 0 OR k = n")
def t2_progress_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).where(timeline.emitted(F.col("k"), F.col("n"))).select("webpage_id", timeline.phase_progress("pages", F.col("k"), F.col("n")).alias("progress"))


@R.query(f"{_PLACED} SELECT webpage_id, CAST(50 + floor(k * 1.0::DOUBLE / n * 20 + 0.5) AS BIGINT) AS progress FROM s WHERE k % 10 = 0")
def t3_saved_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress while addresses are saved: told at every tenth."""
    return _placed(spark, sf_dir).where("k % 10 = 0").select("webpage_id", timeline.phase_progress("saving", F.col("k"), F.col("n")).alias("progress"))


@R.query("""SELECT activity_id, CASE WHEN sitemap_count > 0 THEN CAST(floor(least(sitemap_count, crawl_count) * 1.0::DOUBLE / sitemap_count * 30 + 0.5) AS BIGINT) ELSE 0 END AS sitemaps,
 30 + CASE WHEN sitemap_count > 0 THEN CAST(floor(least(sitemap_count, crawl_count) * 1.0::DOUBLE / sitemap_count * 20 + 0.5) AS BIGINT) ELSE 0 END AS children FROM activities""")
def t2_sitemap_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of the sitemap phases, a sitemap done for every crawl so far; an unknown number of crawls gives none."""
    done = F.when(F.col("crawl_count").isNull(), F.col("sitemap_count")).otherwise(F.least("sitemap_count", "crawl_count"))
    return table(spark, sf_dir, "activities").select("activity_id", *[timeline.phase_progress(p, done, F.col("sitemap_count")).alias(p) for p in ("sitemaps", "children")])


@R.query("""SELECT user_id, ts, event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS value, last_value(CASE WHEN event_type = 'view' THEN event_type END IGNORE NULLS) OVER w AS event_type
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def t4_merged_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("value"), F.when(F.col("event_type") == "view", F.col("event_type")).alias("event_type"))
    return timeline.latest_state(events, "user_id", ["ts", "event_id"], ["value", "event_type"])


@R.query("""
WITH r AS (SELECT user_id, event_id, ts, event_type, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events),
c AS (SELECT event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS f FROM r),
b AS (SELECT event_id, CAST(f AS BIGINT) AS failures, CAST(CASE WHEN f > 0 THEN least(2000 * pow(2, least(f, 10)), 30000) ELSE 0 END AS BIGINT) AS backoff_ms FROM c)
SELECT event_id, failures, backoff_ms, failures > 10 OR backoff_ms >= 30000 AS blocked FROM b""")
def t8_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.failure_runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "failures", "backoff_ms", "blocked")


@R.query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTES THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS began, max(ts) AS ended, count(*) AS events FROM s GROUP BY 1, 2""")
def t9_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.sessions(table(spark, sf_dir, "events"), "user_id", "ts")


@R.query("SELECT user_id, time_bucket(INTERVAL 15 MINUTES, ts, TIMESTAMP '1970-01-01') AS began, count(*) AS requests FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def t10_request_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.over_limit(table(spark, sf_dir, "events"), "user_id", "ts", 1)


@R.query("SELECT event_type, time_bucket(INTERVAL 5760 MINUTES, ts, TIMESTAMP '1970-01-01') AS began, count(*) AS requests FROM events GROUP BY 1, 2 HAVING count(*) > 200")
def t10_limited_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit of 200 requests, with kinds of events as clients and windows of four days, as no user comes near it in a quarter of an hour."""
    return timeline.over_limit(table(spark, sf_dir, "events"), "event_type", "ts", timeline.REQUEST_LIMIT, 5760)


@R.query("""
WITH r AS (SELECT user_id, event_id, ts, event_type, value, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events),
c AS (SELECT event_id, value, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS attempt FROM r)
SELECT event_id, attempt, CASE WHEN attempt <= 3 THEN CAST(5000 * pow(2, attempt) * CASE WHEN value > 50 THEN 2 ELSE 1 END AS BIGINT) END AS delay_ms FROM c WHERE attempt > 0""")
def t11_retry_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delay after every failure of a user, by how many there were in a row."""
    runs = timeline.failure_runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").where("failures > 0")
    return runs.select("event_id", F.col("failures").alias("attempt"), timeline.retry_delay(F.col("failures"), F.coalesce(F.col("value") > 50, F.lit(False))).alias("delay_ms"))


@R.query("""SELECT summary_id, CASE WHEN contains(lower(error_message), 'rate limit') OR contains(lower(error_message), '429') OR contains(lower(error_message), 'too many requests') THEN 'rate_limit'
 WHEN contains(lower(error_message), 'timeout') OR contains(lower(error_message), 'timed out') THEN 'timeout' WHEN contains(lower(error_message), '403') OR contains(lower(error_message), 'forbidden') THEN 'forbidden' WHEN error_message IS NOT NULL THEN 'general' END AS kind FROM backlink_summaries""")
def t12_error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "backlink_summaries").select("summary_id", timeline.error_class(F.col("error_message")).alias("kind"))


@R.query("""
WITH c AS (SELECT user_id, start_time AS moment, 1 AS d FROM activities WHERE start_time IS NOT NULL UNION ALL SELECT user_id, end_time, -1 FROM activities WHERE start_time IS NOT NULL AND end_time IS NOT NULL),
g AS (SELECT user_id, moment, sum(d) AS d FROM c GROUP BY 1, 2)
SELECT user_id, moment, CAST(sum(d) OVER (PARTITION BY user_id ORDER BY moment ROWS UNBOUNDED PRECEDING) AS BIGINT) AS active FROM g""")
def t13_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.concurrency(table(spark, sf_dir, "activities"), "start_time", "end_time", ["user_id"])


@R.query("SELECT user_id, activity_id, row_number() OVER (PARTITION BY user_id ORDER BY crawl_count DESC NULLS LAST, activity_id) AS turn FROM (SELECT user_id, activity_id, max(crawl_count) AS crawl_count FROM activities GROUP BY 1, 2)")
def t14_priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = table(spark, sf_dir, "activities").groupBy("user_id", "activity_id").agg(F.max("crawl_count").alias("c"))
    order = ["__last", "activity_id"]
    ordered = chunked(once.select("user_id", "activity_id", F.coalesce(-F.col("c"), F.lit(1)).alias("__last")), "user_id", order)
    return ranked(ordered, "user_id", order, "turn").select("user_id", "activity_id", "turn")


@R.query("""
WITH k AS (SELECT website_url, webpage_id, crawled_at AS ts, row_number() OVER (PARTITION BY website_url ORDER BY crawled_at) - 1 AS k FROM (SELECT website_url, min(webpage_id) AS webpage_id, crawled_at FROM webpages WHERE crawled_at IS NOT NULL GROUP BY 1, 3))
SELECT website_url, ts, make_timestamp(max(epoch_us(ts) - k * 2000000) OVER (PARTITION BY website_url ORDER BY k ROWS UNBOUNDED PRECEDING) + k * 2000000) AS scheduled FROM k""")
def t7_paced_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "webpages").where("crawled_at is not null").select("website_url", F.col("crawled_at").alias("ts")).distinct()
    return timeline.paced(requests, "website_url", "ts")


@R.query("SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS began, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def t16_hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").start.alias("began"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value"))


QUERIES, SQL = R.QUERIES, R.SQL
