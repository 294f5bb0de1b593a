"""Queries pN_ of the general problems 4 and 7, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators.skew import hot_keys, site_profile
from auditlake.operators.snapshots import snapshot_changes
from auditlake.session import table

HOT_SHARE = 0.03
HOT_FIELDS = ("website_url", "user_activity_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot_keys(table(spark, sf_dir, "webpages"), HOT_FIELDS, HOT_SHARE)


def p4_site_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_profile(table(spark, sf_dir, "webpages"), "website_url")


def p4_activity_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_profile(table(spark, sf_dir, "webpages"), "user_activity_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        snapshot_changes(table(spark, sf_dir, name), key).select(F.lit(name).alias("table_name"), "snapshot_no", "row_key", "change")
        for name, key in (("page_snapshots", "url"), ("activity_snapshots", "activity_id"))
    ]
    return parts[0].unionByName(parts[1])


QUERIES = {f.__name__: f for f in (p4_found, p4_site_profile, p4_activity_profile, p7_found)}

_PROFILE = """
SELECT {key}, count(*) AS pages, CAST(sum(CASE WHEN status_code >= 400 THEN 1 ELSE 0 END) AS BIGINT) AS failures,
       count(DISTINCT url) AS urls, round(sum(seo_score) / count(seo_score), 6) AS avg_score, CAST(sum(word_count) AS BIGINT) AS words,
       min(crawled_at) AS first_crawl, max(crawled_at) AS last_crawl
FROM webpages GROUP BY 1"""


def _changes(name: str, key: str, values: str) -> str:
    return f"""
    SELECT '{name}' AS table_name, later AS snapshot_no, row_key,
           CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM (
      SELECT coalesce(a.later, b.no) AS later, coalesce(a.k, b.k) AS row_key, a.v AS o, b.v AS n
      FROM (SELECT s.later, r.k, r.v FROM {name}_rows r JOIN {name}_steps s ON r.no = s.no WHERE s.later IS NOT NULL) a
      FULL OUTER JOIN (SELECT * FROM {name}_rows WHERE no > (SELECT min(no) FROM {name}_steps)) b ON a.later = b.no AND a.k = b.k
    ) WHERE o IS DISTINCT FROM n"""


def _rows(name: str, key: str, values: str) -> str:
    return f"""{name}_rows AS (SELECT snapshot_no AS no, {key} AS k, arg_max({{{values}}}, delivered_at) AS v FROM {name} GROUP BY 1, 2),
    {name}_steps AS (SELECT no, lead(no) OVER (ORDER BY no) AS later FROM (SELECT DISTINCT snapshot_no AS no FROM {name}))"""


_SNAPSHOTS = (
    ("page_snapshots", "url", "'a': website_url, 'b': title, 'c': status_code, 'd': seo_score, 'e': crawled_at"),
    ("activity_snapshots", "activity_id", "'a': user_id, 'b': website_url, 'c': status, 'd': crawl_count, 'e': webpage_count, 'f': last_crawl_started"),
)

SQL = {
    "p4_found": f"""
WITH s AS (SELECT 'website_url' AS field, website_url AS key_value FROM webpages
           UNION ALL SELECT 'user_activity_id', user_activity_id FROM webpages)
SELECT field, key_value FROM s WHERE key_value IS NOT NULL
GROUP BY 1, 2 HAVING count(*) >= {HOT_SHARE} * (SELECT count(*) FROM webpages)""",
    "p4_site_profile": _PROFILE.format(key="website_url"),
    "p4_activity_profile": _PROFILE.format(key="user_activity_id"),
    "p7_found": "WITH " + ", ".join(_rows(*s) for s in _SNAPSHOTS) + " UNION ALL ".join(_changes(*s) for s in _SNAPSHOTS),
}
