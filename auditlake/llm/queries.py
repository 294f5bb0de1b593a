"""Queries pN_ of the llm problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import abuse
from auditlake.llm.format_dups import collapsed, format_duplicates
from auditlake.llm.leakage import leaked, leaks
from auditlake.llm.mojibake import garbled
from auditlake.llm.near_dups import NearDuplicates
from auditlake.llm.packing import containers, fill_report
from auditlake.llm.template_residue import residue, titles_without_residue
from auditlake.llm.truncation import cut_rates, cut_values
from auditlake.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(table(spark, sf_dir, "webpages")).select("webpage_id")


def p1_clean_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles_without_residue(table(spark, sf_dir, "webpages")).select("webpage_id", "website_url", "title")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled(table(spark, sf_dir, "webpages")).select("webpage_id", "field")


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled(table(spark, sf_dir, "webpages"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_duplicates(table(spark, sf_dir, "raw_pages"))


def p3_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapsed(table(spark, sf_dir, "raw_pages"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_values(table(spark, sf_dir, "webpages"), table(spark, sf_dir, "backlink_summaries")).select("table_name", "record_id", "item_no")


def p5_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_rates(table(spark, sf_dir, "webpages"), table(spark, sf_dir, "backlink_summaries"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDuplicates(table(spark, sf_dir, "webpages")).record_pairs()


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDuplicates(table(spark, sf_dir, "webpages")).groups()


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers(table(spark, sf_dir, "documents"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(containers(table(spark, sf_dir, "documents")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_item_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each leaked item: documents that hold a passage word for word, and with small edits only."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.groupBy("item_id").agg(F.count_if(F.col("windows") > 0).alias("documents"), F.count_if(F.col("windows") == 0).alias("edited_documents"))


#: Documents of this score or more count as abusive.
ABUSIVE = 0.5


_MODELS: dict[tuple, abuse.Model] = {}


def _model(spark: SparkSession, sf_dir: str) -> abuse.Model:
    """The model of a folder's labels, fitted once a session for the four queries; other labels or files are another model."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels")
    mark = labels.agg(F.count(F.lit(1)), F.sum(F.xxhash64("doc_id", "reviewer", "abusive") % 1_000_003)).first()
    key = (spark.sparkContext.applicationId, sf_dir, tuple(sorted(docs.inputFiles())), *mark)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = abuse.train(docs, labels)
    return _MODELS[key]


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scores(table(spark, sf_dir, "documents"), _model(spark, sf_dir), keep=("source",))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_scores(spark, sf_dir).where(F.col("score") >= ABUSIVE).select("doc_id")


def p10_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = p10_scores(spark, sf_dir)
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("score") >= ABUSIVE).alias("abusive"), F.round(F.avg(F.when(F.col("score") >= ABUSIVE, 1.0).otherwise(0.0)), 6).alias("rate"))


def p10_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.offending_sentences(table(spark, sf_dir, "documents"), _model(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p1_found, p1_clean_titles, p2_found, p2_restored, p3_found, p3_copies, p5_found, p5_source_rates, p6_found, p6_groups, p8_containers, p8_fill, p9_found, p9_item_report, p10_found, p10_scores, p10_source_rates, p10_sentences)}

_P3 = r"""
WITH f AS (SELECT raw_id, website_url w, url u, unnest(json_keys(fields)) k, fields FROM raw_pages),
e AS (SELECT raw_id, w, u, list(struct_pack(a := regexp_replace(lower(k), '[^\p{L}\p{N}]', '', 'g'),
        b := regexp_replace(lower(json_extract_string(fields, '$."' || k || '"')), '[^\p{L}\p{N}]', '', 'g'))) AS l FROM f GROUP BY 1, 2, 3),
g AS (SELECT raw_id, min(raw_id) OVER p AS first_raw_id, count(*) OVER p AS copies FROM e
      WINDOW p AS (PARTITION BY regexp_replace(lower(w), '[^\p{L}\p{N}]', '', 'g'), regexp_replace(lower(u), '[^\p{L}\p{N}]', '', 'g'), list_sort(l)))
"""

_P6 = r"""
WITH RECURSIVE w AS (SELECT webpage_id AS id, list_sort(list_distinct(regexp_extract_all(lower(title || ' ' || meta_description), '[\p{L}\p{N}]{4,}'))) AS l
           FROM webpages WHERE title <> '' AND meta_description <> ''),
d AS (SELECT id, l, len(l) AS n FROM w WHERE len(l) >= 12),
t AS (SELECT id, n, unnest(l) AS x FROM d),
f AS (SELECT x, count(*) AS c FROM t GROUP BY 1),
p AS (SELECT id, n, x FROM (SELECT t.id, t.n, t.x, row_number() OVER (PARTITION BY t.id ORDER BY f.c, t.x) AS r FROM t JOIN f USING (x)) WHERE r <= n - ceil(0.6 * n) + 1),
c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.x = b.x AND a.id < b.id AND a.n >= 0.6 * b.n AND b.n >= 0.6 * a.n)
"""

SQL = {
    "p3_found": _P3 + "SELECT first_raw_id, raw_id FROM g WHERE raw_id > first_raw_id",
    "p3_copies": _P3 + "SELECT raw_id, copies FROM g WHERE raw_id = first_raw_id",
    "p6_found": _P6 + r"""
SELECT c.a AS webpage_id_a, c.b AS webpage_id_b FROM c JOIN d u ON u.id = c.a JOIN d v ON v.id = c.b
WHERE 5 * len(list_intersect(u.l, v.l)) >= 3 * (u.n + v.n - len(list_intersect(u.l, v.l)))""",
    "p6_groups": _P6 + r""",
k AS (SELECT id, min(id) OVER (PARTITION BY l) AS class_id FROM d),
e AS (SELECT DISTINCT x.class_id AS a, y.class_id AS b FROM c JOIN d u ON u.id = c.a JOIN d v ON v.id = c.b JOIN k x ON x.id = c.a JOIN k y ON y.id = c.b
      WHERE x.class_id <> y.class_id AND 5 * len(list_intersect(u.l, v.l)) >= 3 * (u.n + v.n - len(list_intersect(u.l, v.l)))),
b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a, b FROM b UNION SELECT r.a, b.b FROM r JOIN b ON r.b = b.a)
SELECT k.id AS webpage_id, k.class_id, coalesce((SELECT min(least(r.a, r.b)) FROM r WHERE r.a = k.class_id), k.class_id) AS group_id, (SELECT count(*) FROM b WHERE b.a = k.class_id) AS links FROM k""",
    "p9_found": r"""
WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS l FROM documents),
d AS (SELECT id, unnest(list_transform(range(1, len(l) - 10), lambda k: hash(list_slice(l, k, k + 11)))) AS h FROM w WHERE len(l) >= 12),
v AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS l FROM eval_items),
i AS (SELECT id, unnest(list_transform(range(1, len(l) - 10), lambda k: hash(list_slice(l, k, k + 11)))) AS h FROM v WHERE len(l) >= 12)
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM d JOIN i USING (h)""",
}
