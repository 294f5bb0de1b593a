"""Queries of page scores, texts and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import text as T
from auditlake.operators import duplicates, spelling
from auditlake.operators import page_scores as S
from auditlake.operators.skew import State, tree_aggregate
from auditlake.plans.registry import Registry
from auditlake.session import spread, table, written

R = Registry()
WORDS = r"len(regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+'))"
_LEN = "coalesce(length({0}), 0)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "webpages")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


TITLE = r"""CASE WHEN coalesce(length(title), 0) = 0 THEN 0.0 ELSE greatest(0.0, least(10.0, 10.0
  - CASE WHEN length(title) < 30 THEN 4 ELSE 0 END - CASE WHEN length(title) > 60 THEN 3 ELSE 0 END
  - CASE WHEN title = upper(title) AND regexp_matches(title, '\p{Lu}') THEN 1 ELSE 0 END
  - CASE WHEN length(title) - length(replace(title, '|', '')) > 2 OR length(title) - length(replace(title, '-', '')) > 3 THEN 1 ELSE 0 END
  - CASE WHEN NOT regexp_matches(title, '\p{L}') THEN 2 ELSE 0 END)) END"""
DESCRIPTION = r"""CASE WHEN coalesce(length(meta_description), 0) = 0 THEN 0.0 ELSE greatest(0.0, least(10.0, 10.0
  - CASE WHEN length(meta_description) < 80 THEN 4 ELSE 0 END - CASE WHEN length(meta_description) > 160 THEN 3 ELSE 0 END
  - CASE WHEN meta_description = upper(meta_description) THEN 1 ELSE 0 END - CASE WHEN NOT regexp_matches(meta_description, '[.!?]$') THEN 0.5 ELSE 0 END)) END"""
_PATH = "regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1)"
URL = rf"""greatest(0.0, least(10.0, 10.0 - CASE WHEN length(url) > 75 THEN 3 ELSE 0 END
  - CASE WHEN regexp_matches(url, '[^a-zA-Z0-9\-._~:/?#\[\]@!$&''()*+,;=%]') THEN 3 ELSE 0 END - CASE WHEN contains(url, '?') THEN 1 ELSE 0 END
  - CASE WHEN length(string_split(regexp_replace({_PATH}, '/+$', ''), '/')[-1]) < 3 THEN 2 ELSE 0 END
  - CASE WHEN contains(url, ' ') THEN 2 ELSE 0 END - CASE WHEN contains({_PATH}, '_') THEN 1 ELSE 0 END
  - CASE WHEN len(list_filter(string_split({_PATH}, '/'), lambda s: s <> '')) > 5 THEN 1 ELSE 0 END))"""
STORED_URL = r"""greatest(0.0, least(10.0, 10.0 - CASE WHEN length(url) > 75 THEN 2 ELSE 0 END - CASE WHEN regexp_matches(url, '[^a-zA-Z0-9\-/.]') THEN 3 ELSE 0 END
  - CASE WHEN contains(url, '?') THEN 2 ELSE 0 END - CASE WHEN length(string_split(url, '/')[-1]) < 3 THEN 2 ELSE 0 END))"""
EASE = rf"""CASE WHEN {WORDS.format("text")} > 0 THEN greatest(0.0, least(100.0, 206.835 - 1.015 * ({WORDS.format("text")} / greatest(len(regexp_extract_all(text, '[.!?]+')), 1))
  - 84.6 * (greatest(len(regexp_extract_all(lower(text), '[aeiouy]+')), 1) / {WORDS.format("text")}))) ELSE 50.0 END"""


@R.query(f"SELECT webpage_id, CAST({TITLE} AS DOUBLE) AS score, coalesce(length(title), 0) BETWEEN 1 AND 29 AS too_short, coalesce(length(title), 0) > 60 AS too_long FROM webpages")
def a1_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.coalesce(F.length("title"), F.lit(0))
    return _pages(spark, sf_dir).select("webpage_id", S.audit_title(F.col("title")).alias("score"), n.between(1, 29).alias("too_short"), (n > 60).alias("too_long"))


@R.query(f"SELECT webpage_id, CAST({DESCRIPTION} AS DOUBLE) AS score FROM webpages")
def a2_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("webpage_id", S.audit_description(F.col("meta_description")).alias("score"))


@R.query(f"SELECT doc_id, CAST({WORDS.format('text')} AS BIGINT) AS words FROM documents")
def a4_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).cast("long").alias("words"))


@R.query(f"SELECT doc_id, round({EASE}, 6) AS ease FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def a5_readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.round(T.readability(F.col("text")), 6).alias("ease"))


@R.query(rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS l FROM documents),
t AS (SELECT doc_id, len(l) AS n, unnest(l) AS word, unnest(range(len(l))) AS pos FROM w),
c AS (SELECT doc_id, any_value(n) AS n, word, count(*) AS k, min(pos) AS first FROM t GROUP BY doc_id, word),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, first) AS rank FROM c),
f AS (SELECT doc_id, max(CASE WHEN rank <= 10 AND length(word) > 3 AND k * 100.0 / n > 5 THEN 1 ELSE 0 END) AS hit FROM r GROUP BY 1)
SELECT w.doc_id, CASE WHEN length(text) < 100 OR len(l) < 50 THEN true ELSE coalesce(hit, 0) = 1 END AS low_density FROM w LEFT JOIN f ON f.doc_id = w.doc_id""")
def a8_keyword_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", T.low_density("text").alias("low_density"))


GRAMMAR = "[" + ", ".join(
    f"len(regexp_extract_all(text, '(?i){p}'))"
    for p in (r"\b(?:your)\s+(?:going|coming|doing)\b", r"\b(?:there)\s+(?:going|coming|doing)\b", r"\b(?:its)\s+a\b", r"\b(?:could|should|would)\s+of\b", r"\.\s*[a-z]", r"\bthen\s+[a-zA-Z]+er\b", r"\baffect\s+on\b", r"\bloose\s+(?:weight|money|game)\b", r"\bi\s", r"\s{2,}", r"[.!?]{2,}")
) + "]"
GRAMMAR_KEPT = "list_reduce(list_prepend(0, k), lambda s, c: s + CASE WHEN s < 50 THEN least(c, 50 - s) ELSE least(c, 1) END)"


@R.query(f"WITH c AS (SELECT doc_id, {GRAMMAR} AS k FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)) SELECT doc_id, CAST(list_sum(k) AS BIGINT) AS found, CAST({GRAMMAR_KEPT} AS BIGINT) AS kept FROM c")
def a7_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _documents(spark, sf_dir).select("doc_id", T.grammar_counts(F.col("text")).alias("k"))
    return counted.select("doc_id", F.aggregate("k", F.lit(0), lambda a, b: a + b).cast("long").alias("found"), T.soft_limit(F.col("k")).cast("long").alias("kept"))


@R.query(None)
def a7_grammar_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every grammar error that is kept, with its text, place, surroundings and what was probably meant."""
    return T.grammar_matches(_documents(spark, sf_dir), "doc_id", "text")


SPELL_WORDS = r"list_transform(list_filter(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, 'https?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+', '', 'g'), '\S+@\S+\.\S+', '', 'g'), '[0-9]+', '', 'g'), '[^\p{{L}}\p{{N}}_]', ' ', 'g'), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-zA-Z]{{3,}}')), lambda x: lower(x))"
SPELL = rf"""
sw AS (SELECT doc_id, {SPELL_WORDS.format("coalesce(text, '')")} AS l FROM documents),
tok AS (SELECT doc_id, unnest(l) AS word, unnest(range(len(l))) AS pos FROM sw),
known AS (SELECT word, count(DISTINCT doc_id) AS n FROM tok GROUP BY word HAVING count(DISTINCT doc_id) >= 3)"""
_FOUND = rf"""{SPELL},
bad AS (SELECT doc_id, batch, word FROM (SELECT doc_id, batch, word, row_number() OVER (PARTITION BY doc_id ORDER BY batch, word) AS r FROM (SELECT DISTINCT doc_id, pos // 100 AS batch, word FROM tok WHERE word NOT IN (SELECT word FROM known))) WHERE r <= 100),
near AS (SELECT b.word, k.word AS suggestion, levenshtein(b.word, k.word) AS distance, k.n FROM (SELECT DISTINCT word FROM bad) b JOIN known k ON abs(length(b.word) - length(k.word)) <= 2 AND levenshtein(b.word, k.word) <= 2),
best AS (SELECT word, suggestion, distance FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, n DESC, suggestion) AS r FROM near) WHERE r = 1)"""


def _spelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, their unknown words, and the dictionary: words that at least three documents have."""
    docs = _documents(spark, sf_dir)
    return docs, *spelling.corpus_unknown(docs, "doc_id", "text")


@R.query(f"WITH {_FOUND} SELECT doc_id, batch, bad.word, coalesce(suggestion, '') AS suggestion FROM bad LEFT JOIN best ON best.word = bad.word")
def a9_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown words, once for every hundred words of a document, with what was probably meant."""
    _, found, known = _spelled(spark, sf_dir)
    return found.join(spelling.suggestions(found, known), "word", "left").select("doc_id", "batch", "word", F.coalesce("suggestion", F.lit("")).alias("suggestion"))


@R.query(f"WITH {_FOUND} SELECT word, suggestion, distance FROM best")
def a10_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of every unknown word from what was probably meant."""
    _, found, known = _spelled(spark, sf_dir)
    return spelling.suggestions(found, known)


@R.query(None)
def a10_whole_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distances over whole texts, counted in characters of any script; SQL can't follow, as its engine counts bytes."""
    t, d, g = (F.coalesce(c, F.lit("")) for c in ("title", "meta_description", "seo_grade"))
    return _pages(spark, sf_dir).select("webpage_id", F.levenshtein(t, F.concat(g, t)).cast("long").alias("distance"), F.levenshtein(t, d).cast("long").alias("other"))


@R.query(f"WITH {_FOUND} SELECT DISTINCT bad.word, CASE WHEN suggestion IS NULL THEN 'low' WHEN distance <= 1 THEN 'high' WHEN distance <= 2 AND length(bad.word) > 4 THEN 'medium' ELSE 'low' END AS confidence FROM bad LEFT JOIN best ON best.word = bad.word")
def a11_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found, known = _spelled(spark, sf_dir)
    spelled = found.select("word").distinct().join(spelling.suggestions(found, known), "word", "left")
    return spelled.select("word", spelling.confidence(F.col("word"), F.col("suggestion"), F.col("distance")).alias("confidence"))


@R.query(f"""
WITH {_FOUND}, p AS (SELECT DISTINCT bad.doc_id, bad.word, text AS t, instr(lower(text), bad.word) AS place, length(bad.word) AS n FROM bad JOIN documents ON documents.doc_id = bad.doc_id)
SELECT doc_id, word, place - 1 AS position, CASE WHEN place > 0 THEN CASE WHEN greatest(1, place - 40) > 1 THEN '...' ELSE '' END || substr(t, greatest(1, place - 40), least(length(t) + 1, place + n + 40) - greatest(1, place - 40))
 || CASE WHEN least(length(t) + 1, place + n + 40) <= length(t) THEN '...' ELSE '' END END AS context FROM p""")
def a12_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place and surroundings of every unknown word."""
    docs, found, known = _spelled(spark, sf_dir)
    return spelling.explained(docs, "doc_id", "text", found, known).select("doc_id", "word", "position", "context").distinct()


@R.query(f"SELECT webpage_id, CAST({URL} AS DOUBLE) AS score FROM webpages WHERE url IS NOT NULL")
def a14_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).where("url is not null").select("webpage_id", S.audit_url(F.col("url")).alias("score"))


QUALITY = """CAST(greatest(0.0, least(10.0, 10.0 - CASE WHEN {words} = 0 THEN 0 WHEN {spelling} * 100.0 / {words} > 2 THEN 5 WHEN {spelling} * 100.0 / {words} > 1 THEN 3 WHEN {spelling} * 100.0 / {words} > 0.5 THEN 2 WHEN {spelling} > 0 THEN 1 ELSE 0 END
  - CASE WHEN {words} = 0 THEN 0 WHEN {grammar} * 100.0 / {words} > 1 THEN 4 WHEN {grammar} * 100.0 / {words} > 0.5 THEN 2 WHEN {grammar} > 0 THEN 1 ELSE 0 END
  + CASE WHEN {ease} >= 60 THEN 1 WHEN {ease} < 30 THEN -2 ELSE 0 END - CASE WHEN {words} < 100 THEN 3 WHEN {words} < 300 THEN 1 ELSE 0 END)) AS DOUBLE)"""


@R.query(rf"""WITH {_FOUND}, d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), c AS (SELECT doc_id, count(*) AS spelling FROM bad GROUP BY 1), m AS (SELECT doc_id, {WORDS.format("text")} AS words, {EASE} AS ease, {GRAMMAR} AS k FROM d),
b AS (SELECT m.doc_id, words, ease, {GRAMMAR_KEPT} AS grammar, coalesce(spelling, 0) AS spelling FROM m LEFT JOIN c USING (doc_id)) SELECT doc_id, {QUALITY.format(words="words", spelling="spelling", grammar="grammar", ease="ease")} AS score FROM b""")
def a20_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of documents by their spelling and grammar errors, readability and length."""
    docs, found, _ = _spelled(spark, sf_dir)
    misspelt = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("spelling"))
    t = F.col("text")
    return docs.join(misspelt, "doc_id", "left").select("doc_id", T.quality_score(T.word_count(t), F.coalesce("spelling", F.lit(0)), T.soft_limit(T.grammar_counts(t)), T.readability(t)).alias("score"))


GRADE = "CASE WHEN {0} >= 95 THEN 'A+' WHEN {0} >= 90 THEN 'A' WHEN {0} >= 85 THEN 'B+' WHEN {0} >= 80 THEN 'B' WHEN {0} >= 70 THEN 'C' WHEN {0} >= 60 THEN 'D' ELSE 'F' END"
_DUPES = """
t AS (SELECT lower(trim(title)) AS k, count(*) AS n FROM webpages WHERE trim(title) <> '' GROUP BY 1),
e AS (SELECT lower(trim(meta_description)) AS k, count(*) AS n FROM webpages WHERE trim(meta_description) <> '' GROUP BY 1)"""


@R.query(f"""WITH {_DUPES}
SELECT webpage_id,
  CAST(CASE WHEN coalesce(length(title), 0) = 0 THEN 0 ELSE greatest(0, 10 - CASE WHEN length(title) < 30 THEN 3 ELSE 0 END - CASE WHEN length(title) > 60 THEN 2 ELSE 0 END - CASE WHEN coalesce(t.n, 0) > 1 THEN 3 ELSE 0 END) END AS DOUBLE) AS title_score,
  CAST(CASE WHEN coalesce(length(meta_description), 0) = 0 THEN 0 ELSE greatest(0, 10 - CASE WHEN length(meta_description) < 80 THEN 3 ELSE 0 END - CASE WHEN length(meta_description) > 160 THEN 2 ELSE 0 END - CASE WHEN coalesce(e.n, 0) > 1 THEN 3 ELSE 0 END) END AS DOUBLE) AS description_score,
  CAST({STORED_URL} AS DOUBLE) AS url_score, CAST(greatest(0, 10 - CASE WHEN word_count < 300 THEN 4 ELSE 0 END) AS DOUBLE) AS content_score,
  CAST(greatest(0, 10 - least(5, coalesce(t.n, 1) - 1) - least(5, coalesce(e.n, 1) - 1)) AS DOUBLE) AS duplicate_score
FROM webpages w LEFT JOIN t ON t.k = lower(trim(title)) LEFT JOIN e ON e.k = lower(trim(meta_description))""")
def m1_stored_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    def counted(column: str, name: str) -> DataFrame:
        rows = pages.select(F.lower(F.trim(column)).alias(f"k_{name}")).where(f"k_{name} <> ''")
        return tree_aggregate(rows, [f"k_{name}"], [State(f"n_{name}", F.count(F.lit(1)))])
    joined = (
        pages.withColumns({"k_t": F.lower(F.trim("title")), "k_d": F.lower(F.trim("meta_description"))})
        .join(counted("title", "t"), "k_t", "left").join(counted("meta_description", "d"), "k_d", "left")
    )
    others = lambda c: F.coalesce(F.col(c), F.lit(1)) - 1
    return joined.select(
        "webpage_id",
        S.stored_title(F.col("title"), F.col("n_t") > 1).alias("title_score"),
        S.stored_description(F.col("meta_description"), F.col("n_d") > 1).alias("description_score"),
        S.stored_url(F.col("url")).alias("url_score"),
        S.stored_content(F.col("word_count"), F.lit(False)).alias("content_score"),
        S.stored_duplicates(others("n_t"), others("n_d")).cast("double").alias("duplicate_score"),
    )


@R.query("""SELECT doc_id, first_key, copies FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first_key, count(*) OVER (PARTITION BY md5(text)) AS copies FROM documents WHERE trim(text) <> '') WHERE copies > 1""")
def d6_equal_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").where(F.length(F.trim("text")) > 0).select("doc_id", F.md5("text").alias("digest"))
    return duplicates.equal_texts(hashed, "doc_id", "digest")


def _equal(column: str) -> str:
    return f"SELECT webpage_id, first_key, copies FROM (SELECT webpage_id, min(webpage_id) OVER w AS first_key, count(*) OVER w AS copies FROM webpages WHERE trim({column}) <> '' WINDOW w AS (PARTITION BY lower(trim({column})))) WHERE copies > 1"


@R.query(_equal("title"))
def d1_equal_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.equal_texts(_pages(spark, sf_dir), "webpage_id", "title")


@R.query(_equal("meta_description"))
def d2_equal_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.equal_texts(_pages(spark, sf_dir), "webpage_id", "meta_description")


@R.query(r"SELECT doc_id, md5(lower(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', '', 'g'), '\s+', ' ', 'g'), '[^\p{L}\p{M}\p{Nd}\p{Pc}\s.,!?;:\-]', '', 'g')))) AS digest FROM documents")
def d3_normalised_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.md5(T.normalised(F.col("text"))).alias("digest"))


@R.query(r"""
WITH s AS (SELECT snapshot_no, url, list_distinct(regexp_extract_all(lower(title), '[\p{L}\p{N}]+')) AS w FROM (SELECT snapshot_no, url, max(title) AS title FROM page_snapshots GROUP BY 1, 2) WHERE title IS NOT NULL)
SELECT a.url, a.snapshot_no, round(CASE WHEN len(a.w) = 0 AND len(b.w) = 0 THEN 100.0 WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w)) * 100.0 / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END, 6) AS jaccard
FROM s a JOIN s b ON a.url = b.url AND b.snapshot_no = a.snapshot_no + 1""")
def d5_title_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a page's title stays from one snapshot number to the next."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit(r"([\p{L}\p{N}]+)")))
    rows = table(spark, sf_dir, "page_snapshots").groupBy("snapshot_no", "url").agg(F.max("title").alias("title")).where("title is not null").select("snapshot_no", "url", words.alias("w"))
    later = rows.select((F.col("snapshot_no") - 1).alias("snapshot_no"), "url", F.col("w").alias("v"))
    return rows.join(later, ["snapshot_no", "url"]).select("url", "snapshot_no", F.round(duplicates.jaccard_percent(F.col("w"), F.col("v")), 6).alias("jaccard"))


_SETS = r"""
r AS (SELECT doc_id, list_sort(list_distinct(v)) AS l, len(v) AS words FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS v FROM documents WHERE length(text) > 100)),
m AS (SELECT doc_id, words, min(doc_id) OVER (PARTITION BY l) AS class_id, count(*) OVER (PARTITION BY l) AS copies FROM r WHERE len(l) > 0),
w AS (SELECT min(doc_id) AS id, l, len(l) AS n FROM r GROUP BY l HAVING len(l) > 0),
t AS (SELECT id, n, unnest(l) AS x FROM w), f AS (SELECT x, count(*) AS c FROM t GROUP BY 1),
p AS (SELECT id, n, x FROM (SELECT t.id, t.n, t.x, row_number() OVER (PARTITION BY t.id ORDER BY f.c, t.x) AS r FROM t JOIN f USING (x)) WHERE r <= n - ceil(0.7 * n) + 1),
c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.x = b.x AND a.id < b.id AND a.n >= 0.7 * b.n AND b.n >= 0.7 * a.n),
j AS (SELECT c.a, c.b, len(list_intersect(u.l, v.l)) * 100.0::DOUBLE / (u.n + v.n - len(list_intersect(u.l, v.l))) AS s FROM c JOIN w u ON u.id = c.a JOIN w v ON v.id = c.b),
k AS (SELECT a AS x, b AS y, s FROM j WHERE s >= 70 - 1e-9 UNION ALL SELECT b, a, s FROM j WHERE s >= 70 - 1e-9)"""


@R.query(f"""WITH {_SETS}
SELECT doc_id, class_id, copies, count(*) FILTER (s >= limit_) AS links, count(*) FILTER (s >= limit_ AND y < class_id) AS earlier, round(max(CASE WHEN s >= limit_ THEN s END), 6) AS best
FROM (SELECT *, CASE WHEN words < 100 THEN 85 WHEN words > 500 THEN 70 ELSE 75 END - 1e-9 AS limit_ FROM m) m LEFT JOIN k ON k.x = m.class_id GROUP BY ALL""")
def d4_similar_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document of more than 100 characters: its class of equal word sets, and the other classes that it is like by the threshold of its own number of words; how many of those are earlier."""
    every = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"))
    docs = spread(table(spark, sf_dir, "documents").where(F.length("text") > 100).select("doc_id", "text"))
    docs = written(docs.select("doc_id", F.size(every).alias("words"), F.array_sort(F.array_distinct(every)).alias("w")).where("words > 0"), "word_sets")
    return duplicates.similar_contents(docs, "doc_id", "words", "w", duplicates.CONTENT_THRESHOLDS)


_DENSITY = r"""
dw AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS l FROM documents),
dt AS (SELECT doc_id, len(l) AS n, unnest(l) AS word, unnest(range(len(l))) AS pos FROM dw),
dc AS (SELECT doc_id, any_value(n) AS n, word, count(*) AS k, min(pos) AS first FROM dt GROUP BY doc_id, word),
dr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, first) AS rank FROM dc),
df AS (SELECT doc_id, max(CASE WHEN rank <= 10 AND length(word) > 3 AND k * 100.0 / n > 5 THEN 1 ELSE 0 END) AS hit FROM dr GROUP BY 1),
density AS (SELECT dw.doc_id, CASE WHEN length(text) < 100 OR len(l) < 50 THEN true ELSE coalesce(hit, 0) = 1 END AS low_density FROM dw LEFT JOIN df ON df.doc_id = dw.doc_id)"""


@R.query(rf"""
WITH {_DENSITY}, d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), b AS (SELECT doc_id, text, {WORDS.format("text")} AS n, {EASE} AS e FROM d)
SELECT doc_id, n AS words, text = '' OR n < 300 AS too_short, text = '' OR e < 30 AS hard_to_read, text = '' OR low_density AS low_density, CASE WHEN text = '' THEN 0.0 ELSE CAST(10 - CASE WHEN n < 300 THEN 5 ELSE 0 END - CASE WHEN e < 30 THEN 2 ELSE 0 END - CASE WHEN low_density THEN 1 ELSE 0 END AS DOUBLE) END AS score FROM b JOIN density USING (doc_id)""")
def a6_content_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, issues and score of contents; empty ones have every issue and score 0."""
    n, e = T.word_count(F.col("text")), T.readability(F.col("text"))
    d, empty = _documents(spark, sf_dir).withColumn("low", T.low_density("text")), F.col("text") == ""
    return d.select("doc_id", n.cast("long").alias("words"), (empty | (n < 300)).alias("too_short"), (empty | (e < 30)).alias("hard_to_read"), (empty | F.col("low")).alias("low_density"), F.when(empty, 0.0).otherwise(T.content_score(n, F.col("low"), e)).alias("score"))


@R.query(None)
def d8_similar_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.similar_neighbours(_pages(spark, sf_dir), "website_url", "webpage_id", "title", 85)


@R.query(None)
def d2_similar_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.similar_neighbours(_pages(spark, sf_dir), "website_url", "webpage_id", "meta_description", 80)


@R.query("SELECT website_url, seo_grade, count(*) AS pages, round(avg(seo_score), 6) AS avg_score FROM webpages GROUP BY ROLLUP (website_url, seo_grade)")
def a22_grades_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).rollup("website_url", "seo_grade").agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg("seo_score"), 6).alias("avg_score"))


QUERIES, SQL = R.QUERIES, R.SQL
