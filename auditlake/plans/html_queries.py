"""Queries of parsed pages and of whole audits. The data has no HTML, so a page is rendered from every stored audit.

Pages differ in where they have their title, description and content, in their head, headings, pictures and links, by
their number; the SQL says what the rules give for such a page, it doesn't parse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import text as T
from auditlake.functions import urls
from auditlake.functions.html import page_facts
from auditlake.operators import page_facts as P
from auditlake.operators import page_scores as S
from auditlake.operators import spelling
from auditlake.operators.page_scores import heading_score
from auditlake.plans import page_queries as sql
from auditlake.plans.registry import Registry
from auditlake.session import spread, table, written

R = Registry()

#: Opening and closing tags of the places where content stands; after them a page without such a place, one whose place has next to nothing, and one without a body.
_PLACES = (
    ("<main>", "</main>"), ("<article>", "</article>"), ('<div role="main">', "</div>"), ('<div class="x main-content">', "</div>"), ('<div class="content">', "</div>"),
    ('<div class="post-content">', "</div>"), ('<div class="entry-content">', "</div>"), ('<div class="article-content">', "</div>"), ('<div class="page-content">', "</div>"),
    ('<div class="blog-post">', "</div>"), ('<div class="post-body">', "</div>"), ('<div id="content">', "</div>"), ('<div id="main">', "</div>"),
    ('<div class="container"><p class="content">', "</p></div>"), ('<div class="wrapper"><p class="content">', "</p></div>"), ("<div>", "</div>"), ("<article>Hi</article><div>", "</div>"), ("<div>", "</div>"),
)
_BARE, _SHORT, _BODILESS = 15, 16, 17
_HREFS = ("/next", "https://other.example/a", "http://plain.example/b", "https://www.facebook.com/x", "mailto:a@b.example", "tel:+123", "", "#top", "javascript:void(0)", "/files/report.pdf", "https://deep.example/" + "x" * 100)
_FILLER = "Fine lamps last long. "


def _repeat(n: Column, item) -> Column:
    """``item(k)`` for k from 0 to n - 1, one after the other."""
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), item), "")).otherwise("")


def rendered(pages: DataFrame) -> DataFrame:
    """(webpage_id, url, html) of every stored audit; html is null where the url is."""
    i = F.col("webpage_id")
    mod = lambda n: F.pmod(i, F.lit(n)).cast("int")
    escaped = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    t, d, page = escaped("title"), escaped("meta_description"), escaped("url")
    choose = lambda n, *texts: F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else x for x in texts]), mod(n) + 1)
    wrap = lambda before, c, after: F.concat(F.lit(before), c, F.lit(after))
    titles = (wrap("<title>", t, "</title>"), wrap('<title>  </title><meta property="og:title" content="', t, '">'), wrap('<meta name="twitter:title" content="', t, '">'), "", "")
    descriptions = (wrap('<meta name="description" content="', d, '">'), wrap('<meta property="og:description" content="', d, '">'), wrap('<meta name="twitter:description" content="', d, '">'), "")
    number = lambda k: k.cast("string")
    sheets = _repeat(mod(9), lambda k: F.concat(F.lit('<link rel="stylesheet"'), F.when((k == 0) & (mod(2) == 1), ' media="Print"').otherwise(""), F.lit(' href="/'), number(k), F.lit('.css">')))
    images = _repeat(mod(6), lambda k: F.concat(
        F.lit("<img"), F.when((mod(3) + k) % 3 > 0, ' alt="A"').otherwise(' alt=" "'), F.when((mod(2) + k) % 2 > 0, ' title="T"').otherwise(""),
        F.element_at(F.array(F.lit(' width="2500" height="10"'), F.lit(' width="9"'), F.lit(""), F.lit(' width="100" height="100"')), (mod(4) + k) % 4 + 1),
        F.element_at(F.array(F.lit(' loading="lazy"'), F.lit(' class="x lazy"'), F.lit(""), F.lit(' data-src="/c.png"'), F.lit("")), (mod(5) + k) % 5 + 1),
        F.when((mod(2) + k) % 2 == 0, ' srcset="/s.png 2x"').otherwise(""), F.element_at(F.array(F.lit(' src="/a.WEBP?v=1">'), F.lit(' src="/b.png">'), F.lit(' src="/optimized.jpg">')), (mod(3) + k) % 3 + 1),
    ))
    links = _repeat(F.when(mod(40) == 0, 200).otherwise(mod(12)), lambda k: F.concat(F.lit('<a rel="nofollow me" href="'), F.element_at(F.array(*[F.lit(h) for h in _HREFS]), (mod(11) + k) % 11 + 1), F.lit('">Go</a>')))
    headings = lambda tag, word, n: _repeat(n, lambda k: F.concat(F.lit(f"<{tag}>{word} "), number(k), F.lit(f"</{tag}>")))
    filler = F.when(mod(2) == 0, F.array_join(F.sequence(F.lit(1), F.lit(1) + F.coalesce("word_count", F.lit(0)).cast("int") % 400), " ")).otherwise(F.repeat(F.lit(_FILLER), (F.coalesce("word_count", F.lit(0)) % 100).cast("int")))
    html = F.concat(
        F.lit("<!doctype html><html><head>"), choose(4, '<meta charset="utf-8">', '<meta charset="utf-8">', '<meta http-equiv="Content-Type" content="text/html">', ""), choose(5, *titles), choose(4, *descriptions),
        F.when(F.coalesce("status_code", F.lit(0)) < 400, wrap('<link rel="canonical" href="', page, '">')).otherwise(""), choose(2, '<meta name="robots" content="index">', ""),
        choose(3, "", '<meta name="viewport" content="width=device-width, initial-scale=1">', '<meta name="viewport" content="width=600">'),
        _repeat(mod(3), lambda k: F.concat(F.lit('<link rel="alternate" hreflang="x'), number(k), F.lit('" href="/x">'))), F.lit('<script type="application/ld+json">{"@type":"Article"}</script>'), sheets,
        choose(5, "<style>@media print{}</style>", "", "", "", ""), choose(2, "", "<!-- <p>gzip</p> -->"), F.lit("</head>"), F.when(mod(18) == _BODILESS, "").otherwise("<body>"),
        F.lit('<nav><a href="/hidden">Menu</a><h2>Menu</h2><img src="/n.png"></nav>'), choose(18, *[a for a, _ in _PLACES]), F.when(mod(5) == 3, wrap("<h1>", t, "</h1>")).otherwise(""),
        headings("h1", "Top", mod(3)), wrap("<b>", d, "</b>"), wrap("<b>", filler, "</b>"), headings("h2", "Part", mod(4)), headings("h3", "Item", mod(5)), images, links, F.lit("<footer>End</footer>"), choose(18, *[b for _, b in _PLACES]),
    )
    return pages.select("webpage_id", "url", F.when(F.col("url").isNotNull(), html).alias("html"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "webpages").select("webpage_id", "url", "title", "meta_description", "status_code", "word_count")
    return page_facts(rendered(spread(pages)), keep=("webpage_id", "url"))


_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
_STRIP = "nullif(regexp_replace({0}, '" + f"^{_SPACE}+|{_SPACE}+$".replace("{", "{{").replace("}", "}}") + "', '', 'g'), '')"
_JOIN = "nullif(array_to_string(list_transform(range({0}), lambda k: '{1} ' || k), ' '), '')"
_BASE = rf"""p AS (SELECT webpage_id, webpage_id AS i, url, {_STRIP.format("title")} AS t, {_STRIP.format("meta_description")} AS d, coalesce(status_code, 0) AS s, coalesce(word_count, 0) AS w FROM webpages),
q AS (SELECT *, CASE WHEN i % 40 = 0 THEN 200 ELSE i % 12 END AS n_links, concat_ws(' ', CASE WHEN i % 5 = 3 THEN t END, {_JOIN.format("i % 3", "Top")}, d,
  CASE WHEN i % 2 = 0 THEN array_to_string(range(1, 2 + w % 400), ' ') ELSE nullif(trim(repeat('{_FILLER}', CAST(w % 100 AS INTEGER))), '') END,
  {_JOIN.format("i % 4", "Part")}, {_JOIN.format("i % 5", "Item")}, nullif(trim(repeat('Go ', CAST(CASE WHEN i % 40 = 0 THEN 200 ELSE i % 12 END AS INTEGER))), '')) AS body FROM p WHERE url IS NOT NULL),
x AS (SELECT *, CASE WHEN i % 5 IN (0, 1, 2) AND t IS NOT NULL THEN t WHEN i % 5 = 3 AND t IS NOT NULL THEN t WHEN i % 5 <> 3 AND i % 3 > 0 THEN 'Top 0' END AS title, CASE WHEN i % 4 < 3 THEN d END AS description,
  concat_ws(' ', CASE WHEN i % 18 = {_SHORT} THEN 'Hi' END, nullif(body, '')) AS inner_text, concat_ws(' ', CASE WHEN i % 5 = 0 THEN t END, CASE WHEN i % 18 = {_SHORT} THEN 'Hi' END, nullif(body, '')) AS all_text FROM q),
c AS (SELECT *, CASE WHEN i % 18 <> {_BODILESS} AND length(inner_text) > 10 THEN inner_text WHEN length(all_text) > 10 THEN all_text ELSE '' END AS content FROM x)"""


@R.query(f"WITH {_BASE} SELECT p.webpage_id, c.title, c.description, CASE WHEN p.url IS NULL THEN 'empty page' END AS error FROM p LEFT JOIN c USING (webpage_id)")
def x1_title_and_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("webpage_id", P.page_title().alias("title"), P.page_description().alias("description"), "facts.error")


@R.query(f"WITH {_BASE} SELECT webpage_id, content FROM c")
def x4_main_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).where("url is not null").select("webpage_id", "facts.content")


@R.query(f"WITH {_BASE} SELECT webpage_id, contains(content, 'Menu') AS menu, contains(content, '@media') AS styles, contains(content, 'gzip') AS comments, contains(content, '{{') AS scripts FROM c")
def x3_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of pruned elements is in the content: only what stands in the page's own texts."""
    content = F.col("facts.content")
    return _parsed(spark, sf_dir).where("url is not null").select("webpage_id", content.contains("Menu").alias("menu"), content.contains("@media").alias("styles"), content.contains("gzip").alias("comments"), content.contains("{").alias("scripts"))


_H1 = "(i % 3 + CASE WHEN i % 5 = 3 THEN 1 ELSE 0 END)"
_HEADINGS = f"CAST(greatest(0, 10 - CASE WHEN {_H1} = 0 THEN 6 WHEN {_H1} > 1 THEN 4 ELSE 0 END - CASE WHEN (i % 4 > 0 AND {_H1} = 0) OR (i % 5 > 0 AND i % 4 = 0) THEN 2 ELSE 0 END) AS DOUBLE)"


@R.query(f"""WITH {_BASE}
SELECT webpage_id, CAST({_H1} AS BIGINT) AS h1, CAST(i % 4 AS BIGINT) AS h2, CAST(i % 5 AS BIGINT) AS h3, 0::BIGINT AS h4, {_H1} = 0 AS h1_missing, {_H1} > 1 AS h1_multiple,
 concat_ws('|', CASE WHEN i % 5 = 3 THEN coalesce(t, '') END, nullif(array_to_string(list_transform(range(i % 3), lambda k: 'Top ' || k), '|'), '')) AS h1_texts, {_HEADINGS} AS score FROM c""")
def a13_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _parsed(spark, sf_dir).where("url is not null").select("webpage_id", *P.heading_counts()[:4], F.array_join(P.heading_texts(1), "|").alias("h1_texts"))
    return counted.withColumns({"h1_missing": F.col("h1") == 0, "h1_multiple": F.col("h1") > 1, "score": heading_score(F.col("h1"), F.col("h2"), F.col("h3"))})


_TECHNICAL = "CAST(8 - CASE WHEN s < 400 THEN 0 ELSE 3 END - i % 2 - CASE WHEN i % 3 = 0 THEN 2 ELSE 0 END - CASE WHEN i % 4 = 3 THEN 1 ELSE 0 END AS DOUBLE)"


@R.query(f"""WITH {_BASE} SELECT webpage_id, CASE WHEN s < 400 THEN url END AS canonical, CASE WHEN i % 2 = 0 THEN 'index' END AS robots, CAST(i % 3 AS BIGINT) AS hreflang, 0::BIGINT AS structured,
 i % 3 > 0 AS has_viewport, i % 4 < 3 AS has_charset, {_TECHNICAL} AS score FROM c""")
def a15_technical(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _parsed(spark, sf_dir).where("url is not null")
    return parsed.select("webpage_id", "facts.canonical", "facts.robots", F.size("facts.hreflang").cast("long").alias("hreflang"), F.size("facts.ld_types").cast("long").alias("structured"), "facts.has_viewport", "facts.has_charset", P.technical_score().alias("score"))


_IMAGES = """g AS (SELECT webpage_id, count(*) AS total, count_if((i % 3 + k) % 3 > 0) AS with_alt, count_if((i % 2 + k) % 2 > 0) AS with_title, count_if((i % 4 + k) % 4 IN (0, 3)) AS with_dimensions, count_if((i % 5 + k) % 5 < 2) AS lazy,
   count_if((i % 2 + k) % 2 = 0) AS responsive, count_if((i % 4 + k) % 4 = 0) AS oversized, count_if((i % 3 + k) % 3 = 0) AS next_gen, count_if((i % 3 + k) % 3 = 1) AS unoptimized FROM (SELECT webpage_id, i, unnest(range(i % 6)) AS k FROM c) GROUP BY 1),
gs AS (SELECT *, CAST(10 - CASE WHEN (total - with_alt) > 0.7 * total THEN 6 WHEN (total - with_alt) > 0.5 * total THEN 4 WHEN (total - with_alt) > 0.3 * total THEN 2 ELSE 0 END
   - CASE WHEN oversized > 0.3 * total THEN 2 ELSE 0 END - CASE WHEN responsive < 0.3 * total THEN 1 ELSE 0 END AS DOUBLE) AS score FROM g)"""
_IMAGE_NAMES = ("total", "with_alt", "with_title", "with_dimensions", "lazy", "responsive", "oversized", "next_gen", "unoptimized")


@R.query(f"WITH {_BASE}, {_IMAGES} SELECT c.webpage_id, {', '.join(f'coalesce({n}, 0)::BIGINT AS {n}' for n in _IMAGE_NAMES)}, coalesce(score, 10.0) AS score FROM c LEFT JOIN gs ON gs.webpage_id = c.webpage_id")
def a16_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = _parsed(spark, sf_dir).where("url is not null").select("webpage_id", P.image_measures().alias("m"))
    return measured.select("webpage_id", *[F.col(f"m.{n}") for n in _IMAGE_NAMES], P.image_score(F.col("m")).alias("score"))


_ORIGIN = "regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1)"
_LINKS = f"""a AS (SELECT webpage_id, url, k, (i % 11 + k) % 11 AS v FROM (SELECT webpage_id, i, url, unnest(range(n_links)) AS k FROM c)),
b AS (SELECT webpage_id, k, v, lower({_ORIGIN.format()}) AS home, CASE v WHEN 0 THEN {_ORIGIN} || '/next' WHEN 1 THEN '{_HREFS[1]}' WHEN 2 THEN '{_HREFS[2]}' WHEN 3 THEN '{_HREFS[3]}' WHEN 9 THEN {_ORIGIN} || '/files/report.pdf' WHEN 10 THEN '{_HREFS[10]}' END AS link FROM a),
o AS (SELECT webpage_id, link, row_number() OVER (PARTITION BY webpage_id ORDER BY k) - 1 AS place, v FROM b WHERE link IS NOT NULL),
ch AS (SELECT webpage_id, place, link, CASE WHEN starts_with(link, 'http://') THEN 'http' WHEN length(link) % 7 = 0 THEN 'client_error' WHEN length(link) % 7 = 1 THEN 'redirect' WHEN length(link) % 7 = 2 THEN 'server_error' WHEN length(link) % 7 = 3 THEN 'timeout' ELSE 'ok' END AS kind
  FROM o WHERE place < 150 AND v <> 9),
br AS (SELECT webpage_id, count_if(kind IN ('client_error', 'server_error', 'timeout')) AS broken, count_if(kind = 'redirect') AS redirects, count_if(kind = 'http') AS plain FROM ch GROUP BY 1),
lm AS (SELECT webpage_id, count_if(v NOT IN (6, 7, 8)) AS total, count_if(v IN (0, 9)) + count_if(v NOT IN (0, 9) AND lower(regexp_extract(link, '^([a-zA-Z]+://[^/?#]+)', 1)) = home) AS internal,
  count_if(v IN (1, 2, 3, 10) AND lower(regexp_extract(link, '^([a-zA-Z]+://[^/?#]+)', 1)) <> home) AS external, count_if(regexp_matches(lower(regexp_extract(link, '^[a-zA-Z]+://([^/?#]+)', 1)), '{"|".join(h.replace(".", "[.]") for h in urls.SOCIAL_HOSTS)}')) AS social, count(link) AS no_follow,
  count_if(regexp_matches(lower(link), '\\.({"|".join(urls.FILE_ENDINGS)})')) AS downloads, count_if(length(link) > 100) AS long, count_if(v = 4) AS email, count_if(v = 5) AS phone, count_if(v = 6) AS empty FROM b GROUP BY 1),
ls AS (SELECT lm.*, coalesce(broken, 0) AS broken, coalesce(redirects, 0) AS redirects, coalesce(plain, 0) AS plain, CASE WHEN total = 0 THEN 10.0 ELSE CAST(greatest(0, 10 - CASE WHEN coalesce(broken, 0) > 0.15 * total THEN 8 WHEN coalesce(broken, 0) > 0.1 * total THEN 6 WHEN coalesce(broken, 0) > 0.05 * total THEN 3 WHEN coalesce(broken, 0) > 0 THEN 1 ELSE 0 END
  - CASE WHEN internal = 0 AND external > 0 THEN 2 ELSE 0 END - CASE WHEN external > internal * 3 THEN 1 ELSE 0 END) AS DOUBLE) END AS score FROM lm LEFT JOIN br USING (webpage_id))"""
_LINK_NAMES = ("total", "internal", "external", "social", "no_follow", "downloads", "long", "email", "phone", "empty", "broken", "redirects", "plain")


def _answered(parsed: DataFrame) -> DataFrame:
    """Checked links of the pages with their kind; every distinct link is asked once, here by a rule instead of the network."""
    checked = P.checked_links(parsed.select("webpage_id", P.page_links(F.col("url")).alias("links")), "webpage_id", "links")
    n = F.length("link") % 7
    answers = checked.select("link").distinct().select("link", F.when(n == 0, 404).when(n == 1, 301).when(n == 2, 500).when(n > 3, 200).alias("status"), F.when(n == 3, "timeout").alias("problem"))
    return P.link_results(checked, answers)


_BROKEN = ("client_error", "server_error", "timeout", "unknown_error")


def _measured_links(parsed: DataFrame) -> DataFrame:
    """(webpage_id, l): the measures of a page's links, what became of those that were checked, and the score."""
    counts = _answered(parsed).groupBy("webpage_id").agg(F.count_if(F.col("kind").isin(*_BROKEN)).alias("broken"), F.count_if(F.col("kind") == "redirect").alias("redirects"), F.count_if(F.col("kind") == "http").alias("plain"))
    both = parsed.select("webpage_id", P.link_measures(F.col("url")).alias("m")).join(counts, "webpage_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select("webpage_id", F.struct("m.*", n("broken"), n("redirects"), n("plain"), P.link_score(F.col("m"), F.coalesce("broken", F.lit(0))).alias("score")).alias("l"))


@R.query(f"WITH {_BASE}, {_LINKS} SELECT c.webpage_id, {', '.join(f'coalesce({n}, 0)::BIGINT AS {n}' for n in _LINK_NAMES)}, coalesce(score, 10.0) AS score FROM c LEFT JOIN ls ON ls.webpage_id = c.webpage_id")
def a17_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = written(_parsed(spark, sf_dir).where("url is not null"), "parsed")
    return _measured_links(parsed).select("webpage_id", *[F.col(f"l.{n}") for n in _LINK_NAMES], "l.score")


@R.query(f"WITH {_BASE}, {_LINKS} SELECT webpage_id, place, link, kind FROM ch")
def a18_link_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answered(_parsed(spark, sf_dir).where("url is not null")).select("webpage_id", F.col("place").cast("long").alias("place"), "link", "kind")


_BLOCKING = "(i % 9 - CASE WHEN i % 9 > 0 THEN i % 2 ELSE 0 END)"
_PERFORMANCE = f"CAST(10 - CASE WHEN i % 3 = 0 THEN 3 ELSE 0 END - CASE WHEN i % 3 = 1 THEN 0 ELSE 2 END - CASE WHEN {_BLOCKING} > 5 THEN 1 ELSE 0 END - CASE WHEN i % 2 = 0 THEN 1 ELSE 0 END AS DOUBLE)"


@R.query(f"""WITH {_BASE} SELECT webpage_id, i % 3 > 0 AS has_viewport, i % 3 = 1 AS responsive, i % 5 = 0 AS has_media_queries, i % 2 = 1 AS compressed, CAST({_BLOCKING} AS BIGINT) AS blocking_stylesheets, 1.0::DOUBLE AS largest_paint,
 CAST(round_even({_BLOCKING} * 0.02::DOUBLE, 2) AS DOUBLE) AS layout_shift, 'good' AS paint_rating, CASE WHEN {_BLOCKING} <= 5 THEN 'good' ELSE 'needs_improvement' END AS shift_rating, {_PERFORMANCE} AS score FROM c""")
def a19_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).where("url is not null").select("webpage_id", P.performance().alias("m")).select("webpage_id", "m.*").drop("page_kb")


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a page: what both rule sets need of it. A page that can't be parsed has an error and no facts."""
    parsed = written(_parsed(spark, sf_dir), "parsed")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = written(spelling.dictionary(spelling.tokens(docs, "doc_id", "text"), "doc_id"), "dictionary")
    good = parsed.where("facts.error is null")
    texts = good.select("webpage_id", F.col("facts.content").alias("content"))
    misspelt = spelling.unknown_words(spelling.tokens(texts, "webpage_id", "content"), known, "webpage_id").groupBy("webpage_id").agg(F.count(F.lit(1)).alias("spelling"))
    c = F.col("facts.content")
    measured = parsed.select(
        "webpage_id", "url", F.col("facts.error").alias("error"), P.page_title().alias("title"), P.page_description().alias("description"), c.alias("content"),
        *P.heading_counts()[:3], P.technical_score().alias("technical"), F.col("facts.canonical").alias("canonical"), F.col("facts.robots").alias("robots"), P.image_measures().alias("g"), P.performance().alias("f"),
        T.word_count(c).alias("words"), T.readability(c).alias("ease"), T.low_density(c).alias("low_density"), T.soft_limit(T.grammar_counts(c)).alias("grammar"),
    )
    return measured.join(misspelt, "webpage_id", "left").withColumn("spelling", F.coalesce("spelling", F.lit(0))).join(_measured_links(good), "webpage_id", "left")


_MEASURES = rf"""
{sql.SPELL}, k AS (SELECT webpage_id, unnest(l) AS word, unnest(range(len(l))) AS pos FROM (SELECT webpage_id, {sql.SPELL_WORDS.format("content")} AS l FROM c)),
e AS (SELECT webpage_id, least(count(*), 100) AS spelling FROM (SELECT DISTINCT webpage_id, pos // 100, word FROM k WHERE word NOT IN (SELECT word FROM known)) GROUP BY 1),
dw AS (SELECT webpage_id, regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]+') AS l, length(content) AS n FROM c),
dc AS (SELECT webpage_id, word, count(*) AS k, min(pos) AS first, any_value(m) AS m FROM (SELECT webpage_id, unnest(l) AS word, unnest(range(len(l))) AS pos, len(l) AS m FROM dw) GROUP BY 1, 2),
dr AS (SELECT webpage_id, max(CASE WHEN length(word) > 3 AND k * 100.0 / m > 5 THEN 1 ELSE 0 END) AS hit FROM (SELECT *, row_number() OVER (PARTITION BY webpage_id ORDER BY k DESC, first) AS r FROM dc) WHERE r <= 10 GROUP BY 1),
m AS (SELECT c.*, text, {sql.WORDS.format("text")} AS words, {sql.EASE} AS ease, {sql.GRAMMAR} AS k FROM (SELECT *, content AS text FROM c) c),
n AS (SELECT m.*, {_H1} AS h1, i % 4 AS h2, i % 5 AS h3, coalesce(e.spelling, 0) AS spelling, {sql.GRAMMAR_KEPT} AS grammar, CASE WHEN dw.n < 100 OR len(dw.l) < 50 THEN true ELSE coalesce(hit, 0) = 1 END AS low_density, coalesce(gs.score, 10.0) AS image_score,
   coalesce(gs.total, 0) AS images, coalesce(gs.total - gs.with_alt, 0) AS bare, coalesce(ls.score, 10.0) AS link_score, coalesce(ls.internal + ls.external, 0) AS links, coalesce(ls.broken, 0) AS broken, coalesce(ls.redirects, 0) AS redirects, coalesce(ls.plain, 0) AS plain
  FROM m LEFT JOIN e USING (webpage_id) LEFT JOIN dw USING (webpage_id) LEFT JOIN dr USING (webpage_id) LEFT JOIN gs USING (webpage_id) LEFT JOIN ls USING (webpage_id))"""
_SCORES = rf"""
z AS (SELECT *, CAST({sql.TITLE.replace("title", "x_title")} AS DOUBLE) AS title_score, CAST({sql.DESCRIPTION.replace("meta_description", "description")} AS DOUBLE) AS meta_score,
  CAST(CASE WHEN content = '' THEN 0 ELSE 10 - CASE WHEN words < 300 THEN 5 ELSE 0 END - CASE WHEN ease < 30 THEN 2 ELSE 0 END - CASE WHEN low_density THEN 1 ELSE 0 END END AS DOUBLE) AS content_score, {_HEADINGS} AS headings_score, CAST({sql.URL} AS DOUBLE) AS url_score,
  {_TECHNICAL} AS technical_score, {_PERFORMANCE} AS performance_score,
  CASE WHEN content = '' THEN 0.0::DOUBLE ELSE {sql.QUALITY.format(words="words", spelling="spelling", grammar="grammar", ease="ease")} END AS quality_score FROM (SELECT *, title AS x_title FROM n)),
y AS (SELECT *, CAST(round_even(round((title_score * 0.1::DOUBLE + meta_score * 0.1::DOUBLE + content_score * 0.15::DOUBLE + headings_score * 0.1::DOUBLE + url_score * 0.05::DOUBLE + technical_score * 0.1::DOUBLE
  + image_score * 0.05::DOUBLE + link_score * 0.1::DOUBLE + performance_score * 0.15::DOUBLE + quality_score * 0.1::DOUBLE) * 10, 9), 0) AS DOUBLE) AS total FROM z)"""
_AUDIT_NAMES = ("title", "meta", "content", "headings", "url", "technical", "image", "link", "performance", "quality")
_CTES = f"WITH {_BASE}, {_IMAGES}, {_LINKS}, {_MEASURES}, {_SCORES}"


def _audit_parts() -> dict[str, Column]:
    zero = lambda c: F.when(F.col("content") == "", 0.0).otherwise(c)
    return {
        "title": S.audit_title(F.col("title")), "meta": S.audit_description(F.col("description")), "content": zero(T.content_score(F.col("words"), F.col("low_density"), F.col("ease"))),
        "headings": heading_score(F.col("h1"), F.col("h2"), F.col("h3")), "url": S.audit_url(F.col("url")), "technical": F.col("technical"), "images": P.image_score(F.col("g")), "links": F.col("l.score"),
        "performance": F.col("f.score"), "quality": zero(T.quality_score(F.col("words"), F.col("spelling"), F.col("grammar"), F.col("ease"))),
    }


@R.query(f"""{_CTES} SELECT p.webpage_id, CASE WHEN p.url IS NULL THEN 'empty page' END AS error, {", ".join(f"{n}_score" for n in _AUDIT_NAMES)}, total, CASE WHEN total IS NOT NULL THEN {sql.GRADE.format("total")} END AS grade FROM p LEFT JOIN y USING (webpage_id)""")
def a23_page_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole audit of every page by the analyser's rules: ten scores, the total and the grade; a page that can't be parsed has an error instead."""
    parts = _audit_parts()
    good = lambda c: F.when(F.col("error").isNull(), c)
    names = dict(zip(_AUDIT_NAMES, parts, strict=True))
    scored = _audited(spark, sf_dir).select("webpage_id", "error", *[good(parts[part]).alias(f"{n}_score") for n, part in names.items()], good(S.total_score(parts, stored=False)).alias("total"))
    return scored.withColumn("grade", F.when(F.col("total").isNotNull(), S.grade(F.col("total"))))


_HALF_UP = "floor({0} + 0.5)"
_SHARE = "least({most}, " + _HALF_UP.format("{part} * {times}::DOUBLE / {whole}") + ")"
_STORED = rf"""
v AS (SELECT *, CAST(CASE WHEN title IS NULL THEN 0 ELSE greatest(0, 10 - CASE WHEN length(title) < 30 THEN 3 ELSE 0 END - CASE WHEN length(title) > 60 THEN 2 ELSE 0 END) END AS DOUBLE) AS v_title,
  CAST(CASE WHEN description IS NULL THEN 0 ELSE greatest(0, 10 - CASE WHEN length(description) < 80 THEN 3 ELSE 0 END - CASE WHEN length(description) > 160 THEN 2 ELSE 0 END) END AS DOUBLE) AS v_meta,
  CAST(10 - CASE WHEN words < 300 THEN 4 ELSE 0 END - CASE WHEN low_density THEN 2 ELSE 0 END AS DOUBLE) AS v_content, CAST(10 - CASE WHEN h1 = 0 THEN 5 WHEN h1 > 1 THEN 3 ELSE 0 END AS DOUBLE) AS v_headings,
  CAST({sql.STORED_URL} AS DOUBLE) AS v_url, CAST(10 - CASE WHEN s < 400 THEN 0 ELSE 3 END - i % 2 AS DOUBLE) AS v_technical,
  CAST(CASE WHEN images = 0 THEN 10 ELSE 10 - {_SHARE.format(most=6, part="bare", times=10, whole="images")} END AS DOUBLE) AS v_images,
  CAST(CASE WHEN links = 0 THEN 5 ELSE greatest(0, 10 - {_SHARE.format(most=10, part="broken", times=20, whole="links")} - {_SHARE.format(most=4, part="plain", times=8, whole="links")} - {_SHARE.format(most=3, part="redirects", times=6, whole="links")}) END AS DOUBLE) AS v_links,
  CAST(6 - CASE WHEN i % 3 = 1 THEN 0 ELSE 5 END - CASE WHEN {_BLOCKING} * 0.02::DOUBLE > 0.1::DOUBLE THEN 1 ELSE 0 END AS DOUBLE) AS v_performance,
  CAST(greatest(0, 10 - CASE WHEN spelling = 0 THEN 0 WHEN words = 0 THEN 5 ELSE {_HALF_UP.format("least(1.0::DOUBLE, spelling * 100.0::DOUBLE / words) * 5")} END - CASE WHEN grammar = 0 THEN 0 WHEN words = 0 THEN 4 ELSE {_HALF_UP.format("least(1.0::DOUBLE, grammar * 100.0::DOUBLE / words) * 4")} END) AS DOUBLE) AS v_quality FROM n),
u AS (SELECT *, CAST(floor(round((v_title * 0.1::DOUBLE + v_meta * 0.1::DOUBLE + v_content * 0.15::DOUBLE + v_headings * 0.1::DOUBLE + v_url * 0.05::DOUBLE + v_technical * 0.1::DOUBLE + v_images * 0.05::DOUBLE + v_links * 0.1::DOUBLE
  + greatest(0.0, v_performance) * 0.15::DOUBLE + v_quality * 0.1::DOUBLE) * 10, 9) + 0.5) AS DOUBLE) AS total FROM v)"""
_STORED_NAMES = ("title", "meta", "content", "headings", "url", "technical", "images", "links", "performance", "quality")


@R.query(f"""WITH {_BASE}, {_IMAGES}, {_LINKS}, {_MEASURES}, {_STORED} SELECT webpage_id, {", ".join(f"greatest(0.0, v_{n}) AS {n}_score" for n in _STORED_NAMES)}, total, {sql.GRADE.format("total")} AS grade,
 '[' || array_to_string(list_filter([CASE WHEN title IS NULL THEN 'Missing title tag' END, CASE WHEN description IS NULL THEN 'Missing meta description' END, CASE WHEN h1 = 0 THEN 'Missing H1 tag' END, CASE WHEN broken > 0 THEN broken || ' broken links' END,
 CASE WHEN i % 3 <> 1 THEN 'Not mobile responsive' END, 'Very slow page speed'], lambda x: x IS NOT NULL), ', ') || ']' AS issues FROM u""")
def m12_stored_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audits as the store scores them again, with its fields mapped as intended; large pictures and the page speed, which no analyser gives, count 0, and so do equal titles, which are scored apart."""
    L = F.lit  # noqa: N806
    page = _audited(spark, sf_dir).where("error is null")
    bare = F.col("g.total") - F.col("g.with_alt")
    pages = F.col("l.internal") + F.col("l.external")
    parts = {
        "title": S.stored_title(F.col("title"), L(False)), "meta": S.stored_description(F.col("description"), L(False)), "content": S.stored_content(F.col("words"), F.col("low_density")),
        "headings": S.stored_headings(F.col("h1"), L(False)), "url": S.stored_url(F.col("url")), "technical": S.stored_technical(F.col("canonical"), F.col("robots")), "images": S.stored_images(F.col("g.total"), F.least(bare, L(P.LISTED_IMAGES)), L(0)),
        "links": S.stored_links(pages, F.col("l.broken"), F.col("l.plain"), F.col("l.redirects")), "performance": S.stored_performance(F.col("f.responsive"), L(0), F.col("f.largest_paint"), F.col("f.layout_shift")),
        "quality": S.stored_quality(F.col("words"), F.col("spelling"), F.col("grammar"), L(0)),
    }
    issues = S.critical_issues(F.col("title"), F.col("description"), F.col("h1"), F.col("l.broken"), F.col("f.responsive"), L(0))
    scored = page.select("webpage_id", *[c.alias(f"{n}_score") for n, c in parts.items()], S.total_score(parts, stored=True).alias("total"), F.concat(L("["), F.array_join(issues, ", "), L("]")).alias("issues"))
    return scored.withColumn("grade", S.grade(F.col("total")))


QUERIES, SQL = R.QUERIES, R.SQL
