"""Page queries that SQL can't follow, against brute force."""

import random
from urllib.parse import urljoin

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.functions import html, text, urls
from auditlake.operators import duplicates, page_facts, spelling
from auditlake.plans import page_queries
from tests.oracle import connection, rows_of_spark, rows_of_sql


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_whole_edit_distance(spark, tmp_path):
    rows = [(1, "Новые книги", "Новые лампы и книги для детей в каталоге, всего 12", "A"), (2, "a" * 50, "a" * 45 + "b" * 30, "B+"), (3, None, "x", None), (4, "crêpes 🙂 légères", "crepes légères", ""), (5, "", None, "F"), (6, "Garden chairs " * 40, "Garden tables " * 39, "C")]
    spark.createDataFrame(rows, "webpage_id long, title string, meta_description string, seo_grade string").write.parquet(f"{tmp_path}/webpages.parquet")
    got = {r.webpage_id: (r.distance, r.other) for r in page_queries.QUERIES["a10_whole_edit_distance"](spark, str(tmp_path)).collect()}
    assert got == {i: (levenshtein(t or "", (g or "") + (t or "")), levenshtein(t or "", d or "")) for i, t, d, g in rows}


@pytest.mark.parametrize(("name", "column", "least"), [("d8_similar_titles", "title", 85), ("d2_similar_descriptions", "meta_description", 80)])
def test_similar_texts_against_brute_force(spark, tmp_path, name, column, least):
    rnd = random.Random(least)
    texts = ["Garden chairs shop", "Garden chair shop", " garden CHAIRS shop ", "ab", "axb", "abc", "a", "aaaa", "aaaaa", "aaaaaaa", "Новые книги для детей", "Новая книга для детей", None, "", "  "]
    for _ in range(40):
        base = " ".join(rnd.choice("garden chairs shop lamps buy wooden new и книги".split()) for _ in range(rnd.randrange(1, 7)))
        for _ in range(4):
            chars = list(base)
            for _ in range(rnd.randrange(0, 6)):
                chars[rnd.randrange(len(chars))] = rnd.choice(["", "x", "e ", chars[0]])
            texts.append("".join(chars))
    rows = [(i, t, f"https://{i % 3 == 0}.example") for i, t in enumerate(texts)]
    rows += [(1000 + i, t, "https://one.example") for i, t in enumerate(texts[:60])]
    pages = spark.createDataFrame(rows, f"webpage_id long, {column} string, website_url string")
    pages.write.parquet(f"{tmp_path}/webpages.parquet")
    first = {}
    for i, t, s in rows:
        if t and t.strip():
            first.setdefault((s, t.strip(" ").lower()), []).append(i)
    want = {(s, g[0], i, 100) for (s, _), g in first.items() for i in g[1:]}
    for (s, t), g in first.items():
        for (r, u), h in first.items():
            if s == r and g[0] < h[0] and (score := duplicates.ratio(t, u)) >= least:
                want.add((s, g[0], h[0], score))
    got = [tuple(r) for r in page_queries.QUERIES[name](spark, str(tmp_path)).select("website_url", "a", "b", "score").collect()]
    assert len(want) > 50 and len(got) == len(set(got))
    assert set(got) == want


@pytest.mark.parametrize(("least", "sketched"), [(85, 1000), (80, 0)])
def test_similar_texts_meet_in_blocks(spark, monkeypatch, least, sketched):
    """No pairs of characters are exploded to find similar texts; many small blocks and tiles, with sketches or rare characters, give what brute force gives."""
    rnd = random.Random(least)
    bases = [" ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n)) for n in (2, 5, 9, 14, 30)] + ["Новые книги для детей и взрослых", "\U0001f642 新しい本"]
    texts = {}
    for i in range(140):
        chars = list(rnd.choice(bases))
        for _ in range(rnd.randrange(0, len(chars) // 4)):
            chars[rnd.randrange(len(chars))] = rnd.choice(["", "x", "e ", "ж"])
        texts.setdefault(" ".join("".join(chars).lower().split(" ")).strip() or "x", i)
    pages = spark.createDataFrame([(i, t, "s") for t, i in texts.items()] + [(1000 + i, t, f"t{i % 9}") for t, i in texts.items()], "k long, t string, s string")
    site = lambda i: "s" if i < 1000 else f"t{i % 1000 % 9}"
    every = [(i, t) for t, i in texts.items()] + [(1000 + i, t) for t, i in texts.items()]
    want = {(site(i), i, j, r) for i, t in every for j, u in every if i < j and site(i) == site(j) and (r := duplicates.ratio(t, u)) >= least}
    one = duplicates.similar_neighbours(pages, "s", "k", "t", least)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and {tuple(r) for r in one.collect()} == want and len(want) > 100
    for name, value in (("FEW_TEXTS", 0), ("TEXT_BLOCK", 40), ("TILE", 16), ("PAIRS", 50), ("SKETCH_ROWS", 7), ("SKETCHED", sketched)):
        monkeypatch.setattr(duplicates, name, value)
    mine = every[: len(texts)]
    half = np.arange(len(mine)) % 2 == 0
    got = duplicates._alike(np.array([i for i, _ in mine]), [t for _, t in mine], half, least)
    ids = [i for i, _ in mine]
    assert {(a, b, c) for f in got for a, b, c in zip(*(x.tolist() for x in f), strict=True)} == {(a, b, r) for s, a, b, r in want if s == "s" and half[ids.index(a)] != half[ids.index(b)]}
    many = [tuple(r) for r in duplicates.similar_neighbours(pages, "s", "k", "t", least).collect()]
    assert len(many) == len(set(many)) and set(many) == want


@pytest.mark.parametrize("narrow", [False, True])
def test_few_whole_descriptions_are_compared(monkeypatch, narrow):
    """Counts and rare characters leave few pairs of long texts to compare whole, and none is lost, also if they look at fewer characters than texts have."""
    rnd = random.Random(4)
    words = ["".join(rnd.choice("eeeaaoorrsttnnilcdmpbughkvwfyjxqz") for _ in range(rnd.randrange(2, 10))) for _ in range(900)]
    bases = [" ".join(rnd.choices(words, k=rnd.randrange(12, 30))) for _ in range(70)]
    texts = list(dict.fromkeys("".join(ch if rnd.random() > spoiled else rnd.choice(["", "e", "zq"]) for ch in b) for b in bases for spoiled in (0, 0.1, 0.2, 0.25)))
    if narrow:
        for name, value in (("TILE_CHARS", 20), ("MET_CHARS", 24), ("RARE_PAIRS", 30), ("MET_ROWS", 5), ("FEATURES", 40), ("TILE", 50)):
            monkeypatch.setattr(duplicates, name, value)
    asked, real = [], duplicates._subsequences
    monkeypatch.setattr(duplicates, "_subsequences", lambda x, i, j: asked.append(len(i)) or real(x, i, j))
    found = duplicates._alike(np.arange(len(texts)), texts, np.zeros(len(texts), bool), 80)
    want = {(a, b, r) for a in range(len(texts)) for b in range(a + 1, len(texts)) if (r := duplicates.ratio(texts[a], texts[b])) >= 80}
    assert {(a, b, c) for f in found for a, b, c in zip(*(x.tolist() for x in f), strict=True)} == want and len(want) > 100
    assert narrow or sum(asked) < len(texts) ** 2 / 2 * 0.03


def test_links_resolve_as_the_standard_says(spark):
    bases = ["https://a.example", "https://a.example/", "https://a.example/b/c/d", "https://a.example/b/c/", "http://a.example:8080/b//c?q=/x/y#f", "https://a.example/b/../c/d"]
    hrefs = ["x", "./x", "../x", "../../x", "../../../x", "x/", "x/../y", "x/./y", "x/..", ".", "..", "./", "../", "/", "/x/../../y", "//c.example/z", "?n=1", "#f", "x?a=../b", "/x//y", "http://o.example/../q", "mailto:a@b.example", "a/b/c/../../d", "x#../y"]
    rows = [(b, h) for b in bases for h in hrefs]
    got = {(r.b, r.h): r.u for r in spark.createDataFrame(rows, "b string, h string").withColumn("u", urls.resolve(F.col("b"), F.col("h"))).collect()}
    assert {k: v for k, v in got.items() if v != urljoin(*k)} == {}


def test_content_falls_on_from_place_to_body_to_all():
    read = lambda page: html.facts(page)["content"]
    assert read("<title>A long enough title</title><article>Hi</article>") == "A long enough title Hi"
    assert read("<article>Hi</article><body>Ho</body>") == ""
    assert read("<body><article>Hi</article><p>and what follows</p></body>") == "Hi and what follows"
    assert read("<body><p>first words of the body</p><main>ten letters</main></body>") == "ten letters"
    assert html.facts(None)["error"] == html.facts("  ")["error"] == "empty page"


def test_link_results(spark):
    links = [("https://a.example/x%d" % i, "") for i in range(200)]
    df = spark.createDataFrame([(1, links), (2, []), (3, None)], "k int, links array<struct<url:string,rel:string>>")
    checked = page_facts.checked_links(df, "k", "links")
    assert checked.count() == 150
    answers = spark.createDataFrame([("https://a.example/x0", 404, None), ("https://a.example/x1", 302, None), ("https://a.example/x2", None, "timeout"), ("https://a.example/x2", None, "timeout")], "link string, status int, problem string")
    kinds = {r.place: r.kind for r in page_facts.link_results(checked, answers).collect()}
    assert len(kinds) == 150 and [kinds[i] for i in range(4)] == ["client_error", "redirect", "timeout", "unknown_error"]


def test_suggestions_against_brute_force(spark):
    rnd = random.Random(6)
    letters = "abcde"
    known = {"".join(rnd.choice(letters) for _ in range(rnd.choice([3, 5, 8, 23, 25, 30]))): rnd.randrange(3, 9) for _ in range(150)}
    asked = set()
    for word in sorted(known) * 2:
        chars = list(word)
        for _ in range(rnd.randrange(1, 4)):
            at = rnd.randrange(len(chars))
            chars[at : at + rnd.randrange(2)] = rnd.choice(["", "x", "ab"])
        asked.add("".join(chars))
    asked -= known.keys()
    want = {}
    for word in asked:
        near = [(levenshtein(word, k), -n, k) for k, n in known.items() if abs(len(k) - len(word)) <= 2]
        near = [x for x in near if x[0] <= 2]
        if near:
            want[word] = (min(near)[2], min(near)[0])
    words = spark.createDataFrame([(w,) for w in sorted(asked)] * 2, "word string")
    got = {r.word: (r.suggestion, r.distance) for r in spelling.suggestions(words, spark.createDataFrame(sorted(known.items()), "word string, n long")).collect()}
    assert got == want and len(want) > 100
    assert spelling.suggestions(words.limit(0), spark.createDataFrame([], "word string, n long")).count() == 0


def test_suggestions_shuffle_words_once_a_block(spark, monkeypatch):
    """No keys of words are formed in the plan: neither exploded, nor shuffled, nor broadcast; several blocks give what one gives."""
    rnd = random.Random(8)
    known = spark.createDataFrame(sorted({"".join(rnd.choice("abcd") for _ in range(rnd.choice([4, 6, 24, 25]))): 3 + i % 5 for i in range(200)}.items()), "word string, n long")
    words = spark.createDataFrame([("".join(rnd.choice("abcd") for _ in range(6)) + "x",) for _ in range(100)], "word string")
    one = spelling.suggestions(words, known)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "BroadcastExchange" not in plan
    monkeypatch.setattr(spelling, "KNOWN_BLOCK", 30)
    monkeypatch.setattr(spelling, "ASKED_BLOCK", 20)
    monkeypatch.setattr(spelling, "PAIRS", 50)
    many = spelling.suggestions(words, known)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) and one.count() > 20


@pytest.mark.parametrize("name", ["a9_spelling", "a10_edit_distance", "a11_confidence", "a20_quality"])
def test_spelling_of_repeated_documents(spark, tmp_path, name):
    """Records of one doc_id are one text; records without one are no text for the dictionary, but have errors."""
    rows = [(1, "Garden lamps and chairs. lmaps " * 60), (1, "lmaps zebra, gardne 3 lamps"), (2, "garden lamps zebra"), (3, "garden lamps zebra chairs gardens"), (None, "garden chairs oddword"), (None, "lmaps oddword"), (4, None), (5, ""), (6, "see http://x.test/lmapz or me@lmapz.test, lampé lamp_s CHAIR5s")]
    if name == "a20_quality":
        rows = [r for r in rows if r[0] not in (None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    next((tmp_path / "d").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    got, want = rows_of_spark(page_queries.QUERIES[name](spark, str(tmp_path))), rows_of_sql(connection(str(tmp_path)), page_queries.SQL[name])
    assert got == want and want


@pytest.mark.parametrize("name", ["a9_spelling", "a11_confidence"])
def test_spelling_plans_form_no_keys(spark, data, name):
    """What is left to run after the words are written has no rows of keys, which were broadcast."""
    assert "MapInArrow" not in page_queries.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()


def _shuffled(spark, run):
    """Records and bytes that the stages of a run write for others."""
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def status():
        context.listenerBus().waitUntilEmpty(30_000)
        stages = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return [stages.apply(i) for i in range(stages.size())]

    before = {(s.stageId(), s.attemptId()) for s in status()}
    run()
    new = [s for s in status() if (s.stageId(), s.attemptId()) not in before]
    return sum(s.shuffleWriteRecords() for s in new), sum(s.shuffleWriteBytes() for s in new)


def test_suggestions_words_go_to_blocks_of_their_keys(spark, monkeypatch):
    """However many blocks there are, a word goes to no more of them than it has keys; the suggestions stay the same."""
    rnd = random.Random(4)
    some = lambda k: sorted({"".join(rnd.choice("abcdé") for _ in range(rnd.choice([3, 4, 4, 23, 25]))) for _ in range(k)})
    known, asked = [(w, 3 + len(w) % 2) for w in some(150)], [(w,) for w in some(150)] + [(w[:9] + w[10:20] + "x" + w[20:],) for w in some(30) if len(w) > 22]
    known += [(w[:5] + "é" + w[6:], 7) for (w,) in asked if len(w) > 22]
    known, asked = spark.createDataFrame(known, "word string, n long"), spark.createDataFrame(asked, "word string").distinct()
    one = sorted(map(tuple, spelling.suggestions(asked, known).collect()))
    short = "length(word) < 5"
    monkeypatch.setattr(spelling, "KNOWN_BLOCK", 12)
    assert sorted(map(tuple, spelling.suggestions(asked, known).collect())) == one and {len(w) < 5 for w, *_ in one} == {True, False}
    monkeypatch.setattr(spelling, "KNOWN_BLOCK", 1)
    monkeypatch.setattr(spelling, "KNOWN_KEYS", 4, raising=False)
    few = known.where(short), asked.where(short)
    words = few[0].count() + few[1].count()
    records, _ = _shuffled(spark, lambda: spelling.suggestions(few[1], few[0]).count())
    assert words > 100 and records < 25 * words


def test_corpus_unknown_shuffles_rare_words_only(spark):
    """Texts don't travel to their unknown words: what is shuffled is far less than the texts have."""
    rnd = random.Random(9)
    common = ["".join(rnd.choice("abcdefghij") for _ in range(7)) for _ in range(300)]
    rows = [(i, " ".join(rnd.choice(common) for _ in range(1000)) + f" rare{common[i % 300]}{common[i // 300]}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc long, text string").coalesce(2)
    got = []
    _, size = _shuffled(spark, lambda: got.extend(spelling.corpus_unknown(df, "doc", "text")))
    assert {(r.doc, r.batch, r.word) for r in got[0].collect()} == {(k, 10, t.split()[-1]) for k, t in rows} and got[1].count() == 300
    assert size < 0.03 * sum(len(t) for _, t in rows)


def test_spelling_edges(spark):
    texts = [(1, None, 0), (2, "", 0), (3, "Lamps and lamps and lmaps, see https://x.example/lmaps or me@lmaps.example 12lmaps", 0), (4, "lmaps " * 250, 0), (5, " ".join("w" + a + b for a in "abcdefghijklmnopqrst" for b in "abcdefghij"), 0)]
    df = spark.createDataFrame(texts, "k int, text string, word int")
    words = spelling.tokens(df, "k", "text")
    known = spark.createDataFrame([("lamps", 5), ("and", 9), ("see", 3)], "word string, n long")
    rows = [tuple(r) for r in spelling.errors(df, "k", "text", words, known).orderBy("k", "batch").collect()]
    assert rows[0] == (3, 0, "lmaps", "lamps", "medium", 20, "Lamps and lamps and lmaps, see https://x.example/lmaps or me@lmap...")
    assert [(r[0], r[1]) for r in rows if r[0] == 4] == [(4, 0), (4, 1), (4, 2)]
    assert sum(r[0] == 5 for r in rows) == 100 and {r[2] for r in rows if r[0] == 5 and r[4] == "high"} <= {"wee"}


def test_similar_contents_against_brute_force(spark):
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(160):
        base = random.Random(rnd.randrange(12)).sample(vocabulary, 30)
        for _ in range(rnd.randrange(6)):
            base[rnd.randrange(30)] = rnd.choice(vocabulary)
        rows.append((i, rnd.choice([40, 99, 100, 500, 501]), sorted(set(base)), "x"))
    rows += [(200 + i, 30, rows[3][2], "copy") for i in range(20)] + [(300, 0, [], "")]
    df = spark.createDataFrame(rows, "k long, n int, w array<string>, class_id string")
    limit = lambda n: 85 if n < 100 else 70 if n > 500 else 75
    first = {}
    for k, _, w, _ in rows:
        first.setdefault(tuple(w), k)
    want = {}
    for k, n, w, _ in rows:
        if w:
            scores = {c: 100 * len(set(w) & set(v)) / len(set(w) | set(v)) for v, c in first.items() if v and v != tuple(w)}
            near = {c: s for c, s in scores.items() if s >= limit(n) - 1e-9}
            want[k] = (first[tuple(w)], sum(r[2] == w for r in rows), len(near), sum(c < first[tuple(w)] for c in near), round(max(near.values()), 6) if near else None)
    got = {r.k: (r.class_id, r.copies, r.links, r.earlier, r.best) for r in duplicates.similar_contents(df.where("size(w) > 0").drop("class_id"), "k", "n", "w", duplicates.CONTENT_THRESHOLDS).collect()}
    assert got == want and sum(w[2] for w in want.values()) > 200


def test_similar_sets_meet_in_blocks(spark, monkeypatch):
    """Sets of 1 to 1,200 words in several blocks against brute force; words are neither exploded nor shuffled to find pairs."""
    rnd = random.Random(5)
    rows = []
    for i in range(150):
        n = rnd.choice([1, 2, 5, 24, 25, 26, 100, 140, 300, 1200])
        words = random.Random(rnd.randrange(5)).sample(range(20_000), n)
        rows.append((i, [f"w{x if rnd.random() > 0.1 else rnd.randrange(20_000)}" for x in words]))
    rows += [(i + 500, w[::-1] + w[:1]) for i, w in rows[:20]] + [(900, []), (901, None)]
    monkeypatch.setattr(duplicates, "SET_BLOCK", 10)
    monkeypatch.setattr(duplicates, "SET_ROWS", 7)
    df = duplicates.similar_sets(spark.createDataFrame(rows, "k long, w array<string>"), "k", "w", 70)
    first = {}
    for k, w in rows:
        if w:
            first.setdefault(frozenset(w), k)
    want = {(a, b): round(100 * len(u & v) / len(u | v), 6) for u, a in first.items() for v, b in first.items() if a < b and len(u & v) >= 0.7 * len(u | v) - 1e-9}
    got = [((r.a, r.b), round(r.jaccard, 6)) for r in df.collect()]
    assert dict(got) == want and len(got) == len(want) > 50
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()


def test_grammar_matches(spark):
    texts = [(1, "Its a fact.  your going , then faster i am!!"), (2, None), (3, "wait.. " * 90), (4, "")]
    df = spark.createDataFrame(texts, "k long, text string")
    rows = text.grammar_matches(df, "k", "text").collect()
    assert [(r.pattern, r.position, r.match) for r in rows if r.k == 1] == [(0, 13, "your going"), (2, 0, "Its a"), (4, 10, ".  y"), (5, 26, "then"), (8, 38, "i "), (9, 11, "  "), (10, 42, "!!")]
    counts = {r.k: r.n for r in df.select("k", text.soft_limit(text.grammar_counts(F.coalesce("text", F.lit("")))).alias("n")).collect()}
    assert {k: sum(r.k == k for r in rows) for k in counts} == counts and counts[3] > 50
    assert next(r for r in rows if r.k == 1).suggestion == "you're" and text.grammar_matches(df.limit(0), "k", "text").count() == 0
