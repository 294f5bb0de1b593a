"""The llm operators against brute force, planted cases and edge cases on small fixtures."""

import itertools
import json
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditlake.llm import abuse, codes, format_dups, leakage, mojibake, near_dups, packing, queries, template_residue, truncation
from tests.oracle import connection, rows_of_spark, rows_of_sql


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, data, name):
    got, want = rows_of_spark(queries.QUERIES[name](spark, data)), rows_of_sql(connection(data), queries.SQL[name])
    assert got == want, ((got - want).most_common(3), (want - got).most_common(3))


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.SQL.keys()))
def test_runs_on_whole_tables(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    rows = df.collect()
    assert rows and len(rows) == len(set(rows)), name


# --- Codes ------------------------------------------------------------------------------------------------------
def test_rolling_hashes_ignore_format():
    a, b = codes.rolling_hashes(["Ab-c 1", "aBC1!", "abc2", None, "", "--", "ÄÖ é"])
    assert a[0] == a[1] != a[2] and b[0] == b[1] != b[2] and a[4] == a[5] != a[3]
    assert codes.rolling_hashes(["äöÉ"])[0][0] == a[6]


def test_word_runs_against_regex():
    texts = ["Hello, wörld_x 12a", "", "a-b", "ß İ x" * 3, "🙂mixed🙂text"]
    own, start, length, h = codes.word_runs(texts)
    want = [(i, m.start(), len(m.group())) for i, t in enumerate(texts) for m in re.finditer(r"[^\W_]+", t)]
    assert list(zip(own.tolist(), start.tolist(), length.tolist(), strict=True)) == want
    words = [texts[i][s : s + n].lower() for i, s, n in want]
    assert len(set(h.tolist())) == len(set(words))


# --- 1 ----------------------------------------------------------------------------------------------------------
CASES = ["{{ title }}", "%PAGE_TITLE% | Shop", "Fine {product.name} shoes", "404 Not Found", "Shop - Access denied", "Begadalo: Loading...", "None", "NaN - undefined", "Untitled Document", "New Page 1", "Lorem ipsum dolor sit amet", "Seite nicht gefunden!", "ERROR 404 (404)", "TODO: write title", "xxxx xxxx", "#REF!"]
TITLES = ["Error pages that nurses like | Shop", "Using {{name}} in mail templates: a guide", "[winter] bright sails by Gubi", "100% fine & 20% off – Shop", "404 rustic chairs to buy", "Null results in gardens studies", "How to fix a 404 page after moving", "Lorem ipsum history and walks | Shop", "Service: sleek puzzles near Salo", "What is undefined behaviour? A review", "", "   "]


def test_residue(spark):
    rows = [(i, t, 200, "https://www.begadalo.example", 1) for i, t in enumerate(CASES + TITLES)]
    rows += [(100, "Closed | Shop", 503, None, 1), (101, "Closed | Shop", 200, None, 1), (102, "Closed", None, None, 1), (103, None, 500, None, 1), (104, "Maintenance", 400, None, 1), (105, "word " * 20000, 500, None, 1)]
    df = spark.createDataFrame(rows, "webpage_id long, title string, status_code int, website_url string, template int")
    got = sorted(r[0] for r in template_residue.residue(df).select("webpage_id").collect())
    assert got == [*range(len(CASES)), 100, 104]
    assert template_residue.residue(df.limit(0)).count() == 0
    assert template_residue.residue(df.union(df)).count() == 2 * len(got)
    assert template_residue.titles_without_residue(df).count() == len(rows) - len(got)


@pytest.mark.parametrize("n", [1, 4, 5, 40])
def test_residue_of_long_titles_at_any_count(spark, n):
    message, notice, title = "The page you are looking for could not be found on this server", "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore", "The page you are looking for could not be found on this map of old gardens"
    rows = [(k * n + i, t, 200, "https://www.begadalo.example") for k, t in enumerate((message, notice, title)) for i in range(n)]
    df = spark.createDataFrame(rows, "webpage_id long, title string, status_code int, website_url string")
    assert sorted(tuple(r) for r in template_residue.residue(df).collect()) == [(i, "message") for i in range(2 * n)]


WORDINGS = ["We'll be right back", "Ce site est en maintenance", "The requested resource could not be located", "404 - Seite existiert nicht mehr", "Internal Server Error - Apache Tomcat/9", "ページが見つかりません", "Sayfa bulunamadı", "Please enable JavaScript and cookies in your browser to continue viewing this whole website today"]


def test_residue_learns_wordings_that_no_list_has(spark):
    rnd = random.Random(12)
    nouns, adjectives = "boats lamps chairs gardens tables shelves carpets curtains".split(), "modern wooden reliable careful bright quiet heavy early".split()
    sites = [f"https://www.{a}{b}.example" for a in ("bega", "soru", "mita") for b in ("dalo", "pim", "kor", "zun")]
    rows = [(i, f"How to {rnd.choice(['build', 'clean', 'move'])} {rnd.choice(adjectives)} {rnd.choice(nouns)} at home", rnd.choice([200] * 9 + [404]), rnd.choice(sites)) for i in range(600)]
    rows += [(1000 + i, t, 200, rnd.choice(sites)) for i, t in enumerate(CASES * 3)]
    rows += [(2000 + 100 * k + i, t, 503 if i % 6 else 200, sites[i % 12]) for k, t in enumerate(WORDINGS) for i in range(24)]
    rows += [(5000 + i, "Spring catalogue", 503 if i % 9 == 0 else 200, sites[i % 12]) for i in range(24)]  # on many sites, but it seldom fails
    rows += [(6000 + i, "Autumn sale of garden chairs", 503, sites[0]) for i in range(24)]  # one site that fails
    df = spark.createDataFrame(rows, "webpage_id long, title string, status_code int, website_url string")
    got = {r.webpage_id for r in template_residue.residue(df).collect()}
    want = {r[0] for r in rows if 2000 <= r[0] < 5000 and r[2] >= 400}
    assert want <= got
    assert {r[0] for r in rows if 1000 <= r[0] < 2000} <= got
    assert not got & {r[0] for r in rows if r[0] < 1000 or r[0] >= 5000}


def test_tree_leaves_no_telling_word_open(spark):
    rows = [(f"zq{w} report of vu{w} wy{w} today".split(), f"s{i % 5}", False) for i, w in enumerate("".join(p) for p in itertools.product("zqvwj", repeat=4))]
    rows += [(t.lower().split(), "s1", False) for t in CASES if not template_residue.has_slot(t)]
    titles = spark.createDataFrame([(w, s, f, [template_residue.telling(x) for x in w]) for w, s, f in rows], "words array<string>, site string, failed boolean, telling array<boolean>")
    got = {" ".join(r.words): r.template for r in template_residue.tree_templates(titles).collect()}
    assert got["zqzqvw report of vuzqvw wyzqvw today"] == "<*> report of <*> <*> today"
    assert all(template_residue.verdict(t) == template_residue.verdict(got[t]) for t in (" ".join(w) for w, _, _ in rows))


# --- 2 ----------------------------------------------------------------------------------------------------------
def clean_corpus():
    rnd = random.Random(5)
    words = {"fr": "crêpes légères théâtres préférées déjà coûts à des pour", "de": "schöne Gärten für Bäcker Möbel über Küchen Tücher", "pl": "żółte świece łóżka części źródła małe są dla", "ru": "новые книги для детей лампы каталоге лежат свежие", "es": "cómodas lámparas niños señales mágicas más único"}
    return [" ".join(rnd.choice(w.split()) for _ in range(9)) for w in words.values() for _ in range(200)]


def broken(text, truth, read):
    return text.encode(truth).decode(read)


def test_garbled(spark):
    clean = clean_corpus()
    fr, de, pl, ru, es = clean[0], clean[200], clean[400], clean[600], clean[800]
    bad = [broken(fr, "utf-8", "cp1252") if "à" not in fr else broken(fr, "utf-8", "latin-1"), broken(de, "utf-8", "mac_roman"), broken(pl, "utf-8", "cp1250"), broken(ru, "utf-8", "cp1251"), broken(es, "utf-8", "cp437"), broken(ru, "cp1251", "cp1252")]
    truth = [fr, de, pl, ru, es, ru]
    lossy = fr.encode("latin-1", "ignore").decode("utf-8", "replace")
    rows = [(i, t, None, 1) for i, t in enumerate(clean)] + [(5000 + i, t, "ok", 1) for i, t in enumerate(bad)] + [(6000, lossy, "", 1), (6001, None, None, 1), (6002, "plain 20 °C – “x” ✓ ½", "x", 1)]
    df = spark.createDataFrame(rows, "webpage_id long, title string, meta_description string, original int")
    got = {r["webpage_id"]: r for r in mojibake.garbled(df).collect()}
    assert sorted(got) == [5000, 5001, 5002, 5003, 5004, 5005, 6000]
    assert [got[5000 + i]["restored"] for i in range(6)] == truth
    assert got[6000]["restored"] is None and got[6000]["field"] == "title"
    assert mojibake.garbled(df.limit(0)).count() == 0


@pytest.mark.parametrize("share", [3, 10, 100])
def test_garbling_is_found_however_frequent(spark, share):
    clean = clean_corpus()
    rows, want, mapped = [], set(), {}
    for i, t in enumerate(clean):
        fr, ru = "Shop – Jardin d’été", "новые книги для детей лежат"
        for k, (good, bad) in enumerate(((f"{t} – {t}", f"{t} â€“ {t}"), (fr, broken(fr, "utf-8", "cp1252")), (ru, broken(ru, "cp1251", "cp1252")), ("caf", "caf\ufffd noir"))):
            title = bad if (i + k) % share == 0 and not (k == 0 and not t.isascii() and "â" in t) else good
            rows.append((4 * i + k, title, None))
            if title != good:
                want.add(4 * i + k)
                mapped[4 * i + k] = None if k == 3 else good
    df = spark.createDataFrame(rows, "webpage_id long, title string, meta_description string")
    got = {r["webpage_id"]: r["restored"] for r in mojibake.garbled(df).collect()}
    assert set(got) == want
    assert got == mapped


@pytest.mark.parametrize("codec", ["cp866", "mac_cyrillic"])
@pytest.mark.parametrize("share", [3, 40])
def test_one_cyrillic_encoding_read_as_another(spark, codec, share):
    clean = clean_corpus()
    words = "Прочные свечи и чашки для друзей, яркие шторы".split()
    rnd = random.Random(share)
    rows = [(i, t, None) for i, t in enumerate(clean)]
    want = {}
    for i in range(300):
        good = " ".join([*rnd.sample(words, 6), "яблоня"])
        bad = broken(good, "cp1251", codec)
        rows.append((10_000 + i, bad if i % share == 0 else good, None))
        if i % share == 0:
            want[10_000 + i] = good
    df = spark.createDataFrame(rows, "webpage_id long, title string, meta_description string")
    got = {r.webpage_id: r.restored for r in mojibake.garbled(df).collect()}
    assert set(got) == set(want)
    assert sum(got[k] == want[k] for k in want) >= 0.9 * len(want)


def test_clean_text_has_no_shape_of_garbling():
    for text in ("«В» и «А»", "её дом", "В\xa0доме «Город»", "LE CAFÉ» – «É", "MAÇÃ» x", "příště þýða žížeň", "Рік і Рёбра", "Größe – Ärger", "naïve—être", "20 °C ½ “x” ✓", "Ångström Öl", "ΑΒΓ Άλφα", "їжа її, Єва й Ёлка", "цена 20€ и √2", "по 5 €за штуку", "■ Текст · №5", "ЁЛКИ и ЁЖ", "рука–об–руку"):
        assert mojibake.suspects(text) == ([], []), text


def test_runs_isolate_the_stretch():
    counts = np.zeros(mojibake.CLASSES**2)
    table = mojibake.class_table()
    for t in clean_corpus():
        c = table[np.frombuffer(t.encode("utf-32-le"), np.uint32)]
        counts += np.bincount(c[:-1] * mojibake.CLASSES + c[1:], minlength=len(counts))
    text = "schöne Gärten fÃ¼r Bäcker"
    (t, a, b, _), *rest = mojibake.PairModel(counts).runs([text])
    assert (t, rest) == (0, []) and text[a:b].strip("fr ") in ("Ã¼", "fÃ¼r") and b - a <= 5


# --- 3 ----------------------------------------------------------------------------------------------------------
def test_format_duplicates_against_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        k = rnd.randrange(90)
        fields = [("title", f"Page {k % 7} é"), ("n", k % 5), ("x", None if k % 4 else "a")]
        rnd.shuffle(fields)
        text = json.dumps(dict(fields), ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 2]))
        text = text if rnd.random() < 0.6 else text.replace("Page", "PAGE ").replace('"n"', '" N"')
        url = rnd.choice(["https://a.example/p?", "HTTPS://a.example/P", " https://a.example/p "])
        rows.append((i, "s", url if k % 3 else None, rnd.choice([text, text, "not json " + str(k % 3), None]) if k % 9 == 0 else text, "clash"))
    df = spark.createDataFrame(rows, "raw_id long, website_url string, url string, fields string, h1 string")
    fold = lambda t: "\x00" if t is None else "".join(c.lower()[0] for c in t if c.isalnum())
    groups = {}
    for i, s, u, f, _ in rows:
        groups.setdefault((fold(s), fold(u), f is None, tuple(sorted((fold(k), fold(v)) for k, v in format_dups.entries(f)))), []).append(i)
    want = {(g[0], x) for g in groups.values() for x in g[1:]}
    assert {tuple(r) for r in format_dups.format_duplicates(df).collect()} == want
    assert {tuple(r) for r in format_dups.format_duplicates(df.union(df).repartition(5)).collect()} == want
    assert {tuple(r) for r in format_dups.collapsed(df).collect()} == {(g[0], len(g)) for g in groups.values()}
    assert format_dups.format_duplicates(df.limit(0)).count() == 0


def test_two_pointers_skip_and_fold():
    left = ["A-b c", "abc", None, "", "x", "ab", "Ä!", None, "--"]
    right = ["a, BC", "abd", None, "?!", "xy", "a b", "ä", "", "a"]
    assert format_dups.same_ignoring_format(left, right).tolist() == [True, False, True, True, False, True, True, False, False]
    assert format_dups.same_ignoring_format([], []).tolist() == []


def test_hash_collisions_are_told_apart(spark, monkeypatch):
    real = format_dups._hash_batches

    def colliding(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([1] * n), pa.array([1] * n)], ["raw_id", "h1", "h2"])

    assert real is not colliding
    monkeypatch.setattr(format_dups, "_hash_batches", colliding)
    rows = [(1, "a", "x", "{}"), (2, "a", "y", "{}"), (3, "A", "x!", "{}"), (4, "a", "Y", "{}"), (5, "b", None, None)]
    df = spark.createDataFrame(rows, "raw_id long, website_url string, url string, fields string")
    assert {tuple(r) for r in format_dups.format_duplicates(df).collect()} == {(1, 3), (2, 4)}


# --- 5 ----------------------------------------------------------------------------------------------------------
def test_cut_values(spark):
    rnd = random.Random(7)
    nouns, adjectives = "boats lamps chairs gardens tables".split(), "modern wooden reliable careful bright".split()
    sentence = lambda: f"Our {rnd.choice(nouns)} show how to build {rnd.choice(adjectives)} {rnd.choice(nouns)} with {rnd.choice(adjectives)} {rnd.choice(nouns)}"
    rows = [(i, sentence() + rnd.choice([".", ".", "."]), "s") for i in range(600)]
    whole = [(1000 + i, sentence(), "s") for i in range(10)]
    cut = [(2000, sentence() + " and relia", "s"), (2001, "Our lamps show how to build modern chairs with", "t"), (2002, "Our lamps show how to build modern cha…", "t"), (2003, "Our boats show how to build wood ...", "t")]
    more = [(3000, None, "s"), (3001, "  ", "s"), (3002, "", None), (3003, "word " * 5000 + "end.", None)]
    pages = spark.createDataFrame(rows + whole + cut + more, "webpage_id long, meta_description string, source string").withColumn("kind", F.lit("clash"))
    links = spark.createDataFrame([(1, [("bright lamps", 1), (None, 2), (" ", 3), ("modern chairs with careful", 4)], "u"), (2, None, "u"), (3, [], "u")], "summary_id long, top_anchors_by_backlinks array<struct<anchor:string,backlinks:long>>, source string")
    got = {(r.table_name, r.record_id, r.item_no) for r in truncation.cut_values(pages, links).collect()}
    assert {("webpages", r[0], 0) for r in cut} <= got
    assert not got & {("webpages", r[0], 0) for r in rows + whole + more}
    assert truncation.cut_values(pages.limit(0), links.limit(0)).count() == 0
    rates = {r.source: r for r in truncation.cut_rates(pages, links).where("table_name = 'webpages'").collect()}
    assert rates["t"].rate == 1.0 and rates["s"].cut == 1


@pytest.mark.parametrize("copies", [1, 2, 30, 600])
def test_copies_of_a_cut_text_are_no_evidence(spark, copies):
    rnd = random.Random(8)
    nouns, adjectives = "boats lamps chairs gardens tables".split(), "modern wooden reliable careful bright".split()
    sentence = lambda: f"Our {rnd.choice(nouns)} show how to build {rnd.choice(adjectives)} {rnd.choice(nouns)} with {rnd.choice(adjectives)} {rnd.choice(nouns)}"
    rows = [(i, sentence() + ".", "s") for i in range(600)]
    hot = ["Our lamps show how to build modern boats and relia", "Our chairs show how to build wooden tables with", "Our boats show how to build modern cha…", "Our tables show how to build wood ... "]
    cut = [(10_000 + 1000 * k + i, t, "hot") for k, t in enumerate(hot) for i in range(copies)]
    pages = spark.createDataFrame(rows + cut, "webpage_id long, meta_description string, source string")
    links = spark.createDataFrame([(i, [("modern chairs with careful", 4), ("bright lamps", 1)], "u") for i in range(copies)], "summary_id long, top_anchors_by_backlinks array<struct<anchor:string,backlinks:long>>, source string")
    got = [(r.table_name, r.record_id, r.item_no) for r in truncation.cut_values(pages, links).collect()]
    assert len(got) == len(set(got))
    assert {g for g in got if g[0] == "webpages"} == {("webpages", r[0], 0) for r in cut}


def test_trie_lookup(spark):
    words = ["car", "care", "cart", "dog", "a", "ab", "straße"]
    vocabulary = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    asked = ["ca", "car", "cart", "c", "a", "ab", "x", "stra", "do", "zzz", "Car"]
    got = {r.token: (r.whole, r.longer) for r in truncation.trie_lookup(spark.createDataFrame([(t, 1) for t in asked], "token string, n long"), vocabulary).collect()}
    assert got == {t: (2 * (t in words), 2 * sum(w.startswith(t) and w != t for w in words)) for t in asked}


def test_ten_copies_of_a_table_give_equal_answers(spark, data):
    pages, links = spark.read.parquet(f"{data}/webpages.parquet"), spark.read.parquet(f"{data}/backlink_summaries.parquet")
    ten = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("copy")
    once = {tuple(r) for r in truncation.cut_values(pages, links).select("table_name", "record_id", "item_no", F.round("odds", 6)).collect()}
    rows = truncation.cut_values(pages.select("*", ten), links.select("*", ten)).select("table_name", "record_id", "item_no", F.round("odds", 6)).collect()
    assert len(once) > 10 and {tuple(r) for r in rows} == once and len(rows) == 10 * len(once)


@pytest.mark.parametrize("limit", [24, 8192])
def test_limits_of_any_length(spark, limit):
    rnd = random.Random(limit)
    rows = [(0, "ab " * rnd.randrange(2, limit) + "c" * rnd.randrange(1, 9)) for _ in range(300)] + [(0, ("word%d " % i + "lamps and " * limit)[:limit]) for i in range(40)]
    got = {(r.kind, r.n) for r in truncation.limit_odds(spark.createDataFrame(rows, "kind int, text string").distinct()).collect()}
    assert (0, limit) in got and len(got) < 4


# --- 6 ----------------------------------------------------------------------------------------------------------
def brute(sets, t):
    return {(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) >= t * len(x | y) - 1e-9}


@pytest.mark.parametrize(("seed", "short", "block"), [(1, 100.0, 4096), (2, 0.5, 4096), (3, 4.0, 4096), (4, 100.0, 7), (5, 1000.0, 40)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, seed, short, block):
    monkeypatch.setattr(near_dups, "SHORT_LIST", short)
    monkeypatch.setattr(near_dups, "BLOCK", block)
    rnd = random.Random(seed)
    vocabulary = [f"word{chr(97 + i % 26)}{i}" for i in range(60)]
    bases = [rnd.sample(vocabulary, rnd.randrange(12, 22)) for _ in range(25)]
    rows = []
    for i in range(260):
        words = list(rnd.choice(bases))
        for _ in range(rnd.randrange(0, 7)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        rnd.shuffle(words)
        rows.append((i, " ".join(words[:5]), " ".join(words[5:]).upper() + " ab c!", "clash"))
    rows += [(900, None, "x " * 30, ""), (901, "", " ".join(vocabulary), ""), (902, "a few", "words only", "")]
    df = spark.createDataFrame(rows, "webpage_id long, title string, meta_description string, words string")
    sets = {i: set(re.findall(r"[^\W_]{4,}", f"{t} {d}".lower())) for i, t, d, _ in rows if t and d}
    sets = {i: s for i, s in sets.items() if len(s) >= 12}
    found = near_dups.NearDuplicates(df)
    want = brute(sets, 0.6)
    assert len(want) > 300
    got = [tuple(r) for r in found.record_pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == want
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(want):
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    groups = {r.webpage_id: r.group_id for r in found.groups().collect()}
    assert groups == {i: root(i) for i in sets}


def test_lists_are_dealt_out_in_blocks_whatever_the_batches():
    import pyarrow as pa

    rnd = np.random.default_rng(3)
    sizes = rnd.integers(1, 12, 60)
    sig = np.repeat(np.arange(60), sizes)
    rows = [sig << near_dups.LOW_BITS | 12 << 1 | 1, np.arange(len(sig)), np.zeros(len(sig), np.int64)]
    for step in (1, 3, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(r[i : i + step]) for r in rows], ["sig", "id", "sketch"]) for i in range(0, len(sig), step)]
        out = pd.concat([b.to_pandas() for b in near_dups._meet(0.6, 4)(iter(batches))])
        pairs = {(int(a), int(b)) for a, b in out[out.sig.isna()][["a", "b"]].to_numpy()}
        assert pairs == {(i, j) for i in range(len(sig)) for j in range(i + 1, len(sig)) if sig[i] == sig[j] and sizes[sig[i]] <= 4}, step
        hot = out[out.sig.notna()]
        assert sorted(hot.id) == [i for i in range(len(sig)) if sizes[sig[i]] > 4]
        per = hot.groupby(["sig", "block"]).size()
        assert per.max() <= 4 and all(set(g.block) == set(range(len(set(g.block)))) for _, g in hot.groupby("sig"))


def test_large_records_are_told_apart_by_their_words(spark):
    words = [f"wort{i}" for i in range(4000)]
    rows = [(1, "t", " ".join(words)), (2, "t", " ".join(words[:2500])), (3, "t", " ".join(words[:2300])), (4, "t", " ".join(words[:2600] + [f"x{w}" for w in words[:900]])), (5, "t", " ".join(words[:1200]))]
    df = spark.createDataFrame(rows, "webpage_id long, title string, meta_description string")
    sets = {i: set(d.split()) for i, _, d in rows}
    assert {tuple(r) for r in near_dups.NearDuplicates(df).record_pairs().collect()} == brute(sets, 0.6) != set()


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([], "webpage_id long, title string, meta_description string")
    found = near_dups.NearDuplicates(df)
    assert found.record_pairs().count() == 0 and found.groups().count() == 0
    same = spark.createDataFrame([(i, "t", " ".join(f"abcd{k}" for k in range(12))) for i in range(40)], "webpage_id long, title string, meta_description string")
    assert near_dups.NearDuplicates(same).record_pairs().count() == 40 * 39 // 2


# --- 8 ----------------------------------------------------------------------------------------------------------
def test_packing(spark):
    rnd = random.Random(2)
    docs = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(rnd.choice([3, 40, 200, 700, 3000]))), "x") for i in range(150)] + [(500, None, "x"), (501, "", "x"), (0, "again", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, shard string")
    rows = packing.containers(df, shard_tokens=40_000).toPandas()
    used = rows.groupby("container_id").tokens.sum()
    assert used.max() <= packing.CAPACITY and len(used) >= -(-rows.tokens.sum() // packing.CAPACITY)
    size = {}
    for i, t, _ in docs:
        size.setdefault(i, []).append(packing.count_tokens(t))
    assert rows.groupby("doc_id").tokens.sum().to_dict() == {i: sum(n) for i, n in size.items()}
    for i, part in rows[rows.doc_id != 0].groupby("doc_id"):
        part = part.sort_values("piece")
        assert part.first_token.tolist() == [k * packing.CAPACITY for k in range(len(part))] and (len(part) == 1) == (size[i][0] <= packing.CAPACITY)
    assert packing.containers(df.limit(0)).count() == 0
    report = packing.fill_report(packing.containers(df)).first()
    assert report.fill > 0.9


def test_pack_balances_cost_and_fills():
    rnd = np.random.default_rng(1)
    sizes = rnd.integers(5, 900, 3000)
    where = packing.pack(sizes)
    used = np.bincount(where, sizes)
    cost = np.bincount(where, packing.LINEAR * sizes + packing.QUADRATIC * sizes**2)
    assert used.max() <= packing.CAPACITY and sizes.sum() / (len(used) * packing.CAPACITY) > 0.97
    assert np.std(cost[cost > 0]) < 0.2 * cost.mean()


def test_tokens_of_parts_add_up(monkeypatch):
    text = "Some words, then more: 123 and so on.\n\n  Ünïcode  too " * 300
    whole = packing.count_tokens(text)
    monkeypatch.setattr(packing, "PART_CHARS", 500)
    assert packing.count_tokens(text) == whole > 1000


# --- 9 ----------------------------------------------------------------------------------------------------------
def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def leak_truth(docs, items, n=12):
    grams = lambda w: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    of_items = {i: grams(words_of(t)) for i, t in items}
    return {(d, i) for d, t in docs for i, g in of_items.items() if g & grams(words_of(t))}


def test_leaks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(leakage, "WINDOW_CHARS", 4000)
    rnd = random.Random(4)
    vocabulary = [f"{a}{b}{c}" for a in "bdgk" for b in "aeiou" for c in ("l", "ster", "n", "mm")]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(8, 40)))) for i in range(30)] + [(99, None)]
    docs = []
    for d in range(120):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 300))]
        if d % 2:
            source = words_of(rnd.choice(items[:30])[1])
            n = rnd.choice([8, 11, 12, 13, len(source)])
            at = rnd.randrange(max(1, len(source) - n + 1))
            words[len(words) // 2 : len(words) // 2] = [w.upper() + rnd.choice(["", ",", " –", "!\n"]) for w in source[at : at + n]]
        docs.append((d, " ".join(words)))
    docs += [(500, None), (501, ""), (502, "x " * 30000 + items[0][1] + " y" * 30000)]
    # A passage that marks spread over many windows, and one after a word that is longer than any window.
    docs += [(503, "z " * 3000 + ("-" * 3000).join(next(t for _, t in items if t and len(t.split()) > 20).split()) + " z" * 3000), (504, "q" * 9000 + " " + items[1][1]), (505, " ".join(next(t for _, t in items if t and len(t.split()) > 15).split() * 200))]
    D, I = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = leak_truth(docs, items)
    assert len(want) > 15
    assert {tuple(r) for r in leakage.leaked(D, I).collect()} == want
    monkeypatch.setattr(leakage, "ITEM_CHARS", 900)
    monkeypatch.setattr(leakage, "PIECE_CHARS", 90)
    assert {tuple(r) for r in leakage.leaked(D.union(D), I).collect()} == want
    assert leakage.leaked(D.limit(0), I).count() == 0 and leakage.leaked(D, I.limit(0)).count() == 0


def test_leaks_find_small_edits(spark):
    item = "the quick brown foxes jumped over several lazy dogs behind the painted wooden fence yesterday evening"
    docs = [(1, item.replace("lazy", "lasy")), (2, item), (3, item.replace(" ", " zq "))]
    got = {r.doc_id: (r.edits, r.windows > 0) for r in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got == {1: (1, False), 2: (0, True)}


# --- 10 ---------------------------------------------------------------------------------------------------------
def corpus(n, seed):
    rnd = random.Random(seed)
    clean = ["The report lists {} pages today.", "I asked Mara about the {} cache.", "What a stupid error in line {}, sorry.", "Kill the stuck job {} before noon.", "Our shop sells {} lamps and chairs.", "The breeder says the bitch had {} puppies."]
    bad = ["You are a worthless idiot and nobody needs your {} lamps.", "I will find you and break your {} legs, moron.", "Send the Zerks back where they crawled from, all {}."]
    texts, labels = [], []
    for _ in range(n):
        s = [rnd.choice(clean).format(rnd.randrange(99)) for _ in range(rnd.randrange(2, 9))]
        y = rnd.random() < 0.25
        if y:
            s.insert(rnd.randrange(len(s) + 1), rnd.choice(bad).format(rnd.randrange(99)))
        texts.append(" ".join(s))
        labels.append(int(y))
    return texts, labels


def test_abuse_held_out(spark):
    texts, labels = corpus(600, 1)
    rnd = random.Random(9)
    votes = pd.DataFrame([(i, f"r{k % 4}", y if rnd.random() > 0.05 else 1 - y) for i, y in enumerate(labels) for k in range(1 + i % 2)], columns=["text", "reviewer", "abusive"])
    model = abuse.fit(texts, votes)
    held, truth = corpus(400, 2)
    guess = model.scores(held) >= 0.5
    truth = np.array(truth, bool)
    assert (guess & truth).sum() / truth.sum() > 0.95 and (guess & truth).sum() / guess.sum() > 0.95
    disguised = ["The report is fine. You are a w-o-r-t-h-l-e-s-s 1d10t and nobody needs your 3 lamps.", "You are a worthless i d i o t and nobody needs your lamps."]
    assert (model.scores(disguised) > 0.5).all()
    df = spark.createDataFrame([(0, disguised[0], "s"), (1, None, "s"), (2, "", None), (3, "The report lists 3 pages today. " * 40000, "s")], "doc_id long, text string, source string")
    got = {r.doc_id: r.score for r in abuse.scores(df, model, keep=("source",)).collect()}
    assert got[0] > 0.5 and got[1] == got[2] == 0
    found = abuse.offending_sentences(df.where("doc_id < 3"), model).collect()
    assert [(r.doc_id, r.sentence) for r in found] == [(0, disguised[0][20:].strip())] and found[0].begin == 20
    assert abuse.scores(df.limit(0), model).count() == 0


def test_abuse_without_labels(spark):
    model = abuse.fit([], pd.DataFrame(columns=["text", "reviewer", "abusive"]))
    assert model.scores(["nice lamps", None]).max() < 0.5
    docs, labels = spark.createDataFrame([(1, "nice lamps"), (2, None)], "doc_id long, text string"), spark.createDataFrame([(2, "r", 1), (9, "r", 1), (None, "r", 1), (1, None, None)], "doc_id long, reviewer string, abusive int")
    for few in (labels, labels.limit(0)):
        assert abuse.train(docs, few).scores(["nice lamps", None]).max() < 0.5


def test_training_on_executors_is_the_same_fit(spark):
    texts, labels = corpus(300, 3)
    votes = pd.DataFrame([(i, f"r{i % 3}", y) for i, y in enumerate(labels)], columns=["text", "reviewer", "abusive"])
    at_hand = abuse.fit(texts, votes)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] * 2, "doc_id long, text string, d string")
    many = [(i, f"r{i % 3}", y) for i, y in enumerate(labels)] + [(0, "r0", labels[0])] * 400  # a hot document
    trained = abuse.train(docs.repartition(3), spark.createDataFrame(many, "doc_id long, reviewer string, abusive int"))
    held, _ = corpus(50, 4)
    assert np.abs(trained.scores(held) - at_hand.scores(held)).max() < 1e-3
    assert abuse.train(docs, spark.createDataFrame(many, "doc_id long, reviewer string, abusive int"), sample_labels=120).scores(held).max() > 0.5


def test_disguises_give_the_same_word():
    plain = abuse.word_feature("idiot")
    for form in ("1d10t", "i.d.i.o.t", "IDIOT!", "idiooot", "i-d-i-o-t"):
        assert int(abuse.features([form])[2][0]) == plain, form
