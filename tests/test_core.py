"""Core operators on small fixtures: empty tables, nulls, ties, copies, clashing names."""

import datetime

import pytest
from pyspark.sql import functions as F

from auditlake.functions import html, text, urls
from auditlake.functions.rounding import half_even, half_up
from auditlake.operators import duplicates, page_scores, records, timeline
from auditlake.operators.skew import State, hot_keys, rounds_for, site_profile, tree_aggregate
from auditlake.operators import snapshots
from auditlake.operators.snapshots import snapshot_changes


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_rounds():
    assert [rounds_for(n, 4) for n in (1, 4, 5, 16, 17, 65)] == [0, 0, 1, 1, 2, 3]


def test_tree_aggregate_equals_group_by(spark):
    df = spark.range(0, 5000, 1, 40).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 7).alias("k"), F.col("id").alias("__node__x"), (F.col("id") % 11).alias("v"))
    states = [State("n", F.count(F.lit(1))), State("s", F.sum("v")), State("low", F.min("v"), "min"), State("u", F.hll_sketch_agg("v"), "hll", "hll_sketch_estimate(u)")]
    got = {r["k"]: (r["n"], r["s"], r["low"], r["u"]) for r in tree_aggregate(df, ["k"], states, fan_in=3, chunk_rows=50).collect()}
    want = {r["k"]: (r["n"], r["s"], r["low"], r["u"]) for r in df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.min("v").alias("low"), F.countDistinct("v").alias("u")).collect()}
    assert got == want


def test_hot_keys_edges(spark):
    schema = "website_url string, user_activity_id string, url string, status_code int, seo_score int, word_count int, crawled_at timestamp_ntz, n int, field string"
    empty = spark.createDataFrame([], schema)
    assert hot_keys(empty, ["website_url"]).count() == 0
    assert site_profile(empty, "website_url").count() == 0
    rows = [("a", None, None, 404, None, 1, None, 0, "x")] * 60 + [("b", None, "u", 200, 3, 1, None, 0, "x")] * 3 + [(None, None, "u", None, 3, None, None, 0, "x")] * 37
    found = {tuple(r) for r in hot_keys(spark.createDataFrame(rows, schema), ["website_url", "user_activity_id"], 0.03).collect()}
    assert found == {("website_url", "a"), ("website_url", "b")}
    profile = {r["website_url"]: r for r in site_profile(spark.createDataFrame(rows, schema), "website_url").collect()}
    assert profile["a"]["pages"] == 60 and profile["a"]["failures"] == 60 and profile["a"]["urls"] == 0 and profile["a"]["avg_score"] is None
    assert profile[None]["pages"] == 37 and profile[None]["urls"] == 1


SNAP = "snapshot_no int, url string, title string, score int, delivered_at timestamp_ntz, row_key string, cut boolean"


def snap(rows):
    t = datetime.datetime(2025, 1, 1)
    return [(no, url, title, score, t + datetime.timedelta(hours=h), "clash", True) for no, url, title, score, h in rows]


def test_snapshot_changes(spark):
    rows = snap([
        (1, "a", "A", 1, 0), (1, "b", "B", None, 0), (1, "c", "C", 3, 0), (1, None, "N", 1, 0),
        (4, "a", "A", 1, 0), (4, "b", None, None, 0), (4, "d", "D", 1, 0), (4, "d", "D", 1, 5), (4, None, "N", 2, 0),
        (9, "a", "A", 1, 0), (9, "b", "B", None, 0), (9, "c", "C", 3, 0), (9, "d", "old", 1, 0), (9, "d", "D", 1, 9), (9, None, "N", 2, 0),
    ])
    got = sorted((r[0], r[1] or "", r[2]) for r in snapshot_changes(spark.createDataFrame(rows, SNAP), "url", chunk_keys=2).collect())
    assert got == sorted([(4, "b", "changed"), (4, "c", "removed"), (4, "d", "added"), (4, "", "changed"), (9, "b", "changed"), (9, "c", "added")])


def test_snapshot_edges(spark):
    assert snapshot_changes(spark.createDataFrame([], SNAP), "url").count() == 0
    assert snapshot_changes(spark.createDataFrame(snap([(3, "a", "A", 1, 0)] * 5), SNAP), "url").count() == 0


@pytest.mark.parametrize("chunk", [1, 8, 1024])
def test_snapshot_against_brute_force(spark, chunk):
    import random

    rnd = random.Random(chunk)
    rows, state = [], {f"u{i}": (f"t{i}", i) for i in range(300)}
    versions = []
    for no in (2, 3, 7):
        for key in list(state):
            x = rnd.random()
            if x < 0.03:
                del state[key]
            elif x < 0.06:
                state[key] = (state[key][0] + "x", None)
        state[f"n{no}"] = ("new", 1)
        versions.append((no, dict(state)))
        rows += [(no, k, t, s, rnd.choice([0, 1])) for k, (t, s) in state.items() for _ in range(rnd.choice([1, 1, 2]))]
    want = set()
    for (_, old), (no, new) in zip(versions, versions[1:], strict=False):
        want |= {(no, k, "added") for k in new.keys() - old.keys()} | {(no, k, "removed") for k in old.keys() - new.keys()} | {(no, k, "changed") for k in new.keys() & old.keys() if old[k] != new[k]}
    df = spark.createDataFrame(snap(rows), SNAP).repartition(7)
    assert {tuple(r) for r in snapshot_changes(df, "url", chunk_keys=chunk).collect()} == want


def test_several_titles(spark):
    L = F.lit  # noqa: N806
    title = "x" * 40
    r = one(spark, page_scores.stored_title(L(title), L(True), L(True)).alias("a"), page_scores.stored_title(L(title), L(False), L(True)).alias("b"), page_scores.stored_description(L("x"), L(True), L(True)).alias("c"), page_scores.stored_title(L(""), L(False), L(True)).alias("d"))
    assert (r.a, r.b, r.c, r.d) == (3.0, 6.0, 0.0, 0.0)


def test_matching_chunks_are_discarded(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(snapshots, "written", lambda df, label: kept.append(df.cache()) or kept[-1])
    rows = [(no, f"u{i}", "T", i + (no == 5 and i == 77), 10 * no) for no in (4, 5, 6) for i in range(2000)]
    changes = snapshot_changes(spark.createDataFrame(snap(rows), SNAP), "url")
    assert sorted(tuple(r) for r in changes.collect()) == [(5, "u77", "changed"), (6, "u77", "changed")]
    assert kept[0].select("chunk").distinct().count() == 1


def test_versions_that_swap_their_order_are_a_change(spark):
    rows = [(1, "a", "A", 1, 0), (1, "a", "B", 1, 2), (2, "a", "B", 1, 10), (2, "a", "A", 1, 12), (1, "b", "A", 1, 0), (1, "b", "A", 1, 0), (2, "b", "A", 1, 10)]
    assert [tuple(r) for r in snapshot_changes(spark.createDataFrame(snap(rows), SNAP), "url").collect()] == [(2, "a", "changed")]


def test_loose_records(spark):
    rows = ['{"title":{"text":"","content":"c"},"n":"12px","b":0,"a":[1],"o":{}}', '{"title":true,"n":3.5,"b":"x","a":{"0":1}}', '{"title":0,"n":null,"b":[]}', '{"title":["x"],"n":"px","b":{}}', "[1]", '"text"', "broken {", None, "{}", '{"title":7}']
    parsed = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r string").withColumn("r", F.try_parse_json("r"))
    r = F.col("r")
    got = [tuple(x) for x in parsed.orderBy("i").select(records.record_text(r, "$.title"), records.record_number(r, "$.n"), records.record_flag(r, "$.b"), F.size(records.record_items(r, "$.a")), records.has_object(r, "$.o"), records.kind_of(r, "$.n")).collect()]
    assert got == [("c", 12.0, False, 1, True, "string"), ("true", 3.5, True, 0, False, "number"), ("", 0.0, True, 0, False, "null"), ("", 0.0, True, 0, False, "string")] + [("", 0.0, False, 0, False, "undefined")] * 5 + [("7", 0.0, False, 0, False, "undefined")]
    whole = records.sanitised(parsed, "r", ["i"]).orderBy("i").collect()
    assert len(whole) == len(rows) and whole[7].page_url == "unknown" and whole[7].seo_grade == "F" and whole[7].duplicate_score == 10.0


def test_rounding(spark):
    r = one(spark, half_up(F.lit(-0.5)).alias("a"), half_up(F.lit(2.5)).alias("b"), half_even(F.lit(2.5)).alias("c"), half_even(F.lit(0.125), 2).alias("d"))
    assert (r.a, r.b, r.c, float(r.d)) == (0, 3, 2, 0.12)


@pytest.mark.parametrize(("length", "score"), [(0, 0), (1, 6), (29, 6), (30, 10), (60, 10), (61, 7)])
def test_title_lengths(spark, length, score):
    assert one(spark, page_scores.audit_title(F.lit("a" * length)).alias("s")).s == score


def test_scores_stay_in_range_and_stored_ceiling(spark):
    full = {n: F.lit(10.0) for n in page_scores.WEIGHTS}
    r = one(spark, page_scores.total_score(full, True).alias("a"), page_scores.total_score({}, True).alias("b"), page_scores.stored_title(F.lit(None).cast("string"), F.lit(None).cast("boolean")).alias("c"))
    assert (r.a, r.b, r.c) == (100.0, 0.0, 0.0)
    persisted = full | {"url": F.lit(7.0), "images": F.lit(0.0), "performance": F.lit(1.0)}
    s = page_scores.total_score(persisted, True)
    r = one(spark, s.alias("s"), page_scores.grade(s).alias("g"))
    assert (r.s, r.g) == (80.0, "B")  # 10 * (10 - 0.05 * 3 - 0.05 * 10 - 0.15 * 9)


def test_model_rules(spark):
    L = F.lit
    r = one(
        spark,
        page_scores.stored_images(L(0), L(0), L(0)).alias("none"), page_scores.stored_images(L(4), L(1), L(4)).alias("some"),
        page_scores.stored_links(L(0), L(0), L(0), L(0)).alias("no_links"), page_scores.stored_links(L(10), L(1), L(5), L(5)).alias("links"),
        page_scores.stored_quality(L(0), L(3), L(0), L(86)).alias("empty_page"), page_scores.stored_performance(L(True), L(60), L(3.0), L(0.2)).alias("speed"),
    )
    assert (r.none, r.some, r.no_links, r.links, r.empty_page, r.speed) == (10.0, 3.0, 5.0, 1.0, 0.0, 6.0)


def test_soft_limit(spark):
    counts = lambda *c: F.array(*[F.lit(x) for x in c])
    r = one(spark, text.soft_limit(counts(49, 5, 7)).alias("a"), text.soft_limit(counts(200, 3, 0, 2)).alias("b"), text.soft_limit(counts(3, 4)).alias("c"))
    assert (r.a, r.b, r.c) == (51, 52, 7)


def test_low_density():
    assert text.has_low_density(None) and text.has_low_density("short")
    assert not text.has_low_density(" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(60)))
    assert text.has_low_density("word " * 10 + " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)) + " tail" * 0)


def test_urls(spark):
    base = "https://a.example/x/y.html?q=1#f"
    got = {h: one(spark, urls.resolve(F.lit(base), F.lit(h)).alias("u")).u for h in ("z", "/z", "//b.example", "?p", "#g", "", "tel:1")}
    assert got == {"z": "https://a.example/x/z", "/z": "https://a.example/z", "//b.example": "https://b.example", "?p": "https://a.example/x/y.html?p", "#g": "https://a.example/x/y.html?q=1#g", "": base, "tel:1": "tel:1"}
    r = one(spark, urls.origin(F.lit("nonsense")).alias("o"), urls.is_web_url(F.lit(None).cast("string")).alias("w"), urls.lookup_target(F.lit(" a.example ")).alias("t"))
    assert (r.o, r.w, r.t) == (None, False, "https://a.example/")


def test_html_facts(spark):
    page = """<html><head><title> </title><meta property="og:title" content="OG"><meta name=robots content=index><link rel="alternate" hreflang="de" href="/de">
    <script type="application/ld+json">[{"@type":["A","B"]},{"@type":"C"}]</script></head><body><header><h1>In header</h1></header><div class="container"><div class="content">Some longer text <b>bold</div></div>
    <script>var x="</p>"</script><a href=" /x " rel=NoFollow>t</a><a>none</a><img src=a.png alt=" " width=10%></body>"""
    f, whole = html.facts(page), html.facts(page, pruned=False)
    assert f["og_title"] == "OG" and f["h1_text"] == "In header" and f["headings"] == [] and whole["headings"] == [{"level": 1, "text": "In header"}]
    assert f["content"] == "Some longer text bold" and f["ld_types"] == [] and whole["ld_types"] == ["A", "B", "C"]
    assert f["links"] == [{"href": "/x", "text": "t", "rel": "nofollow"}] and f["images"][0]["has_alt"] is False and f["images"][0]["width"] is None
    assert f["hreflang"] == [{"lang": "de", "url": "/de"}] and f["error"] is None
    for bad in (None, "", "   "):
        assert html.facts(bad)["error"] == "empty page"
    df = spark.createDataFrame([("u", None), ("v", "<b>x" * 50), ("w", "<title>T</title>")], "url string, html string")
    assert [r["facts"]["title_tag"] for r in html.page_facts(df).orderBy("url").collect()] == [None, None, "T"]


def test_ratio():
    assert duplicates.ratio("abc", "abc") == 100 and duplicates.ratio("", "") == 100 and duplicates.ratio("a", "") == 0 and duplicates.ratio(None, "a") is None
    assert duplicates.ratio("kitten", "sitting") == round(200 * 4 / 13)
    assert duplicates.lcs_length("AGCAT" * 30, "GAC" * 40) == lcs("AGCAT" * 30, "GAC" * 40)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], old + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_similar_sets_against_brute_force(spark):
    import random

    rnd = random.Random(6)
    bases = [rnd.sample(range(80), rnd.randrange(3, 25)) for _ in range(12)]
    sets = {}
    for i in range(150):
        words = list(rnd.choice(bases))
        for _ in range(rnd.randrange(0, 4)):
            words[rnd.randrange(len(words))] = rnd.randrange(80)
        sets[i] = {f"w{w}" for w in words}
    rows = [(i, sorted(s)) for i, s in sets.items()] + [(900, []), (901, None)]
    first = {}
    for i, s in sets.items():
        first.setdefault(frozenset(s), i)
    kept = {i: s for s, i in first.items()}
    want = {(a, b) for a in kept for b in kept if a < b and len(kept[a] & kept[b]) >= 0.7 * len(kept[a] | kept[b]) - 1e-9}
    got = {(r.a, r.b) for r in duplicates.similar_sets(spark.createDataFrame(rows, "id long, words array<string>"), "id", "words", 70).collect()}
    assert got == want and len(want) > 50


def test_records(spark):
    r = one(spark, *[records.safe_number(F.lit(v).cast("string")).alias(n) for n, v in (("a", "12px"), ("b", "-3.9"), ("c", None), ("d", "x"), ("e", "99999999999999999999"))])
    assert (r.a, r.b, r.c, r.d, r.e) == (12, -3, 0, 0, 0)
    rows = spark.createDataFrame([(1, 5, "x"), (1, None, "y"), (1, 5, "x"), (None, 1, "z")], "k int, t int, v string")
    assert {(x.k, x.v) for x in records.latest(rows, ["k"], ["t"]).collect()} == {(1, "x"), (None, "z")}
    again = records.upsert(rows, rows, ["k"], ["t"])
    assert again.count() == 2
    assert records.latest(rows.limit(0), ["k"], ["t"]).count() == 0


def test_backoff_sequence(spark):
    events = spark.createDataFrame([("d", i, f) for i, f in enumerate([True] * 4 + [False] + [True])], "d string, ts int, bad boolean")
    got = [(r.failures, r.backoff_ms, r.blocked) for r in timeline.failure_runs(events, "d", ["ts"], F.col("bad")).orderBy("ts").collect()]
    assert got == [(1, 4000, False), (2, 8000, False), (3, 16000, False), (4, 30000, True), (0, 0, False), (1, 4000, False)]


def test_sessions_boundary(spark):
    t = datetime.datetime(2025, 1, 1)
    minutes = [0, 30, 61, 90]
    events = spark.createDataFrame([("u", t + datetime.timedelta(minutes=m)) for m in minutes], "u string, ts timestamp_ntz")
    got = sorted((r.session, r.events) for r in timeline.sessions(events, "u", "ts").collect())
    assert got == [(0, 2), (1, 2)]


def test_entry_and_contract(spark, data):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
