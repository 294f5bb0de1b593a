"""Scans over chunks of ordered rows, against loops."""

import random

from pyspark.sql import functions as F

from auditlake.operators import ordered


def test_scans_against_loops(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["hot"] * 6 + ["a", "b", None]), i // 2, i, rnd.choice([None, *range(50)])) for i in range(1500)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t long, id long, v long").repartition(6)
    chunks = ordered.chunked(df, "k", ["t", "id"], 7)
    assert chunks.where("k = 'hot'").select(ordered.CHUNK).distinct().count() > 1
    values = {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))}
    got = {r.id: (r.s, r.m, r.l) for r in ordered.scan(chunks, "k", ["t", "id"], values).collect()}
    before = {r.id: (r.s, r.m, r.l) for r in ordered.scan(chunks, "k", ["t", "id"], values, exclusive=True).collect()}
    places = {r.id: (r.k2, r.n) for r in ordered.ranked(chunks, "k", ["t", "id"], "k2", "n").collect()}
    for key in ("hot", "a", "b", None):
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3])
        s, m, last = 0, None, None
        for place, (_, _, i, v) in enumerate(mine, 1):
            assert before[i] == (s, m, last)
            if v is not None:
                s, m, last = s + v, v if m is None else max(m, v), v
            assert got[i] == (s, m, last) and places[i] == (place, len(mine))


def test_scans_of_nothing(spark):
    df = spark.createDataFrame([], "k string, t long")
    assert ordered.ranked(ordered.chunked(df, "k", ["t"]), "k", ["t"], "n").count() == 0
