from __future__ import annotations

import random

from pyspark.sql import functions as F

from lexigrove.llm.leakage import leaks, tiles, words

ITEMS = "item_id bigint, question string, reference_answer string, evidence_text string"


def test_tiles_cover_reordered_passages():
    a = [f"w{i}" for i in range(40)]
    b = a[20:40] + ["x"] + a[0:20]
    assert tiles(a, b, 12) == [(0, 21, 20), (20, 0, 20)]
    assert tiles(a[:11], a, 12) == [] and tiles([], a, 12) == []


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, *(" ".join(rng.choices(vocabulary, k=rng.randrange(5, 30))) for _ in range(3))) for i in range(12)] + [(50, None, "", "Ünï-Code, a_b " * 8), (51, None, None, None)]
    docs = []
    for d in range(120):
        t = rng.choices(vocabulary, k=rng.randrange(0, 60))
        if rng.random() < 0.5:
            w = words(rng.choice([x for x in items[rng.randrange(12)][1:] if x]))
            s = rng.randrange(max(1, len(w) - 8))
            t[5:5] = w[s : s + rng.randrange(9, 15)]
        docs.append((d, "; ".join(t).upper()))
    docs += [(900, None), (901, ""), (902, "ÜNÏ code A B " * 3 + "x" * 100_000), (0, docs[0][1])]
    grams = lambda t: {tuple(w[i : i + 12]) for w in [words(t)] for i in range(len(w) - 11)}
    expected = {(d, i[0]) for d, t in docs for i in items if any(grams(t) & grams(x) for x in i[1:])}
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(1)).withColumn("covered", F.lit("c"))
    it = spark.createDataFrame(items, ITEMS).withColumn("doc_id", F.lit(7)).withColumn("text", F.lit("t"))
    for bits in (1 << 27, 64):  # the filter lets nearly nothing else through, or everything
        got = leaks(df, it, bits=bits)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == expected
        assert all(12 <= r.longest <= r.n_words and 0 < r.covered <= 1 for r in got.collect())
    assert (902, 50) in expected
    half = leaks(df, it, least_covered=0.5).collect()
    assert {(r.doc_id, r.item_id, r.field) for r in half} == {(r.doc_id, r.item_id, r.field) for r in got.collect() if r.covered >= 0.5}
    assert leaks(df.limit(0), it).count() == 0 and leaks(df, it.limit(0)).count() == 0


def plainly(a, b, least):
    """Greedy tiling by looking at all pairs of places again for each tile."""
    used_a, used_b, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n >= least and n > best[2]:
                    best = (i, j, n)
        if not best[2]:
            return out
        i, j, n = best
        used_a |= set(range(i, i + n))
        used_b |= set(range(j, j + n))
        out.append(best)


def test_tiles_are_those_of_plain_tiling():
    rng = random.Random(9)
    for _ in range(150):
        a, b = (rng.choices("abc", k=rng.randrange(0, 24)) for _ in range(2))
        assert tiles(a, b, 3) == plainly(a, b, 3)
    assert [x[2] for x in tiles(["x"] * 300, ["x"] * 5000, 12)] == [300]


def test_a_passage_in_a_third_of_all(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [(i, f"a{i} b{i} " + (passage if i % 3 == 0 else f"c{i}") + f" d{i}") for i in range(3000)] + [(2**60 + 1, passage), (None, passage)]
    it = spark.createDataFrame([(2**61 + 1, passage, None, None)], ITEMS)
    got = leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), it).collect()
    assert sorted((r.doc_id or -1, r.item_id) for r in got) == sorted([(i, 2**61 + 1) for i in range(0, 3000, 3) if i] + [(-1, 2**61 + 1), (-1, 2**61 + 1), (2**60 + 1, 2**61 + 1)])
    assert all(r.covered == 1 and r.longest == 30 and r.n_tiles == 1 for r in got)
