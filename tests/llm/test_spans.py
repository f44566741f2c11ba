from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexigrove.llm import spans
from lexigrove.llm.spans import Shared, shared

L = 60  # a small least length, to which all others scale


def corpus(seed: int, n: int = 160) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(1, 9)))

    def text(k):
        return "".join(word() + rng.choice([" "] * 9 + [". ", "\n", ", ", "-"]) for _ in range(k))

    docs = [(i, text(rng.randrange(1, 60))) for i in range(n)]
    boiler = text(40)[:75]
    for _ in range(120):  # passages from anywhere to anywhere, of lengths about the limit
        a, b = rng.sample(range(n), 2)
        if len(docs[a][1]) > 90:
            s = rng.randrange(len(docs[a][1]) - 80)
            at = rng.randrange(len(docs[b][1]) + 1)
            docs[b] = (b, docs[b][1][:at] + docs[a][1][s : s + rng.randrange(45, 80)] + docs[b][1][at:])
    for i in range(0, n, 3):  # a passage in a third of all
        docs[i] = (i, docs[i][1] + boiler[: rng.choice([58, 75])] + word())
    docs += [(n + i, docs[5][1] + "x" * 60) for i in range(6)] + [(n + 10, "ab" * 2000), (n + 11, "ba" * 500), (n + 12, "é😀" * 40), (n + 13, "q é😀" * 30)]
    return docs


def brute(docs, least):
    grams = {d: {t[i : i + least] for i in range(len(t) - least + 1)} for d, t in docs}
    return {(a, b) for a, b in itertools.combinations(sorted(grams), 2) if grams[a] & grams[b]}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairs_are_those_of_brute_force(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("seed", F.lit(1)).withColumn("first", F.lit("f"))
    expected = brute(docs, L)
    got = Shared(df, least=L, expand=10_000)
    pairs = {tuple(r) for r in got.document_pairs().collect()}
    assert pairs == expected
    by = dict(docs)
    cover = {r.doc_id: r for r in got.coverage().collect()}
    for d, t in docs:
        if len(t) < L:
            assert d not in cover
            continue
        others = {o[i : i + L] for x, o in by.items() if x != d for i in range(len(o) - L + 1)}
        hit = set(itertools.chain.from_iterable(range(i, i + L) for i in range(len(t) - L + 1) if t[i : i + L] in others))
        assert cover[d].n_shared == len(hit)


def test_wide_groups_are_linked_to_their_first(spark):
    docs = corpus(4)
    got = Shared(spark.createDataFrame(docs, "doc_id bigint, text string"), least=L, expand=4)
    pairs, expected = {tuple(r) for r in got.document_pairs().collect()}, brute(docs, L)

    def parts(edges):
        top = {}
        find = lambda x: x if top.setdefault(x, x) == x else find(top[x])
        for a, b in edges:
            top[find(a)] = find(b)
        return {frozenset(x for x in top if find(x) == r) for r in {find(x) for x in top}}

    assert pairs <= expected and len(pairs) < len(expected) and parts(pairs) == parts(expected)


def test_removal_keeps_the_first(spark):
    p = "This is a passage that stands in both. And it has two sentences of some length here. "
    docs = [(1, "One. " + p + "Two."), (2, "Three. " + p + "Four."), (3, "One. " + p + "Two.")]
    got = {r.doc_id: r for r in Shared(spark.createDataFrame(docs, "doc_id bigint, text string"), least=L).without_repeats().collect()}
    assert got[2].text == "Three. Four." and got[2].n_removed == 2 and got[3].text == "" and 1 not in got


def test_edge_rows(spark):
    t = "Some text that is long enough. " * 4
    rows = [(1, t), (1, t), (2, t), (3, None), (4, ""), (None, t), (5, "short"), (6, "z " * 300_000 + t), (7, "z " * 300_001), (2**60 + 1, t)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    pairs = {tuple(r) for r in Shared(df, least=L).document_pairs().collect()}
    assert {(1, 2), (1, 6), (2, 6), (6, 7), (1, 2**60 + 1)} <= pairs
    empty = Shared(df.limit(0), least=L)
    assert empty.document_pairs().count() == 0 and empty.coverage().count() == 0 and empty.without_repeats().count() == 0


def test_shared_intervals():
    a, b = "x" * 10 + "abcdefghij" * 7, "abcdefghij" * 7 + "y"
    in_a, in_b = shared(a, b, L)
    assert in_a == [(10, 80)] and in_b == [(0, 70)]


@pytest.mark.parametrize(("expand", "cell"), [(4, 256), (4, 8)])
def test_wide_groups_of_different_texts_give_all_pairs(spark, monkeypatch, expand, cell):
    monkeypatch.setattr(spans, "CELL", cell)
    passage = "A passage that stands in very many texts, and in each of them whole. "
    docs = [d for d in corpus(5) if d[0] < 160] + [(200 + i, f"{i} {passage}{i * 7919}") for i in range(45)] + [(300, "x" + passage), (301, "x" + passage)]
    got = Shared(spark.createDataFrame(docs, "doc_id bigint, text string"), least=L, expand=expand)
    expected = brute(docs, L)
    assert {tuple(r) for r in got.document_pairs().collect()} == expected
    cover = {r.doc_id: r.n_links for r in got.coverage().collect()}
    assert cover[200] == 45 and cover[300] == cover[301] == 45  # the texts, of which 300 and 301 are one
    others = {d: {b if a == d else a for a, b in expected if d in (a, b)} for d in cover}
    assert all(cover[d] == len(others[d] - {301}) for d in cover if d < 300)


def test_a_third_in_one_class_and_a_third_around_one_stretch(spark, monkeypatch):
    monkeypatch.setattr(spans, "SPREAD", 10)
    passage, copy = "A passage that stands in very many texts, and in each of them whole. ", "The same text again and again, and it is long enough to count here. "
    docs = [(i, copy) for i in range(100)] + [(100 + i, f"{i * 7919} {passage}{i}") for i in range(100)] + [(200 + i, f"Nothing {i * 31337} of it is anywhere else, {i * 65537} at all, {i * 271} or at least {i}.") for i in range(100)]
    got = Shared(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), least=L, expand=8)
    pairs = {tuple(r) for r in got.document_pairs().collect()}
    assert pairs == {(0, i) for i in range(1, 100)} | set(itertools.combinations(range(100, 200), 2))
    cover = {r.doc_id: r for r in got.coverage().collect()}
    assert all((cover[i].class_id, cover[i].n_copies, cover[i].n_links, cover[i].share) == (0, 100, 0, 1) for i in range(100))
    assert all((cover[i].class_id, cover[i].n_copies, cover[i].n_links) == (i, 1, 99) and cover[i].n_shared >= len(passage) for i in range(100, 200))
    assert all(cover[i].n_links == 0 and cover[i].n_shared == 0 for i in range(200, 300) if i in cover)
