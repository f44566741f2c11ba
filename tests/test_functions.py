from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexigrove.functions import fuzzy
from lexigrove.functions import text as tx
from lexigrove.functions.hooks import embed, generate, hashed_embedding, with_retries
from lexigrove.functions.stemming import classic, revised


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("title", "forms"), [("Dense Passage Retrieval", ["DPR"]), ("Fusion-in-Decoder", ["FD", "FID", "FiD"]), ("RAG", ["RAG"]), ("", []), (None, [])])
def test_implicit_acronyms(spark, title, forms):
    assert one(spark, title, tx.implicit_acronyms) == forms


def test_tokens_and_slugs(spark):
    assert one(spark, "The für Straße v2 isn't", tx.tokens) == ["f", "r", "stra", "e", "v2", "isn"][:5]
    assert one(spark, None, tx.tokens) == [] and one(spark, "Été — 12!", tx.slugify) == "ete-12" and one(spark, "!!", tx.slugify) == "untitled"


def test_markdown(spark):
    page = "---\ntitle: \"A: b\"\ntype: note\n---\n# One\n\nText with [[Target|label]] and [x](y.md \"t\").\n\n```\n# no heading\n```\n\n## Summary\n\nFirst. Second e.g. this one. Third! Fourth.\n"
    assert one(spark, page, lambda c: tx.frontmatter_field(c, "title")) == "A: b"
    assert [(h.level, h.title) for h in one(spark, page, tx.headings)] == [(1, "One"), (2, "Summary")]
    assert [(x.target, x.label) for x in one(spark, page, tx.wikilinks)] == [("Target", "label")] and one(spark, page, tx.markdown_links) == ["y.md"]
    assert one(spark, page, lambda c: tx.section_paragraphs(c, "Summary")) == ["First. Second e.g. this one. Third! Fourth."]
    assert one(spark, "First. Second e.g. this one. Third! Fourth.", tx.sentences) == ["First.", "Second e.g. this one.", "Third!", "Fourth."]
    assert one(spark, page, lambda c: tx.title_of(c, F.lit("f"))) == "One" and one(spark, "\n\n", lambda c: tx.title_of(c, F.lit("f"))) == "f"


def test_truncate(spark):
    assert one(spark, "short  text", lambda c: tx.truncate(c, 50)) == "short text"
    assert one(spark, "One sentence. Two words here and more", lambda c: tx.truncate(c, 24)) == "One sentence...."
    assert one(spark, "word " * 30, lambda c: tx.truncate(c, 40)) == "word word word word word word word..."
    assert one(spark, "x" * 60, lambda c: tx.truncate(c, 20, False)) == "x" * 20


def test_data_references(spark):
    got = one(spark, "So [Data: Entities (1, 2, +more); Reports (7)]. And [Data: entities (1, 2, +more)].", tx.data_references)
    assert [(r.kind, r.ids) for r in got] == [("entities", ["1", "2"]), ("reports", ["7"])]


def test_join_capped_and_payload(spark):
    df = spark.createDataFrame([(["aa", "", None, "bb", "cccc", "d"],)], "x array<string>")
    assert df.select(tx.join_capped(F.col("x"), 6)).first()[0] == "aa bb"
    assert one(spark, "Sure:\n```json\n{\"a\": 1}\n```", tx.json_payload) == '{"a": 1}' and one(spark, "so [1, 2] it is", tx.json_payload) == "[1, 2]" and one(spark, "none", tx.json_payload) is None


def test_variant_pairs(spark):
    cases = [("data-base", "database", True), ("graph", "graph-rag", False), ("supervised", "unsupervised", False), ("retrieval", "retriever", True)]
    df = spark.createDataFrame(cases, "a string, b string, y boolean")
    assert all(r.got == r.y for r in df.select("y", tx.variant_pair(F.col("a"), F.col("b")).alias("got")).collect())


def test_fuzzy():
    assert fuzzy.ratio("abc", "abc") == 100 and fuzzy.ratio("", "") == 100 and fuzzy.ratio("abcd", "abxd") == 75
    assert fuzzy.token_sort_ratio("b a", "a b") == 100 and fuzzy.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert fuzzy.partial_ratio("test", "this is a test!") == 100 and fuzzy.token_set_ratio("", "a") == 0
    import itertools
    import random

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            d = 0
            for j, y in enumerate(b, 1):
                d, row[j] = row[j], d + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(1)
    words = ["".join(rng.choices("abc", k=rng.randrange(0, 90))) for _ in range(25)]
    assert all(fuzzy.common_length(a, b) == lcs(a, b) for a, b in itertools.product(words, words))


def test_stems():
    assert [classic(w) for w in ("relational", "hopping", "adjustable", "controll")] == ["relat", "hop", "adjust", "control"]
    assert [revised(w) for w in ("consistency", "generously", "dying", "knightly", "go")] == ["consist", "generous", "die", "knight", "go"]


def test_hooks(spark):
    df = spark.createDataFrame([("a b",), (None,), ("",)], "x string")
    got = [r.v for r in df.select(embed(F.col("x")).alias("v")).collect()]
    assert got[0] == hashed_embedding(["a b"])[0] and got[1] is None and sum(got[2]) == 0
    assert [r.v for r in df.select(generate(F.col("x")).alias("v")).collect()] == ["a b", None, ""]
    calls = []

    class Busy(Exception):
        status = 429

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise Busy
        return x

    assert with_retries(flaky, sleep=lambda s: None)("q") == "q" and len(calls) == 3
