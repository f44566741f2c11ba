from __future__ import annotations

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigrove.llm.splitting import _TOKEN, split_oversized, split_text


def check(text: str, limit: int, overlap: int, by: str) -> None:
    pieces = split_text(text, limit, overlap, by)
    size = (lambda s: len(_TOKEN.findall(s))) if by == "tokens" else len
    if size(text) == 0:
        assert pieces == []
        return
    whole, last = "", 0
    for k, (a, b, n, _) in enumerate(pieces):
        assert a <= last < b and n <= limit and size(text[a:b]) == n
        assert size(text[a:last]) == (0 if k == 0 else overlap)
        whole += text[last:b]
        last = b
    assert whole == text


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abc .\n#é_😀1"), max_size=400), st.integers(2, 40), st.integers(0, 20))
def test_round_trip(text, limit, overlap):
    for by in ("chars", "tokens"):
        check(text, limit, min(overlap, limit - 1), by)


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("ab .\n#"), max_size=200), st.integers(4, 30), st.integers(0, 3))
def test_packing_is_greedy(text, limit, overlap):
    """No piece could have taken all that is new in the next."""
    pieces = split_text(text, limit, overlap)
    for (a, b, _, _), (_, d, _, _) in itertools.pairwise(pieces):
        assert d - a > limit


def test_natural_boundaries():
    text = "# A\n\none two. three four.\n\n# B\n\n" + "five six seven. " * 5
    assert [text[a:b] for a, b, _, _ in split_text(text, 40, 0, coarsest=True)][0] == "# A\n\none two. three four.\n\n"
    assert [text[a:b] for a, b, _, _ in split_text(text, 40, 0)][:2] == ["# A\n\none two. three four.\n\n# B\n\n", "five six seven. five six seven. "]
    assert [c for *_, c in split_text("x" * 25, 10, 0)] == ["character", "character", "end"]


def test_very_long_text():
    rng = random.Random(1)
    text = "".join(rng.choice(["word ", "Stop. ", "\n\n", "x" * 300, "\n# H\n"]) for _ in range(60_000))
    check(text, 4800, 200, "chars")


def test_bad_overlap():
    with pytest.raises(ValueError, match="overlap"):
        split_text("a", 5, 5)


def test_rows(spark):
    rows = [("t", "a", "x y " * 20), ("t", "a", "x y " * 20), ("t", "b", None), ("t", "c", ""), ("t", "d", "short"), (None, None, "z" * 60), ("t", "a", "q" * 70)]
    df = spark.createDataFrame(rows, "record_table string, record_key string, text string").withColumn("size", F.lit(1)).withColumn("piece_index", F.lit("k"))
    out = split_oversized(df, 50, 10).collect()
    assert {(r.record_key, r.size) for r in out} == {("a", 50), ("a", 40), (None, 40), (None, 30)}
    assert split_oversized(df.limit(0), 50, 10).count() == 0
    exact = spark.createDataFrame([("t", "e", "x " * 12), ("t", "f", "x " * 13)], "record_table string, record_key string, text string")
    assert {r.record_key for r in split_oversized(exact, 12, 2, "tokens").collect()} == {"f"}
