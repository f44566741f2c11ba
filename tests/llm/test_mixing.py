from __future__ import annotations

import heapq
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigrove.llm.mixing import apportion, mix, quotas
from lexigrove.llm.tokens import VOCABULARY, encoding


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=8), st.integers(0, 300))
def test_apportionment_by_highest_quotients(votes, seats):
    got = [0] * len(votes)
    if sum(votes):
        heap = [(-v, i) for i, v in enumerate(votes) if v]
        heapq.heapify(heap)
        for _ in range(seats):
            _, i = heapq.heappop(heap)
            got[i] += 1
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    ours = apportion(votes, seats)
    assert sum(ours) == sum(got)
    # Ties may be settled either way: the quotients taken must agree.
    taken = lambda x: sorted(round(v / (2 * k + 1), 9) for v, n in zip(votes, x, strict=True) for k in range(n))
    assert taken(ours) == taken(got)


def test_quotas_respect_caps():
    out = quotas({"a": {0: 100, 1: 300}, "b": {0: 50}}, {"a": (0.5, 1), "b": (0.4, 2), "c": (0.1, 3)}, 1000, 10)
    assert sum(q for s, _, _, q in out if s == "a") == 400  # all it has
    assert sum(q for s, _, _, q in out if s == "b") == 100
    assert quotas({}, {}, 0) == []


def test_mix(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randrange(1, 60))), rng.choice(["big"] * 8 + ["Small Source", "small_source", "none", None, " "])) for i in range(3000)]
    docs += [(9000, None, "big"), (9001, "", "big"), (9002, "many words " * 50_000, "none"), (None, "x y z", "big")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("n_tokens", F.lit("x")).withColumn("shard", F.lit(1))
    targets = spark.createDataFrame([("big", 0.08, 1), ("small-source", 0.04, 2), ("absent", 0.1, 1), (None, 0.1, 1), ("none", None, 1), ("big", 0.01, None)], "source string, target_share double, max_repeats int").withColumn("n_documents", F.lit(5))
    chosen, shares = mix(df, targets, block=64)
    again, _ = mix(df.repartition(3), targets, block=64)
    rows = [tuple(r) for r in chosen.collect()]
    assert sorted(rows, key=str) == sorted((tuple(r) for r in again.collect()), key=str)
    encode = encoding(VOCABULARY).encode_ordinary
    sizes = {d: len(encode(t)) for d, t, _ in docs if t}
    total = sum(sizes.values())
    assert all(n == sizes[d] and 1 <= r <= {"big": 1, "small-source": 2}[s] for d, s, n, r in rows) and len({d for d, *_ in rows}) == len(rows)
    by = {r.source: r for r in shares.collect()}
    assert by["big"].share_of_all == pytest.approx(0.08, abs=0.002) and by["absent"].chosen_tokens == 0 and set(by) == {"big", "small-source", "absent", "none"}
    assert by["small-source"].chosen_tokens == sum(n * r for _, s, n, r in rows if s == "small-source") <= 2 * by["small-source"].available_tokens
    assert by["big"].share_of_all == round(by["big"].chosen_tokens / total, 6)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("a", 0.5, 1)], "source string, target_share double, max_repeats int")
    chosen, shares = mix(df, t)
    assert chosen.count() == 0 and [r.chosen_tokens for r in shares.collect()] == [0]
    chosen, shares = mix(df, t.limit(0))
    assert chosen.count() == 0 and shares.count() == 0
