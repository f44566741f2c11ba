from __future__ import annotations

import random
import re
from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lexigrove.llm.ledger import Ledger, copies, fill, keyed

SCHEMA = "row_id bigint, name string, type string, aliases array<string>, extracted_at timestamp"
T = datetime(2025, 1, 1)


def key(name, kind, aliases):
    c = lambda s: "".join(x for x in (s or "").upper().lower() if x.isalnum())
    return c(name), c(kind), frozenset(filter(None, map(c, aliases or [])))


def test_against_brute_force_with_a_hot_key(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        name = "Hot Name" if i % 3 == 0 else rng.choice(["a b", "A-B", "straße", "STRASSE", "", None, "é", "e"])
        rows.append((i, rng.choice([name, name and name.upper()]), rng.choice(["T", "t "]), rng.choice([None, [], ["x", "Y"], ["y", "X.", "x"], [None, " "]]), rng.choice([None, T + timedelta(hours=rng.randrange(5000))])))
    groups = defaultdict(list)
    for r in rows:
        groups[key(*r[1:4])].append(r[0])
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("mine")).withColumn("copies", F.lit(0))
    k = keyed(df)
    for batches in (1, 4):
        ledger = fill(k, batches)
        assert {(r.first_id, r.copies) for r in ledger.rows().collect()} == {(min(g), len(g)) for g in groups.values()}
        assert {tuple(r) for r in copies(k, ledger).collect()} == {(min(g), x) for g in groups.values() for x in g if x != min(g)}


def test_empty_and_untouched_buckets(spark):
    empty = keyed(spark.createDataFrame([], SCHEMA))
    assert fill(empty).rows().count() == 0
    ledger = Ledger(spark, buckets=8)
    one = spark.createDataFrame([(bytearray(b"k1"), 5), (None, 1), (bytearray(b"k1"), None)], "key binary, id bigint")
    ledger.add(one)
    ledger.add(one.limit(0))
    ledger.add(spark.createDataFrame([(bytearray(b"k2"), 3), (bytearray(b"k1"), 4)], "key binary, id bigint"))
    assert {(bytes(r.key), r.copies, r.first_id) for r in ledger.rows().collect()} == {(b"k1", 3, 4), (b"k2", 1, 3)}
    assert len(set(ledger.generation)) <= 8 and re.match(r".*ledger$", ledger.at)


def test_a_later_session_takes_it_up(spark, tmp_path):
    at = f"file://{tmp_path}/ledger"
    many = spark.range(4000).selectExpr("unhex(md5(string(id))) AS key", "id")
    Ledger(spark, 64, at).add(many)
    again = Ledger(spark, at=at)
    assert again.buckets == 64 and again.batches == 1
    few = spark.createDataFrame([(5,), (5,), (77,), (9999,)], "id bigint").selectExpr("unhex(md5(string(id))) AS key", "id + 100 AS id")
    again.add(few)
    assert sorted(set(again.generation.values())) == [1, 2] and sum(g == 2 for g in again.generation.values()) <= 3
    last = Ledger(spark, at=at)
    assert last.rows().count() == 4001 and sorted((r.copies, r.first_id) for r in last.rows().where("copies > 1 OR first_id > 4000").collect()) == [(1, 10099), (2, 77), (3, 5)]


def test_a_batch_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/ledger"
    one = spark.createDataFrame([(bytearray(b"k"), 5), (bytearray(b"l"), 6)], "key binary, id bigint")
    Ledger(spark, at=at).add(one)
    broken = Ledger(spark, at=at)
    with monkeypatch.context() as m:
        m.setattr(Ledger, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        try:
            broken.add(one)
        except OSError:
            pass
    for _ in range(2):
        held = Ledger(spark, at=at)
        before = {r.copies for r in held.rows().collect()}
        held.add(one)
        assert before == ({1} if held.batches == 2 else {2})
    assert {(bytes(r.key), r.copies) for r in Ledger(spark, at=at).rows().collect()} == {(b"k", 3), (b"l", 3)}
