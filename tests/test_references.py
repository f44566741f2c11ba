from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lexigrove.operators.references import count_orphans, orphan_references, tidy_key

REFS = "parent_table string, ref_table string, row_key string, ref_key string, ref_time timestamp"
PARENTS = "parent_table string, ref_key string, begins timestamp, ends timestamp"
T = datetime(2025, 3, 10)


def day(n: int) -> datetime:
    return T + timedelta(days=n)


def found(spark, refs, parents):
    return {tuple(r) for r in orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)).collect()}


def test_reasons_ties_and_nulls(spark):
    parents = [("p", "a", day(0), None), ("p", "b", day(0), day(2)), ("p", "b", day(5), None), ("p", "c", None, None), ("p", "d", day(1), day(1)), ("p", None, day(0), None)]
    refs = [
        ("p", "t", "1", "a", day(0)),  # begins at that very time: alive
        ("p", "t", "2", "a", day(-1)), ("p", "t", "3", "b", day(1)), ("p", "t", "4", "b", day(2)),  # removed at that very time
        ("p", "t", "5", "b", day(3)), ("p", "t", "6", "b", day(5)), ("p", "t", "7", "x", day(3)), ("p", "t", "7", "x", day(3)),
        ("p", "t", "8", None, day(3)), ("p", "t", "9", "c", day(3)), ("p", "t", "10", "a", None), ("p", "t", "11", "x", None), ("q", "t", "12", "a", day(3)), ("p", "t", None, "x", day(3)), ("p", "t", "13", "d", day(1)),
    ]
    assert found(spark, refs, parents) == {
        ("t", "2", "a", "2025-03", "late"), ("t", "4", "b", "2025-03", "removed"), ("t", "5", "b", "2025-03", "removed"), ("t", "7", "x", "2025-03", "missing"),
        ("t", "9", "c", "2025-03", "late"), ("t", "11", "x", None, "missing"), ("t", "12", "a", "2025-03", "missing"), ("t", None, "x", "2025-03", "missing"), ("t", "13", "d", "2025-03", "removed"),
    }


def test_empty_tables(spark):
    assert found(spark, [], [("p", "a", T, None)]) == set()
    assert found(spark, [("p", "t", "1", "a", T)], []) == {("t", "1", "a", "2025-03", "missing")}


def test_brute_force_and_clashing_columns(spark):
    rng = random.Random(3)
    parents = [("p", rng.choice("abcdefg"), day(rng.randrange(40)), rng.choice([None, day(rng.randrange(10, 60))])) for _ in range(60)]
    refs = [("p", "t", str(i), rng.choice("aaaaaabcdefghij"), day(rng.randrange(60))) for i in range(500)]
    expected = set()
    for _, t, row, key, at in refs:
        rows = [(b, e) for _, k, b, e in parents if k == key]
        begun = [(b, e) for b, e in rows if b <= at]
        if not any(e is None or e > at for _, e in begun):
            expected.add((t, row, key, at.strftime("%Y-%m"), "missing" if not rows else "late" if not begun else "removed"))
    a = spark.createDataFrame(refs, REFS).withColumn("reason", F.lit("mine")).withColumn("uses", F.lit(1))
    b = spark.createDataFrame(parents, PARENTS).withColumn("known", F.lit(1)).withColumn("row_key", F.lit("z"))
    got = orphan_references(a, b)
    assert {tuple(r) for r in got.collect()} == expected
    assert sum(r.n_references for r in count_orphans(got).collect()) == len(expected)


def test_tidy_key(spark):
    df = spark.createDataFrame([("\t A b \n",), ("  ",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(tidy_key(F.col("x"))).collect()] == ["a b", None, None, None]


def test_periods_are_in_utc_whatever_the_session(spark):
    rows = spark.sql("SELECT 'p' AS parent_table, 't' AS ref_table, '1' AS row_key, 'x' AS ref_key, timestamp '2025-03-31 23:30:00 UTC' AS ref_time")
    empty = spark.createDataFrame([], PARENTS)
    for zone in ("Asia/Tokyo", "America/Lima", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert [r.period for r in orphan_references(rows, empty).collect()] == ["2025-03"]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
