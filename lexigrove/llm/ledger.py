"""Duplicates hidden by formatting differences.

A ledger keeps, in hash buckets, one row for each canonical key: how many copies came so far and the earliest of them.
Each batch is aggregated by key first, then outer-joined with those buckets of the ledger that it touches; a touched
bucket is written as a new generation, the others stay as they are.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.shared import join_heavy, materialize, new_path, table

#: Buckets of a ledger if its maker knows no better; a ledger of billions of keys wants thousands. Files of a bucket.
BUCKETS, FILES = 16, 4
#: Rows that fill() plans for a bucket.
BUCKET_ROWS = 1_000_000
BATCHES = 3


def canonical(c: Column) -> Column:
    """Letters and digits alone, without letter case (by way of upper case, so that ß and ss agree); null gives ''."""
    # The optimizer would take lower(upper(x)) for lower(x); with the pattern between the two it doesn't.
    return F.coalesce(F.lower(F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}]+", "")), F.lit(""))


def entity_key(name: Column, kind: Column, aliases: Column) -> Column:
    """16 bytes that agree if name, type and the set of aliases agree canonically.

    Null and empty lists are equal; aliases that are null or without letters and digits don't count.
    """
    names = F.array_sort(F.array_distinct(F.filter(F.transform(aliases, canonical), lambda x: x != "")))
    return F.unhex(F.md5(F.concat_ws("\x1f", canonical(name), canonical(kind), F.coalesce(F.concat_ws("\x1e", names), F.lit("")))))


class Ledger:
    """Copies per canonical key: bucket, key, copies, first_id; kept in a folder, so that a later session takes it up again.

    add() takes batches of (key binary, id bigint); each row counts as a copy, also one that repeats an id. Null keys
    don't count; null ids count but never represent. An empty batch changes nothing.

    at: folder of the ledger, which a manifest in it describes; without one the ledger lies in the shared folder and ends with
    the session. buckets holds for a new ledger: as many as keep a bucket small enough to be written again for a batch that
    touches it. Each batch writes its buckets beside the old ones and then a manifest of its number, so that a batch that
    breaks off changes nothing and can be added again. One session writes at a time.
    """

    def __init__(self, spark: SparkSession, buckets: int = BUCKETS, at: str | None = None):
        self.spark, self.buckets = spark, buckets
        self.at = at.rstrip("/") if at else new_path(spark, "ledger")
        self.generation: dict[int, int] = {}  # of each bucket that has rows
        self.batches = 0
        if at:
            self._reopen()

    def _reopen(self) -> None:
        folder, files = self._path("manifest")
        names = [x.getPath().getName() for x in files.listStatus(folder)] if files.exists(folder) else []
        numbers = [int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit()]
        if numbers:
            self.batches = max(numbers)
            text = self.spark.read.option("wholetext", "true").text(f"{self.at}/manifest/{self.batches}.json").first()[0]
            held = json.loads(text)
            self.buckets, self.generation = held["buckets"], {int(k): v for k, v in held["generation"].items()}

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _commit(self, generation: dict[int, int]) -> None:
        """The manifest comes last, by a rename to a name that didn't exist."""
        number = self.batches + 1
        path, files = self._path(f"manifest/.{number}.tmp")
        out = files.create(path, True)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "generation": generation}).encode()))
        out.close()
        final = self._path(f"manifest/{number}.json")[0]
        if files.exists(final) or not files.rename(path, final):
            raise RuntimeError(f"batch {number} of the ledger {self.at} is there already")
        self.batches, self.generation = number, generation

    def add(self, batch: DataFrame) -> None:
        fresh = (
            batch.where(F.col("key").isNotNull())
            .groupBy(F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int").alias("bucket"), "key")
            .agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id"))
        )
        fresh = materialize(fresh, "batch")
        touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most `buckets` numbers
        if not touched:
            return
        held = [b for b in touched if b in self.generation]
        if held:
            old = self._read(held).select("bucket", "key", F.col("copies").alias("n"), F.col("first_id").alias("f"))
            fresh = fresh.join(old, ["bucket", "key"], "full_outer").select(
                "bucket", "key", (F.coalesce("copies", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("copies"), F.least("first_id", "f").alias("first_id"))
        # A bucket's keys are spread over FILES tasks at most, so that few buckets don't mean few tasks.
        spread = fresh.repartition("bucket", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(FILES)))
        spread.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.at}/generation={self.batches + 1}")
        self._commit(self.generation | dict.fromkeys(touched, self.batches + 1))

    def _read(self, buckets: list[int]) -> DataFrame:
        out = None
        for g in sorted({self.generation[b] for b in buckets}):
            part = (
                self.spark.read.schema("key binary, copies bigint, first_id bigint, bucket int").parquet(f"{self.at}/generation={g}")
                .where(F.col("bucket").isin([b for b in buckets if self.generation[b] == g]))
            )
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], "key binary, copies bigint, first_id bigint, bucket int")

    def rows(self) -> DataFrame:
        return self._read(sorted(self.generation))


def keyed(entities: DataFrame) -> DataFrame:
    """id, key and time of each row; computed once, for the batches and for the way back."""
    return materialize(
        entities.select(F.col("row_id").alias("id"), entity_key(F.col("name"), F.col("type"), F.col("aliases")).alias("key"), F.col("extracted_at").alias("at")), "keyed")


def fill(rows: DataFrame, batches: int = BATCHES, at: str | None = None) -> Ledger:
    """A ledger that took the rows in batches by time, as they would arrive; rows without a time come last.

    A new ledger has a bucket for each BUCKET_ROWS rows, and BUCKETS at least, in powers of two.
    """
    low, high, n = rows.select(F.min(F.unix_micros("at")), F.max(F.unix_micros("at")), F.count(F.lit(1))).first()
    ledger = Ledger(rows.sparkSession, max(BUCKETS, 1 << (n // BUCKET_ROWS).bit_length()), at)
    step = ((high or 0) - (low or 0)) // batches + 1
    number = F.coalesce(F.floor((F.unix_micros("at") - F.lit(low or 0)) / F.lit(step)), F.lit(batches - 1))
    for i in range(batches):
        ledger.add(rows.where(number == i))
    return ledger


def copies(rows: DataFrame, ledger: Ledger) -> DataFrame:
    """first_id and id of each row other than the first of its key. A key may hold any part of the rows."""
    many = ledger.rows().where(F.col("copies") > 1).select("key", "copies", "first_id")
    return join_heavy(rows.select("id", "key"), many, ["key"], "copies").where(F.col("id") != F.col("first_id")).select("first_id", "id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = keyed(table(spark, folder, "extracted_entities"))
    return copies(rows, fill(rows)).select(F.col("first_id").alias("first_row_id"), F.col("id").alias("copy_row_id"))


def p4_entities(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each entity, as its first row has it, with the number of copies."""
    entities = table(spark, folder, "extracted_entities")
    ledger = fill(keyed(entities)).rows().select(F.col("first_id").alias("row_id"), F.col("copies").alias("n_copies"))
    return entities.select("row_id", "name", "type", F.array_join("aliases", "|").alias("aliases")).join(ledger, "row_id")


_P4_SQL = r"""
WITH keyed AS (
  SELECT row_id, name, type, aliases,
    regexp_replace(replace(lower(name), 'ß', 'ss'), '[^\p{L}\p{N}]+', '', 'g') AS n,
    regexp_replace(lower(type), '[^\p{L}\p{N}]+', '', 'g') AS t,
    list_sort(list_distinct(list_filter(list_transform(coalesce(aliases, []),
      lambda x: regexp_replace(replace(lower(x), 'ß', 'ss'), '[^\p{L}\p{N}]+', '', 'g')), lambda x: x <> ''))) AS a
  FROM extracted_entities
), led AS (SELECT *, min(row_id) OVER (PARTITION BY n, t, a) AS f, count(*) OVER (PARTITION BY n, t, a) AS c FROM keyed)
"""
QUERIES = {"p4_found": p4_found, "p4_entities": p4_entities}
ORACLES = {
    "p4_found": _P4_SQL + "SELECT f AS first_row_id, row_id AS copy_row_id FROM led WHERE row_id <> f",
    "p4_entities": _P4_SQL + "SELECT row_id, name, type, array_to_string(aliases, '|') AS aliases, c AS n_copies FROM led WHERE row_id = f",
}
