"""References to records that do not exist.

Distinct non-null foreign keys are aggregated first (partial aggregation on the map side), anti-joined with the keys of
the parent tables, and the suspects are joined back to the references. Where the parents have lifetimes, a key is a
suspect also if a reference to it may fall outside them; these few go through an as-of sweep.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrove.shared import join_heavy, materialize, table

_SPACE = r"[\s\p{Z}\x{200b}\x{feff}]+"
_END = "9999-12-31 00:00:00"


def tidy_key(c: Column) -> Column:
    """Lower case without surrounding whitespace; null where nothing is left."""
    t = F.regexp_replace(F.lower(c), f"(?U)^{_SPACE}|{_SPACE}$", "")
    return F.when(t != "", t)


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Each reference whose target is missing, late or removed.

    refs: parent_table, ref_table, row_key, ref_key, ref_time; ref_key already tidied (tidy_key). Null keys don't count.
    parents: parent_table, ref_key, begins, ends (null while alive). Further columns of either are dropped.
    Returns ref_table, row_key, ref_key, period (UTC month, null for a null time), reason; distinct.

    missing: the target has no row at all. late: all its rows begin after ref_time. removed: some began by then, none is
    alive. A null ref_time can only be missing; a target row with null begins exists but never begins, so references to
    a target with such rows alone are late. Empty refs give no rows; with empty parents every key is missing.
    """
    refs = refs.select("parent_table", "ref_table", "row_key", "ref_key", "ref_time").where(F.col("ref_key").isNotNull())
    parents = parents.select("parent_table", "ref_key", "begins", "ends").where(F.col("ref_key").isNotNull())
    key = ["parent_table", "ref_key"]
    used = refs.groupBy(*key).agg(F.min("ref_time").alias("first_use"), F.count(F.lit(1)).alias("uses"))
    known = parents.groupBy(*key).agg(
        F.min("begins").alias("first_begin"), F.min(F.when(F.col("ends").isNull(), F.col("begins"))).alias("open_from"),
    )
    absent = used.join(known, key, "left_anti").select(
        *key, "uses", F.lit(False).alias("known"), F.lit(None).cast("timestamp").alias("first_begin"), F.lit(None).cast("timestamp").alias("open_from"),
    )
    doubtful = (
        used.join(known, key)
        .where(F.col("first_use").isNotNull() & (F.col("open_from").isNull() | (F.col("first_use") < F.col("open_from"))))
        .select(*key, "uses", F.lit(True).alias("known"), "first_begin", "open_from")
    )
    suspects = materialize(absent.unionByName(doubtful), "suspects")
    back = join_heavy(refs, suspects, key, "uses").withColumn(
        "reason",
        F.when(~F.col("known"), "missing")
        .when(F.col("ref_time").isNull(), "alive")
        .when(F.col("first_begin").isNull() | (F.col("ref_time") < F.col("first_begin")), "late")
        .when(F.col("ref_time") >= F.col("open_from"), "alive")
        .otherwise("sweep"),
    ).where(F.col("reason") != "alive").select(*key, "ref_table", "row_key", "ref_time", "reason")
    back = materialize(back.distinct(), "joined_back")
    swept = _sweep(back.where(F.col("reason") == "sweep"), parents)
    return (
        back.where(F.col("reason") != "sweep").select("ref_table", "row_key", "ref_key", "ref_time", "reason")
        .unionByName(swept)
        .select("ref_table", "row_key", "ref_key", F.date_format(F.to_utc_timestamp("ref_time", F.current_timezone()), "yyyy-MM").alias("period"), "reason")
        .distinct()
    )


def _sweep(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References that aren't alive at their time, by a running maximum of the ends of the rows begun so far.

    Alive at t means: the greatest end among rows begun by t lies after t. Only distinct times of a key are swept, so that a burst
    of references counts once; the sweep is cut by minutes, with the maximum of the minutes before carried in, so that one key's
    times are never sorted in one task. What is found goes back to the references by key and time.
    """
    key = ["parent_table", "ref_key"]
    lives = parents.where(F.col("begins").isNotNull()).join(refs.select(*key).distinct(), key, "left_semi").select(
        *key, F.col("begins").alias("at"), F.coalesce("ends", F.lit(_END).cast("timestamp")).alias("end"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("n"),
    )
    asks = refs.groupBy(*key, F.col("ref_time").alias("at")).agg(F.count(F.lit(1)).alias("n")).select(*key, "at", F.lit(None).cast("timestamp").alias("end"), F.lit(1).alias("kind"), "n")
    events = lives.unionByName(asks).withColumn("minute", F.date_trunc("minute", "at"))
    before = Window.partitionBy(*key).orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    carried = events.groupBy(*key, "minute").agg(F.max("end").alias("e")).select(*key, "minute", F.max("e").over(before).alias("carry"))
    so_far = Window.partitionBy(*key, "minute").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.greatest(F.col("carry"), F.max("end").over(so_far))
    gone = (
        events.join(carried, [*key, "minute"])
        .withColumn("last_end", last)
        .where((F.col("kind") == 1) & (F.col("last_end").isNull() | (F.col("last_end") <= F.col("at"))))
        .select(*key, F.col("at").alias("ref_time"), F.when(F.col("last_end").isNull(), "late").otherwise("removed").alias("why"), "n")
    )
    return join_heavy(refs, materialize(gone, "gone"), [*key, "ref_time"], "n").select("ref_table", "row_key", "ref_key", "ref_time", F.col("why").alias("reason"))


def count_orphans(found: DataFrame) -> DataFrame:
    """References and distinct missing keys per table, period and reason."""
    return found.groupBy("ref_table", "period", "reason").agg(
        F.count(F.lit(1)).alias("n_references"), F.countDistinct("ref_key").alias("n_keys")
    )


def corpus_references(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The references of light_chunks, missing_sources and extracted_entities, and the rows they point to."""
    refs = reduce(DataFrame.unionByName, [
        table(spark, folder, "light_chunks").select(
            F.lit("sources").alias("parent_table"), F.lit("light_chunks").alias("ref_table"), F.col("id").alias("row_key"),
            tidy_key(F.col("source_id")).alias("ref_key"), F.col("built_at").alias("ref_time")),
        table(spark, folder, "missing_sources").select(
            F.lit("sources").alias("parent_table"), F.lit("missing_sources").alias("ref_table"), F.col("record_id").cast("string").alias("row_key"),
            tidy_key(F.col("source_id")).alias("ref_key"), F.col("flagged_at").alias("ref_time")),
        table(spark, folder, "extracted_entities").select("row_id", "extracted_at", F.explode("chunk_ids").alias("ref")).select(
            F.lit("light_chunks").alias("parent_table"), F.lit("extracted_entities").alias("ref_table"), F.col("row_id").cast("string").alias("row_key"),
            tidy_key(F.col("ref")).alias("ref_key"), F.col("extracted_at").alias("ref_time")),
    ])
    parents = table(spark, folder, "sources").select(
        F.lit("sources").alias("parent_table"), tidy_key(F.col("source_id")).alias("ref_key"), F.col("ingested_at").alias("begins"), F.col("removed_at").alias("ends"),
    ).unionByName(table(spark, folder, "light_chunks").select(
        F.lit("light_chunks").alias("parent_table"), tidy_key(F.col("id")).alias("ref_key"), F.col("built_at").alias("begins"), F.col("removed_at").alias("ends"),
    ))
    return refs, parents


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references of the three tables; `removed` is no case in missing_sources."""
    found = orphan_references(*corpus_references(spark, folder))
    return found.where(~((F.col("ref_table") == "missing_sources") & (F.col("reason") == "removed")))


def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_orphans(p1_found(spark, folder))


_P1_SQL = r"""
WITH refs AS (
  SELECT 'sources' AS parent_table, 'light_chunks' AS ref_table, id AS row_key, source_id AS raw, built_at AS ref_time FROM light_chunks
  UNION ALL SELECT 'sources', 'missing_sources', CAST(record_id AS VARCHAR), source_id, flagged_at FROM missing_sources
  UNION ALL SELECT 'light_chunks', 'extracted_entities', CAST(row_id AS VARCHAR), raw, extracted_at
            FROM (SELECT row_id, extracted_at, unnest(chunk_ids) AS raw FROM extracted_entities)
), tidy AS (
  SELECT DISTINCT parent_table, ref_table, row_key, regexp_replace(lower(raw), '^\s+|\s+$', '', 'g') AS ref_key, ref_time
  FROM refs WHERE raw IS NOT NULL AND regexp_replace(raw, '\s', '', 'g') <> ''
), parents AS (
  SELECT 'sources' AS parent_table, regexp_replace(lower(source_id), '^\s+|\s+$', '', 'g') AS ref_key, ingested_at AS begins, removed_at AS ends FROM sources
  UNION ALL SELECT 'light_chunks', regexp_replace(lower(id), '^\s+|\s+$', '', 'g'), built_at, removed_at FROM light_chunks
), judged AS (
  SELECT t.ref_table, t.row_key, t.ref_key, t.ref_time, count(p.ref_key) AS n_rows,
         count(p.ref_key) FILTER (p.begins <= t.ref_time) AS n_begun,
         count(p.ref_key) FILTER (p.begins <= t.ref_time AND (p.ends IS NULL OR p.ends > t.ref_time)) AS n_alive
  FROM tidy t LEFT JOIN parents p ON t.parent_table = p.parent_table AND t.ref_key = p.ref_key
  GROUP BY ALL
), found AS (
  SELECT DISTINCT ref_table, row_key, ref_key, strftime(ref_time AT TIME ZONE 'UTC', '%Y-%m') AS period,
         CASE WHEN n_rows = 0 THEN 'missing' WHEN n_begun = 0 THEN 'late' ELSE 'removed' END AS reason
  FROM judged WHERE n_alive = 0 AND NOT (ref_table = 'missing_sources' AND n_begun > 0)
)
"""

QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts}
ORACLES = {
    "p1_found": _P1_SQL + "SELECT * FROM found",
    "p1_counts": _P1_SQL + "SELECT ref_table, period, reason, count(*) AS n_references, count(DISTINCT ref_key) AS n_keys FROM found GROUP BY 1, 2, 3",
}
