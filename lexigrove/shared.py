"""Session, table access and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a heavy-hitter table that may be broadcast; a key outside the heaviest TOP_KEYS holds at most 1/TOP_KEYS of the rows.
TOP_KEYS = 1000

_written: list[tuple[SparkSession, str]] = []


def local_session(app: str = "lexigrove", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for one machine; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset, as in tests, one of our own, and that on one machine alone."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='lexigrove-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder, removed when the driver ends."""
    at = f"{shared_dir(spark)}/lexigrove-{uuid.uuid4().hex}/{name}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, at.rsplit("/", 1)[0]))
    return at


def remove_path(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _clean() -> None:
    for spark, at in _written:
        try:
            remove_path(spark, at)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as parquet in the shared folder and read it again: the lineage is cut, the rows survive lost executors."""
    spark = df.sparkSession
    at = new_path(spark, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def join_large(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join of two sides that grow with the input: by shuffle, never by broadcast.

    Spark takes the size of a materialized table from its compressed files, and that of what a function makes of its rows from
    the same figure, so that by itself it would send millions of rows through the driver.
    """
    return left.join(right.hint("merge"), keys, how)


def join_heavy(left: DataFrame, right: DataFrame, keys: list[str], weight: str, top: int = TOP_KEYS, large: bool = False) -> DataFrame:
    """Inner join of left with right, whose keys are unique, when a few keys hold most rows of left.

    The heaviest `top` keys of right (by `weight`) are broadcast, never more rows than that; the rest, none of
    which holds more than 1/top of the rows, is joined by shuffle, by join_large if right is `large` and else as Spark chooses.
    right should be a materialized table: it is read three times.
    """
    heavy = right.orderBy(F.col(weight).desc(), *keys).limit(top)
    light = right.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    mark = "__heavy"
    tagged = left.join(F.broadcast(heavy.select(*keys, F.lit(True).alias(mark))), keys, "left")
    return (
        tagged.where(F.col(mark)).drop(mark).join(F.broadcast(heavy), keys)
        .unionByName((join_large if large else DataFrame.join)(tagged.where(F.col(mark).isNull()).drop(mark), light, keys))
    )


def row_number(partition: list[str], order: list) -> F.Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))


def number_rows(df: DataFrame, order: list, name: str) -> DataFrame:
    """Consecutive numbers from 1 in the given order over all rows, without gathering them in one task.

    Ranges of the order are sorted apart; each starts where the ones before it end. Ties that `order` leaves open are
    numbered in any way.
    """
    part = materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = sorted((r[0], r[1]) for r in part.groupBy("__range").count().collect())  # a row for each partition
    starts, at = [], 0
    for k, n in sizes:
        starts.append((k, at))
        at += n
    offsets = df.sparkSession.createDataFrame(starts, "__range int, __start bigint")
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return part.withColumn("__n", within).join(F.broadcast(offsets), "__range").withColumn(name, F.col("__n") + F.col("__start")).drop("__range", "__n", "__start")


def numbered_within(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Numbers from 1 within each group of keys, in order, also where one group holds most rows: by ranges of keys and order."""
    part = number_rows(df, [*keys, *order], "__number")
    of = [F.xxhash64(*keys, *[F.col(k).isNull() for k in keys]).alias("__of")]  # nulls are a group like others
    part = materialize(part.select("*", *of), "numbered")
    first = materialize(part.groupBy("__of").agg(F.min("__number").alias("__first"), F.count(F.lit(1)).alias("__rows")), "firsts")
    return join_heavy(part, first, ["__of"], "__rows").withColumn(name, (F.col("__number") - F.col("__first") + 1).cast("bigint")).select(*df.columns, name)
