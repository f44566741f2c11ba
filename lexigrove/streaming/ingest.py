"""An extension: a folder of JSON lines as a stream of documents, de-duplicated by content within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "source_id string, text string, ingested_at timestamp"


def stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def first_copies(rows: DataFrame, delay: str = "1 day") -> DataFrame:
    """Documents whose content didn't come before, as far back as the watermark reaches; rows without a time or text fall out."""
    hashed = rows.where("ingested_at is not null and text is not null").withColumn("content_hash", F.sha2("text", 256))
    return hashed.withWatermark("ingested_at", delay).dropDuplicatesWithinWatermark(["content_hash"])


def hourly_counts(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Documents and characters by source and hour; late rows within the delay count."""
    w = rows.withWatermark("ingested_at", delay).groupBy(F.window("ingested_at", "1 hour"), "source_id")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars")).select("source_id", F.col("window.start").alias("hour"), "n", "n_chars")


def run(rows: DataFrame, out: str, checkpoint: str, mode: str = "append"):
    """Write all that is there, then stop."""
    return rows.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
