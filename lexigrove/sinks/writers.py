"""Sinks: indexes with a manifest written last, upserts by bucket, markdown pages, run histories and leaderboards."""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrove.functions.text import one_line, slugify
from lexigrove.shared import numbered_within

MAX_RELATIONSHIPS, PER_ENTITY = 500, 50


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write one small file by way of a temporary one and a rename over the old: a reader sees the old file or the new one, never none."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs
    p, tmp = fs.Path(path), fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = p.getFileSystem(conf).create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    fs.FileContext.getFileContext(p.getFileSystem(conf).getUri(), conf).rename(p.getFileSystem(conf).makeQualified(tmp), p.getFileSystem(conf).makeQualified(p), how)


def _get(spark: SparkSession, path: str) -> str | None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    return spark.read.option("wholetext", "true").text(path).first().value


def save_index(spark: SparkSession, folder: str, tables: dict[str, DataFrame], info: dict, partition_by: dict[str, list[str]] | None = None) -> str:
    """Write the tables as a new build and then the manifest, which alone makes the build visible; returns the build's folder."""
    old = load_manifest(spark, folder)
    build = f"{folder}/build-{(old or {}).get('build', 0) + 1:06d}"
    for name, df in tables.items():
        w = df.write.mode("overwrite").option("compression", "zstd")
        by = (partition_by or {}).get(name)
        (w.partitionBy(*by) if by else w).parquet(f"{build}/{name}")
    _put(spark, f"{folder}/manifest.json", json.dumps(info | {"build": (old or {}).get("build", 0) + 1, "path": build, "tables": sorted(tables)}))
    return build


def load_manifest(spark: SparkSession, folder: str) -> dict | None:
    """The manifest, or null where there is none or it is corrupt."""
    try:
        return json.loads(_get(spark, f"{folder}/manifest.json") or "null")
    except ValueError:
        return None


def load_index(spark: SparkSession, folder: str) -> dict[str, DataFrame] | None:
    m = load_manifest(spark, folder)
    return {t: spark.read.parquet(f"{m['path']}/{t}") for t in m["tables"]} if m else None


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: str, buckets: int = 16, removed: DataFrame | None = None, files: int = 4) -> None:
    """Replace the rows of the keys given, add new ones and delete those of `removed` (key); only buckets that change are rewritten.

    They are written beside the old ones, by `files` tasks a bucket at most, and the manifest that comes last makes them visible:
    an upsert that breaks off changes nothing. Read with `upserted`. The number of buckets is that of the first upsert.
    """
    held = load_manifest(spark, path) or {"build": 0, "buckets": buckets, "generation": {}}
    buckets, build = held["buckets"], held["build"] + 1
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
    fresh = rows.withColumn("bucket", bucket)
    gone = rows.select(key) if removed is None else rows.select(key).unionByName(removed.select(key))
    touched = [r.bucket for r in gone.select(bucket).distinct().collect()]  # at most `buckets` numbers
    old = _generations(spark, path, held, touched)
    if old is not None:
        fresh = fresh.unionByName(old.join(gone.distinct(), key, "left_anti").select(*fresh.columns))
    fresh.repartition("bucket", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(files))).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/generation={build}")
    _put(spark, f"{path}/manifest.json", json.dumps({"build": build, "buckets": buckets, "generation": held["generation"] | {str(b): build for b in touched}}))


def _generations(spark: SparkSession, path: str, held: dict, buckets: list[int] | None = None) -> DataFrame | None:
    of: dict[int, list[int]] = {}
    for b, g in held["generation"].items():
        if buckets is None or int(b) in buckets:
            of.setdefault(g, []).append(int(b))
    parts = [spark.read.option("basePath", f"{path}/generation={g}").parquet(f"{path}/generation={g}").where(F.col("bucket").isin(bs)) for g, bs in sorted(of.items())]
    return functools.reduce(lambda a, b: a.unionByName(b), parts) if parts else None


def upserted(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows as of the last upsert that came to its end; null where there was none."""
    held = load_manifest(spark, path)
    return _generations(spark, path, held) if held else None


def stale(existing: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Keys that are stored and no longer there."""
    return existing.select(key).distinct().join(current.select(key).distinct(), key, "left_anti")


def markdown_inline(c: Column) -> Column:
    """A value for a table's cell."""
    return F.replace(F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " ")), F.lit("|"), F.lit(r"\|"))


def field_list(rows: DataFrame, columns: list[str]) -> Column:
    """Lines `- name: value` of the columns that have one."""
    return F.array_join(F.filter(F.array(*[F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"- {c}: "), markdown_inline(F.col(c)))) for c in columns]), lambda x: x.isNotNull()), "\n")


def top_relationships(relations: DataFrame, weights: list[str], most: int = MAX_RELATIONSHIPS) -> DataFrame:
    """The `most` relationships (source, target) with the greatest first number among the weight columns."""
    w = F.coalesce(*[F.col(c).try_cast("double") for c in weights], F.lit(0.0))
    return relations.withColumn("w", w).orderBy(F.col("w").desc(), "source", "target").limit(most)


def relationships_by_entity(relations: DataFrame, most: int = PER_ENTITY) -> DataFrame:
    """entity, other, w: the `most` heaviest relationships (source, target, w) of each entity, loops once."""
    x = relations.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("entity"), "source", "target", "w").withColumn("other", F.when(F.col("entity") == F.col("source"), F.col("target")).otherwise(F.col("source")))
    return x.withColumn("n", F.row_number().over(Window.partitionBy("entity").orderBy(F.col("w").desc(), "other"))).where(F.col("n") <= most).select("entity", "other", "w", "n")


def community_rows(communities: DataFrame, reports: DataFrame) -> DataFrame:
    """Communities (community, title, size) under their reports (community, title, summary, rank): a report's value wins; reports without a community stay."""
    c = communities.select("community", F.col("title").alias("c_title"), "size")
    return reports.join(c, "community", "left").select("community", F.coalesce("title", "c_title").alias("title"), "summary", "rank", "size")


def pages(rows: DataFrame, name: Column, title: Column, parts: list[Column]) -> DataFrame:
    """file, text of one markdown page a row: a heading and the parts that aren't blank."""
    text = F.array_join(F.filter(F.array(F.concat(F.lit("# "), title), *parts), lambda p: p.isNotNull() & (F.trim(p) != "")), "\n\n")
    return rows.select(name.alias("file"), F.concat(text, F.lit("\n")).alias("text"))


def write_pages(files: DataFrame, folder: str) -> DataFrame:
    """Write each (file, text) below a folder that all executors share; returns file and bytes. Each by a temporary file and a rename."""

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import uuid

        for f in frames:
            out = []
            for name, text in zip(f["file"], f["text"], strict=True):
                at = os.path.normpath(os.path.join(folder, name))
                if not at.startswith(os.path.normpath(folder) + os.sep):
                    raise ValueError(f"{name} is outside of the folder")
                os.makedirs(os.path.dirname(at), exist_ok=True)
                tmp = f"{at}.{uuid.uuid4().hex}"
                with open(tmp, "w", encoding="utf-8") as w:
                    w.write(text)
                os.replace(tmp, at)
                out.append((name, len(text.encode())))
            yield pd.DataFrame(out, columns=["file", "bytes"])

    return files.select("file", "text").mapInPandas(put, "file string, bytes bigint")


def index_page(rows: DataFrame, group: Column, link: Column, title: Column, most: int = 1000) -> DataFrame:
    """group, text: an index of the first `most` links of each group, in order of the title, with the number of all."""
    x = rows.select(group.alias("group"), link.alias("link"), title.alias("title")).withColumn("n", F.row_number().over(Window.partitionBy("group").orderBy(F.lower("title"), "link")))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= most, F.struct("n", "link", "title")))), lambda r: F.concat(F.lit("- [["), r["link"], F.lit("|"), r["title"], F.lit("]]")))
    return x.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.array_join(listed, "\n").alias("text"))


def index_parts(rows: DataFrame, group: Column, link: Column, title: Column, per_page: int = 1000) -> DataFrame:
    """group, part, n, text: the whole index of each group in order of the title, in parts of per_page links; n is the number of all."""
    x = numbered_within(rows.select(group.alias("group"), F.lower(title).alias("low"), link.alias("link"), title.alias("title")), ["group"], ["low", "link"], "k")
    x = x.withColumn("part", F.floor((F.col("k") - 1) / per_page) + 1)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("k", "link", "title"))), lambda r: F.concat(F.lit("- [["), r["link"], F.lit("|"), F.coalesce(r["title"], r["link"]), F.lit("]]")))
    parts = x.groupBy("group", "part").agg(F.array_join(lines, "\n").alias("text"))  # per_page links
    sizes = x.groupBy("group").agg(F.max("k").alias("n"))
    return parts.join(sizes, parts["group"].eqNullSafe(sizes["group"])).select(parts["group"], "part", "n", "text")


def answer_pages(answers: DataFrame, saved_at: str) -> DataFrame:
    """file, text of a saved page for each answer (question, answer, citations, method): front matter with its provenance, the answer, and its citations as a list."""
    slug = F.concat(F.slice(F.split(slugify(F.col("question")), "-"), 1, 10), F.array(F.substring(F.md5("question"), 1, 6)))
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(one_line(c), r'(["\\\\])', r"\\$1"), F.lit('"'))
    cited = F.coalesce("citations", F.expr("cast(array() as array<string>)"))
    head = F.concat(
        F.lit("---\ntype: analysis\ntitle: "), quoted(F.col("question")), F.lit("\nquestion: "), quoted(F.col("question")), F.lit(f"\nsaved_at: {saved_at}\nmethod: "), F.coalesce("method", F.lit("")),
        F.lit("\ncitation_count: "), F.size(cited).cast("string"), F.lit("\ninsufficient_evidence: "), F.when(F.trim(F.coalesce("answer", F.lit(""))) == "", "true").otherwise("false"), F.lit("\n---\n"))
    listed = F.when(F.size(cited) > 0, F.concat(F.lit("\n\n## Citations\n\n"), F.array_join(F.transform(cited, lambda c: F.concat(F.lit("- "), c)), "\n"))).otherwise("")
    return answers.select(F.concat(F.lit("analysis/"), F.array_join(slug, "-"), F.lit(".md")).alias("file"), F.concat(head, F.lit("\n# "), one_line(F.col("question")), F.lit("\n\n"), F.trim(F.coalesce("answer", F.lit(""))), listed, F.lit("\n")).alias("text"))


def records_json(sources: DataFrame, texts: DataFrame, most_bytes: int = 10 << 20) -> DataFrame:
    """source_id, record: JSON of each source with its text, where that isn't over the size guard."""
    x = sources.join(texts.select("source_id", "text"), "source_id").where(F.octet_length("text") <= most_bytes)
    return x.select("source_id", F.to_json(F.struct(*sources.columns, "text")).alias("record"))


def append_run(spark: SparkSession, path: str, run: DataFrame, keep: int, order: str = "run_at") -> None:
    """Add runs to a history (table runs of an index) and keep the newest `keep`; one that breaks off leaves the history as it was."""
    old = load_index(spark, path)
    if old:
        run = old["runs"].unionByName(run, allowMissingColumns=True)
    save_index(spark, path, {"runs": run.orderBy(F.col(order).desc()).limit(keep)}, {})  # `keep` rows


def write_metrics(rows: list[DataFrame], folder: str) -> DataFrame:
    """Metric rows of several tables under the union of their columns, as CSV with blanks for what is missing, and as JSON."""
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r, allowMissingColumns=True)
    every.write.mode("overwrite").option("header", True).option("nullValue", "").csv(f"{folder}/rows_csv")
    every.write.mode("overwrite").json(f"{folder}/rows_json")
    return every


def leaderboard_markdown(board: DataFrame, row: str) -> str:
    """A leaderboard (a row a backend) as a markdown table, backends in order."""
    cols = [c for c in board.columns if c != row]
    lines = [f"| {row} | " + " | ".join(cols) + " |", "|" + "---|" * (len(cols) + 1)]
    for r in board.orderBy(row).collect():  # a row a backend
        lines.append(f"| {r[row]} | " + " | ".join("-" if r[c] is None else f"{r[c]:.3f}" for c in cols) + " |")
    return "\n".join(lines) + "\n"
