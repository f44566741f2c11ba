"""Freshness and incremental recomputation by comparing hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrove.functions.text import TOKENS_SQL
from lexigrove.operators.lexical import LexicalIndex
from lexigrove.shared import join_heavy, materialize, number_rows, table


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key."""
    best = rows.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("__r"))
    return best.select("__r.*")


def first_of_content(rows: DataFrame, content: str, order: list[str]) -> DataFrame:
    """The first row of each content, which later copies are dropped for; rows without a hash all stay."""
    best = rows.where(F.col(content).isNotNull()).groupBy(content).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("__r")).select("__r.*")
    return best.unionByName(rows.where(F.col(content).isNull()))


def first_of_either(rows: DataFrame, keys: list[str], order: list[str], rounds: int = 100) -> DataFrame:
    """Rows that would be taken in one by one, in `order`, where a row is left out if any of its keys is that of a row taken before.

    Null keys don't count; order must settle which row comes first. A row that comes first in all its groups is taken, and those
    that share a key with it are out; this is repeated among the rest, as often as rows hang on each other by alternating keys.
    """
    rest = materialize(rows.select(F.struct(*order).alias("__at"), F.struct("*").alias("__r"), *[F.col(k).cast("string").alias(f"__k{i}") for i, k in enumerate(keys)]), "rest")
    names, kept = [f"__k{i}" for i in range(len(keys))], None
    for _ in range(rounds):
        if rest.isEmpty():
            return (rest if kept is None else kept).select("__r.*")
        first = rest
        for k in names:
            low = rest.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("__at").alias("__low"), F.count(F.lit(1)).alias("__n"))
            first = join_heavy(first.where(F.col(k).isNotNull()), materialize(low, "lows"), [k], "__n").where("__at = __low").select(*rest.columns).unionByName(first.where(F.col(k).isNull()))
        first = materialize(first, "first")
        kept = first if kept is None else kept.unionByName(first)
        out = rest.join(first.select("__at"), "__at", "left_anti")
        for k in names:
            out = out.join(first.select(k).where(F.col(k).isNotNull()), k, "left_anti")
        rest = materialize(out.select(*rest.columns), "rest")
    raise RuntimeError(f"not settled after {rounds} rounds")


def changes(old: DataFrame, new: DataFrame, key: str = "source_id", value: str = "content_hash") -> DataFrame:
    """key and status of a full outer comparison: new, missing, changed or unchanged; null hashes are equal to null."""
    a, b = old.select(key, F.col(value).alias("was"), F.lit(True).alias("in_old")), new.select(key, F.col(value).alias("now"), F.lit(True).alias("in_new"))
    status = F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "missing").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def compile_status(sources: DataFrame) -> DataFrame:
    """source_id, status and details: new, missing, changed or up_to_date of the compiled against the current content.

    sources: source_id, content_hash, compiled_at, compiled_from_hash and current_hash, that of the file, null where it is gone.
    """
    fresh = F.col("compiled_at").isNull() | F.col("compiled_from_hash").isNull()
    status = F.when(fresh, "new").when(F.col("current_hash").isNull(), "missing").when(F.col("current_hash") != F.col("compiled_from_hash"), "changed").otherwise("up_to_date")
    details = F.when(status == "new", "not yet compiled").when(status == "missing", "normalized source file missing").when(status == "changed", F.when(F.col("current_hash").eqNullSafe(F.col("content_hash")), "source changed since last compile").otherwise("normalized file changed"))
    return sources.select("source_id", status.alias("status"), details.alias("details"))


def digest(rows: DataFrame, columns: list[str], buckets: int = 256) -> DataFrame:
    """One row: n and a digest of all rows, whatever their order; equal tables have equal digests. Sums of hashes, so that no rows are gathered."""
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    parts = rows.select(F.conv(F.substring(h, 1, 12), 16, 10).cast("decimal(38,0)").alias("a"), F.conv(F.substring(h, 13, 12), 16, 10).cast("decimal(38,0)").alias("b"))
    return parts.agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).select("n", F.sha2(F.concat_ws("|", "n", "a", "b"), 256).alias("digest"))


def incremental(old: DataFrame, status: DataFrame, new_rows: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str = "source_id") -> DataFrame:
    """The derived rows of unchanged keys, and those computed anew of new and changed ones; equal to computing all."""
    kept = old.join(status.where("status = 'unchanged'").select(key), key, "left_semi")
    again = compute(new_rows.join(status.where("status in ('new', 'changed')").select(key), key, "left_semi"))
    return kept.unionByName(again)


def reuse(rows: DataFrame, cache: DataFrame, on: str, value: str, compute: Callable[[Column], Column]) -> DataFrame:
    """Rows with the cached value of the same key (the first one), and computed where there is none."""
    first = cache.groupBy(on).agg(F.min(value).alias("__v"))
    return rows.join(first, on, "left").withColumn(value, F.coalesce("__v", compute(F.col(on)))).drop("__v")


def contributions(entities: DataFrame, sources: DataFrame) -> DataFrame:
    """source_id, status, requires_review, n_rows and n_chunks of what each source gave; sources that are gone stay as rows to review."""
    x = entities.select("row_id", "chunk_ids", F.explode("source_ids").alias("source_id")).groupBy("source_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.size("chunk_ids")).alias("n_chunks"))
    known = sources.select("source_id", F.lit(True).alias("known")).distinct()
    gone = F.col("known").isNull()
    return x.join(known, "source_id", "full_outer").select("source_id", F.when(gone, "missing").when(F.col("n_rows").isNull(), "empty").otherwise("active").alias("status"), gone.alias("requires_review"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def replay(entities: DataFrame, reused: DataFrame) -> DataFrame:
    """Extracted rows of chunks that are reused (chunk_id), one for each chunk, so that a rebuild needs no extraction of them."""
    return entities.select("row_id", "name", "type", F.explode(F.array_distinct("chunk_ids")).alias("chunk_id")).join(reused.select("chunk_id").distinct(), "chunk_id", "left_semi").select("row_id", "name", "type", "chunk_id", F.lit(0.99).alias("confidence"))


def unique_slugs(rows: DataFrame, base: str, order: list[str]) -> DataFrame:
    """Adds slug: the base where it is free when its row comes, in `order`, else the base with the least of -2, -3 and so on that is free.

    order must settle which row comes first. Null bases stay null. What comes first can only matter between a base and another
    that is the same with a number at its end, so that the sequence is settled without going through the rows: such a base
    either came before the number was given out, and the number is skipped, or it finds itself taken. These few decisions are
    repeated until none changes; rows are ranked within their base by ranges, however many have one base.
    """
    packed = rows.where(F.col(base).isNotNull()).select(F.col(base).alias("__base"), F.struct(*order).alias("__at"), F.struct("*").alias("__r"))
    part = materialize(number_rows(packed, ["__base", "__at"], "__no"), "slug_rows")
    groups = materialize(part.groupBy("__base").agg(F.min("__no").alias("start"), F.count(F.lit(1)).alias("n"), F.min("__at").alias("first")), "slug_bases")
    # k: the number at the end; of a base that exists itself. Numbers beyond all that could be given out don't matter.
    form = r"^(.*)-([2-9]|[1-9][0-9]{1,17})$"
    child = groups.select(F.col("__base").alias("child"), "first", F.regexp_extract("__base", form, 1).alias("parent"), F.regexp_extract("__base", form, 2).alias("k")).where(F.col("k") != "").withColumn("k", F.col("k").cast("bigint"))
    child = child.join(groups.select(F.col("__base").alias("parent"), "start", "n"), "parent")
    rank = F.row_number().over(Window.partitionBy("parent").orderBy("k"))  # bases with a number that one base could reach
    child = materialize(child.withColumn("rank", rank).where(F.col("k") - F.col("rank") <= F.col("n")).drop("rank"), "slug_children")
    state = child.select("child", "parent", "k", "first", "start", "n", F.lit(False).alias("skipped"), F.lit(False).alias("taken"))
    while True:
        before = F.coalesce(F.sum(F.col("skipped").cast("int")).over(Window.partitionBy("parent").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        shifted = state.where("taken").select(F.col("child").alias("parent"), F.lit(1).alias("shift"))
        now = state.withColumn("before", before).join(shifted, "parent", "left")
        now = now.withColumn("__row", F.col("k") - F.col("before") - F.coalesce("shift", F.lit(0)))  # the row of the parent that would come to k
        reached = now.withColumn("__no", F.when(F.col("__row") <= F.col("n"), F.col("start") + F.col("__row") - 1)).join(part.select("__no", "__at"), "__no", "left")
        free = F.col("__at").isNull() | (F.col("first") < F.col("__at"))
        after = reached.select("child", "parent", "k", "first", "start", "n", (F.col("__at").isNotNull() & free).alias("skipped"), (~free).alias("taken"), (F.col("skipped") != (F.col("__at").isNotNull() & free)).alias("c1"), (F.col("taken") != ~free).alias("c2"))
        after = materialize(after, "slug_state")
        changed = not after.where(F.col("c1") | F.col("c2")).isEmpty()
        state = after.drop("c1", "c2")
        if not changed:
            break
    skips = state.where("skipped").groupBy("parent").agg(F.array_sort(F.collect_list("k")).alias("ks"))  # bases that one base skips
    known = groups.select("__base", "start", "n").join(skips.withColumnRenamed("parent", "__base"), "__base", "left").join(state.where("taken").select(F.col("child").alias("__base"), F.lit(1).alias("shift")), "__base", "left")
    numbered = join_heavy(part, materialize(known, "slugs_known"), ["__base"], "n").withColumn("__m", F.col("__no") - F.col("start") + 1 + F.coalesce("shift", F.lit(0)))
    over = F.size(F.filter(F.transform(F.coalesce("ks", F.array().cast("array<bigint>")), lambda k, i: k - i), lambda x: x <= F.col("__m")))
    slug = F.when(F.col("__m") == 1, F.col("__base")).otherwise(F.concat("__base", F.lit("-"), F.col("__m") + over))
    return numbered.select("__r.*", slug.alias("slug")).unionByName(rows.where(F.col(base).isNull()).withColumn("slug", F.lit(None).cast("string")))


def recent_runs(runs: DataFrame, per: str, order: str, keep: int) -> DataFrame:
    """The last `keep` runs of each kind."""
    return runs.withColumn("__n", F.row_number().over(Window.partitionBy(per).orderBy(F.col(order).desc()))).where(F.col("__n") <= keep).drop("__n")


def freshness(status: DataFrame) -> DataFrame:
    """One row: counts of new, changed and missing keys, and whether the index is stale."""
    n = status.agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("new", "changed", "missing", "unchanged")])
    return n.withColumn("state", F.when(F.col("n_new") + F.col("n_changed") + F.col("n_missing") > 0, "stale").otherwise("fresh"))


def plan(old: DataFrame | None, new: DataFrame, contract: dict[str, str], was: dict[str, str] | None, force: bool = False, key: str = "source_id", value: str = "content_hash") -> tuple[DataFrame, bool]:
    """changes() of the sources against those of the last build, and whether the rest of that build can be kept.

    It can if there was one, nobody forces a rebuild, and everything that shapes derived rows (prompts, models, limits: contract)
    is as it was. Without an old build all sources are new.
    """
    status = changes(new.limit(0) if old is None else old, new, key, value)
    return status, old is not None and not force and was is not None and all(was.get(k) == v for k, v in contract.items())


def stale_reasons(status: DataFrame, contract: dict[str, str], was: dict[str, str] | None) -> DataFrame:
    """reason, n: why a build is stale: new, changed and missing keys with their number, and each part of the contract that is another."""
    n = status.where("status <> 'unchanged'").groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(F.concat("status", F.lit(" sources")).alias("reason"), "n")
    if was is None:
        drifted = ["index not built"]
    else:
        drifted = [f"{k} changed" for k, v in sorted(contract.items()) if was.get(k) and was[k] != v]
    return n.unionByName(status.sparkSession.createDataFrame([(r, 1) for r in drifted], "reason string, n bigint"))


def index_action(states: DataFrame) -> DataFrame:
    """states with action, method and reason of the next indexing, by the first rule that fits.

    states: run_index, force, documents, requested (auto or a method), last_success, output (missing, partial or complete),
    has_metadata, config_changed, input_changed; nulls count as false, a null last_success as no run before.
    """
    full = F.when(F.col("requested") == "auto", "fast").otherwise(F.regexp_replace("requested", "-update$", ""))
    complete, yes = F.coalesce(F.col("output"), F.lit("missing")) == "complete", lambda c: F.coalesce(F.col(c), F.lit(False))
    row = lambda action, method, reason: F.struct(F.lit(action).alias("action"), (F.lit(method) if method is None or isinstance(method, str) else method).cast("string").alias("method"), F.lit(reason).alias("reason"))
    pick = (
        F.when(~yes("run_index"), row("input-only", None, "indexing is switched off"))
        .when(F.coalesce("documents", F.lit(0)) == 0, row("skip", None, "there are no documents"))
        .when(yes("force"), row("index", full, "forced"))
        .when((F.col("requested") != "auto") & F.col("requested").endswith("-update") & ~complete, row("index", full, "an update needs complete output"))
        .when(F.col("requested") != "auto", row("index", F.col("requested"), "the method was asked for"))
        .when(~F.coalesce("last_success", F.lit(True)), row("index", F.when(complete, "fast-update").otherwise("fast"), "the last run failed"))
        .when(~complete, row("index", "fast", "the output isn't complete"))
        .when(~yes("has_metadata"), row("index", "fast", "the last run left no digests"))
        .when(yes("config_changed"), row("index", "fast", "the configuration changed"))
        .when(yes("input_changed"), row("index", "fast-update", "the input changed"))
        .otherwise(row("skip", None, "the index is current"))
    )
    return states.withColumn("__a", pick).select(*states.columns, "__a.action", "__a.method", "__a.reason")


# --- queries -------------------------------------------------------------------------------------------------------------

_CUT = "2025-10-01 00:00:00"


def _manifests(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The manifest as of a time, and as of now: the last row of each source that wasn't withdrawn by then."""
    s, cut = table(spark, folder, "sources"), F.lit(_CUT).cast("timestamp")
    order = [F.col("ingested_at"), F.col("content_hash")]
    return latest(s.where((F.col("ingested_at") <= cut) & (F.col("removed_at").isNull() | (F.col("removed_at") > cut))), "source_id", order), latest(s.where(F.col("removed_at").isNull()), "source_id", order)


def incr_changes(spark: SparkSession, folder: str) -> DataFrame:
    return changes(*_manifests(spark, folder))


def incr_freshness(spark: SparkSession, folder: str) -> DataFrame:
    return freshness(incr_changes(spark, folder))


_CONTRACT = {"chunking": "1200/100", "prompt": "b", "embedding": "words"}


def incr_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of the plan against the manifest of an earlier time, and why the index of then is stale; its prompt was another."""
    old, new = _manifests(spark, folder)
    status, incremental_ = plan(old, new, _CONTRACT, _CONTRACT | {"prompt": "a"})
    reasons = stale_reasons(status, _CONTRACT, _CONTRACT | {"prompt": "a"})
    return reasons.withColumn("incremental", F.lit(incremental_))


def incr_actions(spark: SparkSession, folder: str) -> DataFrame:
    """What to do next for each type of source: its manifest rows stand for documents, recompiled ones for changed input."""
    s = table(spark, folder, "sources")
    states = s.groupBy("source_type").agg(
        F.count(F.lit(1)).alias("documents"), F.max((~F.col("compiled_from_hash").eqNullSafe(F.col("content_hash"))).cast("int")).cast("boolean").alias("input_changed"), F.count("compiled_at").alias("compiled"))
    requested = spark.createDataFrame([("auto",), ("standard",), ("standard-update",)], "requested string")
    states = states.crossJoin(F.broadcast(requested)).select(  # three rows
        "source_type", "requested", "documents", "input_changed", F.lit(True).alias("run_index"), F.lit(False).alias("force"), F.lit(True).alias("last_success"), F.when(F.col("compiled") > 0, "complete").otherwise("missing").alias("output"), F.lit(True).alias("has_metadata"), F.lit(False).alias("config_changed"))
    return index_action(states).select("source_type", "requested", "action", "method", "reason")


def incr_compile_status(spark: SparkSession, folder: str) -> DataFrame:
    """Of the current manifest; the text units' last hash stands for the file's."""
    units = table(spark, folder, "text_units").groupBy("source_id").agg(F.max_by("source_hash", F.struct("unit_index", "source_hash")).alias("current_hash"))
    return compile_status(_manifests(spark, folder)[1].join(units, "source_id", "left"))


def incr_first_of_content(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), "source_id")
    return first_of_content(docs, "content_hash", ["doc_id"])


def incr_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest rows in order of coming, each left out if an earlier one has its origin's hash or its content's."""
    s = table(spark, folder, "sources").select("source_id", F.unix_micros("ingested_at").alias("ingested_us"), "origin_hash", "content_hash").distinct()
    return first_of_either(s, ["origin_hash", "content_hash"], ["ingested_us", "source_id", "content_hash", "origin_hash"])


def incr_table_digest(spark: SparkSession, folder: str) -> DataFrame:
    return digest(table(spark, folder, "documents").select("doc_id", "title", "page_type"), ["doc_id", "title", "page_type"])


def incr_stored_postings(spark: SparkSession, folder: str) -> DataFrame:
    """Postings by source, brought up to date from those stored when the documents of an earlier time were all there were.

    What is kept comes from the stored table alone: sources whose documents are the same ones with the same texts.
    """
    docs = table(spark, folder, "documents").where(F.col("source_id").isNotNull())
    before = docs.where(F.col("ingested_at") <= F.lit(_CUT).cast("timestamp"))
    counted = lambda d: LexicalIndex.build(d).postings.join(d.select("doc_id", "source_id"), "doc_id").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("total"))
    stored = materialize(counted(before), "stored")
    state = lambda d: d.groupBy("source_id").agg(F.concat_ws("|", F.count(F.lit(1)), F.sum(F.xxhash64("doc_id", "text").cast("decimal(38,0)"))).alias("content_hash"))
    return incremental(stored, changes(state(before), state(docs)), docs, counted)


def incr_digest(spark: SparkSession, folder: str) -> DataFrame:
    """Equal for the table and its rows in another order and partitioning."""
    s = table(spark, folder, "sources").select("source_id", "content_hash", "ingested_at")
    a, b = digest(s, s.columns), digest(s.repartition(7).orderBy("content_hash"), s.columns)
    return a.join(b, ["n", "digest"]).select("n", F.lit(True).alias("equal"))


def incr_postings(spark: SparkSession, folder: str) -> DataFrame:
    """Postings kept for unchanged sources and counted anew for the others, against the documents of all current sources."""
    docs = table(spark, folder, "documents").where(F.col("source_id").isNotNull())
    status = incr_changes(spark, folder)
    of = lambda d: LexicalIndex.build(d).postings.join(d.select("doc_id", "source_id"), "doc_id")
    return incremental(of(docs), status, docs, of).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("total"))


def incr_reuse(spark: SparkSession, folder: str) -> DataFrame:
    """Content hashes of chunks, cached for those built before a time."""
    c = table(spark, folder, "light_chunks").select("id", "text", "built_at").distinct()
    cache = c.where(F.col("built_at") <= F.lit(_CUT).cast("timestamp")).select("text", F.sha2("text", 256).alias("content_hash"))
    return reuse(c.select("id", "built_at", "text"), cache, "text", "content_hash", lambda t: F.sha2(t, 256)).select("id", F.unix_micros("built_at").alias("built_us"), "content_hash")


def incr_contributions(spark: SparkSession, folder: str) -> DataFrame:
    return contributions(table(spark, folder, "extracted_entities"), table(spark, folder, "sources").where(F.col("removed_at").isNull()))


def incr_replay(spark: SparkSession, folder: str) -> DataFrame:
    return replay(table(spark, folder, "extracted_entities"), table(spark, folder, "light_chunks").where(F.col("removed_at").isNull()).select(F.col("id").alias("chunk_id")))


def incr_unique_slugs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.lower(F.regexp_replace(F.substring_index("title", " ", -1), "[^A-Za-z0-9]+", "")).alias("base"))
    return unique_slugs(docs, "base", ["doc_id"]).select("doc_id", "slug")


def incr_recent_runs(spark: SparkSession, folder: str) -> DataFrame:
    return recent_runs(table(spark, folder, "events").select("event_id", "event_type"), "event_type", "event_id", 20)


_MAN = f"""WITH o AS (SELECT source_id, arg_max(content_hash, (ingested_at, content_hash)) AS h FROM sources WHERE ingested_at <= TIMESTAMPTZ '{_CUT}+00' AND (removed_at IS NULL OR removed_at > TIMESTAMPTZ '{_CUT}+00') GROUP BY 1),
 n AS (SELECT source_id, arg_max(content_hash, (ingested_at, content_hash)) AS h, arg_max({{'c': compiled_at, 'f': compiled_from_hash}}, (ingested_at, content_hash)) AS r FROM sources WHERE removed_at IS NULL GROUP BY 1),
 st AS (SELECT coalesce(o.source_id, n.source_id) AS source_id, CASE WHEN o.source_id IS NULL THEN 'new' WHEN n.source_id IS NULL THEN 'missing' WHEN o.h IS NOT DISTINCT FROM n.h THEN 'unchanged' ELSE 'changed' END AS status FROM o FULL JOIN n ON o.source_id = n.source_id)"""
QUERIES = {f.__name__: f for f in (incr_changes, incr_freshness, incr_plan, incr_actions, incr_compile_status, incr_first_of_content, incr_ingest, incr_digest, incr_table_digest, incr_postings, incr_stored_postings, incr_reuse, incr_contributions, incr_replay, incr_unique_slugs, incr_recent_runs)}
ORACLES = {
    "incr_unique_slugs": """WITH d AS (SELECT doc_id, lower(regexp_replace(string_split(title, ' ')[-1], '[^A-Za-z0-9]+', '', 'g')) AS base FROM documents), f AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS n FROM d),
        s AS (SELECT *, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM f), t AS (SELECT base, max(n) AS top FROM s WHERE n > 1 AND slug IN (SELECT base FROM d) GROUP BY 1)
        SELECT doc_id, CASE WHEN n > 1 AND top IS NOT NULL THEN base || '-' || (n + top) ELSE slug END AS slug FROM s LEFT JOIN t USING (base)""",
    "incr_changes": _MAN + " SELECT * FROM st",
    "incr_plan": _MAN + " SELECT status || ' sources' AS reason, count(*) AS n, false AS incremental FROM st WHERE status <> 'unchanged' GROUP BY status UNION ALL SELECT 'prompt changed', 1, false",
    "incr_actions": """WITH g AS (SELECT source_type, bool_or(compiled_from_hash IS DISTINCT FROM content_hash) AS c, count(compiled_at) AS k FROM sources GROUP BY 1)
        SELECT source_type, r AS requested, CASE WHEN r = 'auto' AND k > 0 AND NOT c THEN 'skip' ELSE 'index' END AS action, CASE WHEN r = 'standard' THEN 'standard' WHEN r = 'standard-update' THEN CASE WHEN k > 0 THEN r ELSE 'standard' END WHEN k = 0 THEN 'fast' WHEN c THEN 'fast-update' END AS method,
          CASE WHEN r = 'standard-update' AND k = 0 THEN 'an update needs complete output' WHEN r <> 'auto' THEN 'the method was asked for' WHEN k = 0 THEN 'the output isn''t complete' WHEN c THEN 'the input changed' ELSE 'the index is current' END AS reason
        FROM g, (VALUES ('auto'), ('standard'), ('standard-update')) AS t(r)""",
    "incr_freshness": _MAN + """ SELECT *, CASE WHEN n_new + n_changed + n_missing > 0 THEN 'stale' ELSE 'fresh' END AS state FROM (SELECT count(*) FILTER (status = 'new') AS n_new, count(*) FILTER (status = 'changed') AS n_changed,
        count(*) FILTER (status = 'missing') AS n_missing, count(*) FILTER (status = 'unchanged') AS n_unchanged FROM st)""",
    "incr_compile_status": _MAN + """, u AS (SELECT source_id, arg_max(source_hash, (unit_index, source_hash)) AS cur FROM text_units GROUP BY 1)
        , x AS (SELECT n.source_id, h, cur, CASE WHEN r.c IS NULL OR r.f IS NULL THEN 'new' WHEN cur IS NULL THEN 'missing' WHEN cur <> r.f THEN 'changed' ELSE 'up_to_date' END AS status FROM n LEFT JOIN u USING (source_id))
        SELECT source_id, status, CASE status WHEN 'new' THEN 'not yet compiled' WHEN 'missing' THEN 'normalized source file missing' WHEN 'changed' THEN CASE WHEN cur = h THEN 'source changed since last compile' ELSE 'normalized file changed' END END AS details FROM x""",
    "incr_first_of_content": "SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash, arg_min({'s': source_id}, doc_id).s AS source_id FROM documents GROUP BY text",
    "incr_table_digest": """WITH h AS (SELECT sha256(concat_ws(chr(31), CAST(doc_id AS VARCHAR), coalesce(title, chr(0)), coalesce(page_type, chr(0)))) AS h FROM documents),
        s AS (SELECT count(*) AS n, sum(CAST('0x' || h[1:12] AS HUGEINT)) AS a, sum(CAST('0x' || h[13:24] AS HUGEINT)) AS b FROM h) SELECT n, sha256(n || '|' || CAST(a AS HUGEINT) || '|' || CAST(b AS HUGEINT)) AS digest FROM s""",
    "incr_stored_postings": f"""WITH p AS (SELECT source_id, doc_id, unnest({TOKENS_SQL}) AS token FROM documents WHERE source_id IS NOT NULL)
        SELECT source_id, count(DISTINCT doc_id || ' ' || token) AS n, count(*) AS total FROM p GROUP BY 1""",
    "incr_ingest": """WITH RECURSIVE s AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY us, source_id, content_hash, origin_hash NULLS FIRST) AS k FROM (SELECT DISTINCT source_id, epoch_us(ingested_at) AS us, origin_hash, content_hash FROM sources)),
        t AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS seen, false AS kept UNION ALL
          SELECT s.k, CASE WHEN f THEN seen ELSE list_concat(seen, ks) END, NOT f FROM (SELECT s.*, t.seen, ks, len(list_intersect(t.seen, ks)) > 0 AS f FROM t JOIN (SELECT *, list_filter(['o' || origin_hash, 'c' || content_hash], lambda x: x IS NOT NULL) AS ks FROM s) s ON s.k = t.k + 1) s)
        SELECT source_id, us AS ingested_us, origin_hash, content_hash FROM s JOIN t USING (k) WHERE kept""",
    "incr_digest": "SELECT count(*) AS n, true AS equal FROM sources",
    "incr_postings": _MAN + f""", p AS (SELECT source_id, doc_id, unnest({TOKENS_SQL}) AS token FROM documents JOIN st USING (source_id) WHERE status <> 'missing')
        SELECT source_id, count(DISTINCT doc_id || ' ' || token) AS n, count(*) AS total FROM p GROUP BY 1""",
    "incr_reuse": "SELECT DISTINCT id, epoch_us(built_at) AS built_us, sha256(text) AS content_hash FROM light_chunks",
    "incr_contributions": """WITH x AS (SELECT unnest(source_ids) AS source_id, len(chunk_ids) AS c FROM extracted_entities), g AS (SELECT source_id, count(*) AS n_rows, sum(c) AS n_chunks FROM x GROUP BY 1), s AS (SELECT DISTINCT source_id FROM sources WHERE removed_at IS NULL)
        SELECT coalesce(g.source_id, s.source_id) AS source_id, CASE WHEN s.source_id IS NULL THEN 'missing' WHEN n_rows IS NULL THEN 'empty' ELSE 'active' END AS status, s.source_id IS NULL AS requires_review, coalesce(n_rows, 0) AS n_rows, CAST(coalesce(n_chunks, 0) AS BIGINT) AS n_chunks FROM g FULL JOIN s ON g.source_id = s.source_id""",
    "incr_replay": "SELECT row_id, name, type, chunk_id, 0.99::DOUBLE AS confidence FROM (SELECT row_id, name, type, unnest(list_distinct(chunk_ids)) AS chunk_id FROM extracted_entities) WHERE chunk_id IN (SELECT id FROM light_chunks WHERE removed_at IS NULL)",
    "incr_recent_runs": "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events) WHERE n <= 20",
}
