"""Aggregates for reports: counts, statuses, per-document statistics, HTML and JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.functions.text import first_number, json_payload, number_text, occurrences
from lexigrove.operators.extraction import _MENTION, build_mentions
from lexigrove.shared import table
from lexigrove.sinks.writers import answer_pages, field_list, index_page, index_parts, pages, relationships_by_entity, top_relationships
from lexigrove.sources.readers import html_text, html_title, is_http, suffix_for, unique_violations


def status(sources: DataFrame, units: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: how many sources, compiled and withdrawn ones, text units and chunks, and the last compilation."""
    s = sources.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("source_id").alias("n_sources"), F.count("compiled_at").alias("n_compiled"), F.count("removed_at").alias("n_removed"), F.unix_micros(F.max("compiled_at")).alias("last_compiled_us"))
    u = units.select("source_id", "unit_index").distinct().agg(F.count(F.lit(1)).alias("n_units"))
    c = chunks.agg(F.count_distinct("id").alias("n_chunks"), F.sum("token_count").alias("n_tokens"))
    return s.join(F.broadcast(u)).join(F.broadcast(c))  # one row each


def unit_statistics(units: DataFrame, mentioned: DataFrame) -> DataFrame:
    """normalized_path, n_units, n_chars, n_entities of each document."""
    u = units.select("source_id", "unit_index", "normalized_path", F.length("text").alias("n")).distinct()
    m = mentioned.select("text_id", "node").distinct()
    held = u.withColumn("text_id", F.concat_ws("#", "source_id", "unit_index")).join(m, "text_id", "left")
    base = u.groupBy("normalized_path").agg(F.count(F.lit(1)).alias("n_units"), F.sum("n").alias("n_chars"))
    return base.join(held.groupBy("normalized_path").agg(F.count_distinct("node").alias("n_entities")), "normalized_path")


def status_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(column), F.lit("none")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


# --- queries -------------------------------------------------------------------------------------------------------------


def report_status(spark: SparkSession, folder: str) -> DataFrame:
    return status(table(spark, folder, "sources"), table(spark, folder, "text_units"), table(spark, folder, "light_chunks"))


def report_units(spark: SparkSession, folder: str) -> DataFrame:
    return unit_statistics(table(spark, folder, "text_units"), build_mentions(spark, folder))


def report_errors(spark: SparkSession, folder: str) -> DataFrame:
    return status_counts(table(spark, folder, "rag_samples"), "error")


def report_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """Confidence by tier and type; blanks and NaN don't count."""
    return table(spark, folder, "extracted_entities").groupBy("tier", F.upper("type").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(first_number(F.col("confidence"))), 6).alias("confidence"), F.count_if(F.col("description").isNull()).alias("n_blank"))


def report_html(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as HTML, and back to text and title."""
    d = table(spark, folder, "documents")
    html = F.concat(F.lit("<html><head><title>"), "title", F.lit("</title><style>p {x: y}</style></head><body><p>"), F.translate("text", "<>", "  "), F.lit("</p><script>var a = 1;</script></body></html>"))
    return d.select("doc_id", html_title(html).alias("title"), F.length(html_text(html)).alias("n_chars"), F.md5(html_text(html)).alias("digest"))


def report_origins(spark: SparkSession, folder: str) -> DataFrame:
    o = F.col("origin")
    return table(spark, folder, "sources").select("source_id", F.unix_micros("ingested_at").alias("ingested_us"), is_http(o).alias("http"), suffix_for(F.lit(None).cast("string"), F.lit(""), o).alias("suffix"))


def report_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events by type with the keys of their JSON properties."""
    e = table(spark, folder, "events").select("event_type", F.explode(F.json_object_keys(json_payload(F.col("props")))).alias("key"))
    return e.groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("n"))


def report_unique(spark: SparkSession, folder: str) -> DataFrame:
    return unique_violations(table(spark, folder, "sources"), ["source_id", "slug", "content_hash"])


def _links(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "extracted_entities").select(F.lower("name").alias("source"), F.lower("type").alias("target"), "confidence")
    return e.groupBy("source", "target").agg(F.round(F.sum("confidence"), 3).alias("weight"), F.count(F.lit(1)).alias("degree"))


def export_relationships(spark: SparkSession, folder: str) -> DataFrame:
    return top_relationships(_links(spark, folder), ["weight", "degree"]).select("source", "target", "w")


def export_by_entity(spark: SparkSession, folder: str) -> DataFrame:
    return relationships_by_entity(_links(spark, folder).select("source", "target", F.col("degree").cast("double").alias("w")))


def export_cards(spark: SparkSession, folder: str) -> DataFrame:
    """A page for each row of the manifest."""
    s = table(spark, folder, "sources").withColumn("pages", number_text(first_number(F.col("metadata")["page_count"])))
    return pages(s, F.concat("slug", F.lit(".md")), F.col("title"), [field_list(s, ["source_id", "source_type", "origin", "pages"]), F.concat(F.lit("Compiled from "), F.substring("compiled_from_hash", 1, 12))])


def export_index(spark: SparkSession, folder: str) -> DataFrame:
    return index_page(table(spark, folder, "documents"), F.col("page_type"), F.col("doc_id").cast("string"), F.col("title"), 20)


def export_index_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The index of all documents by type, 500 links a part."""
    return index_parts(table(spark, folder, "documents"), F.col("page_type"), F.col("doc_id").cast("string"), F.col("title"), 500)


def export_answers(spark: SparkSession, folder: str) -> DataFrame:
    """A saved page of each answered sample's question, by the file's name and a digest of its text."""
    r = table(spark, folder, "rag_samples").where("answer is not null").select("sample_id", "question", "answer", "citations", "method")
    named = answer_pages(r.withColumn("method", F.concat_ws(" ", "method", F.col("sample_id").cast("string"))), "2025-01-01")
    return named.select("file", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def report_title_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document names its own title's first word."""
    first = F.lower(F.regexp_extract("title", r"^(\S+)", 1))
    return table(spark, folder, "documents").select("doc_id", occurrences(F.lower("text"), first).alias("n"))


QUERIES = {f.__name__: f for f in (report_status, report_units, report_errors, report_tiers, report_html, report_origins, report_events, report_unique, export_relationships, export_by_entity, export_cards, export_index, export_index_parts, export_answers, report_title_mentions)}
ORACLES = {
    "report_units": f"""WITH {_MENTION}, u AS (SELECT DISTINCT source_id, unit_index, normalized_path, len(text) AS n FROM text_units), b AS (SELECT normalized_path, count(*) AS n_units, CAST(sum(n) AS BIGINT) AS n_chars FROM u GROUP BY 1),
        e AS (SELECT normalized_path, count(DISTINCT node) AS n_entities FROM u LEFT JOIN m ON m.text_id = u.source_id || '#' || u.unit_index GROUP BY 1) SELECT * FROM b JOIN e USING (normalized_path)""",
    "export_index": """WITH x AS (SELECT page_type AS g, doc_id, title, row_number() OVER (PARTITION BY page_type ORDER BY lower(title), CAST(doc_id AS VARCHAR)) AS k FROM documents)
        SELECT g AS "group", count(*) AS n, string_agg('- [[' || doc_id || '|' || title || ']]', chr(10) ORDER BY k) FILTER (k <= 20) AS text FROM x GROUP BY 1""",
    "export_index_parts": """WITH x AS (SELECT page_type AS g, doc_id, title, row_number() OVER (PARTITION BY page_type ORDER BY lower(title), CAST(doc_id AS VARCHAR)) AS k, count(*) OVER (PARTITION BY page_type) AS n FROM documents)
        SELECT g AS "group", (k - 1) // 500 + 1 AS part, n, string_agg('- [[' || doc_id || '|' || title || ']]', chr(10) ORDER BY k) AS text FROM x GROUP BY ALL""",
    "report_status": """SELECT count(*) AS n_rows, count(DISTINCT source_id) AS n_sources, count(compiled_at) AS n_compiled, count(removed_at) AS n_removed, epoch_us(max(compiled_at)) AS last_compiled_us,
        (SELECT count(*) FROM (SELECT DISTINCT source_id, unit_index FROM text_units)) AS n_units, (SELECT count(DISTINCT id) FROM light_chunks) AS n_chunks, (SELECT CAST(sum(token_count) AS BIGINT) FROM light_chunks) AS n_tokens FROM sources""",
    "report_errors": "SELECT coalesce(error, 'none') AS status, count(*) AS n FROM rag_samples GROUP BY 1",
    "report_tiers": "SELECT tier, upper(type) AS type, count(*) AS n, round(avg(confidence), 6) AS confidence, count(*) FILTER (description IS NULL) AS n_blank FROM extracted_entities GROUP BY 1, 2",
    "report_html": r"""WITH h AS (SELECT doc_id, title, trim(regexp_replace('  ' || title || '    ' || translate(text, '<>', '  ') || '   ', '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM documents)
        SELECT doc_id, trim(regexp_replace(title, '\s+', ' ', 'g')) AS title, len(t) AS n_chars, md5(t) AS digest FROM h""",
    "report_origins": r"""SELECT source_id, epoch_us(ingested_at) AS ingested_us, regexp_matches(lower(origin), '^https?://[^/]+') AS http, coalesce(nullif(CASE WHEN regexp_matches(lower(origin), '^([a-z]+://[^/]*)?[^?#]*\.(pdf|md|txt|html)([?#].*)?$') THEN regexp_extract(lower(split_part(split_part(origin, '?', 1), '#', 1)), '(\.[a-z]+)$', 1) END, ''), '.html') AS suffix FROM sources""",
    "report_events": "SELECT event_type, key, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS key FROM events) GROUP BY 1, 2",
    "report_unique": " UNION ALL ".join(f"SELECT '{c}' AS key, {c} AS value, count(*) AS n FROM sources GROUP BY {c} HAVING count(*) > 1" for c in ("source_id", "slug", "content_hash")),
    "export_by_entity": """WITH r AS (SELECT lower(name) AS source, lower(type) AS target, CAST(count(*) AS DOUBLE) AS w FROM extracted_entities GROUP BY 1, 2), x AS (SELECT source AS entity, target AS other, w FROM r UNION ALL SELECT target, source, w FROM r WHERE source <> target)
        SELECT * FROM (SELECT entity, other, w, row_number() OVER (PARTITION BY entity ORDER BY w DESC, other) AS n FROM x) WHERE n <= 50""",
    "export_relationships": """SELECT source, target, w FROM (SELECT lower(name) AS source, lower(type) AS target, coalesce(round(sum(confidence), 3), count(*)) AS w FROM extracted_entities GROUP BY 1, 2) ORDER BY w DESC, source, target LIMIT 500""",
    "report_title_mentions": r"""WITH f AS (SELECT doc_id, lower(text) AS t, lower(regexp_extract(title, '^(\S+)', 1)) AS w FROM documents) SELECT doc_id, CASE WHEN len(w) <= 2 THEN len(regexp_extract_all(t, '\b' || regexp_escape(w) || '\b')) ELSE (len(t) - len(replace(t, w, ''))) // len(w) END AS n FROM f""",
}
