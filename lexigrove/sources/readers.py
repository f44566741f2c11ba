"""Sources: markdown trees, late-bound parquet, JSON record lists, files by suffix, benchmarks and snapshots."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrove.functions.text import body, frontmatter_field, headings, markdown_links, title_of, wikilinks

# Suffixes by the converter that reads them.
SUFFIXES = {"text": [".md", ".markdown", ".txt", ".rst"], "ocr": [".pdf", ".docx", ".pptx", ".png", ".jpg", ".jpeg", ".avif"], "html": [".html", ".htm"], "table": [".csv", ".epub", ".ipynb", ".xls", ".xlsx"]}
SKIPPED_NAMES = ["index.md", "log.md"]


def markdown_tree(spark: SparkSession, folder: str, skipped: list[str] = SKIPPED_NAMES) -> DataFrame:
    """path, modified, size, text of every *.md below a folder, but those of the skipped names."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    path = F.col("_metadata.file_path")
    return files.select(F.regexp_replace(path, "^file:/*", "/").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("text")).where(~F.substring_index("path", "/", -1).isin(skipped))


def parse_pages(files: DataFrame) -> DataFrame:
    """Typed page rows of files (path, text): title, page type (of the front matter, else the folder), source id, summary, body, headings and links."""
    t, stem = F.col("text"), F.regexp_replace(F.substring_index("path", "/", -1), r"\.[a-z]+$", "")
    of_folder = F.when(F.col("path").contains("/sources/"), "source").when(F.col("path").contains("/concepts/"), "concept").when(F.col("path").contains("/analysis/"), "analysis").otherwise("page")
    return files.select(
        "path", F.coalesce(frontmatter_field(t, "title"), title_of(t, stem)).alias("title"), F.coalesce(frontmatter_field(t, "type"), of_folder).alias("page_type"),
        frontmatter_field(t, "source_id").alias("source_id"), frontmatter_field(t, "summary").alias("summary"), body(t).alias("body"), headings(t).alias("headings"), wikilinks(t).alias("wikilinks"), markdown_links(t).alias("markdown_links"))


def inventory(files: DataFrame) -> DataFrame:
    """path, modified, size: what tells whether an index is stale."""
    return files.select("path", "modified", "size")


def records(spark: SparkSession, path: str, columns: list[str], schema: str | None = None) -> DataFrame:
    """The wanted columns that a parquet table has; where it can't be read, no rows of `schema` (or of those columns as strings).

    Only the files' footers decide; a projection reaches the scan.
    """
    try:
        found = spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema or ", ".join(f"`{c}` string" for c in columns))
    return found.select(*[c for c in columns if c in found.columns])


def without_nan(rows: DataFrame) -> DataFrame:
    """Floating NaN as null."""
    return rows.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if isinstance(rows.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.col(c) for c in rows.columns])


def alias_of(rows: DataFrame, *names: str) -> Column:
    """The first of several columns that is there and isn't blank, as a string; null where none is."""
    cs = [F.when(F.trim(F.col(n).cast("string")) != "", F.col(n).cast("string")) for n in names if n in rows.columns]
    return F.coalesce(*cs) if cs else F.lit(None).cast("string")


def term_columns(rows: DataFrame, columns: list[str], limit: int = 2000) -> DataFrame:
    """column, value of the wanted columns over the first `limit` rows in order of these, which is what the scan of known terms is capped at."""
    have = [c for c in columns if c in rows.columns]
    return rows.select(*[F.col(c).cast("string").alias(c) for c in have]).orderBy(*have).limit(limit).unpivot([], have, "column", "value").where("trim(value) <> ''")


def table_state(spark: SparkSession, path: str) -> tuple[str, int]:
    """missing, present_unreadable, or ready, with the number of rows; the count reads footers alone."""
    if not _exists(spark, path):
        return "missing", 0
    try:
        return "ready", spark.read.parquet(path).count()
    except Exception:  # noqa: BLE001 - whatever a broken file raises
        return "present_unreadable", 0


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def match_table(paths: list[str], names: list[str]) -> str | None:
    """The first path whose stem is one of the names, else one that holds a name."""
    stem = lambda p: os.path.basename(p.rstrip("/")).removesuffix(".parquet").lower()
    for test in (lambda s, n: s == n, lambda s, n: n in s):
        for n in names:
            for p in sorted(paths):
                if test(stem(p), n.lower()):
                    return p
    return None


def active_snapshot(snapshots: list[tuple[str, float, bool]], recorded: str | None = None) -> str | None:
    """Of (path, time, complete): the recorded one if complete, else the newest complete, else the newest."""
    if any(p == recorded and ok for p, _, ok in snapshots):
        return recorded
    best = max(snapshots, key=lambda s: (s[2], s[1], s[0]), default=None)
    return best[0] if best else None


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON file that holds a list, or an object with the list under sources or documents; rows that don't parse are dropped."""
    texts = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", f"sources array<struct<{schema}>>, documents array<struct<{schema}>>")
    rows = F.coalesce(F.from_json("value", f"array<struct<{schema}>>"), wrapped["sources"], wrapped["documents"])
    lists = texts.select(F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<struct<{schema}>>")).otherwise(F.coalesce(wrapped["sources"], wrapped["documents"], rows)).alias("r"))
    return lists.select(F.explode("r").alias("r")).select("r.*")


def discover(spark: SparkSession, folder: str, excluded: tuple[str, ...] = (".git", "node_modules", "__pycache__")) -> DataFrame:
    """path, suffix and converter of the files below a folder with a supported suffix, outside the excluded folders, in order of the path without letter case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "length", "modificationTime")
    suffix = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    kind = F.lit(None).cast("string")
    for k, v in SUFFIXES.items():
        kind = F.when(suffix.isin(v), k).otherwise(kind)
    parts = F.split("path", "/")
    return files.withColumn("suffix", suffix).withColumn("converter", kind).where(F.col("converter").isNotNull() & ~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in excluded]))).orderBy(F.lower("path"))


def convert(files: DataFrame, converters: dict[str, Callable[[bytes], str | None]]) -> DataFrame:
    """path, text, converter: contents (path, converter, content) by the hook of its converter, else by its suffix where the standard library reads it; the text hook decodes. Failures give null."""
    hooks = {"text": lambda b: b.decode("utf-8", "replace")} | converters

    def run(frames):
        for f in frames:
            out = []
            for path, kind, content in zip(f["path"], f["converter"], f["content"], strict=True):
                try:
                    hook = hooks.get(kind) or BY_SUFFIX.get(os.path.splitext(path)[1].lower())
                    text = hook(bytes(content)) if hook else None
                except Exception:  # noqa: BLE001 - a hook's failure is that file's alone
                    text = None
                out.append((path, text, kind))
            yield pd.DataFrame(out, columns=["path", "text", "converter"])

    return files.select("path", "converter", "content").mapInPandas(run, "path string, text string, converter string")


def _xml_text(content: bytes, member: str, row: str, cell: str) -> list[str]:
    """Texts of the cells in each row of the members of a zipped XML document, by local names of the elements."""
    import zipfile
    from io import BytesIO
    from xml.etree import ElementTree

    local = lambda e: e.tag.rsplit("}", 1)[-1]
    out = []
    with zipfile.ZipFile(BytesIO(content)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(member, n)), key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])
        for name in names:
            for e in ElementTree.fromstring(z.read(name)).iter():
                if local(e) == row:
                    out.append("".join(c.text or "" for c in e.iter() if local(c) == cell))
    return out


def _docx(b: bytes) -> str:
    return "\n\n".join(x for x in _xml_text(b, r"word/document\.xml", "p", "t") if x.strip())


def _pptx(b: bytes) -> str:
    return "\n\n".join(x for x in _xml_text(b, r"ppt/slides/slide\d+\.xml", "p", "t") if x.strip())


def _plain_html(b: bytes) -> str:
    import html

    t = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", b.decode("utf-8", "replace"))
    t = re.sub(r"(?is)<(?:/p|/h[1-6]|/div|/li|/tr|br\s*/?)>", "\n\n", t)
    return "\n\n".join(x for x in (re.sub(r"\s+", " ", html.unescape(re.sub(r"(?s)<[^>]+>", " ", p))).strip() for p in t.split("\n\n")) if x)


def _epub(b: bytes) -> str:
    import zipfile
    from io import BytesIO

    with zipfile.ZipFile(BytesIO(b)) as z:
        return "\n\n".join(_plain_html(z.read(n)) for n in sorted(z.namelist()) if n.lower().endswith((".xhtml", ".html", ".htm")))


def _table_markdown(rows: list[list[str]]) -> str:
    width = max(map(len, rows), default=0)
    line = lambda r: "| " + " | ".join(re.sub(r"\s+", " ", x).replace("|", "\\|").strip() for x in [*r, *[""] * (width - len(r))]) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])]) if rows else ""


def _csv(b: bytes) -> str:
    import csv
    from io import StringIO

    return _table_markdown([r for r in csv.reader(StringIO(b.decode("utf-8-sig", "replace"))) if r])


def _xlsx(b: bytes) -> str:
    import zipfile
    from io import BytesIO
    from xml.etree import ElementTree

    local = lambda e: e.tag.rsplit("}", 1)[-1]
    try:
        shared = _xml_text(b, r"xl/sharedStrings\.xml", "si", "t")
    except KeyError:
        shared = []
    parts = []
    with zipfile.ZipFile(BytesIO(b)) as z:
        for name in sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n).group())):
            rows = []
            for row in (e for e in ElementTree.fromstring(z.read(name)).iter() if local(e) == "row"):
                cells = []
                for c in (e for e in row if local(e) == "c"):
                    v = "".join(x.text or "" for x in c.iter() if local(x) in ("v", "t"))
                    cells.append(shared[int(v)] if c.get("t") == "s" and v else v)
                if any(cells):
                    rows.append(cells)
            parts.append(_table_markdown(rows))
    return "\n\n".join(p for p in parts if p)


def _notebook(b: bytes) -> str:
    import json

    out = []
    for cell in json.loads(b).get("cells", []):
        text = "".join(cell.get("source", []))
        if text.strip():
            out.append(text if cell.get("cell_type") == "markdown" else f"```\n{text}\n```")
    return "\n\n".join(out)


#: Converters by suffix that need nothing but the standard library; PDFs and images need a hook.
BY_SUFFIX: dict[str, Callable[[bytes], str]] = {".docx": _docx, ".pptx": _pptx, ".html": _plain_html, ".htm": _plain_html, ".epub": _epub, ".csv": _csv, ".xlsx": _xlsx, ".ipynb": _notebook}


def first_text(*converters: Callable[[bytes], str | None]) -> Callable[[bytes], str | None]:
    """A converter that tries several in turn and gives the first text that isn't blank."""

    def convert_one(content: bytes) -> str | None:
        for c in converters:
            try:
                if (text := c(content)) and text.strip():
                    return text
            except Exception:  # noqa: BLE001 - the next may read it
                continue
        return None

    return convert_one


def acceptable(text: Column, pages: Column | None = None) -> Column:
    """Whether a converted text is worth keeping: 20 characters or more, five words or a blank line's worth of paragraphs, 60 characters a page."""
    t = F.trim(F.coalesce(text, F.lit("")))
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    ok = (F.length(t) >= 20) & ((words >= 5) | t.contains("\n\n"))
    return ok if pages is None else ok & (F.length(t) >= pages * 60)


def benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a YAML benchmark: id, question, category, expected_source_ids, expected_entities, reference_answer, insufficient_expected."""
    import yaml

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f)
    rows = data.get("questions", data) if isinstance(data, dict) else data
    out = [(str(r["id"]), r["question"], r.get("category"), [str(x) for x in r.get("expected_source_ids") or r.get("expected_sources") or []], [str(x) for x in r.get("expected_entities") or []], r.get("reference_answer"), bool(r.get("insufficient_expected") or r.get("category") == "unsupported_claim")) for r in rows]
    return spark.createDataFrame(out, "id string, question string, category string, expected_source_ids array<string>, expected_entities array<string>, reference_answer string, insufficient_expected boolean")


def latest_run(runs: DataFrame, order: str, valid: Column, wanted: str | None = None) -> DataFrame:
    """The run that a pointer names if it is valid, else the newest valid one."""
    good = runs.where(valid)
    rank = F.struct((F.col("run_id") == F.lit(wanted)).alias("named") if wanted is not None else F.lit(False).alias("named"), F.col(order).alias("o"), F.col("run_id").alias("i"))
    return good.agg(F.max_by(F.struct("*"), rank).alias("r")).where("r is not null").select("r.*")


def unique_violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """key, value, n of values that stand in several rows."""
    out = None
    for k in keys:
        part = rows.groupBy(F.col(k).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(k).alias("key"), "value", "n")
        out = part if out is None else out.unionByName(part)
    return out


def html_text(c: Column) -> Column:
    """Text of HTML: scripts and styles out, tags as blanks, whitespace collapsed; entities stay."""
    t = F.regexp_replace(F.regexp_replace(c, r"(?is)<script\b.*?</script\s*>", " "), r"(?is)<style\b.*?</style\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?s)<[^>]+>", " "), r"\s+", " "))


def html_title(c: Column) -> Column:
    t = F.trim(F.regexp_replace(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    for entity, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(ch))
    return F.nullif(t, F.lit(""))


def is_http(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & (F.length(F.try_parse_url(url, F.lit("HOST"))) > 0), F.lit(False))


def suffix_for(content_type: Column, head: Column, url: Column) -> Column:
    """File suffix of a fetched page: by header, else by first bytes, else by the URL's path, else html."""
    ct, path = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    return (
        F.when(ct.contains("pdf"), ".pdf").when(ct.contains("html"), ".html").when(ct.contains("markdown"), ".md").when(ct.contains("text/plain"), ".txt")
        .when(head.startswith("%PDF"), ".pdf").when(F.lower(F.ltrim(head)).rlike(r"^(<!doctype html|<html)"), ".html")
        .when(path.rlike(r"\.(pdf|md|txt|html)$"), F.regexp_extract(path, r"(\.[a-z]+)$", 1)).otherwise(".html"))


def web_findings(replies: DataFrame, limit: int = 10) -> DataFrame:
    """Rows of JSON replies (reply_id, payload): title, url, kind and relevance; unknown kinds are `other`, malformed rows are skipped, at most `limit` a reply."""
    schema = "findings array<struct<title: string, url: string, src: string, kind: string, relevance: double>>"
    x = replies.select("reply_id", F.posexplode(F.slice(F.from_json("payload", schema)["findings"], 1, limit)).alias("pos", "f"))
    url = F.coalesce(F.nullif(F.trim("f.url"), F.lit("")), F.nullif(F.trim("f.src"), F.lit("")))
    return x.select("reply_id", F.col("f.title").alias("title"), url.alias("url"), F.when(F.lower("f.kind").isin("paper", "dataset", "code", "article"), F.lower("f.kind")).otherwise("other").alias("kind"), "f.relevance", "pos").where("url is not null").withColumn("n", F.row_number().over(Window.partitionBy("reply_id").orderBy("pos"))).drop("pos")
