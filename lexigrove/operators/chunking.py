"""Chunkers: character windows with paragraph cuts, token windows over words, and packing of sections."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrove.functions.text import normal_lines
from lexigrove.shared import table

_WORD = re.compile(r"\S+")
_TOKEN = re.compile(r"\w+|[^\w\s]")
CHUNKS = "chunk_index int, start_char bigint, end_char bigint, text string"


def count_tokens(text: str) -> int:
    """Words and other characters; the fallback tokenizer."""
    return len(_TOKEN.findall(text))


def char_windows(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, stripped text) of windows of at most limit characters.

    A window that isn't the last ends at the last blank line in its second half, if there is one; the next starts `overlap`
    characters before its end, and one further on at least. Offsets are those before stripping; blank windows are left out.
    """
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    out, at = [], 0
    while at < len(text):
        end = min(at + limit, len(text))
        if end < len(text) and (gap := text.rfind("\n\n", at, end)) > at + limit // 2:
            end = gap
        if piece := text[at:end].strip():
            out.append((at, end, piece))
        if end == len(text):
            break
        at = max(at + 1, end - overlap)
    return out


def token_windows(text: str, size: int, overlap: int, count: Callable[[str], int] = count_tokens) -> list[tuple[int, int, str]]:
    """(start, end, text) of windows of whole words with at most `size` tokens, or one word; each steps back until `overlap` tokens are repeated."""
    spans = [m.span() for m in _WORD.finditer(text)]
    cost = [count(" " + text[a:b]) for a, b in spans]
    out, first = [], 0
    while first < len(spans):
        last, total = first + 1, cost[first]
        while last < len(spans) and total + cost[last] <= size:
            total += cost[last]
            last += 1
        a, b = spans[first][0], spans[last - 1][1]
        out.append((a, b, text[a:b]))
        if last == len(spans):
            break
        back, k = 0, last
        while overlap > 0 and k > first + 1 and back < overlap:
            k -= 1
            back += cost[k]
        first = max(first + 1, k)
    return out


def chunk(rows: DataFrame, key: str, windows: Callable[[str], list[tuple[int, int, str]]], min_chars: int = 0) -> DataFrame:
    """key, chunk_index, start_char, end_char, text for each window of each row's text.

    Windows shorter than min_chars are left out after they are numbered. Null and empty texts give none.
    """
    kind = dict(rows.dtypes)[key]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(k, i, a, b, t) for k, text in zip(f[key], f["text"], strict=True) for i, (a, b, t) in enumerate(windows(text)) if len(t) >= min_chars]
            yield pd.DataFrame(out, columns=[key, "chunk_index", "start_char", "end_char", "text"])

    # Keys go as text: pandas would make numbers inexact beside nulls.
    held = rows.select(F.col(key).cast("string").alias(key), "text").where(F.length("text") > 0)
    return held.mapInPandas(cut, f"{key} string, {CHUNKS}").withColumn(key, F.col(key).cast(kind))


def pack(parts: Column, limit: int) -> Column:
    """Greedy packing of an array of paragraphs into chunks joined by blank lines: a paragraph that would pass the limit starts the next.

    Each paragraph counts its length and 2. A fold, since the sum starts anew with each chunk.
    """
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def add(acc: Column, p: Column) -> Column:
        n = F.length(p) + 2
        full = (acc["n"] > 0) & (acc["n"] + n > limit)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["n"] == 0), p).otherwise(F.concat(acc["now"], F.lit("\n\n"), p)).alias("now"),
            F.when(full, n).otherwise(acc["n"] + n).cast("int").alias("n"))

    return F.aggregate(F.filter(parts, lambda p: F.trim(p) != ""), start, add, lambda acc: F.when(acc["n"] > 0, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]))


def sections(text: Column, default: Column) -> Column:
    """Structs (title, body) of the parts of a markdown text between headings; what stands before the first has the default title."""
    marked = F.regexp_replace(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), r"\n#{1,6}[ \t]+([^\n]*)", "\x02$1\x03")
    parts = F.split(marked, "\x02")
    of = lambda p: F.struct(F.when(p.contains("\x03"), F.trim(F.substring_index(p, "\x03", 1))).otherwise(default).alias("title"), F.when(p.contains("\x03"), F.substring_index(p, "\x03", -1)).otherwise(p).alias("body"))
    return F.filter(F.transform(parts, of), lambda s: F.trim(F.regexp_replace(s["body"], r"\s+", " ")) != "")


def section_chunks(rows: DataFrame, key: str, limit: int, skipped: tuple[str, ...] = ("sources", "related", "changelog", "backlinks")) -> DataFrame:
    """key, section, chunk_index, text: sections packed into chunks; bookkeeping sections are skipped."""
    s = rows.select(key, F.posexplode(sections(F.col("text"), F.col("title"))).alias("pos", "s")).where(~F.lower(F.trim(F.col("s.title"))).isin(*skipped))
    packed = s.select(key, "pos", F.col("s.title").alias("section"), F.posexplode(pack(F.split("s.body", r"\n[ \t]*\n"), limit)).alias("part", "text"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("pos", "part")) - 1
    return packed.select(key, "section", number.alias("chunk_index"), F.trim("text").alias("text"))


# --- queries -------------------------------------------------------------------------------------------------------------


def chunk_characters(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", normal_lines(F.col("text")).alias("text"))
    return chunk(docs, "doc_id", lambda t: char_windows(t, 1200, 150), 40).select("doc_id", "chunk_index", "start_char", "end_char", F.length("text").alias("n_chars"))


def chunk_tokens(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", normal_lines(F.col("text")).alias("text"))
    return chunk(docs, "doc_id", lambda t: token_windows(t, 200, 40)).select("doc_id", "chunk_index", "start_char", "end_char", F.length("text").alias("n_chars"))


def chunk_sections(spark: SparkSession, folder: str) -> DataFrame:
    return section_chunks(table(spark, folder, "documents").select("doc_id", "title", "text"), "doc_id", 1500).select("doc_id", "section", "chunk_index", F.length("text").alias("n_chars"))


def chunk_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the documents packed to 600 characters."""
    return table(spark, folder, "documents").select("doc_id", F.size(pack(F.split("text", "\n"), 600)).alias("n_chunks"))


#: CTEs in SQL whose last, s, has the sections of the documents: doc_id, pos, section, body.
SECTIONS_SQL = r"""p AS (SELECT doc_id, title AS dt, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM (SELECT doc_id, title, string_split(regexp_replace(chr(10) || coalesce(text, ''), '\n#{1,6}[ \t]+([^\n]*)', chr(2) || '\1' || chr(3), 'g'), chr(2)) AS parts FROM documents)),
 s AS (SELECT * FROM (SELECT doc_id, pos, CASE WHEN contains(part, chr(3)) THEN trim(split_part(part, chr(3), 1)) ELSE dt END AS section, string_split(part, chr(3))[-1] AS body FROM p) WHERE trim(regexp_replace(body, '\s+', ' ', 'g')) <> '')"""
QUERIES = {f.__name__: f for f in (chunk_characters, chunk_tokens, chunk_sections, chunk_packing)}
ORACLES = {
    "chunk_sections": r"""WITH RECURSIVE """ + SECTIONS_SQL + r""", q AS (SELECT doc_id, pos, section, list_filter(regexp_split_to_array(body, '\n[ \t]*\n'), lambda x: trim(x) <> '') AS ps FROM s WHERE lower(trim(section)) NOT IN ('sources', 'related', 'changelog', 'backlinks')),
        r AS (SELECT doc_id, pos, section, ps, 1 AS i, 1 AS part, len(ps[1]) + 2 AS n, ps[1] AS now FROM q WHERE len(ps) > 0
          UNION ALL SELECT doc_id, pos, section, ps, i + 1, CASE WHEN n + len(ps[i + 1]) + 2 > 1500 THEN part + 1 ELSE part END, CASE WHEN n + len(ps[i + 1]) + 2 > 1500 THEN len(ps[i + 1]) + 2 ELSE n + len(ps[i + 1]) + 2 END, CASE WHEN n + len(ps[i + 1]) + 2 > 1500 THEN ps[i + 1] ELSE now || chr(10) || chr(10) || ps[i + 1] END FROM r WHERE i < len(ps))
        SELECT doc_id, section, row_number() OVER (PARTITION BY doc_id ORDER BY pos, part) - 1 AS chunk_index, len(trim(text)) AS n_chars FROM (SELECT doc_id, pos, section, part, arg_max(now, i) AS text FROM r GROUP BY ALL)""",
    "chunk_packing": """WITH RECURSIVE l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents),
        r AS (SELECT doc_id, ls, 1 AS i, least(1, len(ls)) AS n, coalesce(len(ls[1]) + 2, 0) AS s FROM l
          UNION ALL SELECT doc_id, ls, i + 1, CASE WHEN s + len(ls[i + 1]) + 2 > 600 THEN n + 1 ELSE n END, CASE WHEN s + len(ls[i + 1]) + 2 > 600 THEN len(ls[i + 1]) + 2 ELSE s + len(ls[i + 1]) + 2 END FROM r WHERE i < len(ls))
        SELECT doc_id, max(n) AS n_chunks FROM r GROUP BY 1""",
    # The windows' data-dependent steps are a recursion in SQL.
    "chunk_characters": r"""WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?m)[ \t\f\x0B]+$', '', 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS t FROM documents),
        w AS (SELECT doc_id, t, 0 AS i, 0 AS a, CASE WHEN len(t) > 1200 AND contains(t[601:1200], chr(10) || chr(10)) AND 1200 - strpos(reverse(t[1:1200]), chr(10) || chr(10)) - 1 > 600 THEN 1200 - strpos(reverse(t[1:1200]), chr(10) || chr(10)) - 1 ELSE least(1200, len(t)) END AS b FROM t WHERE len(t) > 0
          UNION ALL SELECT doc_id, t, i + 1, a2, CASE WHEN a2 + 1200 < len(t) AND strpos(reverse(t[a2 + 1:a2 + 1200]), chr(10) || chr(10)) > 0 AND 1200 - strpos(reverse(t[a2 + 1:a2 + 1200]), chr(10) || chr(10)) - 1 > 600
              THEN a2 + 1200 - strpos(reverse(t[a2 + 1:a2 + 1200]), chr(10) || chr(10)) - 1 ELSE least(a2 + 1200, len(t)) END
            FROM (SELECT *, greatest(a + 1, b - 150) AS a2 FROM w WHERE b < len(t)) q)
        , s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, a AS start_char, b AS end_char, len(regexp_replace(t[a + 1:b], '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS n_chars FROM w)
        SELECT * FROM s WHERE n_chars >= 40""",
}
