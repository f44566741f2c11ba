"""Splitting oversized items at natural boundaries.

A hierarchy of separators (section, paragraph, sentence or line, word, character) is applied recursively: a stretch over
the budget is cut at the coarsest separator that it has, and its parts again at the next. The resulting stretches are packed
greedily up to the limit, and each piece after the first repeats the last `overlap` units of the one before it.
"""

from __future__ import annotations

import functools
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.shared import table

#: Limits and overlaps of the two tables: characters for text_units, tokens for light_chunks.
UNIT_LIMIT, UNIT_OVERLAP, CHUNK_LIMIT, CHUNK_OVERLAP = 4800, 200, 1200, 100
#: A token: a longest run of letters, digits and underscores, or one other character that isn't whitespace. The same pattern serves Java and Python.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"

LEVELS = ("section", "paragraph", "sentence", "word", "character")
_CUTS = tuple(map(regex.compile, (
    r"(?:^|(?<=\n))(?=#{1,6}[ \t]|\f)|\f",
    r"\n[ \t]*\n\s*",
    r"[.!?…。！？]+[\"'”’»)\]]*\s+|\n\s*",
    r"\s+",
)))
_TOKEN = regex.compile(TOKEN)

PIECES = "record_table string, record_key string, piece_index int, start_char bigint, end_char bigint, size int, cut string, text string"


def split_text(text: str, limit: int, overlap: int, by: str = "chars", coarsest: bool = False) -> list[tuple[int, int, int, str]]:
    """(start, end, size, level of the cut that ends it) of each piece; start and end are code points, size is in `by`.

    The pieces cover the text in order; each but the first starts exactly `overlap` units (chars or tokens) before the end
    of the one before it. Texts within the limit give one piece, empty texts none. With `coarsest` a piece ends at the coarsest
    cut of those that fill half of the limit, so that headings stay with what follows, instead of the last that fits.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    if by == "tokens":
        starts = [m.start() for m in _TOKEN.finditer(text)]
        n, place, char_at = len(starts), functools.partial(bisect_left, starts), lambda i: 0 if i == 0 else starts[i]
    else:
        n, place, char_at = len(text), lambda c: c, lambda i: i
    if not text or n == 0:
        return []
    if n <= limit:
        return [(0, len(text), n, "end")]
    marks = [sorted({p for m in cut.finditer(text) if 0 < (p := place(m.end())) < n}) for cut in _CUTS]
    budget = limit - overlap
    atoms: list[tuple[int, int]] = []  # end of a stretch, level of its cut

    def cut(a: int, b: int, level: int, closing: int) -> None:
        if b - a <= budget:
            atoms.append((b, closing))
            return
        if level == len(marks):
            atoms.extend((p, level) for p in range(a + budget, b, budget))
            atoms.append((b, closing))
            return
        for p in marks[level][bisect_right(marks[level], a) : bisect_left(marks[level], b)]:
            cut(a, p, level + 1, level)
            a = p
        cut(a, b, level + 1, closing)

    cut(0, n, 0, -1)
    pieces, done, k = [], 0, 0
    while done < n:
        begin, last = max(0, done - overlap), k
        while last + 1 < len(atoms) and atoms[last + 1][0] - begin <= limit:
            last += 1
        if coarsest and last + 1 < len(atoms):  # of the coarsest the last
            last = min((i for i in range(k, last + 1) if i == last or atoms[i][0] - begin >= max(limit / 2, overlap + 1)), key=lambda i: (atoms[i][1], -i))
        end, level = atoms[last]
        pieces.append((char_at(begin), len(text) if end == n else char_at(end), end - begin, LEVELS[level] if end < n else "end"))
        done, k = end, last + 1
    return pieces


def split_oversized(items: DataFrame, limit: int, overlap: int, by: str = "chars", coarsest: bool = False) -> DataFrame:
    """Pieces of the items over the limit; items: record_table, record_key, text. Columns as in PIECES.

    Items within the limit and null or empty texts give no rows. Rows repeated with key and text count once; one key with
    several texts gives the pieces of each. Texts of any length are split whole. Further columns are dropped.
    """
    size = F.length("text") if by == "chars" else F.size(F.regexp_extract_all("text", F.lit(TOKEN.replace(r"\s", r"\s\p{Z}\x{85}")), F.lit(0)))
    over = (
        items.select("record_table", "record_key", "text")
        .where(F.length("text") > limit)  # a token has at least one character
        .where(size > limit)
        .dropDuplicates(["record_table", "record_key", "text"])
    )

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (t, k, i, a, b, n, c, text[a:b])
                for t, k, text in zip(frame["record_table"], frame["record_key"], frame["text"], strict=True)
                for i, (a, b, n, c) in enumerate(split_text(text, limit, overlap, by, coarsest))
            ]
            yield pd.DataFrame(rows, columns=["record_table", "record_key", "piece_index", "start_char", "end_char", "size", "cut", "text"])

    return over.mapInPandas(pieces, PIECES)


def _items(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    units = table(spark, folder, "text_units").select(
        F.lit("text_units").alias("record_table"), F.concat("source_id", F.lit(":"), "unit_index").alias("record_key"), "text")
    chunks = table(spark, folder, "light_chunks").select(F.lit("light_chunks").alias("record_table"), F.col("id").alias("record_key"), "text")
    return units, chunks


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    units, chunks = _items(spark, folder)
    return split_oversized(units, UNIT_LIMIT, UNIT_OVERLAP).unionByName(split_oversized(chunks, CHUNK_LIMIT, CHUNK_OVERLAP, "tokens"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_pieces(spark, folder).select("record_table", "record_key").distinct()


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces}
ORACLES = {
    "p3_found": r"""
SELECT DISTINCT 'text_units' AS record_table, source_id || ':' || unit_index AS record_key FROM text_units WHERE length(text) > 4800
UNION ALL
SELECT DISTINCT 'light_chunks', id FROM light_chunks
WHERE len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]')) > 1200
""",
}
