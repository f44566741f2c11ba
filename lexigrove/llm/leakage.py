"""Evaluation texts leaking into training text, by greedy string tiling over words.

Items and documents are sequences of words: runs of letters and digits, without letter case. Windows of MIN_WORDS words
are hashed by Karp-Rabin. Windows of documents pass a filter of fixed size that has a bit for each window of the items;
what is left is joined with the windows of the items by hash: these are the seeds. For each document and item with a seed,
the longest match of unmarked words is marked as a tile, again and again until none of MIN_WORDS is left, so that passages
put in another order are covered too. Neither side has a bound: many items only let more windows through to the join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.shared import join_heavy, materialize, table

MIN_WORDS = 12
FIELDS = ("question", "reference_answer", "evidence_text")
#: Bits of the filter: 16 MB at most, whatever the number of items.
FILTER_BITS = 1 << 27

_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)

TILES = "doc_id bigint, item_id bigint, field string, n_tiles int, longest int, n_words int, covered double"


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.casefold()) if text else []


class Numbers(dict):
    """A number of 64 bits for each word; a cache that starts anew when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        n = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return n

    def of(self, ws: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash of each window of k ids, modulo 2^64, its bits mixed."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * _BASE + ids[j : j + n]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def tiles(a: list, b: list, least: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in a, start in b, length), longest first; ties go to the earliest in a, then in b.

    Match lengths are kept for one word of a at a time, so that memory is linear also where both repeat themselves.
    """
    at: dict = {}
    for j, w in enumerate(b):
        at.setdefault(w, []).append(j)
    columns = [np.array(at.get(w, ()), np.int64) for w in a]
    free_a, free_b, out = np.ones(len(a), bool), np.ones(len(b), bool), []
    while True:
        best, before = (0, 0, 0), np.zeros(len(b) + 1, np.int64)
        last = np.empty(0, np.int64)
        for i in range(len(a) - 1, -1, -1):  # length of the match that begins at i and j: one more than that at i + 1 and j + 1
            cols = columns[i]
            now = np.empty(0, np.int64)
            if free_a[i] and len(cols):
                cols = cols[free_b[cols]]
                now = before[cols + 1] + 1
            before[last] = 0
            if len(now):
                before[cols] = now
                k = int(now.argmax())
                if now[k] >= max(least, best[2]):
                    best = (i, int(cols[k]), int(now[k]))
                last = cols
            else:
                last = now
        if not best[2]:
            return out
        i, j, n = best
        free_a[i : i + n] = free_b[j : j + n] = False
        out.append(best)


def _windows_of_items(stacked: DataFrame, least: int) -> DataFrame:
    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = Numbers()
        for frame in frames:
            hs = [np.unique(rolling(numbers.of(words(t)), least)).view(np.int64) for t in frame["text"]]
            yield pd.DataFrame({"part": np.repeat(frame["part"].to_numpy(np.int64), [len(h) for h in hs]), "hash": np.concatenate([np.empty(0, np.int64), *hs])})

    return stacked.mapInPandas(windows, "part bigint, hash bigint")


def leaks(documents: DataFrame, items: DataFrame, fields: tuple[str, ...] = FIELDS, least: int = MIN_WORDS, least_covered: float = 0.0, bits: int = FILTER_BITS) -> DataFrame:
    """A row for each document, item and field that share a run of at least `least` words; columns as in TILES.

    documents: doc_id, text; items: item_id and the fields. covered is the share of the field's words under tiles, and rows
    with less than least_covered are left out. Null and blank texts and fields share nothing; rows of a document repeated
    with their text count once; an item_id with several rows gives a row for each. Further columns are dropped. Whole texts
    are read. bits: size of the filter, which changes the costs alone.
    """
    stacked = items.select("item_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("x")).select("item_id", "x.field", "x.text")
    stacked = materialize(stacked.where(F.length("text") > 0).distinct().withColumn("part", F.xxhash64("item_id", "field", "text")), "item_parts")
    of_items = materialize(_windows_of_items(stacked, least), "item_windows")
    slot = F.pmod("hash", F.lit(bits))
    filled = (
        of_items.groupBy(F.floor(slot / 64).cast("int").alias("slot")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(pmod(hash, {bits}), 64) as int))")).alias("bits")).collect()
    )  # bits / 64 rows at most
    sent = documents.sparkSession.sparkContext.broadcast((np.array([r.slot for r in filled], np.int64), np.array([r.bits for r in filled], np.int64)))

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, passes = Numbers(), np.zeros(-(-bits // 64), np.int64)
        passes[sent.value[0]] = sent.value[1]
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                h = rolling(numbers.of(words(text)), least).view(np.int64)
                at = h % bits
                hit = np.unique(h[(passes[at >> 6] >> (at & 63)) & 1 == 1])
                if len(hit):
                    rows.append((doc, text, hit))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "hashes"])

    docs = documents.select(F.col("doc_id").cast("string"), "text").where(F.length("text") > 0)  # pandas would make null numbers inexact
    picked = docs.mapInPandas(pick, "doc_id string, text string, hashes array<bigint>").withColumn("doc", F.xxhash64("doc_id", "text"))
    picked = materialize(picked, "picked")
    seen = materialize(picked.select("doc", F.explode("hashes").alias("hash")).distinct(), "seeds")
    # A passage may stand in any part of the documents: its windows are the heavy keys, and there are few of an item.
    held = materialize(of_items.groupBy("hash").agg(F.collect_set("part").alias("parts")).join(seen.groupBy("hash").agg(F.count(F.lit(1)).alias("n")), "hash"), "held")
    pairs = materialize(join_heavy(seen, held, ["hash"], "n").select("doc", F.explode("parts").alias("part")).distinct(), "seed_pairs")
    weighed = materialize(stacked.join(pairs.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "part"), "weighed")
    of_doc = join_heavy(pairs, weighed, ["part"], "n").groupBy("doc").agg(F.collect_list(F.struct(F.col("item_id").cast("string").alias("item_id"), "field", "text")).alias("found"))  # items that one text holds
    texts = picked.select("doc", "doc_id", "text").dropDuplicates(["doc", "doc_id", "text"])

    def tile(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, text, found in zip(frame["doc_id"], frame["text"], frame["found"], strict=True):
                ws = words(text)
                for x in found:
                    of = words(x["text"])
                    if got := tiles(of, ws, least):
                        covered = round(sum(n for _, _, n in got) / len(of), 6)
                        if covered >= least_covered:
                            out.append((doc, x["item_id"], x["field"], len(got), got[0][2], len(of), covered))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "field", "n_tiles", "longest", "n_words", "covered"])

    return texts.join(of_doc, "doc").select("doc_id", "text", "found").mapInPandas(tile, TILES.replace("bigint", "string")).withColumns({x: F.col(x).cast("bigint") for x in ("doc_id", "item_id")})


def _of(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_questions"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _of(spark, folder).select("doc_id", "item_id").distinct()


def p6_tiles(spark: SparkSession, folder: str) -> DataFrame:
    return _of(spark, folder)


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    """Which items leaked: into how many documents, and how much of a field at most."""
    return _of(spark, folder).groupBy("item_id").agg(
        F.countDistinct("doc_id").alias("n_documents"), F.max("longest").alias("longest"), F.max("covered").alias("covered"))


QUERIES = {"p6_found": p6_found, "p6_tiles": p6_tiles, "p6_items": p6_items}
ORACLES = {
    "p6_found": r"""
WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
), d AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 11), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM doc)
), item AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
  FROM (SELECT item_id, unnest([question, reference_answer, evidence_text]) AS t FROM eval_questions)
), e AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 11), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM item)
)
SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (g)
""",
}
