"""Long exact spans shared between records, by hashes of runs of consecutive sentences.

Every run of consecutive sentences that just reaches RUN characters is hashed; sentences over LONG characters are
covered by their winnowed shingles besides, so that any shared stretch of LEAST characters holds a hashed run or shingle
whole: either a partial sentence at its ends or one inside is over LONG, or its whole sentences have at least
LEAST - 2 LONG = RUN characters. Of the LEAST characters around a run, the half on its right or the half on its left is
shared too; runs are joined globally together with one of these, which keeps short boilerplate from pairing documents.
Joined places are then compared character by character. Equal texts form a class and take part once. Where many texts hold
a stretch, each is compared with the first of them alone, which gives its spans; the stretch itself, known by its digest,
gives the pairs, cell by cell of a grid over the holders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrove.shared import join_heavy, materialize, table

LEAST, LONG, RUN, SHINGLE = 300, 110, 80, 60
#: Up to so many exact copies of a text give all pairs; beyond it they are linked to the first alone. Up to so many different
#: texts that hold a span are compared with each other; beyond it their pairs are told by the span, in cells of 2 CELL holders.
EXPAND, CELL = 32, 256
#: Rows of one key that a join leaves in one task.
SPREAD = 1000

_CUT = re.compile(r"[.!?]\s|\n")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 15)
        with np.errstate(over="ignore"):
            _powers = tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64))), dtype=np.uint64) for b in (_BASE, _INVERSE))
    return _powers


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def cuts(text: str) -> list[int]:
    """Where sentences begin and, at last, the text ends."""
    return sorted({0, len(text), *(m.end() for m in _CUT.finditer(text))})


class Hashes:
    """Polynomial hashes, modulo 2^64, of any stretches of a text."""

    def __init__(self, text: str):
        n = len(text)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.power, inverse = _upto(n)
        with np.errstate(over="ignore"):
            self.total = np.concatenate(([np.uint64(0)], np.cumsum(chars * inverse[:n], dtype=np.uint64)))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mixed((self.total[b] - self.total[a]) * self.power[a] + (b - a).astype(np.uint64))

    def windows(self, k: int) -> np.ndarray:
        a = np.arange(max(0, len(self.total) - k))
        return self(a, a + k)


def seeds(text: str, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each seed of the text: a run or shingle with the half on its right, or the half on its left."""
    n = len(text)
    none = np.empty(0, np.int64)
    if n < least:
        return none, none, none
    long, run, k = least * LONG // LEAST, least - 2 * (least * LONG // LEAST), least * SHINGLE // LEAST
    hashed = Hashes(text)
    at = np.array(cuts(text), np.int64)
    ends = np.searchsorted(at, at[:-1] + run)
    ok = ends < len(at)
    starts, stops = at[:-1][ok], at[ends[ok]]
    ok = stops - starts <= run + long
    starts, stops = [starts[ok]], [stops[ok]]
    lengthy = np.flatnonzero(np.diff(at) > long)
    if len(lengthy):
        grams, w, picked = hashed.windows(k), long - k + 1, []
        for i in lengthy:
            view = np.lib.stride_tricks.sliding_window_view(grams[at[i] : at[i + 1] - k + 1], w)
            picked.append(at[i] + np.unique(np.arange(len(view)) + view.argmin(axis=1)))
        starts.append(np.concatenate(picked))
        stops.append(starts[-1] + k)
    starts, stops = np.concatenate(starts), np.concatenate(stops)
    half = np.maximum(0, (least - (stops - starts) + 1) // 2)
    right, left = stops + half <= n, starts - half >= 0
    begin, end = np.concatenate((starts[right], (starts - half)[left])), np.concatenate(((stops + half)[right], stops[left]))
    return hashed(begin, end).view(np.int64), begin, end


def intervals(hit: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Stretches covered by windows of k at the places hit."""
    if not len(hit):
        return []
    gap = np.flatnonzero(np.diff(hit) > 1)
    return list(zip(hit[np.concatenate(([0], gap + 1))].tolist(), (hit[np.concatenate((gap, [len(hit) - 1]))] + k).tolist(), strict=True))


def shared(a: str, b: str, least: int = LEAST) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Stretches of a and of b that are covered by `least` or more characters standing in the other too."""
    x, y = Hashes(a).windows(least), Hashes(b).windows(least)
    in_a = [(s, e) for s, e in intervals(np.flatnonzero(np.isin(x, y)), least) if a[s : s + least] in b]
    in_b = [(s, e) for s, e in intervals(np.flatnonzero(np.isin(y, x)), least) if b[s : s + least] in a]
    return in_a, in_b


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


SPANS = "array<struct<s: int, e: int>>"


class Shared:
    """Spans shared among documents.

    documents: doc_id, text; further columns are dropped. Texts that are null or under `least` characters share nothing.
    Equal rows count once; a doc_id with several texts takes part with each of them. Empty tables give empty results.

    copies: doc_id, first (least doc_id with the same text), n; for texts that occur more than once.
    pairs: a < b, both first of their texts, with the stretches shared, spans_a and spans_b. Of a stretch that stands in more
    than `expand` texts each is there with the first of these alone, which is enough for the spans.
    links: a < b, both first of their texts: each pair of different texts that shares a stretch, without exception.
    """

    def __init__(self, documents: DataFrame, least: int = LEAST, expand: int = EXPAND):
        self.least, self.expand = least, expand
        self.docs = docs = documents.select("doc_id", "text").where(F.length("text") >= least)
        ids = materialize(docs.select("doc_id", F.unhex(F.md5("text")).alias("class")).distinct(), "ids")
        several = ids.groupBy("class").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        several = materialize(several, "classes")
        self.copies = materialize(join_heavy(ids, several, ["class"], "n").select("doc_id", "first", "n"), "copies")
        self.wide: DataFrame | None = None  # seed, doc_id and n of the stretches in more than `expand` texts
        self.pairs = self._pairs()
        self._linked: DataFrame | None = None

    @property
    def links(self) -> DataFrame:
        if self._linked is None:
            near = self.pairs.select("a", "b")
            self._linked = near if self.wide is None else materialize(near.unionByName(_cell_pairs(self.wide)).distinct(), "links")
        return self._linked

    def _firsts(self) -> DataFrame:
        """One document of each text."""
        return self.docs.join(self.copies.where(F.col("doc_id") != F.col("first")).select("doc_id"), "doc_id", "left_anti")

    def _held(self) -> DataFrame:
        """seed and first document of the texts that hold it, for the seeds of more than one text."""
        least = self.least

        def seeded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                hs, ids = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                    hs.append(np.unique(seeds(text, least)[0]))
                    ids.append(np.full(len(hs[-1]), doc))
                yield pd.DataFrame({"seed": np.concatenate(hs), "doc_id": np.concatenate(ids)})

        rows = materialize(self.docs.where(F.col("doc_id").isNotNull()).mapInPandas(seeded, "seed bigint, doc_id bigint"), "seeds")
        repeated = materialize(rows.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "repeated")
        held = (
            join_heavy(rows, repeated, ["seed"], "n").join(self.copies.select("doc_id", "first"), "doc_id", "left")
            .select("seed", F.coalesce("first", "doc_id").alias("doc_id")).distinct()
        )
        held = materialize(held, "held")
        groups = materialize(held.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "groups")
        return join_heavy(held, groups, ["seed"], "n")

    def _pairs(self) -> DataFrame:
        held = materialize(self._held(), "groups_held")
        near = held.where(F.col("n") <= self.expand)
        wide = held.where(F.col("n") > self.expand)
        candidates = _all_pairs(near, "seed")
        if not wide.isEmpty():
            held = materialize(self._windows(wide), "windows")
            groups = materialize(held.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("a")).where(F.col("n") > 1), "window_groups")
            held = materialize(join_heavy(held, groups, ["seed"], "n"), "windows_held")
            self.wide = held.where(F.col("n") > self.expand).select("seed", "doc_id", "n")
            candidates = candidates.unionByName(_all_pairs(held.where(F.col("n") <= self.expand), "seed"))
            candidates = candidates.unionByName(held.where((F.col("n") > self.expand) & (F.col("doc_id") != F.col("a"))).select("a", F.col("doc_id").alias("b")))
        candidates = materialize(candidates.distinct(), "candidates")
        involved = candidates.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        texts = materialize(self.docs.join(involved, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), "texts")
        least = self.least

        def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for a, b, x, y in zip(frame["a"], frame["b"], frame["text_a"], frame["text_b"], strict=True):
                    in_a, in_b = shared(x, y, least)
                    if in_a and in_b:
                        rows.append((a, b, [{"s": s, "e": e} for s, e in in_a], [{"s": s, "e": e} for s, e in in_b]))
                yield pd.DataFrame(rows, columns=["a", "b", "spans_a", "spans_b"])

        side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
        both = _join_spread(_join_spread(candidates, side("a"), "a", "b"), side("b"), "b", "a", candidates)
        return materialize(both.mapInPandas(compared, f"a bigint, b bigint, spans_a {SPANS}, spans_b {SPANS}"), "pairs")

    def _windows(self, wide: DataFrame) -> DataFrame:
        """Each stretch of `least` characters around a seed that many texts hold, by its digest, as a seed of its own.

        Two texts that hold the seed share `least` characters around it if and only if they share one of these.
        """
        least = self.least
        of = wide.groupBy("doc_id").agg(F.collect_set("seed").alias("wanted"))  # the seeds of one text

        def around(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                hs, ids = [], []
                for doc, text, wanted in zip(frame["doc_id"], frame["text"], frame["wanted"], strict=True):
                    h, begin, end = seeds(text, least)
                    at = set()
                    for i in np.flatnonzero(np.isin(h, np.array(wanted, np.int64))):
                        at.update(range(max(0, end[i] - least), min(begin[i], len(text) - least) + 1))
                    own = {blake2b(text[s : s + least].encode("utf-8", "surrogatepass"), digest_size=16).digest() for s in at}
                    hs += own
                    ids += [doc] * len(own)
                yield pd.DataFrame({"seed": hs, "doc_id": np.array(ids, np.int64)})

        return self.docs.join(of, "doc_id").mapInPandas(around, "seed binary, doc_id bigint").distinct()

    def document_pairs(self) -> DataFrame:
        """doc_id_a < doc_id_b of the documents that share a stretch.

        Among exact copies of one text, and between them and those of another, all pairs are given where a text has at most
        `expand` copies; beyond it, copies are paired with the first alone and other texts with the first of the copies. Of
        different texts, all pairs are given, however many hold a stretch.
        """
        few = self.copies.where(F.col("n") <= self.expand)
        members = few.groupBy("first").agg(F.array_sort(F.collect_set("doc_id")).alias("ids"))  # at most `expand`
        side = lambda c, name: members.select(F.col("first").alias(c), F.col("ids").alias(name))
        apart = (
            _join_spread(_join_spread(self.links, side("a", "ids_a"), "a", "b", how="left"), side("b", "ids_b"), "b", "a", self.links, "left")
            .select(F.explode(F.coalesce("ids_a", F.array("a"))).alias("x"), F.coalesce("ids_b", F.array("b")).alias("ids_b"))
            .select("x", F.explode("ids_b").alias("y"))
            .select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
        )
        pair = F.explode(F.flatten(F.transform("ids", lambda x: F.transform(F.filter("ids", lambda y: y > x), lambda y: F.struct(x.alias("doc_id_a"), y.alias("doc_id_b"))))))
        within = members.select(pair.alias("p")).select("p.*")
        star = self.copies.where((F.col("n") > self.expand) & (F.col("doc_id") != F.col("first"))).select(F.col("first").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b"))
        return apart.unionByName(within).unionByName(star).where(F.col("doc_id_a") != F.col("doc_id_b")).distinct()

    def _spans(self, later_only: bool) -> DataFrame:
        """first and merged spans of each text that shares any; with later_only, those whose first holder is another."""
        sides = self.pairs.select(F.col("b").alias("first"), F.explode("spans_b").alias("x"))
        if not later_only:
            sides = sides.unionByName(self.pairs.select(F.col("a").alias("first"), F.explode("spans_a").alias("x")))
        sides = sides.select("first", F.col("x.s").alias("s"), F.col("x.e").alias("e")).distinct()
        before = F.max("e").over(Window.partitionBy("first").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
        opens = F.when(before >= F.col("s"), 0).otherwise(1)
        island = F.sum("opens").over(Window.partitionBy("first").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return sides.withColumn("opens", opens).withColumn("island", island).groupBy("first", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))

    def coverage(self) -> DataFrame:
        """doc_id, class_id (first document with the text), n_copies, n_links (other texts linked), n_chars, n_shared, share: a row for each document."""
        links = self.links.select(F.col("a").alias("first")).unionByName(self.links.select(F.col("b").alias("first"))).groupBy("first").agg(F.count(F.lit(1)).alias("n_links"))
        spans = self._spans(False).groupBy("first").agg(F.sum(F.col("e") - F.col("s")).alias("n_part"))
        known = links.join(spans, "first", "full_outer")
        of_class = self.copies.groupBy("first").agg(F.max("n").alias("n")).join(known, "first", "left")
        copies = join_heavy(self.copies.select("doc_id", "first"), materialize(of_class, "of_class"), ["first"], "n")  # a class may have any part of the documents
        single = known.join(self.copies.select(F.col("doc_id").alias("first")), "first", "left_anti").select(F.col("first").alias("doc_id"), "first", F.lit(1).cast("bigint").alias("n"), "n_links", "n_part")
        return (
            self.docs.select("doc_id", F.length("text").alias("n_chars")).join(copies.select("doc_id", "first", "n", "n_links", "n_part").unionByName(single), "doc_id", "left")
            .withColumn("n_shared", F.when(F.col("n") > 1, F.col("n_chars")).otherwise(F.coalesce("n_part", F.lit(0))).cast("bigint"))
            .select("doc_id", F.coalesce("first", "doc_id").alias("class_id"), F.coalesce("n", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_chars", "n_shared",
                    F.round(F.col("n_shared") / F.col("n_chars"), 6).alias("share"))
        )

    def without_repeats(self) -> DataFrame:
        """doc_id, text without the sentences that lie in a span whose first holder is another document, n_sentences, n_removed.

        Only documents that lose something: later copies lose everything.
        """
        spans = self._spans(True).groupBy("first").agg(F.collect_list(F.struct("s", "e")).alias("spans"))  # the spans of one text
        work = (
            self.docs.join(self.copies, "doc_id", "left").withColumn("copy", F.coalesce(F.col("first") != F.col("doc_id"), F.lit(False)))
            .join(spans.withColumnRenamed("first", "doc_id"), "doc_id", "left").where(F.col("copy") | F.col("spans").isNotNull())
            .select("doc_id", "text", "copy", "spans")
        )

        def cleaned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for doc, text, copy, spans in zip(frame["doc_id"], frame["text"], frame["copy"], frame["spans"], strict=True):
                    at = cuts(text)
                    inside = [(0, len(text))] if copy else merged([(x["s"], x["e"]) for x in spans])
                    keep = [(s, e) for s, e in zip(at, at[1:], strict=False) if not any(a <= s and s + len(text[s:e].rstrip()) <= b for a, b in inside)]
                    rows.append((doc, "".join(text[s:e] for s, e in keep), len(at) - 1, len(at) - 1 - len(keep)))
                yield pd.DataFrame(rows, columns=["doc_id", "text", "n_sentences", "n_removed"])

        return work.mapInPandas(cleaned, "doc_id bigint, text string, n_sentences int, n_removed int").where(F.col("n_removed") > 0)


def _join_spread(pairs: DataFrame, right: DataFrame, key: str, other: str, counted: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """Join of pairs with what belongs to one side of them, when one key may be in any part of the pairs.

    The rows of such keys are spread by the other side over parts of about SPREAD rows, and right is repeated for each part.
    At most 1,000 keys are spread, those with most rows: another has a thousandth of the rows at most. counted: pairs before
    earlier joins, which has the same keys.
    """
    many = (pairs if counted is None else counted).groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > SPREAD).orderBy(F.col("__n").desc(), key).limit(1000)
    many = F.broadcast(materialize(many.select(key, F.ceil(F.col("__n") / SPREAD).cast("int").alias("__parts")), "spread"))
    left = pairs.join(many, key, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(other), F.col("__parts")).cast("int"), F.lit(0))).drop("__parts")
    spread = right.join(many, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts"), F.lit(1)) - 1))).drop("__parts")
    return left.join(spread, [key, "__part"], how).drop("__part")


def _all_pairs(held: DataFrame, key: str) -> DataFrame:
    """Pairs a < b within groups that are known to be small."""
    groups = held.groupBy(key).agg(F.array_sort(F.collect_set("doc_id")).alias("ids")).select("ids").distinct()
    pair = F.explode(F.flatten(F.transform("ids", lambda x: F.transform(F.filter("ids", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b"))))))
    return groups.select(pair.alias("p")).select("p.a", "p.b").distinct()


def _cell_pairs(held: DataFrame) -> DataFrame:
    """Pairs a < b within groups (seed, doc_id, n) of any size.

    Groups of the same members count once. The members of a group fall into about n / CELL parts; a member goes to the cells of
    its part with each, so that a task has the pairs of two parts at a time and no key holds a whole group.
    """
    mark = F.xxhash64("doc_id", F.lit(8))
    alike = held.groupBy("seed").agg(F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(mark).alias("y"), F.first("n").alias("n"))
    one = materialize(alike.groupBy("x", "y", "n").agg(F.min("seed").alias("seed")).select("seed", "n"), "wide_groups")
    parts = F.ceil(F.col("n") / CELL).cast("int")
    part = join_heavy(held.drop("n"), one, ["seed"], "n").withColumn("parts", parts).withColumn("p", F.pmod(mark, F.col("parts")).cast("int"))
    cells = part.select("seed", "doc_id", "p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q")).select(
        "seed", "doc_id", "p", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"))
    ids = lambda side: F.array_sort(F.collect_list(F.when(F.col("p") == F.col(side), F.col("doc_id"))))  # noqa: E731 - of one part
    both = cells.groupBy("seed", "i", "j").agg(ids("i").alias("xs"), ids("j").alias("ys"))
    pairs = both.select("i", "j", F.explode("xs").alias("x"), "ys").select("i", "j", "x", F.explode("ys").alias("y")).where((F.col("i") < F.col("j")) | (F.col("x") < F.col("y")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return Shared(table(spark, folder, "documents")).document_pairs()


def p8_shared(spark: SparkSession, folder: str) -> DataFrame:
    return Shared(table(spark, folder, "documents")).coverage()


def p8_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return Shared(table(spark, folder, "documents")).without_repeats()


QUERIES = {"p8_found": p8_found, "p8_shared": p8_shared, "p8_cleaned": p8_cleaned}
ORACLES = {
    "p8_cleaned": r"""WITH c AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS class_id FROM documents WHERE len(text) >= 300),
        w AS MATERIALIZED (SELECT class_id, i, hash(substr(text, i, 300)) AS h FROM (SELECT class_id, text, unnest(range(1, len(text) - 298)) AS i FROM c WHERE doc_id = class_id)), f AS (SELECT h, min(class_id) AS a FROM w GROUP BY h),
        s AS (SELECT class_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY class_id ORDER BY i) <= 300 THEN 0 ELSE 1 END AS opens FROM (SELECT DISTINCT class_id, i FROM w JOIN f USING (h) WHERE a < class_id)),
        m AS MATERIALIZED (SELECT class_id, min(i) - 1 AS a, max(i) + 299 AS b FROM (SELECT *, sum(opens) OVER (PARTITION BY class_id ORDER BY i) AS island FROM s) GROUP BY class_id, island),
        t AS (SELECT doc_id, class_id, list_filter(string_split(regexp_replace(text, '([.!?][\s\x{85}\p{Z}]|\n)', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ss FROM c WHERE doc_id <> class_id OR class_id IN (SELECT class_id FROM m)),
        u AS (SELECT *, coalesce(sum(len(x)) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (SELECT doc_id, class_id, unnest(ss) AS x, generate_subscripts(ss, 1) AS p FROM t)),
        z AS (SELECT *, doc_id <> class_id OR EXISTS (SELECT 1 FROM m WHERE m.class_id = u.class_id AND m.a <= u.s AND u.s + len(regexp_replace(u.x, '[\s\x{85}\p{Z}]+$', '')) <= m.b) AS gone FROM u)
        SELECT doc_id, coalesce(string_agg(x, '' ORDER BY p) FILTER (NOT gone), '') AS text, count(*) AS n_sentences, count(*) FILTER (gone) AS n_removed FROM z GROUP BY 1 HAVING count(*) FILTER (gone) > 0""",
    "p8_shared": """WITH c AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS n_copies, len(text) AS n_chars FROM documents WHERE len(text) >= 300),
        w AS MATERIALIZED (SELECT class_id, i, hash(substr(text, i, 300)) AS h FROM (SELECT class_id, text, unnest(range(1, len(text) - 298)) AS i FROM c WHERE doc_id = class_id)),
        k AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT class_id) > 1), s AS MATERIALIZED (SELECT w.* FROM w SEMI JOIN k USING (h)),
        l AS (SELECT a.class_id, count(DISTINCT b.class_id) AS n_links FROM s a JOIN s b USING (h) WHERE a.class_id <> b.class_id GROUP BY 1),
        g AS (SELECT class_id, CAST(sum(n) AS BIGINT) AS n_part FROM (SELECT class_id, least(300, coalesce(lead(i) OVER (PARTITION BY class_id ORDER BY i) - i, 300)) AS n FROM s) GROUP BY 1),
        r AS (SELECT doc_id, class_id, n_copies, coalesce(n_links, 0) AS n_links, n_chars, CASE WHEN n_copies > 1 THEN n_chars ELSE coalesce(n_part, 0) END AS n_shared FROM c LEFT JOIN l USING (class_id) LEFT JOIN g USING (class_id))
        SELECT *, round(n_shared / n_chars, 6) AS share FROM r""",
    "p8_found": """WITH w AS (SELECT DISTINCT doc_id, hash(substr(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, len(text) - 298)) AS i FROM documents WHERE len(text) >= 300)),
        r AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1), k AS (SELECT w.* FROM w SEMI JOIN r USING (h))
        SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM k a JOIN k b USING (h) WHERE a.doc_id < b.doc_id""",
}
