"""Canonical entity and relation profiles from extracted rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrove.functions.fuzzy import token_sort_of
from lexigrove.functions.text import canonical_key, initials, is_acronym, join_capped, slugify
from lexigrove.operators.graph import components
from lexigrove.shared import join_heavy, join_large, materialize, numbered_within, table

# Relation types that are others read backwards.
INVERSE = {"USED_BY": "USES", "IS_IMPROVED_BY": "IMPROVES_OVER", "IS_EVALUATION_DATASET_FOR": "EVALUATES_ON", "INTRODUCED_BY": "INTRODUCES", "DEPENDED_ON_BY": "DEPENDS_ON"}
FUZZY, DESCRIPTION_CAP = 88.0, 1500


def edits(m: int, n: int, least: float = FUZZY) -> int:
    """Most insertions and deletions between strings of these lengths whose ratio reaches `least`; below 0 if none does."""
    most = int((100 - least) * (m + n) / 100 + 1e-9)
    most -= (most - m - n) % 2  # as odd or even as the lengths together
    return most if most >= abs(m - n) else -1


def pieces(n: int, k: int) -> list[tuple[int, int]]:
    """Begin and end of k stretches that fill a string of n characters, as even as can be."""
    at = [i * n // k for i in range(k + 1)]
    return list(zip(at, at[1:], strict=False))


def held_pieces(s: str, least: float = FUZZY) -> list[tuple[int, int, int, str]]:
    """Keys (length, edits, number, piece) of a string as the shorter of two that may be alike.

    Strings within k edits of each other have one key in common at least: of k + 1 pieces of the shorter one stands whole in
    the longer, moved by no more than the edits before it and, seen from the end, no more than those after it.
    """
    n = len(s)
    longest = int(n * (100 + 100 - least) / least + 1e-9)
    ks = {k for m in range(n, longest + 1) if (k := edits(n, m, least)) >= 0}
    return [(n, k, i, s[a:b]) for k in sorted(ks) for i, (a, b) in enumerate(pieces(n, k + 1))]


def sought_pieces(s: str, least: float = FUZZY) -> list[tuple[int, int, int, str]]:
    """Keys of a string as the longer of two, for held_pieces of the shorter."""
    n, sought = len(s), set()
    shortest = int(n * least / (200 - least) - 1e-9)
    for m in range(max(0, shortest), n + 1):
        k = edits(m, n, least)
        if k >= 0:
            for i, (a, b) in enumerate(pieces(m, k + 1)):
                for by in range(max(-i, n - m - (k - i), -a), min(i, n - m + k - i, n - b) + 1):
                    sought.add((m, k, i, s[a + by : b + by]))
    return sorted(sought)


def parities(s: str) -> int:
    """64 bits, each whether a class of characters occurs an odd number of times: an insertion or deletion changes one bit."""
    out = 0
    for c in s:
        out ^= 1 << (ord(c) & 63)
    return out - (1 << 64) if out >> 63 else out


def alike_names(names: DataFrame, least: float = FUZZY) -> DataFrame:
    """type, name_key, other: each two names (type, name_key, sorted) of one type once whose sorted forms are alike by `least`.

    Names meet by a number made of their pieces' keys; of those that meet, only such go on whose characters' parities differ in no more
    places than the edits allowed, and these are compared in full. Keys with one number cost one comparison more.
    """
    names = materialize(names.select("type", "name_key", "sorted").withColumn("id", F.monotonically_increasing_id()), "names")

    def keyed(of) -> DataFrame:
        def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for t, name, s in zip(frame["type"], frame["id"], frame["sorted"], strict=True):
                    kind, sign, n = zlib.crc32((t or "").encode()), parities(s), len(s)
                    rows += [((m & 0x7FFF) << 48 | (k & 0xFF) << 40 | (i & 0xFF) << 32 | zlib.crc32(x.encode("utf-8", "surrogatepass"), kind), name, n, sign, k) for m, k, i, x in of(s, least)]
                yield pd.DataFrame(rows, columns=["key", "id", "n", "sign", "k"])

        return names.select("type", "id", "sorted").mapInPandas(keys, "key bigint, id bigint, n int, sign bigint, k int")

    short, long = keyed(held_pieces), keyed(sought_pieces).select("key", F.col("id").alias("other"), F.col("n").alias("other_n"), F.col("sign").alias("other_sign"))
    # Two of one length find each other both ways; one is enough.
    once = (F.col("id") < F.col("other")) | ((F.col("id") > F.col("other")) & (F.col("n") < F.col("other_n")))
    met = join_large(short, long, ["key"]).where(once & (F.bit_count(F.col("sign").bitwiseXOR(F.col("other_sign"))) <= F.col("k")))
    candidates = materialize(met.select("id", "other").distinct(), "candidates")
    both = join_large(join_large(candidates, names, ["id"]), names.select(F.col("id").alias("other"), F.col("type").alias("other_type"), F.col("name_key").alias("other_key"), F.col("sorted").alias("other_sorted")), ["other"])
    return both.where(F.col("type").eqNullSafe(F.col("other_type"))).where(token_sort_of("sorted", "other_sorted") >= least).select("type", "name_key", F.col("other_key").alias("other"))


def entity_groups(rows: DataFrame) -> DataFrame:
    """name_key, type and the group (least node of its component) of distinct entities, from rows (name, type, aliases).

    Entities of one type are one if they share a canonical key among names and aliases, if one is the acronym of the other, or
    if their sorted names are alike by FUZZY. Names under one key are linked through the key, not with each other. All alike
    names are found, by alike_names. Types are compared in upper case; null names and types count as ''.
    """
    name, kind = F.coalesce("name", F.lit("")), F.upper(F.trim(F.coalesce("type", F.lit(""))))
    base = rows.select(canonical_key(name).alias("name_key"), kind.alias("type"), F.when(~is_acronym(name), initials(name)).alias("short"), is_acronym(name).alias("acronym"), F.coalesce("aliases", F.expr("cast(array() as array<string>)")).alias("aliases"))
    base = materialize(base.distinct(), "entities")
    node = F.concat_ws("\x1f", F.lit("n"), "type", "name_key")
    key = lambda c: F.concat_ws("\x1f", F.lit("k"), F.col("type"), c)
    by_name = base.select(node.alias("source"), key(F.col("name_key")).alias("target"))
    by_alias = base.select("type", "name_key", F.explode("aliases").alias("a")).withColumn("k", canonical_key(F.col("a"))).where("k <> ''").select(node.alias("source"), key(F.col("k")).alias("target"))
    known = base.where("acronym").select("type", F.col("name_key").alias("short")).distinct()
    by_short = join_large(base.where(F.length("short") > 1).withColumn("short", F.lower("short")), known, ["type", "short"], "left_semi").select(node.alias("source"), key(F.col("short")).alias("target"))
    plain = base.select("type", "name_key").distinct().withColumn("sorted", F.array_join(F.array_sort(F.split("name_key", " ")), " "))
    near = alike_names(plain)
    alike = near.select(node.alias("source"), F.concat_ws("\x1f", F.lit("n"), "type", "other").alias("target"))
    edges = by_name.unionByName(by_alias).unionByName(by_short).unionByName(alike)
    return components(edges).where(F.col("node").startswith("n\x1f")).select(F.split("node", "\x1f")[1].alias("type"), F.split("node", "\x1f")[2].alias("name_key"), F.col("component").alias("group"))


def entity_profiles(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """One row for each group: id, the longest name that is no acronym, type by votes, counts, and the first aliases, chunks and sources in order.

    rows: row_id, name, type, aliases, description, chunk_ids, source_ids. Lists hold the distinct values with the least row_id,
    at most 50; their counts are exact. Ties of names go to the lesser.
    """
    kind = F.upper(F.trim(F.coalesce("type", F.lit(""))))
    groups = materialize(groups.withColumnRenamed("type", "t"), "groups")  # read for each of the lists below
    held = join_large(rows.withColumn("t", kind).withColumn("name_key", canonical_key(F.coalesce("name", F.lit("")))), groups, ["t", "name_key"])
    named = held.groupBy("group").agg(
        F.max_by("name", F.struct((~is_acronym(F.coalesce("name", F.lit("")))).alias("full"), F.length("name").alias("n"), "name")).alias("canonical_name"), F.count(F.lit(1)).alias("n_rows"),
        F.max_by("description", F.struct(F.length("description"), F.col("description"))).alias("description"), F.round(F.avg("confidence"), 6).alias("confidence"))
    votes = held.groupBy("group", "t").agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(F.max_by("t", F.struct("n", "t")).alias("type"))

    def firsts(c: Column, name: str) -> DataFrame:
        one = held.select("group", "row_id", F.explode(c).alias("v")).where("v is not null and trim(v) <> ''").groupBy("group", "v").agg(F.min("row_id").alias("at"))
        r = one.withColumn("r", F.row_number().over(Window.partitionBy("group").orderBy("at", "v")))
        return r.groupBy("group").agg(F.count(F.lit(1)).alias(f"n_{name}"), F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 50, F.struct("r", "v")))), lambda x: x["v"]).alias(name))

    out = join_large(named, votes, ["group"])
    for c, name in ((F.concat(F.array("name"), F.coalesce("aliases", F.expr("cast(array() as array<string>)"))), "aliases"), (F.col("chunk_ids"), "chunk_ids"), (F.col("source_ids"), "source_ids")):
        out = join_large(out, firsts(c, name), ["group"], "left")
    slug = slugify(F.col("canonical_name"))
    n = F.row_number().over(Window.partitionBy(slug).orderBy("group"))
    out = out.withColumn("id", F.concat(F.lit("entity:"), slug, F.when(n > 1, F.concat(F.lit("-"), n)).otherwise("")))
    profile = join_capped(F.array(F.col("canonical_name"), F.col("type"), F.array_join(F.slice("aliases", 1, 8), ", "), F.col("description")), DESCRIPTION_CAP, " | ")
    return out.withColumn("profile_text", profile)


def merged_relations(relations: DataFrame, names: DataFrame) -> DataFrame:
    """Relations between canonical entities: id, ends, type, weight, n_rows, and the distinct keywords in order.

    relations: ord, source, target, relation_type, keywords, weight; names: key (canonical), entity_id. Ends without an entity
    and loops fall out, inverse types are turned round, weights add up (a sum of 0 counts 1).
    """
    of = lambda c, out: names.select(F.col("key").alias(f"{c}_key"), F.col("entity_id").alias(out))
    kind = F.upper(F.trim(F.coalesce("relation_type", F.lit(""))))
    r = relations.withColumn("source_key", canonical_key(F.col("source"))).withColumn("target_key", canonical_key(F.col("target"))).join(of("source", "a"), "source_key").join(of("target", "b"), "target_key").where("a <> b").withColumn("t", F.when(kind == "", "RELATED_TO").otherwise(kind))
    back = F.col("t").isin(*INVERSE)
    for k, v in INVERSE.items():
        r = r.withColumn("u", F.when(F.col("t") == k, v).otherwise(F.col("u") if "u" in r.columns else F.col("t")))
    r = r.select("ord", F.when(back, F.col("b")).otherwise(F.col("a")).alias("source_entity_id"), F.when(back, F.col("a")).otherwise(F.col("b")).alias("target_entity_id"), F.col("u").alias("relation_type"), F.col("weight").cast("double").alias("weight"), "keywords")
    ident = F.concat(F.lit("relation:"), F.element_at(F.split("source_entity_id", ":"), -1), F.lit(":"), F.lower("relation_type"), F.lit(":"), F.element_at(F.split("target_entity_id", ":"), -1))
    of = r.select(ident.alias("id"), "source_entity_id", "target_entity_id", "relation_type", "weight", "ord", "keywords")
    # Each keyword once, at its first place, before a relation's are put together.
    once = of.select("id", "ord", F.posexplode("keywords").alias("pos", "word")).groupBy("id", "word").agg(F.min(F.struct("ord", "pos")).alias("at"))
    words = once.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("keywords"))
    sums = of.groupBy("id", "source_entity_id", "target_entity_id", "relation_type").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n_rows"))
    return sums.join(words, "id", "left").select(
        "id", "source_entity_id", "target_entity_id", "relation_type", F.round(F.when(F.col("w") == 0, 1.0).otherwise(F.col("w")), 6).alias("weight"), "n_rows", F.array_join(F.coalesce("keywords", F.expr("cast(array() as array<string>)")), "|").alias("keywords"))


def evidence(profiles: DataFrame, chunks: DataFrame, most: int = 3) -> DataFrame:
    """id, n, chunk_id: the first chunks of each profile (id, chunk_ids) that exist (chunk_id)."""
    x = profiles.select("id", F.posexplode("chunk_ids").alias("at", "chunk_id")).join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return x.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("at"))).where(F.col("n") <= most).select("id", "n", "chunk_id")


def relation_ids(relations: DataFrame) -> DataFrame:
    """entity_id, n_relations and its first 50 relation ids in order."""
    x = relations.select("id", F.explode(F.array_distinct(F.array("source_entity_id", "target_entity_id"))).alias("entity_id"))
    r = x.withColumn("r", F.row_number().over(Window.partitionBy("entity_id").orderBy("id")))
    return r.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_relations"), F.array_sort(F.collect_list(F.when(F.col("r") <= 50, F.col("id")))).alias("relation_ids"))


def relation_links(relations: DataFrame) -> DataFrame:
    """entity_id, relation_id, pos: each relation of each entity, in order; an entity may have any number."""
    x = relations.select(F.explode(F.array_distinct(F.array("source_entity_id", "target_entity_id"))).alias("entity_id"), F.col("id").alias("relation_id"))
    return numbered_within(x.distinct(), ["entity_id"], ["relation_id"], "pos")


def members(rows: DataFrame, groups: DataFrame, column: str) -> DataFrame:
    """group, value, pos: each distinct value of an array column (chunk_ids, source_ids) of the rows of a group, in order of coming; without a bound."""
    kind = F.upper(F.trim(F.coalesce("type", F.lit(""))))
    of = join_heavy(
        rows.select(F.concat_ws("\x1f", kind, canonical_key(F.coalesce("name", F.lit("")))).alias("who"), "row_id", F.explode(column).alias("value")).where("value is not null and trim(value) <> ''"),
        materialize(groups.select(F.concat_ws("\x1f", "type", "name_key").alias("who"), "group", F.lit(1).alias("w")).dropDuplicates(["who"]), "who"), ["who"], "w")
    first = of.groupBy("group", "value").agg(F.min("row_id").alias("at"))
    return numbered_within(first, ["group"], ["at", "value"], "pos").select("group", "value", "pos")


# --- queries -------------------------------------------------------------------------------------------------------------


def profile_groups(spark: SparkSession, folder: str) -> DataFrame:
    return entity_groups(table(spark, folder, "extracted_entities"))


def profile_entities(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "extracted_entities")
    return entity_profiles(rows, entity_groups(rows)).select("id", "canonical_name", "type", "n_rows", "n_aliases", "n_chunk_ids", "n_source_ids", "profile_text")


def _relations(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Relations made of consecutive entity rows of one source, typed by the row, and the entities by canonical name."""
    rows = table(spark, folder, "extracted_entities").select("row_id", "name", F.upper("type").alias("type"), F.get("source_ids", F.lit(0)).alias("s"))
    w = Window.partitionBy("s").orderBy("row_id")
    r = rows.select(F.col("row_id").alias("ord"), F.col("name").alias("source"), F.lead("name").over(w).alias("target"), F.when(F.col("row_id") % 3 == 0, "used_by").when(F.col("row_id") % 3 == 1, "USES").otherwise("").alias("relation_type"), F.array("type").alias("keywords"), (F.col("row_id") % 2).alias("weight")).where("target is not null")
    names = rows.groupBy(canonical_key(F.col("name")).alias("key")).agg(F.min("row_id").alias("m")).select("key", F.concat(F.lit("entity:"), F.col("m")).alias("entity_id"))
    return r, names


def profile_relations(spark: SparkSession, folder: str) -> DataFrame:
    return merged_relations(*_relations(spark, folder))


def profile_relation_links(spark: SparkSession, folder: str) -> DataFrame:
    return relation_links(merged_relations(*_relations(spark, folder)))


def profile_relation_ids(spark: SparkSession, folder: str) -> DataFrame:
    return relation_ids(merged_relations(*_relations(spark, folder))).select("entity_id", "n_relations", F.array_join(F.slice("relation_ids", 1, 3), "|").alias("first_ids"))


def profile_evidence(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "extracted_entities").select(F.col("row_id").alias("id"), "chunk_ids")
    return evidence(rows, table(spark, folder, "light_chunks").select(F.col("id").alias("chunk_id")))


_CANON = lambda c: rf"trim(regexp_replace(lower(replace({c}, 'ß', 'ss')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_REL = f"""WITH rows_ AS (SELECT row_id, name, upper(type) AS type, source_ids[1] AS s FROM extracted_entities),
 r AS (SELECT row_id AS ord, name AS source, lead(name) OVER (PARTITION BY s ORDER BY row_id) AS target, CASE row_id % 3 WHEN 0 THEN 'USED_BY' WHEN 1 THEN 'USES' ELSE 'RELATED_TO' END AS t, type AS kw, row_id % 2 AS weight FROM rows_),
 n AS (SELECT {_CANON("name")} AS key, 'entity:' || min(row_id) AS e FROM rows_ GROUP BY 1),
 j AS (SELECT ord, CASE t WHEN 'USED_BY' THEN b.e ELSE a.e END AS x, CASE t WHEN 'USED_BY' THEN a.e ELSE b.e END AS y, CASE t WHEN 'USED_BY' THEN 'USES' ELSE t END AS t, kw, weight
   FROM r JOIN n a ON a.key = {_CANON("source")} JOIN n b ON b.key = {_CANON("target")} WHERE a.e <> b.e),
 k AS (SELECT x, y, t, kw, min(ord) AS o FROM j GROUP BY ALL),
 m AS (SELECT 'relation:' || split_part(x, ':', 2) || ':' || lower(t) || ':' || split_part(y, ':', 2) AS id, x AS source_entity_id, y AS target_entity_id, t AS relation_type, CAST(CASE WHEN sum(weight) = 0 THEN 1 ELSE sum(weight) END AS DOUBLE) AS weight, count(*) AS n_rows,
   (SELECT string_agg(kw, '|' ORDER BY o) FROM k WHERE k.x = j.x AND k.y = j.y AND k.t = j.t) AS keywords FROM j GROUP BY x, y, t)"""
QUERIES = {f.__name__: f for f in (profile_groups, profile_entities, profile_relations, profile_relation_links, profile_relation_ids, profile_evidence)}
ORACLES = {
    "profile_relations": _REL + " SELECT * FROM m",
    "profile_relation_links": _REL + """, x AS (SELECT source_entity_id AS entity_id, id AS relation_id FROM m UNION SELECT target_entity_id, id FROM m) SELECT entity_id, relation_id, row_number() OVER (PARTITION BY entity_id ORDER BY relation_id) AS pos FROM x""",
    "profile_relation_ids": _REL + """, x AS (SELECT source_entity_id AS e, id FROM m UNION SELECT target_entity_id, id FROM m), y AS (SELECT e, id, row_number() OVER (PARTITION BY e ORDER BY id) AS r FROM x)
        SELECT e AS entity_id, count(*) AS n_relations, string_agg(id, '|' ORDER BY id) FILTER (r <= 3) AS first_ids FROM y GROUP BY 1""",
    "profile_evidence": """WITH x AS (SELECT row_id AS id, unnest(chunk_ids) AS chunk_id, generate_subscripts(chunk_ids, 1) AS pos FROM extracted_entities), y AS (SELECT x.*, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM x WHERE chunk_id IN (SELECT id FROM light_chunks))
        SELECT id, n, chunk_id FROM y WHERE n <= 3""",
}
