"""Building a corpus graph: entities, claims, mentions, co-mentions and links, as equi-joins on tokens and keys."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrove.functions.stopwords import STOPWORDS
from lexigrove.functions.text import CAPITALISED, CAPITALISED_LINKED, acceptable_entity, acronyms, canonical_key, normalize_entity, occurrences, phrases, slugify, wikilinks
from lexigrove.operators.chunking import SECTIONS_SQL, sections
from lexigrove.operators.graph import dedupe_undirected
from lexigrove.shared import materialize, table

# Titles of the sections that hold claims.
CLAIM_SECTIONS = ["key points", "key findings", "findings", "claims", "summary", "main contributions", "contributions", "methods", "results"]
MAX_MENTIONS, MIN_NAME = 5, 4


#: Nodes of one text whose pairs a task makes at once.
BLOCK = 200


def candidate_phrases(text: Column, pattern: str = CAPITALISED_LINKED) -> Column:
    """Capitalised phrases and acronyms of a text, normalised; with repeats."""
    both = F.concat(phrases(text, pattern), acronyms(text))
    return F.filter(F.transform(both, normalize_entity), acceptable_entity)


def page_entities(pages: DataFrame) -> DataFrame:
    """page_id, name, occurrences, aliases of pages (page_id, title, text): the page's own title and each phrase met twice or linked to.

    A title with a colon also goes by the part before it. Pages without a title or text give what the other yields.
    """
    found = pages.select("page_id", "title", F.explode(candidate_phrases(F.col("text"))).alias("name"), F.lit(0).alias("linked"))
    linked = pages.select("page_id", "title", F.explode(F.filter(F.transform(wikilinks(F.col("text")), lambda x: x["target"]), acceptable_entity)).alias("name"), F.lit(1).alias("linked"))
    counted = found.unionByName(linked).groupBy("page_id", "title", "name").agg(F.count(F.lit(1)).alias("occurrences"), F.max("linked").alias("linked"))
    extra = counted.where(((F.col("occurrences") >= 2) | (F.col("linked") == 1)) & ~F.lower("name").eqNullSafe(F.lower("title"))).select("page_id", "name", "occurrences", F.expr("cast(array() as array<string>)").alias("aliases"))
    prefix = F.trim(F.substring_index("title", ":", 1))
    own = pages.where(F.col("title").isNotNull()).select("page_id", F.col("title").alias("name"), F.filter(F.array(F.when(F.col("title").contains(":"), prefix)), lambda a: a.isNotNull() & acceptable_entity(a)).alias("aliases"))
    own = own.join(counted.select("page_id", "name", "occurrences"), ["page_id", "name"], "left").select("page_id", "name", F.greatest(F.lit(1), F.coalesce("occurrences", F.lit(1))).alias("occurrences"), "aliases")
    return own.unionByName(extra)


def entity_catalog(found: DataFrame) -> DataFrame:
    """Entities of all pages by lower-case name: first page, total occurrences, distinct aliases other than the name, and their node id."""
    merged = found.groupBy(F.lower("name").alias("key")).agg(
        F.min_by("name", F.struct("page_id", "name")).alias("name"), F.min("page_id").alias("first_page"), F.sum("occurrences").alias("occurrences"), F.count_distinct("page_id").alias("n_pages"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("aliases")))).alias("aliases"))  # each list once
    return merged.withColumn("aliases", F.filter("aliases", lambda a: F.lower(a) != F.col("key"))).withColumn("node", F.concat(F.lit("entity::"), slugify(F.col("name"))))


def merge_slugs(catalog: DataFrame) -> DataFrame:
    """One row for each node id: the first name, the other names and aliases together."""
    return catalog.groupBy("node").agg(F.min_by("name", F.struct("first_page", "name")).alias("title"), F.sum("occurrences").alias("occurrences"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat("aliases", F.array("name")))))).alias("aliases"))


def claims(pages: DataFrame) -> DataFrame:
    """page_id, section, ordinal, text of claims: bullets, else paragraphs, of 12 to 400 characters with a letter, in the claim sections."""
    s = pages.select("page_id", F.posexplode(sections(F.col("text"), F.col("title"))).alias("at", "s")).where(F.lower(F.trim(F.col("s.title"))).isin(CLAIM_SECTIONS))
    para = s.select("page_id", "at", F.col("s.title").alias("section"), F.posexplode(F.split("s.body", r"\n[ \t]*\n")).alias("p", "para"))
    bullets = F.filter(F.split("para", "\n"), lambda x: x.rlike(r"^\s*[-*+]\s+\S"))
    line = para.select("page_id", "at", "section", "p", F.posexplode(F.when(F.size(bullets) > 0, F.transform(bullets, lambda x: F.regexp_replace(x, r"^\s*[-*+]\s+", ""))).otherwise(F.array("para"))).alias("l", "text"))
    clean = line.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))).where(F.length("text").between(12, 400) & F.col("text").rlike(r"\p{L}"))
    return clean.select("page_id", "section", (F.row_number().over(Window.partitionBy("page_id").orderBy("at", "p", "l")) - 1).alias("ordinal"), "text")


def claim_chunks(claimed: DataFrame, chunks: DataFrame) -> DataFrame:
    """Claims with the last chunk of their section on their page (page_id, section, chunk_index), null where there is none."""
    last = chunks.groupBy("page_id", F.lower("section").alias("key")).agg(F.max("chunk_index").alias("chunk_index"))
    return claimed.withColumn("key", F.lower("section")).join(last, ["page_id", "key"], "left").drop("key")


def mentions(texts: DataFrame, names: DataFrame, most: int = MAX_MENTIONS, least: int = MIN_NAME) -> DataFrame:
    """text_id, node, n: names (node, name) of `least` or more characters that stand in texts (text_id, text), without letter case; n counts at most `most`.

    A name meets only those texts that hold its rarest word as a word: an equi-join on that word, then the containment itself.
    Names without a letter or digit match nothing; a name that stands only inside longer words is found by mentions_anywhere.
    """
    n = names.select("node", F.lower("name").alias("name")).where(F.length("name") >= least).distinct()
    words = texts.select("text_id", F.explode(F.array_distinct(F.split(canonical_key(F.col("text")), " "))).alias("word")).where("word <> ''")
    parts = n.select("node", "name", F.explode(F.array_distinct(F.split(canonical_key(F.col("name")), " "))).alias("word")).where("word <> ''")
    frequency = words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    anchor = parts.join(frequency, "word").groupBy("node", "name").agg(F.min_by("word", F.struct("df", "word")).alias("word"))
    near = words.join(anchor, "word").select("text_id", "node", "name").distinct()
    hit = near.join(texts.select("text_id", F.lower("text").alias("text")), "text_id").select("text_id", "node", occurrences(F.col("text"), F.col("name")).alias("n"))
    return hit.where("n > 0").groupBy("text_id", "node").agg(F.least(F.lit(most), F.max("n")).alias("n"))


def mentions_anywhere(texts: DataFrame, names: DataFrame, most: int = MAX_MENTIONS, least: int = MIN_NAME, block_chars: int = 4_000_000) -> DataFrame:
    """text_id, node, n as mentions() gives them, of names standing anywhere in a text, inside longer words too.

    Each text is read once by an automaton of the names of a block of at most block_chars characters, for each block.
    """
    held = names.select("node", F.lower("name").alias("name")).where(F.length("name") >= least).distinct()
    total = held.agg(F.sum(F.length("name"))).first()[0] or 0
    passes, out = max(1, -(-total // block_chars)), None
    kinds = dict(texts.dtypes)["text_id"], dict(names.dtypes)["node"]
    low = texts.select(F.col("text_id").cast("string").alias("text_id"), F.lower("text").alias("text")).where(F.length("text") > 0)
    for p in range(passes):
        some = held if passes == 1 else held.where(F.pmod(F.xxhash64("name"), F.lit(passes)) == p)
        by_name: dict[str, list] = {}
        for r in some.collect():
            by_name.setdefault(r.name, []).append(r.node)
        part = low.mapInPandas(_finder(by_name, most), f"text_id string, node {kinds[1]}, n int").withColumn("text_id", F.col("text_id").cast(kinds[0]))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("text_id", "node").agg(F.max("n").alias("n"))


def _finder(by_name: dict[str, list], most: int):
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for w in by_name:
                automaton.add_word(w, w)
            automaton.make_automaton()
        except ImportError:
            automaton = None
        for frame in frames:
            rows = []
            for key, text in zip(frame["text_id"], frame["text"], strict=True):
                n: dict[str, int] = {}
                if automaton is None:
                    n = {w: k for w in by_name if (k := text.count(w))}
                elif by_name:
                    last: dict[str, int] = {}
                    for end, w in automaton.iter(text):
                        if end - len(w) >= last.get(w, -1):
                            last[w] = end
                            n[w] = n.get(w, 0) + 1
                rows += [(key, node, min(most, k)) for w, k in n.items() for node in by_name[w]]
            yield pd.DataFrame(rows, columns=["text_id", "node", "n"])

    return scan


def co_mentions(mentioned: DataFrame, weight: float = 0.5, widest: int | None = None) -> DataFrame:
    """Edges between nodes mentioned in one text (text_id, node): weight for each text.

    All pairs of a text's distinct nodes, from its own sorted list; a list of more than BLOCK nodes is cut, and its pairs are
    made cell by cell over many tasks. Only with `widest`, texts with more nodes than that give a star from their least node
    instead, which keeps them connected without squaring their number.
    """
    lists = mentioned.groupBy("text_id").agg(F.array_sort(F.collect_set("node")).alias("ns"))
    few = F.flatten(F.transform("ns", lambda a, i: F.transform(F.slice("ns", i + 2, F.size("ns")), lambda b: F.struct(a.alias("source"), b.alias("target")))))
    star = F.transform(F.slice("ns", 2, 1 << 30), lambda b: F.struct(F.get("ns", F.lit(0)).alias("source"), b.alias("target")))
    if widest is None:
        lists = materialize(lists.where("size(ns) > 1"), "lists")
        pairs = lists.where(F.size("ns") <= BLOCK).select(F.explode(few).alias("p")).select("p.*").unionByName(_wide_pairs(lists.where(F.size("ns") > BLOCK)))
    else:
        pairs = lists.where("size(ns) > 1").select(F.explode(F.when(F.size("ns") <= widest, few).otherwise(star)).alias("p")).select("p.*")
    return pairs.groupBy("source", "target").agg((F.count(F.lit(1)) * weight).alias("weight"))


def _wide_pairs(lists: DataFrame) -> DataFrame:
    """source < target of long sorted lists (text_id, ns): each cell has the pairs of two stretches of BLOCK nodes."""
    k = F.ceil(F.size("ns") / BLOCK).cast("int")
    cut = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.slice("ns", i * BLOCK + 1, F.lit(BLOCK)))
    cells = lists.select("text_id", k.alias("k"), F.posexplode(cut).alias("p", "xs")).select("text_id", "p", "xs", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("q"))
    cells = cells.select("text_id", "p", "xs", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"))
    side = lambda c: F.first(F.when(F.col("p") == F.col(c), F.col("xs")), ignorenulls=True)
    both = cells.groupBy("text_id", "i", "j").agg(side("i").alias("xs"), side("j").alias("ys"))
    return both.select(F.explode("xs").alias("source"), "ys").select("source", F.explode("ys").alias("target")).where("source < target")


def link_edges(pages: DataFrame) -> DataFrame:
    """Edges page to page of [[links]] that name a title or else an alias, without letter case; the last page of a title and the first of an alias win, own links fall out, repeats stay."""
    links = pages.select(F.col("page_id").alias("source"), F.explode(wikilinks(F.col("text"))).alias("x")).select("source", F.lower("x.target").alias("key"))
    by_title = pages.groupBy(F.lower("title").alias("key")).agg(F.max("page_id").alias("by_title"))
    by_alias = pages.select("page_id", F.explode("aliases").alias("a")).groupBy(F.lower("a").alias("key")).agg(F.min("page_id").alias("by_alias"))
    return links.join(by_title, "key", "left").join(by_alias, "key", "left").select("source", F.coalesce("by_title", "by_alias").alias("target")).where("target is not null and source <> target")


def fallback_entities(chunks: DataFrame, most: int = 8) -> DataFrame:
    """chunk_id, ord, name: the most frequent phrases and acronyms of each chunk, ties by first place; acronyms count in both."""
    found = chunks.select("chunk_id", F.posexplode(F.concat(F.transform(phrases(F.col("text"), CAPITALISED), normalize_entity), acronyms(F.col("text")))).alias("pos", "name")).where(F.length("name") >= 2)
    n = found.groupBy("chunk_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    return n.withColumn("ord", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.col("n").desc(), "pos"))).where(F.col("ord") <= most).select("chunk_id", "ord", "name", "n")


def fallback_relations(found: DataFrame, most: int = 12) -> DataFrame:
    """chunk_id, ord, source, target: the first pairs of a chunk's entities, in order of the first and then the second."""
    lists = found.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("ns"))
    pairs = F.flatten(F.transform("ns", lambda a, i: F.transform(F.slice("ns", i + 2, F.size("ns")), lambda b: F.struct(a.alias("source"), b.alias("target")))))
    return lists.select("chunk_id", F.posexplode(F.slice(pairs, 1, most)).alias("ord", "p")).select("chunk_id", (F.col("ord") + 1).alias("ord"), "p.source", "p.target")


def guarded_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations (chunk_id, source, target) both of whose ends are among the chunk's entities (chunk_id, name), without letter case."""
    known = entities.select("chunk_id", F.lower("name").alias("k")).distinct()
    for end in ("source", "target"):
        relations = relations.withColumn("k", F.lower(end)).join(known, ["chunk_id", "k"], "left_semi").drop("k")
    return relations


# --- queries -------------------------------------------------------------------------------------------------------------


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("page_id"), "title", "text", F.array("page_type").alias("aliases"))


def build_page_entities(spark: SparkSession, folder: str) -> DataFrame:
    return page_entities(_pages(spark, folder)).select("page_id", "name", "occurrences", F.array_join("aliases", "|").alias("aliases"))


def build_catalog(spark: SparkSession, folder: str) -> DataFrame:
    return entity_catalog(page_entities(_pages(spark, folder))).select("key", "first_page", "occurrences", "n_pages")


def build_entity_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return merge_slugs(entity_catalog(page_entities(_pages(spark, folder)))).select("node", "title", "occurrences", F.size("aliases").alias("n_aliases"))


def build_claims(spark: SparkSession, folder: str) -> DataFrame:
    return claims(_pages(spark, folder))


def build_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """First words of source titles in text units."""
    names = table(spark, folder, "sources").select(F.concat(F.lit("entity::"), F.lower(F.substring_index("title", ":", 1))).alias("node"), F.substring_index("title", ":", 1).alias("name")).distinct()
    units = table(spark, folder, "text_units").select(F.concat_ws("#", "source_id", "unit_index").alias("text_id"), "text").distinct()
    return mentions(units, names)


def build_mentions_anywhere(spark: SparkSession, folder: str) -> DataFrame:
    """Titles' last words in text units, also inside longer words."""
    names = table(spark, folder, "sources").select(F.concat(F.lit("entity::"), F.lower(F.element_at(F.split("title", " "), -1))).alias("node"), F.element_at(F.split("title", " "), -1).alias("name")).distinct()
    units = table(spark, folder, "text_units").select(F.concat_ws("#", "source_id", "unit_index").alias("text_id"), "text").distinct()
    return mentions_anywhere(units, names)


def build_co_mentions(spark: SparkSession, folder: str) -> DataFrame:
    return co_mentions(build_mentions_anywhere(spark, folder))


def build_links(spark: SparkSession, folder: str) -> DataFrame:
    return link_edges(_pages(spark, folder)).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def build_unit_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Source documents and their text units; units without a source fall out."""
    units = table(spark, folder, "text_units").select("source_id", "unit_index").distinct()
    return units.join(table(spark, folder, "sources").select("source_id").distinct(), "source_id").select(F.concat(F.lit("source::"), "source_id").alias("source"), F.concat_ws("#", F.lit("textunit::"), "source_id", "unit_index").alias("target"), F.lit(0.15).alias("weight"))


def build_derived_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Pages and the sources that they are derived from."""
    return table(spark, folder, "documents").join(table(spark, folder, "sources").select("source_id").distinct(), "source_id").select(F.col("doc_id").alias("page_id"), "source_id")


def build_merged_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Entities by name and their chunks' sources, in either direction, merged."""
    e = table(spark, folder, "extracted_entities").select("row_id", F.lower("type").alias("t"), F.lower("name").alias("n"), F.explode("source_ids").alias("s"))
    flip = F.col("row_id") % 2 == 0
    edges = e.select(F.when(flip, F.col("n")).otherwise(F.col("s")).alias("source"), F.when(flip, F.col("s")).otherwise(F.col("n")).alias("target"), F.col("t").alias("kind"), F.lit(0.5).alias("weight"), F.array("t").alias("evidence"), F.col("row_id").alias("ord"))
    return dedupe_undirected(edges).select("source", "target", "kind", "weight", F.array_join("evidence", "|").alias("evidence"))


def _chunk_texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "light_chunks").groupBy(F.col("id").alias("chunk_id")).agg(F.max("text").alias("text"))


def extract_entities(spark: SparkSession, folder: str) -> DataFrame:
    return fallback_entities(_chunk_texts(spark, folder))


def extract_relations(spark: SparkSession, folder: str) -> DataFrame:
    found = fallback_entities(_chunk_texts(spark, folder))
    return guarded_relations(fallback_relations(found), found)


STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS)
_PHRASE = r"'\b([A-Z][A-Za-z0-9][A-Za-z0-9\-]*(?:\s+[A-Z][A-Za-z0-9][A-Za-z0-9\-]*){0,3})\b'"
_ASCII = "regexp_replace(text, '[À-ÖØ-öø-ÿŒœ]', '_', 'g')"
_EXTRACT = rf"""c AS (SELECT id AS chunk_id, {_ASCII.replace("text", "max(text)")} AS t FROM light_chunks GROUP BY 1),
 f AS (SELECT chunk_id, list_concat(list_transform(regexp_extract_all(t, {_PHRASE}, 1), lambda x: regexp_replace(trim(regexp_replace(x, '\s+', ' ', 'g')), '^[ .,:;]+|[ .,:;]+$', '', 'g')), regexp_extract_all(t, '\b([A-Z]{{2,6}})\b', 1)) AS l FROM c),
 u AS (SELECT chunk_id, unnest(l) AS name, generate_subscripts(l, 1) AS pos FROM f), n AS (SELECT chunk_id, name, count(*) AS n, min(pos) AS pos FROM u WHERE len(name) >= 2 GROUP BY 1, 2),
 e AS (SELECT chunk_id, name, n, row_number() OVER (PARTITION BY chunk_id ORDER BY n DESC, pos) AS ord FROM n QUALIFY ord <= 8)"""
_MENTION = r"""nm AS (SELECT DISTINCT 'entity::' || lower(split_part(title, ':', 1)) AS node, lower(split_part(title, ':', 1)) AS name FROM sources), un AS (SELECT DISTINCT source_id || '#' || unit_index AS text_id, lower(text) AS t FROM text_units),
 m AS (SELECT text_id, node, least(5, max((len(t) - len(replace(t, name, ''))) // len(name))) AS n FROM un JOIN nm ON contains(t, name) WHERE len(name) >= 4 GROUP BY 1, 2)"""
_ANYWHERE = """nm AS (SELECT DISTINCT 'entity::' || lower(split_part(title, ' ', -1)) AS node, lower(split_part(title, ' ', -1)) AS name FROM sources), un AS (SELECT DISTINCT source_id || '#' || unit_index AS text_id, lower(text) AS t FROM text_units),
 m AS (SELECT text_id, node, least(5, max((len(t) - len(replace(t, name, ''))) // len(name))) AS n FROM un JOIN nm ON contains(t, name) WHERE len(name) >= 4 GROUP BY 1, 2)"""
QUERIES = {f.__name__: f for f in (build_page_entities, build_catalog, build_entity_nodes, build_claims, build_mentions, build_mentions_anywhere, build_co_mentions, build_links, build_unit_edges, build_derived_edges, build_merged_edges, extract_entities, extract_relations)}
_ACCEPT = f"len(n) BETWEEN 2 AND 80 AND regexp_matches(n, '[A-Za-z]') AND lower(n) NOT IN ({STOP_SQL})"
_CATALOG = rf"""x AS (SELECT doc_id AS page_id, title, {_ASCII} AS t, text FROM documents),
 c AS (SELECT page_id, title, unnest(list_concat(list_transform(list_concat(regexp_extract_all(t, '\b([A-Z][A-Za-z0-9][A-Za-z0-9\-]*(?:\s+(?:of|for|and|in|on|the|a)?\s*[A-Z][A-Za-z0-9][A-Za-z0-9\-]*){{0,3}})\b', 1), regexp_extract_all(t, '\b([A-Z]{{2,6}})\b', 1)),
   lambda y: {{'n': regexp_replace(trim(regexp_replace(y, '[\s\p{{Z}}]+', ' ', 'g')), '^[ .,:;]+|[ .,:;]+$', '', 'g'), 'l': 0}}), list_transform(regexp_extract_all(text, '\[\[([^\[\]]+)\]\]', 1), lambda y: {{'n': trim(string_split(y, '|')[1]), 'l': 1}}))) AS v FROM x),
 k AS (SELECT page_id, title, v.n AS name, count(*) AS occurrences, max(v.l) AS linked FROM (SELECT *, v.n AS n FROM c) WHERE {_ACCEPT} GROUP BY 1, 2, 3),
 pe AS (SELECT page_id, name, occurrences, '' AS aliases FROM k WHERE (occurrences >= 2 OR linked = 1) AND lower(name) IS DISTINCT FROM lower(title)
   UNION ALL SELECT d.doc_id, d.title, greatest(1, coalesce(k.occurrences, 1)), CASE WHEN contains(d.title, ':') AND {_ACCEPT.replace("(n", "(trim(split_part(d.title, ':', 1))")} THEN trim(split_part(d.title, ':', 1)) ELSE '' END FROM documents d LEFT JOIN k ON k.page_id = d.doc_id AND k.name = d.title WHERE d.title IS NOT NULL)"""
ORACLES = {
    "build_page_entities": f"WITH {_CATALOG} SELECT * FROM pe",
    "build_claims": f"""WITH {SECTIONS_SQL}, c AS (SELECT * FROM s WHERE lower(trim(section)) IN ({", ".join(f"'{x}'" for x in CLAIM_SECTIONS)})), a AS (SELECT doc_id, pos, section, regexp_split_to_array(body, '\\n[ \\t]*\\n') AS ps FROM c), b AS (SELECT doc_id, pos, section, unnest(ps) AS para, generate_subscripts(ps, 1) AS p FROM a),
        d AS (SELECT doc_id, pos, section, p, CASE WHEN len(bs) > 0 THEN list_transform(bs, lambda x: regexp_replace(x, '^\\s*[-*+]\\s+', '')) ELSE [para] END AS ls FROM (SELECT *, list_filter(string_split(para, chr(10)), lambda x: regexp_matches(x, '^\\s*[-*+]\\s+\\S')) AS bs FROM b)),
        e AS (SELECT doc_id, pos, section, p, trim(regexp_replace(unnest(ls), '\\s+', ' ', 'g')) AS text, generate_subscripts(ls, 1) AS l FROM d)
        SELECT doc_id AS page_id, section, row_number() OVER (PARTITION BY doc_id ORDER BY pos, p, l) - 1 AS ordinal, text FROM e WHERE len(text) BETWEEN 12 AND 400 AND regexp_matches(text, '\\p{{L}}')""",
    "build_catalog": f"WITH {_CATALOG} SELECT lower(name) AS key, min(page_id) AS first_page, CAST(sum(occurrences) AS BIGINT) AS occurrences, count(DISTINCT page_id) AS n_pages FROM pe GROUP BY 1",
    "build_entity_nodes": f"""WITH {_CATALOG}, g AS (SELECT lower(name) AS key, arg_min(name, (page_id, name)) AS name, min(page_id) AS first_page, sum(occurrences) AS occurrences, list_distinct(list_filter(list(aliases), lambda a: a <> '' AND lower(a) <> lower(any_value(name)))) AS aliases FROM pe GROUP BY 1),
        n AS (SELECT 'entity::' || coalesce(nullif(regexp_replace(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'untitled') AS node, * FROM g)
        SELECT node, arg_min(name, (first_page, name)) AS title, CAST(sum(occurrences) AS BIGINT) AS occurrences, len(list_distinct(flatten(list(list_append(aliases, name))))) AS n_aliases FROM n GROUP BY 1""",
    "build_mentions": f"WITH {_MENTION} SELECT * FROM m",
    "build_mentions_anywhere": f"WITH {_ANYWHERE} SELECT * FROM m",
    "build_co_mentions": f"WITH {_ANYWHERE} SELECT a.node AS source, b.node AS target, count(*) * 0.5::DOUBLE AS weight FROM m a JOIN m b ON a.text_id = b.text_id AND a.node < b.node GROUP BY 1, 2",
    "build_links": r"""WITH l AS (SELECT doc_id AS source, lower(trim(string_split(x, '|')[1])) AS key FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\[\[([^\[\]]+)\]\]', 1)) AS x FROM documents)),
        t AS (SELECT lower(title) AS key, max(doc_id) AS by_title FROM documents GROUP BY 1), a AS (SELECT lower(page_type) AS key, min(doc_id) AS by_alias FROM documents GROUP BY 1)
        SELECT source, coalesce(by_title, by_alias) AS target, count(*) AS n FROM l LEFT JOIN t USING (key) LEFT JOIN a USING (key) WHERE coalesce(by_title, by_alias) <> source GROUP BY 1, 2""",
    "build_unit_edges": "SELECT DISTINCT 'source::' || source_id AS source, 'textunit::#' || source_id || '#' || unit_index AS target, 0.15::DOUBLE AS weight FROM text_units SEMI JOIN sources USING (source_id)",
    "build_derived_edges": "SELECT doc_id AS page_id, source_id FROM documents SEMI JOIN sources USING (source_id)",
    "build_merged_edges": """WITH e AS (SELECT row_id, lower(type) AS t, lower(name) AS n, unnest(source_ids) AS s FROM extracted_entities)
        SELECT arg_min(CASE WHEN row_id % 2 = 0 THEN n ELSE s END, row_id) AS source, arg_min(CASE WHEN row_id % 2 = 0 THEN s ELSE n END, row_id) AS target, t AS kind, count(*) * 0.5::DOUBLE AS weight, t AS evidence FROM e GROUP BY least(n, s), greatest(n, s), t""",
    "extract_entities": f"WITH {_EXTRACT} SELECT chunk_id, ord, name, n FROM e",
    "extract_relations": f"""WITH {_EXTRACT}, p AS (SELECT a.chunk_id, a.name AS source, b.name AS target, row_number() OVER (PARTITION BY a.chunk_id ORDER BY a.ord, b.ord) AS ord FROM e a JOIN e b ON a.chunk_id = b.chunk_id AND a.ord < b.ord)
        SELECT chunk_id, ord, source, target FROM p WHERE ord <= 12""",
}
