"""Rules over pages and indexes as one table of issues; related pages and terms by shared terms."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrove.functions.fuzzy import ratio_of
from lexigrove.functions.stemming import revised_of
from lexigrove.functions.text import FIELD_SQL, HEADINGS_SQL, TOKENS_SQL, frontmatter, frontmatter_field, headings, markdown_links, slugify, tokens, variant_pair, wikilinks
from lexigrove.operators.graph import components
from lexigrove.shared import materialize, table

ISSUE = ("severity", "code", "path", "message")


def issues(rows: DataFrame, severity: str, code: str, message: Column | str, path: str = "page_id") -> DataFrame:
    return rows.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col(path).cast("string").alias("path"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def page_rules(pages: DataFrame) -> DataFrame:
    """Issues of single pages (page_id, title, text): front matter, headings and summaries.

    Null texts count as empty. Each rule gives at most one row a page but for headings, which give one for each heading at fault.
    """
    t = F.coalesce("text", F.lit(""))
    p = pages.withColumn("fm", frontmatter(t)).withColumn("hs", headings(t))
    each = p.select("page_id", F.posexplode("hs").alias("pos", "h")).select("page_id", "pos", "h.level", "h.title")
    before = F.lag("level").over(Window.partitionBy("page_id").orderBy("pos"))
    twice = each.groupBy("page_id", F.lower("title").alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return reduce(DataFrame.unionByName, [
        issues(p.where("fm is null"), "error", "missing-frontmatter", "Pages must begin with front matter."),
        issues(p.where("fm is not null").where(frontmatter_field(t, "title").isNull()), "error", "missing-field", "Missing required frontmatter field: title"),
        issues(p.where("fm is not null").where(frontmatter_field(t, "type").isNull()), "error", "missing-field", "Missing required frontmatter field: type"),
        issues(p.where("fm is not null").where(frontmatter_field(t, "summary").isNull()), "warning", "empty-summary", "Summary field is empty."),
        issues(p.where(F.trim(t) == ""), "warning", "empty-page", "The page has no text."),
        issues(p.where("size(filter(hs, h -> h.level = 1)) > 1"), "warning", "multiple-h1", "The page has several level-one headings."),
        issues(each.withColumn("was", before).where("level > was + 1"), "warning", "heading-level-skip", F.concat(F.lit("Heading skips a level: "), "title")),
        issues(twice, "warning", "duplicate-heading", F.concat(F.lit("Heading occurs several times: "), "k")),
    ])


def corpus_rules(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Issues among pages (page_id, title, text, source_id) and sources (source_id, normalized_path): titles, links, sources."""
    key = slugify(F.col("title"))
    known = pages.select(key.alias("key")).distinct()
    links = pages.select("page_id", F.explode(wikilinks(F.col("text"))).alias("x")).select("page_id", slugify(F.substring_index("x.target", "#", 1)).alias("key"), "x.target").distinct()
    linked = links.select("key").distinct()
    same = pages.groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("page_id")).where("n > 1")
    have = sources.select("source_id").distinct()
    used = pages.select("source_id").where("source_id is not null").distinct()
    return reduce(DataFrame.unionByName, [
        issues(links.join(known, "key", "left_anti"), "error", "broken-link", F.concat(F.lit("Link target does not exist: "), "target")),
        issues(pages.withColumn("key", key).join(linked, "key", "left_anti"), "suggestion", "orphan-page", "No page links here."),
        issues(same, "warning", "duplicate-title", F.concat(F.lit("Title is used by "), "n", F.lit(" pages."))),
        issues(pages.where("source_id is not null").join(have, "source_id", "left_anti"), "error", "unknown-source", F.concat(F.lit("Source is not in the manifest: "), "source_id")),
        issues(sources.select("source_id").distinct().join(used, "source_id", "left_anti"), "warning", "unused-source", "No page is made of this source.", "source_id"),
        issues(sources.where("normalized_path is null or trim(normalized_path) = ''").select("source_id").distinct(), "warning", "missing-normalized", "The source has no normalized file.", "source_id"),
    ])


# Types of front matter fields, and the order of severities.
FIELD_TYPES = {
    "title": "string", "summary": "string", "source_id": "string", "raw_path": "string", "source_hash": "string", "origin": "string", "normalized_path": "string",
    "compiled_at": "date", "ingested_at": "date", "tags": "list", "type": "string", "question": "string", "saved_at": "date", "citations": "list",
    "insufficient_evidence": "bool", "claim_count": "int", "citation_count": "int", "claims": "list", "provider_citations": "list", "generated_at": "date",
    "generator": "string", "source_pages": "list", "topic_terms": "list", "key_points": "list", "open_questions": "list", "title_suggestion": "string", "agent": "string", "run_id": "string",
}
SEVERITIES = ["suggestion", "warning", "error"]
# Patterns of values as YAML reads them, in this order; they serve Spark and SQL.
VALUE_KINDS = [
    ("string", r"""^("[^"]*"|'[^']*')$"""), ("list", r"^\[.*\]$"), ("dict", r"^\{.*\}$"), ("null", r"^(|~|null|Null|NULL)$"), ("bool", r"^(?i:true|false|yes|no|on|off)$"), ("int", r"^[-+]?[0-9][0-9_]*$"),
    ("float", r"^[-+]?([0-9]*\.[0-9]+|[0-9]+\.)([eE][-+]?[0-9]+)?$"), ("date", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([Tt ].*)?$"),
]
_NO_LINE = r"^([ \t].*|#.*|- .*|-|[A-Za-z_][\w-]*:([ \t].*)?|)$"
_OPEN = r"^[^:]+:[ \t]*(\[[^\]]*|\{[^}]*|\"[^\"]*|'[^']*)$"


def fields(pages: DataFrame) -> DataFrame:
    """page_id, pos, name, value, kind of the top-level fields of front matter (page_id, text), as YAML would read them."""
    lines = pages.select("page_id", F.split(frontmatter(F.col("text")), "\n").alias("lines")).where("lines is not null")
    each = lines.select("page_id", F.posexplode("lines").alias("pos", "line"), "lines").withColumn("after", F.coalesce(F.get("lines", F.col("pos") + 1), F.lit(""))).where(F.col("line").rlike(r"^[A-Za-z_][\w-]*:"))
    value = F.regexp_replace(F.trim(F.regexp_extract("line", r"^[^:]+:(.*)$", 1)), r"\s+#.*$", "")
    x = each.select("page_id", "pos", F.regexp_extract("line", r"^([^:]+):", 1).alias("name"), value.alias("value"), "after")
    kind = F.when((F.col("value") == "") & F.col("after").rlike(r"^\s*- "), "list").when((F.col("value") == "") & F.col("after").rlike(r"^\s+\S+:"), "dict")
    for name, pattern in VALUE_KINDS:
        kind = kind.when(F.col("value").rlike(pattern), name)
    return x.select("page_id", "pos", "name", "value", kind.otherwise("string").alias("kind"))


def field_rules(pages: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Issues of front matter (page_id, text): lines that no field has, fields of another type than theirs, dates that aren't ISO dates."""
    types = FIELD_TYPES if types is None else types
    wanted = pages.sparkSession.createDataFrame(list(types.items()), "name string, wanted string")  # one row a field
    x = fields(pages).join(F.broadcast(wanted), "name")
    lines = pages.select("page_id", F.split(frontmatter(F.col("text")), "\n").alias("lines")).where("lines is not null")
    bad = lines.where(F.exists("lines", lambda v: ~v.rlike(_NO_LINE) | v.rlike(_OPEN)))
    return reduce(DataFrame.unionByName, [
        issues(bad, "error", "invalid-frontmatter-yaml", "The front matter can't be read."),
        issues(x.where((F.col("wanted") != "date") & (F.col("wanted") != F.col("kind"))), "warning", "invalid-field-type", F.concat(F.lit("Field "), "name", F.lit(" should be of type "), "wanted", F.lit(", not "), "kind")),
        issues(x.where((F.col("wanted") == "date") & ~F.col("value").rlike(r"""^["']?[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{2}:[0-9]{2}(:[0-9]{2})?)?""")), "warning", "invalid-date-format", F.concat(F.lit("Field "), "name", F.lit(" isn't an ISO date: "), "value")),
    ])


def link_rules(pages: DataFrame) -> DataFrame:
    """Issues of fragments and markdown links of pages (page_id, path, title, text).

    A fragment must be the slug of a heading of its page; relative targets must be the path of a page, resolved against the
    linking page's folder; links with a scheme are left alone.
    """
    anchors = pages.select(F.col("page_id").alias("to"), F.explode(headings(F.col("text"))).alias("h")).select("to", slugify(F.col("h.title")).alias("anchor")).distinct()
    wiki = pages.select("page_id", F.explode(wikilinks(F.col("text"))).alias("x")).select("page_id", F.trim(F.substring_index("x.target", "#", 1)).alias("target"), F.trim(F.substring(F.col("x.target"), F.instr("x.target", "#") + 1, F.length("x.target"))).alias("fragment"), F.col("x.target").contains("#").alias("has")).where("has and fragment <> ''")
    by_slug = pages.groupBy(slugify(F.col("title")).alias("key")).agg(F.min("page_id").alias("to"))
    wiki = wiki.withColumn("key", slugify(F.col("target"))).join(by_slug, "key").select("page_id", "to", "fragment", F.concat(F.lit("[["), "target", F.lit("#"), "fragment", F.lit("]]")).alias("shown"))
    pattern = r"(?<!!)(?<!\[)\[([^\]]*)\]\(([^)]*)\)"
    links = pages.select("page_id", "path", F.explode(F.arrays_zip(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(1)).alias("label"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(2)).alias("target"))).alias("x")).select("page_id", "path", "x.label", F.trim("x.target").alias("raw")).distinct()
    shown = F.concat(F.lit("["), "label", F.lit("]("), "raw", F.lit(")"))
    clean = F.regexp_replace("raw", r"^<(.*)>$", "$1")
    clean = F.when(clean.startswith("#"), clean).otherwise(F.substring_index(clean, " ", 1))
    links = links.withColumn("shown", shown).withColumn("clean", clean).withColumn("destination", F.substring_index("clean", "#", 1)).withColumn("fragment", F.when(F.col("clean").contains("#"), F.regexp_replace("clean", "^[^#]*#", "")).otherwise(""))
    inner = links.where((F.col("raw") != "") & ~F.col("destination").rlike("^(?i:[a-z][a-z0-9+.-]*):"))
    folder = F.regexp_replace("path", "[^/]*$", "")
    steps = F.split(F.when(F.col("destination").startswith("/"), F.col("destination")).otherwise(F.concat(folder, "destination")), "/")
    there = F.array_join(F.aggregate(F.filter(steps, lambda v: (v != "") & (v != ".")), F.expr("cast(array() as array<string>)"), lambda acc, v: F.when(v == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(v)))), "/")
    known = pages.select(F.regexp_replace("path", "^/+", "").alias("there"), F.col("page_id").alias("to"))
    away = inner.where("destination <> ''").withColumn("there", there).join(known, "there", "left")
    here = inner.where("destination = ''").withColumn("to", F.col("page_id"))
    sought = wiki.unionByName(away.where("to is not null and fragment <> ''").select("page_id", "to", "fragment", "shown")).unionByName(here.where("fragment <> ''").select("page_id", "to", "fragment", "shown"))
    lost = sought.withColumn("anchor", slugify(F.col("fragment"))).join(anchors, ["to", "anchor"], "left_anti")
    return reduce(DataFrame.unionByName, [
        issues(lost, "error", "broken-fragment", F.concat(F.lit("No heading for the fragment: "), "shown")),
        issues(links.where("raw = ''"), "error", "empty-markdown-link", F.concat(F.lit("The link has no target: "), "shown")),
        issues(away.where("to is null"), "error", "broken-markdown-link", F.concat(F.lit("Link target not found: "), "shown")),
    ])


def source_rules(sources: DataFrame, pages: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Issues of sources (source_id, slug, raw_path, content_hash, compiled_from_hash) against pages (key, the slug of a compiled page)
    and, where given, files (path) that exist."""
    same = F.col("compiled_from_hash").eqNullSafe(F.col("content_hash"))
    out = [
        issues(sources.where(~same), "warning", "stale-source-page", "The page was compiled from other content.", "source_id"),
        issues(sources.where(same & F.col("content_hash").isNotNull()).join(pages.select(F.col("key").alias("slug")).distinct(), "slug", "left_anti"), "error", "missing-compiled-page", "The source was compiled, but has no page.", "source_id"),
    ]
    if files is not None:
        out.append(issues(sources.join(files.select(F.col("path").alias("raw_path")).distinct(), "raw_path", "left_anti"), "error", "missing-raw-source", F.concat(F.lit("No such file: "), F.coalesce("raw_path", F.lit(""))), "source_id"))
    return reduce(DataFrame.unionByName, out)


def analysis_rules(pages: DataFrame) -> DataFrame:
    """Pages (page_id, text) whose front matter says that they are analyses, without citations and not marked as lacking evidence."""
    of = fields(pages)
    got = of.groupBy("page_id").agg(*[F.max_by(c, F.when(F.col("name") == n, F.col("pos"))).alias(out) for n, c, out in (("type", "value", "type"), ("insufficient_evidence", "value", "insufficient"), ("citation_count", "value", "count"), ("citations", "value", "citations"), ("citations", "kind", "how"))])
    listed = F.when((F.col("how") == "list") & (F.col("citations") == ""), 1).when(F.col("how") == "list", F.when(F.trim(F.regexp_replace("citations", r"^\[|\]$", "")) == "", 0).otherwise(1)).otherwise(0)
    count = F.coalesce(F.when(F.col("count").rlike(r"^[-+]?[0-9]+$"), F.col("count").try_cast("bigint")), listed)
    bare = F.regexp_replace("type", "^[\"']|[\"']$", "") == "analysis"
    lacking = F.coalesce(F.lower("insufficient").isin("true", "yes", "on"), F.lit(False))
    return issues(got.where(bare & ~lacking & (count == 0)), "warning", "analysis-without-citations", "The analysis has no citations and isn't marked as lacking evidence.")


def index_rules(entities: DataFrame, relations: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """Integrity of an index: entities (id, chunk_ids) and relations (id, source_entity_id, target_entity_id, chunk_ids) without chunks or ends, and reasons (reason) why it is stale."""
    blank = F.coalesce(F.size("chunk_ids"), F.lit(0)) <= 0
    out = [issues(entities.where(blank), "warning", "entity-no-source-chunks", "The entity has no source chunks.", "id"), issues(relations.where(blank), "warning", "relation-no-source-chunks", "The relation has no source chunks.", "id"), relation_rules(relations, entities)]
    if reasons is not None:
        out.append(issues(reasons.withColumn("id", F.lit("index")), "warning", "index-stale", F.concat(F.lit("The index is stale: "), "reason"), "id"))
    return reduce(DataFrame.unionByName, out)


def gate(found: DataFrame, fail_on: str) -> DataFrame:
    """One row: the number of issues of this severity or a worse one, and whether there are any."""
    worse = SEVERITIES[SEVERITIES.index(fail_on) :]
    return found.agg(F.count_if(F.col("severity").isin(worse)).alias("n")).select("n", (F.col("n") > 0).alias("fails"))


def manifest_rules(sources: DataFrame) -> DataFrame:
    """Keys that should be unique and aren't, and required fields that are blank."""
    parts = []
    for c in ("source_id", "slug", "content_hash"):
        n = sources.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        parts.append(issues(n, "error", f"duplicate-{c.replace('_', '-')}", F.concat(F.lit("Used by "), "n", F.lit(" rows.")), c))
    for c in ("title", "origin", "raw_path"):
        parts.append(issues(sources.where(F.col(c).isNull() | (F.trim(c) == "")), "error", f"blank-{c.replace('_', '-')}", "A required field is blank.", "source_id"))
    return reduce(DataFrame.unionByName, parts)


def relation_rules(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations (id, source_entity_id, target_entity_id) with an end that is no entity (id)."""
    known = entities.select("id").distinct()
    return reduce(DataFrame.unionByName, [
        issues(relations.join(known.withColumnRenamed("id", c), c, "left_anti"), "error", "dangling-relation", F.concat(F.lit("No such entity: "), c), "id") for c in ("source_entity_id", "target_entity_id")])


def inbound(pages: DataFrame) -> DataFrame:
    """key, n_links, n_pages: how often each target is linked to, and from how many pages."""
    x = pages.select("page_id", F.explode(wikilinks(F.col("text"))).alias("x")).select("page_id", slugify(F.col("x.target")).alias("key"))
    return x.groupBy("key").agg(F.count(F.lit(1)).alias("n_links"), F.count_distinct("page_id").alias("n_pages"))


def jaccard_pairs(sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, jaccard) of ids whose sets of terms (id, terms) are at least so alike, and the class of each id.

    Ids with equal sets form a class, which takes part once, by its least id. Prefix filtering: terms are ordered from rare to
    frequent, and two sets that alike share a term among the first size - ceil(threshold size) + 1 of theirs; so the join is on
    rare terms, and each pair found is compared in full. Empty and null sets are like none.
    """
    held = sets.select("id", F.array_sort(F.array_distinct(F.filter("terms", lambda t: t.isNotNull()))).alias("terms")).where("size(terms) > 0")
    classes = materialize(held.groupBy("terms").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n")), "classes")
    members = held.join(classes.select("terms", "class_id", "n"), "terms").select("id", "class_id", "n")
    df = classes.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    ordered = classes.select("class_id", F.size("terms").alias("size"), F.explode("terms").alias("t")).join(df, "t").withColumn("r", F.row_number().over(Window.partitionBy("class_id").orderBy("df", "t")))
    prefix = materialize(ordered.where(F.col("r") <= F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9) + 1).select("class_id", "size", "t"), "prefixes")
    other = prefix.select(F.col("class_id").alias("b"), F.col("size").alias("size_b"), "t")
    near = prefix.withColumnRenamed("class_id", "a").join(other, "t").where("a < b").where((F.col("size") >= threshold * F.col("size_b") - 1e-9) & (F.col("size_b") >= threshold * F.col("size") - 1e-9)).select("a", "b").distinct()
    full = lambda c, n: classes.select(F.col("class_id").alias(c), F.col("terms").alias(n))
    common = F.size(F.array_intersect("x", "y"))
    exact = near.join(full("a", "x"), "a").join(full("b", "y"), "b").withColumn("jaccard", common / (F.size("x") + F.size("y") - common))
    return exact.where(F.col("jaccard") >= threshold - 1e-9).select("a", "b", F.round("jaccard", 6).alias("jaccard")), members


def concept_groups(sets: DataFrame, shared: int = 2, threshold: float = 0.18) -> DataFrame:
    """node, component of ids linked by two shared terms, or by one where the Jaccard similarity of their sets reaches the threshold.

    Two shared terms are one shared pair of terms, so ids are linked through the pairs that they hold; and with one shared term
    the condition bounds the sum of the sizes, so that each id is linked with the smallest set of a term. Either way a term that
    a third of all hold gives as many links as it has holders. shared is 2 for pairs of terms.
    """
    if shared != 2:
        raise ValueError("links go through pairs of terms")
    held = sets.select("id", F.array_sort(F.array_distinct(F.filter("terms", lambda t: t.isNotNull()))).alias("terms"))
    pairs = F.flatten(F.transform("terms", lambda x, i: F.transform(F.slice("terms", i + 2, F.size("terms")), lambda y: F.concat_ws("\x1f", x, y))))
    by_pair = held.select(F.concat(F.lit("i\x1f"), F.col("id").cast("string")).alias("source"), F.explode(pairs).alias("p")).select("source", F.concat(F.lit("p\x1f"), "p").alias("target"))
    most = int((1 + 1e-9) / threshold) + 1  # 1 / (a + b - 1) reaches the threshold up to this a + b
    each = held.select("id", F.size("terms").alias("size"), F.explode("terms").alias("t"))
    least = each.groupBy("t").agg(F.min(F.struct("size", "id")).alias("m"))
    by_one = each.join(least, "t").where((F.col("size") + F.col("m.size") <= most) & (F.col("id") != F.col("m.id"))).select(F.concat(F.lit("i\x1f"), F.col("id").cast("string")).alias("source"), F.concat(F.lit("i\x1f"), F.col("m.id").cast("string")).alias("target"))
    nodes = held.select(F.concat(F.lit("i\x1f"), F.col("id").cast("string")).alias("node"))
    found = components(by_pair.unionByName(by_one), nodes)
    return found.where(F.col("node").startswith("i\x1f")).select(F.substring_index("node", "\x1f", -1).alias("node"), F.col("component").alias("component"))


def term_pages(pages: DataFrame, most: int = 500, least: int = 6) -> DataFrame:
    """The `most` terms of at least `least` characters that stand on most pages, with their number of pages."""
    x = pages.select("page_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).where(F.length("term") >= least)
    return x.groupBy("term").agg(F.count(F.lit(1)).alias("n_pages")).orderBy(F.col("n_pages").desc(), "term").limit(most)


def term_variants(terms: DataFrame, alike: float = 92.0) -> DataFrame:
    """Pairs of terms (term, n_pages), a few hundred, that may be spellings of one: blocked by their first four letters or first part."""
    t = terms.select("term", "n_pages", revised_of(F.col("term")).alias("stem"), F.explode(F.array_distinct(F.array(F.substring(F.regexp_replace("term", "-", ""), 1, 4), F.concat(F.lit("="), F.split("term", "-")[0])))).alias("block"))
    o = t.select(F.col("term").alias("other"), F.col("stem").alias("other_stem"), "block")
    pairs = t.join(o, "block").where((F.col("term") < F.col("other")) & (F.col("stem") != F.col("other_stem"))).select("term", "other").distinct()
    return pairs.where(variant_pair(F.col("term"), F.col("other"))).withColumn("ratio", F.round(ratio_of("term", "other"), 4)).where((F.col("ratio") >= alike) | (F.regexp_replace("term", "-", "") == F.regexp_replace("other", "-", "")))


def _grams(pages: DataFrame, size: int) -> DataFrame:
    """page_id and runs of tokens w0, w1 and so on, in the shared folder: they are counted several times."""
    ts = pages.select("page_id", tokens(F.col("text")).alias("ts")).where(F.size("ts") >= size)
    runs = F.transform(F.sequence(F.lit(0), F.size("ts") - size), lambda i: F.struct(*[F.get("ts", i + k).alias(f"w{k}") for k in range(size)]))
    return materialize(ts.select("page_id", F.explode(runs).alias("g")).select("page_id", "g.*"), "grams")


def collocations(pages: DataFrame, least: int = 2, size: int = 2) -> DataFrame:
    """phrase, n, n_pages, llr of runs of 2 or 3 different tokens met `least` times on as many pages: the log-likelihood ratio against
    independent tokens, from the counts of each part of the run."""
    if size not in (2, 3):
        raise ValueError("runs have 2 or 3 tokens")
    grams, names = _grams(pages, size), [f"w{k}" for k in range(size)]
    different = F.size(F.array_distinct(F.array(*names))) == size
    run = grams.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("n_pages")).where((F.col("n") >= least) & (F.col("n_pages") >= least) & different)
    total = F.lit(float(grams.count()))
    of: dict[tuple[int, ...], Column] = {tuple(range(size)): F.col("n"), (): total}
    for k in range(1, size):
        for some in itertools.combinations(range(size), k):
            name, on = "n_" + "".join(map(str, some)), [f"w{i}" for i in some]
            run = run.join(grams.groupBy(*on).agg(F.count(F.lit(1)).alias(name)), on)
            of[some] = F.col(name)
    llr = F.lit(0.0)
    for cell in itertools.product((True, False), repeat=size):
        inside = [i for i in range(size) if cell[i]]
        outside = [i for i in range(size) if not cell[i]]
        # Runs with exactly these of the tokens at their places, by inclusion and exclusion.
        seen = reduce(lambda a, b: a + b, [(-1) ** len(more) * of[tuple(sorted([*inside, *more]))] for k in range(len(outside) + 1) for more in itertools.combinations(outside, k)])
        expected = reduce(lambda a, b: a * b, [of[(i,)] if cell[i] else total - of[(i,)] for i in range(size)]) / reduce(lambda a, b: a * b, [total] * (size - 1))
        llr = llr + F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    return run.select(F.concat_ws(" ", *names).alias("phrase"), "n", "n_pages", F.round(2 * llr, 4).alias("llr"))


# --- queries -------------------------------------------------------------------------------------------------------------


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("page_id"), "title", "text", "source_id")


def lint_pages(spark: SparkSession, folder: str) -> DataFrame:
    return page_rules(_pages(spark, folder))


def lint_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_rules(_pages(spark, folder), table(spark, folder, "sources"))


def lint_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest_rules(table(spark, folder, "sources"))


def lint_relations(spark: SparkSession, folder: str) -> DataFrame:
    """Entity rows as relations between their source and chunk ids, against the tables of these."""
    e = table(spark, folder, "extracted_entities").select(F.col("row_id").cast("string").alias("id"), F.get("source_ids", F.lit(0)).alias("source_entity_id"), F.get("chunk_ids", F.lit(0)).alias("target_entity_id"))
    known = table(spark, folder, "sources").select(F.col("source_id").alias("id")).unionByName(table(spark, folder, "light_chunks").select("id"))
    return relation_rules(e.where("source_entity_id is not null and target_entity_id is not null"), known)


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).withColumn("path", F.concat(slugify(F.col("title")), F.lit(".md")))


def lint_fields(spark: SparkSession, folder: str) -> DataFrame:
    return field_rules(_pages(spark, folder))


def lint_links(spark: SparkSession, folder: str) -> DataFrame:
    return link_rules(_paths(spark, folder))


def lint_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest's current rows against the slugs of the pages' titles."""
    return source_rules(table(spark, folder, "sources").where("removed_at is null"), _pages(spark, folder).select(slugify(F.col("title")).alias("key")))


def lint_analysis(spark: SparkSession, folder: str) -> DataFrame:
    return analysis_rules(_pages(spark, folder))


def lint_index(spark: SparkSession, folder: str) -> DataFrame:
    """Entity rows as entities, and each with each of its chunks as a relation to it."""
    e = table(spark, folder, "extracted_entities")
    entities = e.select(F.col("row_id").cast("string").alias("id"), "chunk_ids")
    known = entities.unionByName(table(spark, folder, "light_chunks").select("id", F.array("id").alias("chunk_ids")))
    relations = e.select(F.col("row_id").cast("string").alias("source_entity_id"), F.explode(F.array_distinct("chunk_ids")).alias("target_entity_id"), "source_ids").select(F.concat_ws("|", "source_entity_id", "target_entity_id").alias("id"), "source_entity_id", "target_entity_id", F.col("source_ids").alias("chunk_ids"))
    return index_rules(known, relations)


def lint_gate(spark: SparkSession, folder: str) -> DataFrame:
    return gate(lint_pages(spark, folder).unionByName(lint_manifest(spark, folder)), "warning")


def lint_counts(spark: SparkSession, folder: str) -> DataFrame:
    every = lint_pages(spark, folder).unionByName(lint_corpus(spark, folder)).unionByName(lint_manifest(spark, folder))
    return every.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


def lint_inbound(spark: SparkSession, folder: str) -> DataFrame:
    return inbound(_pages(spark, folder))


def lint_plain_links(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select("page_id", F.explode(markdown_links(F.col("text"))).alias("target"))


def _term_sets(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select(F.col("page_id").alias("id"), F.array_distinct(tokens(F.col("title"))).alias("terms"))


def review_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of equal titles' terms that are alike by .55."""
    return jaccard_pairs(_term_sets(spark, folder), 0.55)[0]


def review_classes(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_pairs(_term_sets(spark, folder), 0.55)[1]


def concept_components(spark: SparkSession, folder: str) -> DataFrame:
    c = concept_groups(_term_sets(spark, folder))
    return c.select(F.col("node").cast("bigint").alias("page_id"), F.min(F.col("node").cast("bigint")).over(Window.partitionBy("component")).alias("component"))


def review_terms(spark: SparkSession, folder: str) -> DataFrame:
    return term_pages(_pages(spark, folder))


def review_variants(spark: SparkSession, folder: str) -> DataFrame:
    return term_variants(term_pages(_pages(spark, folder)))


def concept_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(_pages(spark, folder))


def concept_trigrams(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(_pages(spark, folder), size=3)


_SLUG = lambda c: f"coalesce(nullif(regexp_replace(regexp_replace(lower(strip_accents({c})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'untitled')"
_LK = rf"""l AS (SELECT page_id, trim(string_split(x, '|')[1]) AS target FROM (SELECT doc_id AS page_id, unnest(regexp_extract_all(text, '\[\[([^\[\]]+)\]\]', 1)) AS x FROM documents))"""
_TS = f"ts AS (SELECT doc_id AS id, list_sort(list_distinct({TOKENS_SQL.replace('text', 'title')})) AS terms FROM documents)"
QUERIES = {f.__name__: f for f in (lint_pages, lint_corpus, lint_manifest, lint_relations, lint_fields, lint_links, lint_sources, lint_analysis, lint_index, lint_gate, lint_counts, lint_inbound, lint_plain_links, review_overlaps, review_classes, concept_components, review_terms, review_variants, concept_collocations, concept_trigrams)}
_PAGE_RULES = rf"""WITH p AS (SELECT doc_id, text, nullif(regexp_extract(text, '(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)', 1), '') AS fm, {HEADINGS_SQL} AS hs FROM documents),
 h AS (SELECT doc_id, unnest(hs).level AS level, unnest(hs).title AS title, generate_subscripts(hs, 1) AS pos FROM p), b AS (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY pos) AS was FROM h),
 i AS (SELECT 'error' AS severity, 'missing-frontmatter' AS code, doc_id, 'Pages must begin with front matter.' AS message FROM p WHERE fm IS NULL
   UNION ALL SELECT 'error', 'missing-field', doc_id, 'Missing required frontmatter field: title' FROM p WHERE fm IS NOT NULL AND {FIELD_SQL("title")} IS NULL
   UNION ALL SELECT 'error', 'missing-field', doc_id, 'Missing required frontmatter field: type' FROM p WHERE fm IS NOT NULL AND {FIELD_SQL("type")} IS NULL
   UNION ALL SELECT 'warning', 'empty-summary', doc_id, 'Summary field is empty.' FROM p WHERE fm IS NOT NULL AND {FIELD_SQL("summary")} IS NULL
   UNION ALL SELECT 'warning', 'empty-page', doc_id, 'The page has no text.' FROM p WHERE trim(coalesce(text, '')) = ''
   UNION ALL SELECT 'warning', 'multiple-h1', doc_id, 'The page has several level-one headings.' FROM p WHERE len(list_filter(hs, lambda x: x.level = 1)) > 1
   UNION ALL SELECT 'warning', 'heading-level-skip', doc_id, 'Heading skips a level: ' || title FROM b WHERE level > was + 1
   UNION ALL SELECT 'warning', 'duplicate-heading', doc_id, 'Heading occurs several times: ' || lower(title) FROM h GROUP BY doc_id, lower(title) HAVING count(*) > 1)
 """
ORACLES = {
    "lint_pages": _PAGE_RULES + "SELECT severity, code, CAST(doc_id AS VARCHAR) AS path, message FROM i",
    "lint_corpus": f"""WITH {_LK}, k AS (SELECT DISTINCT {_SLUG("title")} AS key FROM documents), lk AS (SELECT DISTINCT page_id, {_SLUG("split_part(target, '#', 1)")} AS key, target FROM l)
        SELECT 'error' AS severity, 'broken-link' AS code, CAST(page_id AS VARCHAR) AS path, 'Link target does not exist: ' || target AS message FROM lk WHERE key NOT IN (SELECT key FROM k)
        UNION ALL SELECT 'suggestion', 'orphan-page', CAST(doc_id AS VARCHAR), 'No page links here.' FROM documents WHERE {_SLUG("title")} NOT IN (SELECT key FROM lk)
        UNION ALL SELECT 'warning', 'duplicate-title', CAST(min(doc_id) AS VARCHAR), 'Title is used by ' || count(*) || ' pages.' FROM documents GROUP BY title HAVING count(*) > 1
        UNION ALL SELECT 'error', 'unknown-source', CAST(doc_id AS VARCHAR), 'Source is not in the manifest: ' || source_id FROM documents WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT source_id FROM sources)
        UNION ALL SELECT DISTINCT 'warning', 'unused-source', source_id, 'No page is made of this source.' FROM sources WHERE source_id NOT IN (SELECT source_id FROM documents WHERE source_id IS NOT NULL)
        UNION ALL SELECT DISTINCT 'warning', 'missing-normalized', source_id, 'The source has no normalized file.' FROM sources WHERE normalized_path IS NULL OR trim(normalized_path) = ''""",
    "lint_manifest": " UNION ALL ".join(
        [f"SELECT 'error' AS severity, 'duplicate-{c.replace('_', '-')}' AS code, {c} AS path, 'Used by ' || count(*) || ' rows.' AS message FROM sources GROUP BY {c} HAVING count(*) > 1" for c in ("source_id", "slug", "content_hash")]
        + [f"SELECT 'error', 'blank-{c.replace('_', '-')}', source_id, 'A required field is blank.' FROM sources WHERE {c} IS NULL OR trim({c}) = ''" for c in ("title", "origin", "raw_path")]),
    "lint_relations": """WITH e AS (SELECT CAST(row_id AS VARCHAR) AS id, source_ids[1] AS s, chunk_ids[1] AS t FROM extracted_entities WHERE source_ids[1] IS NOT NULL AND chunk_ids[1] IS NOT NULL), k AS (SELECT source_id AS id FROM sources UNION SELECT id FROM light_chunks)
        SELECT 'error' AS severity, 'dangling-relation' AS code, id AS path, 'No such entity: ' || s AS message FROM e WHERE s NOT IN (SELECT id FROM k)
        UNION ALL SELECT 'error', 'dangling-relation', id, 'No such entity: ' || t FROM e WHERE t NOT IN (SELECT id FROM k)""",
    "lint_inbound": f"WITH {_LK} SELECT {_SLUG('target')} AS key, count(*) AS n_links, count(DISTINCT page_id) AS n_pages FROM l GROUP BY 1",
    "review_overlaps": f"""WITH {_TS}, c AS (SELECT min(id) AS id, terms FROM ts WHERE len(terms) > 0 GROUP BY terms)
        SELECT a, b, jaccard FROM (SELECT x.id AS a, y.id AS b, round(len(list_intersect(x.terms, y.terms)) / len(list_distinct(list_concat(x.terms, y.terms))), 6) AS jaccard FROM c x JOIN c y ON x.id < y.id) WHERE jaccard >= 0.55""",
    "review_classes": f"WITH {_TS} SELECT id, min(id) OVER (PARTITION BY terms) AS class_id, count(*) OVER (PARTITION BY terms) AS n FROM ts WHERE len(terms) > 0",
    "review_terms": f"SELECT term, count(*) AS n_pages FROM (SELECT unnest(list_distinct({TOKENS_SQL})) AS term FROM documents) WHERE len(term) >= 6 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 500",
    "concept_collocations": f"""WITH t AS (SELECT doc_id, {TOKENS_SQL} AS ts FROM documents), g AS (SELECT doc_id, x, y FROM (SELECT doc_id, unnest(ts[1:len(ts) - 1]) AS x, unnest(ts[2:len(ts)]) AS y FROM t WHERE len(ts) > 1)),
        p AS (SELECT x, y, count(*) AS n, count(DISTINCT doc_id) AS n_pages FROM g GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT doc_id) >= 2 AND x <> y), a AS (SELECT x, count(*) AS nx FROM g GROUP BY 1), b AS (SELECT y, count(*) AS ny FROM g GROUP BY 1), c AS (SELECT CAST(count(*) AS DOUBLE) AS t FROM g),
        q AS (SELECT x, y, n, n_pages, [n, nx - n, ny - n, t - nx - ny + n] AS o, [CAST(nx AS DOUBLE) * ny, nx * (t - ny), (t - nx) * ny, (t - nx) * (t - ny)] AS e, t FROM p JOIN a USING (x) JOIN b USING (y), c)
        SELECT x || ' ' || y AS phrase, n, n_pages, round(2 * list_sum(list_transform(list_zip(o, e), lambda z: CASE WHEN z[1] > 0 THEN z[1] * ln(z[1] * t / z[2]) ELSE 0 END)), 4) AS llr FROM q""",
}
_KIND_SQL = "CASE WHEN value = '' AND regexp_matches(after, '^\\s*- ') THEN 'list' WHEN value = '' AND regexp_matches(after, '^\\s+\\S+:') THEN 'dict' " + " ".join(f"WHEN regexp_matches(value, '{p.replace(chr(39), chr(39) * 2)}') THEN '{k}'" for k, p in VALUE_KINDS) + " ELSE 'string' END"
_FIELDS = rf"""WITH ls AS (SELECT doc_id, string_split(nullif(regexp_extract(text, '(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)', 1), ''), chr(10)) AS lines FROM documents), l AS (SELECT doc_id, lines, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM ls WHERE lines IS NOT NULL),
 v AS (SELECT doc_id, pos, regexp_extract(line, '^([^:]+):', 1) AS name, regexp_replace(trim(regexp_extract(line, '^[^:]+:(.*)$', 1)), '\s+#.*$', '') AS value, coalesce(lines[pos + 1], '') AS after FROM l WHERE regexp_matches(line, '^[A-Za-z_][\w-]*:')),
 f AS (SELECT doc_id, pos, name, value, {_KIND_SQL} AS kind FROM v), ty AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in FIELD_TYPES.items())}) AS t(name, wanted))
 """
_QUOTED = lambda p: p.replace("'", "''")
ORACLES["lint_fields"] = _FIELDS + rf"""SELECT DISTINCT 'error' AS severity, 'invalid-frontmatter-yaml' AS code, CAST(doc_id AS VARCHAR) AS path, 'The front matter can''t be read.' AS message FROM l WHERE NOT regexp_matches(line, '{_QUOTED(_NO_LINE)}') OR regexp_matches(line, '{_QUOTED(_OPEN)}')
        UNION ALL SELECT 'warning', 'invalid-field-type', CAST(doc_id AS VARCHAR), 'Field ' || name || ' should be of type ' || wanted || ', not ' || kind FROM f JOIN ty USING (name) WHERE wanted <> 'date' AND wanted <> kind
        UNION ALL SELECT 'warning', 'invalid-date-format', CAST(doc_id AS VARCHAR), 'Field ' || name || ' isn''t an ISO date: ' || value FROM f JOIN ty USING (name) WHERE wanted = 'date' AND NOT regexp_matches(value, '^["'']?[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(T[0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}})?)?')"""
ORACLES["lint_analysis"] = _FIELDS + r"""SELECT 'warning' AS severity, 'analysis-without-citations' AS code, CAST(doc_id AS VARCHAR) AS path, 'The analysis has no citations and isn''t marked as lacking evidence.' AS message
        FROM (SELECT doc_id, max(value) FILTER (name = 'type') AS ty, max(lower(value)) FILTER (name = 'insufficient_evidence') AS i, max(value) FILTER (name = 'citation_count') AS n, max(value) FILTER (name = 'citations' AND kind = 'list') AS c FROM f GROUP BY 1)
        WHERE trim(ty, '"' || chr(39)) = 'analysis' AND coalesce(i, '') NOT IN ('true', 'yes', 'on') AND coalesce(TRY_CAST(n AS BIGINT), CASE WHEN c IS NULL OR trim(c, '[] ') = '' AND c <> '' THEN 0 ELSE 1 END) = 0"""
ORACLES["lint_sources"] = f"""WITH s AS (SELECT * FROM sources WHERE removed_at IS NULL) SELECT 'warning' AS severity, 'stale-source-page' AS code, source_id AS path, 'The page was compiled from other content.' AS message FROM s WHERE compiled_from_hash IS DISTINCT FROM content_hash
        UNION ALL SELECT 'error', 'missing-compiled-page', source_id, 'The source was compiled, but has no page.' FROM s WHERE compiled_from_hash = content_hash AND slug NOT IN (SELECT {_SLUG("title")} FROM documents)"""
ORACLES["lint_index"] = """WITH r AS (SELECT CAST(row_id AS VARCHAR) AS s, unnest(list_distinct(chunk_ids)) AS t, source_ids FROM extracted_entities), k AS (SELECT id FROM light_chunks UNION SELECT CAST(row_id AS VARCHAR) FROM extracted_entities)
        SELECT 'warning' AS severity, 'entity-no-source-chunks' AS code, CAST(row_id AS VARCHAR) AS path, 'The entity has no source chunks.' AS message FROM extracted_entities WHERE coalesce(len(chunk_ids), 0) = 0
        UNION ALL SELECT 'warning', 'relation-no-source-chunks', s || '|' || t, 'The relation has no source chunks.' FROM r WHERE coalesce(len(source_ids), 0) = 0
        UNION ALL SELECT 'error', 'dangling-relation', s || '|' || t, 'No such entity: ' || t FROM r WHERE t NOT IN (SELECT id FROM k)"""
ORACLES["lint_gate"] = f"SELECT count(*) FILTER (severity IN ('warning', 'error')) AS n, count(*) FILTER (severity IN ('warning', 'error')) > 0 AS fails FROM (SELECT severity FROM ({ORACLES['lint_pages']}) UNION ALL SELECT severity FROM ({ORACLES['lint_manifest']}))"
ORACLES["concept_trigrams"] = f"""WITH t AS (SELECT doc_id, {TOKENS_SQL} AS ts FROM documents), g AS MATERIALIZED (SELECT doc_id, x, y, z FROM (SELECT doc_id, unnest(ts[1:len(ts) - 2]) AS x, unnest(ts[2:len(ts) - 1]) AS y, unnest(ts[3:len(ts)]) AS z FROM t WHERE len(ts) > 2)),
        p AS (SELECT x, y, z, count(*) AS n, count(DISTINCT doc_id) AS n_pages FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND count(DISTINCT doc_id) >= 2 AND x <> y AND x <> z AND y <> z),
        a AS (SELECT x, count(*) AS nx FROM g GROUP BY 1), b AS (SELECT y, count(*) AS ny FROM g GROUP BY 1), c AS (SELECT z, count(*) AS nz FROM g GROUP BY 1), ab AS (SELECT x, y, count(*) AS nxy FROM g GROUP BY 1, 2), ac AS (SELECT x, z, count(*) AS nxz FROM g GROUP BY 1, 2), bc AS (SELECT y, z, count(*) AS nyz FROM g GROUP BY 1, 2), m AS (SELECT CAST(count(*) AS DOUBLE) AS t FROM g),
        q AS (SELECT x, y, z, n, n_pages, t, [n, nxy - n, nxz - n, nyz - n, nx - nxy - nxz + n, ny - nxy - nyz + n, nz - nxz - nyz + n, t - nx - ny - nz + nxy + nxz + nyz - n] AS o,
          [nx * ny * CAST(nz AS DOUBLE), nx * ny * (t - nz), nx * (t - ny) * nz, (t - nx) * ny * nz, nx * (t - ny) * (t - nz), (t - nx) * ny * (t - nz), (t - nx) * (t - ny) * nz, (t - nx) * (t - ny) * (t - nz)] AS e FROM p JOIN a USING (x) JOIN b USING (y) JOIN c USING (z) JOIN ab USING (x, y) JOIN ac USING (x, z) JOIN bc USING (y, z), m)
        SELECT x || ' ' || y || ' ' || z AS phrase, n, n_pages, round(2 * list_sum(list_transform(list_zip(o, e), lambda v: CASE WHEN v[1] > 0 THEN v[1] * ln(v[1] * t * t / v[2]) ELSE 0 END)), 4) AS llr FROM q"""
ORACLES["lint_plain_links"] = r"SELECT doc_id AS page_id, unnest(regexp_extract_all(' ' || text, '[^!]\[[^\]\[]*\]\(([^)\s]+)[^)]*\)', 1)) AS target FROM documents"
ORACLES["lint_counts"] = "SELECT severity, code, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT severity, code FROM ({ORACLES[k]})" for k in ("lint_pages", "lint_corpus", "lint_manifest")) + ") GROUP BY 1, 2"
# Least labels of neighbours, with a jump to the label's own label, as often as these sets need.
ORACLES["concept_components"] = (
    f"WITH {_TS}, e AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM ts x JOIN ts y ON x.id <> y.id AND len(list_intersect(x.terms, y.terms)) > 0 AND (len(list_intersect(x.terms, y.terms)) >= 2 OR len(list_intersect(x.terms, y.terms)) / len(list_distinct(list_concat(x.terms, y.terms))) >= 0.18)), l0 AS (SELECT id, id AS l FROM ts)"
    + "".join(f", n{i} AS MATERIALIZED (SELECT id, least(any_value(p.l), coalesce(min(q.l), any_value(p.l))) AS l FROM l{i - 1} p LEFT JOIN (SELECT e.a AS id, x.l FROM e JOIN l{i - 1} x ON x.id = e.b) q USING (id) GROUP BY id), l{i} AS MATERIALIZED (SELECT n.id, j.l FROM n{i} n JOIN n{i} j ON j.id = n.l)" for i in range(1, 9))
    + " SELECT id AS page_id, l AS component FROM l8")
