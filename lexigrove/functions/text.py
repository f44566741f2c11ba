"""Scalar functions on text as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrove.functions.stopwords import STOPWORDS
from lexigrove.shared import table

# Patterns and word lists of the text functions.
TERM = "[a-z0-9]+"
CAPITALISED = r"\b([A-Z][A-Za-z0-9][A-Za-z0-9\-]*(?:\s+[A-Z][A-Za-z0-9][A-Za-z0-9\-]*){0,3})\b"
CAPITALISED_LINKED = r"\b([A-Z][A-Za-z0-9][A-Za-z0-9\-]*(?:\s+(?:of|for|and|in|on|the|a)?\s*[A-Z][A-Za-z0-9][A-Za-z0-9\-]*){0,3})\b"
ACRONYM = r"\b([A-Z]{2,6})\b"
CONNECTIVES = ["of", "the", "for", "in", "on", "a", "and", "with"]
ABBREVIATIONS = ["e.g", "i.e", "etc", "et al", "fig", "figs", "eq", "vs", "dr", "mr", "mrs", "ms", "prof", "no", "vol"]
INSUFFICIENT = ["insufficient evidence", "not enough evidence", "cannot determine", "can't determine", "not stated", "not available"]
CITATION = r"\s*[\[\(][`\s]*(?:wiki/[A-Za-z0-9._/-]+#chunk-\d+)(?:\s*,\s*(?:wiki/[A-Za-z0-9._/-]+#chunk-\d+))*[`\s]*[\]\)]"
NEGATING = ["non", "un", "in", "im", "ir", "il", "dis", "de", "anti", "mis"]


def terms(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, stopwords included, in order and with repeats."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TERM), F.lit(0))


def tokens(c: Column) -> Column:
    """terms() without stopwords."""
    return F.filter(terms(c), lambda x: ~x.isin(STOPWORDS))


def unicode_words(c: Column) -> Column:
    """Lower-case runs of word characters of any script."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))


def token_count(c: Column) -> Column:
    """Words and single other characters that aren't whitespace; the fallback where no tokenizer is at hand."""
    return F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0)))


def one_line(c: Column) -> Column:
    """Runs of whitespace as one space, none outside."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normal_lines(c: Column) -> Column:
    """Without blanks at line ends and outside."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"(?m)[ \t\f\x0B]+$", ""), r"(?U)^\s+|\s+$", "")


def slugify(c: Column) -> Column:
    """ASCII letters and digits joined by hyphens, accents dropped; untitled where nothing is left."""
    plain = F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿœæß", "aaaaaaceeeeiiiinooooouuuuyyoas")
    s = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", "untitled").otherwise(s)


def normalize_identifier(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def canonical_key(c: Column) -> Column:
    """Matching key: lower case, everything but letters, digits and spaces as spaces, collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, "ß", "ss")), r"(?U)[^\p{L}\p{N}]+", " "))


def is_acronym(c: Column) -> Column:
    return F.trim(c).rlike("^[A-Z]{2,6}$")


def initials(c: Column) -> Column:
    """First letters of the words, in upper case."""
    return F.upper(F.array_join(F.transform(F.filter(F.split(F.trim(c), r"[\s\-]+"), lambda w: w != ""), lambda w: F.substring(w, 1, 1)), ""))


def implicit_acronyms(c: Column) -> Column:
    """Up to three acronyms of a title: without connectives, with them, and with them in lower case; one word is its own."""
    ws = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))
    link = lambda w: F.lower(w).isin(CONNECTIVES)
    first = lambda w: F.substring(w, 1, 1)
    drop = F.upper(F.array_join(F.transform(F.filter(ws, lambda w: ~link(w)), first), ""))
    keep = F.upper(F.array_join(F.transform(ws, first), ""))
    mixed = F.array_join(F.transform(ws, lambda w: F.when(link(w), F.lower(first(w))).otherwise(F.upper(first(w)))), "")
    several = F.array_distinct(F.filter(F.array(drop, keep, mixed), lambda x: x != ""))
    return F.when(F.size(ws) == 1, F.transform(ws, F.upper)).otherwise(several)


def preferred_name(a: Column, b: Column) -> Column:
    """Of two names the one that is no acronym, of two such the longer, the first if equal."""
    return F.when(is_acronym(a) & ~is_acronym(b), b).when(~is_acronym(a) & is_acronym(b), a).when(F.length(b) > F.length(a), b).otherwise(a)


def normalize_entity(c: Column) -> Column:
    return F.regexp_replace(one_line(c), r"^[ .,:;]+|[ .,:;]+$", "")


def acceptable_entity(c: Column) -> Column:
    return F.length(c).between(2, 80) & c.rlike("[A-Za-z]") & ~F.lower(c).isin(STOPWORDS)


def phrases(c: Column, pattern: str = CAPITALISED) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(1))


def acronyms(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(ACRONYM), F.lit(1))


def wikilinks(c: Column) -> Column:
    """Structs (target, label) of [[target|label]]."""
    whole = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1))
    return F.transform(whole, lambda x: F.struct(F.trim(F.split(x, r"\|")[0]).alias("target"), F.trim(F.element_at(F.split(x, r"\|"), -1)).alias("label")))


def markdown_links(c: Column) -> Column:
    """Targets of [text](target) links."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?<!!)\[[^\]\[]*\]\(([^)\s]+)[^)]*\)"), F.lit(1))


def headings(c: Column) -> Column:
    """Structs (level, title) of ATX headings outside code fences."""
    plain = without_fences(c)
    lines = F.filter(F.split(plain, "\n"), lambda x: x.rlike(r"^#{1,6}[ \t]+\S"))
    return F.transform(lines, lambda x: F.struct(F.length(F.regexp_extract(x, "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(x, r"^#+[ \t]+|[ \t]#+[ \t]*$", "")).alias("title")))


def without_fences(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?ms)^[ \t]*```.*?(?:^[ \t]*```[ \t]*$|\z)", "")


def frontmatter(c: Column) -> Column:
    """The block between the first two --- lines, or null."""
    return F.nullif(F.regexp_extract(c, r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)", 1), F.lit(""))


def frontmatter_field(c: Column, field: str) -> Column:
    """A plain field of the front matter, without quotes, or null."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(frontmatter(c), rf"(?m)^{field}:[ \t]*(.*)$", 1), r"^[\"']|[\"']$", "")), F.lit(""))


def body(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\A---[ \t]*\n.*?\n---[ \t]*(?:\n|\z)", "")


def plain_text(c: Column) -> Column:
    """Markdown without fences, heading marks, list marks, table rules, emphasis and link targets, on one line."""
    t = without_fences(body(c))
    t = F.regexp_replace(t, r"(?m)^[ \t]*\|?[ \t:|-]*-{3,}[ \t:|-]*$", " ")
    t = F.regexp_replace(t, r"(?m)^[ \t]*(?:#{1,6}|[-*+>]|\d+[.)])[ \t]+", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\[\[([^|\]]+)\|([^\]]+)\]\]", "$2"), r"\[\[([^\]]+)\]\]", "$1")
    return one_line(F.regexp_replace(F.regexp_replace(t, r"!?\[([^\]]*)\]\([^)]*\)", "$1"), r"[`*|]", " "))


def paragraphs(c: Column) -> Column:
    """Blocks between blank lines that aren't headings, tables or fences."""
    blocks = F.transform(F.split(without_fences(body(c)), r"\n[ \t]*\n"), one_line)
    return F.filter(blocks, lambda x: (x != "") & ~x.rlike(r"^(#{1,6} |\||---)"))


def section_paragraphs(c: Column, title: str) -> Column:
    """Paragraphs under a level-two heading of this title."""
    return paragraphs(F.regexp_extract(without_fences(c), rf"(?ims)^##[ \t]+{title}[ \t]*\n(.*?)(?=^##?[ \t]|\z)", 1))


def clean_snippet(c: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(one_line(c), r"\[\[([^|\]]+)\|([^\]]+)\]\]", "$2"), r"\[\[([^\]]+)\]\]", "$1")
    return F.trim(F.regexp_replace(t, "`([^`]+)`", "$1"))


def snippet(text: Column, wanted: Column) -> Column:
    """Up to 80 characters before and 220 after the first place of any wanted term; the start where there is none."""
    places = F.filter(F.transform(wanted, lambda t: F.instr(F.lower(text), t) - 1), lambda p: p >= 0)
    at = F.coalesce(F.array_min(places), F.lit(0))
    start = F.greatest(F.lit(0), at - 80)
    return one_line(F.substring(text, start + 1, at + 220 - start))


def clean_citations(c: Column) -> Column:
    return F.regexp_replace(c, CITATION, "")


def data_references(c: Column) -> Column:
    """Distinct structs (kind, ids) of references such as [Data: Entities (1, 2); Reports (3, +more)]."""
    blocks = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?i)\[Data:([^\]]*)\]"), F.lit(1))
    parts = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"[A-Za-z ]+\([^)]*\)"), F.lit(0))))
    kind = lambda p: F.trim(F.regexp_replace(F.lower(F.regexp_extract(p, r"^([A-Za-z ]+)\(", 1)), "[^a-z0-9]+", " "))
    ids = lambda p: F.filter(F.transform(F.split(F.regexp_extract(p, r"\(([^)]*)\)", 1), "[,;]"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("+"))
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.struct(F.regexp_replace(kind(p), " ", "_").alias("kind"), ids(p).alias("ids"))), lambda r: F.size(r["ids"]) > 0))


def sentences(c: Column) -> Column:
    """Sentences of text on one line; full stops of abbreviations end none."""
    protected = one_line(c)
    for a in ABBREVIATIONS:
        protected = F.regexp_replace(protected, rf"(?i)\b({a.replace('.', '[.]')})[.]", "$1\x01")
    return F.transform(F.filter(F.split(protected, r"(?<=[.!?])\s+(?=[A-Z0-9\"'])"), lambda x: x != ""), lambda x: F.trim(F.regexp_replace(x, "\x01", ".")))


def truncate(c: Column, limit: int, ellipsis: bool = True) -> Column:
    """At most limit characters, cut after a sentence in the last 160 of them, else at the last space, else hard."""
    clean, dots = one_line(c), "..." if ellipsis and limit > 3 else ""
    room = limit - len(dots)
    window = F.substring(clean, 1, room)
    start = max(0, room - 160)
    head, tail = F.substring(clean, 1, start), F.substring(window, start + 1, room)
    sentence = F.regexp_extract(tail, r"(?s)^(.*[.!?][\"')\]]?(?:\s|$))", 1)
    word = F.regexp_extract(window, r"(?s)^(.*) ", 1)
    cut = F.when(sentence != "", F.concat(head, sentence)).when(F.length(word) > max(20, room // 3), word).otherwise(window)
    cut = F.regexp_replace(cut, r"\s+$", "")
    return F.when(F.length(clean) <= limit, clean).otherwise(F.concat(F.regexp_replace(cut, "[ ,;:]+$", ""), F.lit(dots)) if dots else cut)


def summary(c: Column) -> Column:
    """The first three sentences of the paragraphs, at most 700 characters."""
    return truncate(F.array_join(F.slice(sentences(F.array_join(paragraphs(c), " ")), 1, 3), " "), 700)


def title_of(text: Column, fallback: Column) -> Column:
    """The first plausible line among the first 60: one before any heading, else a heading, else a later line, else the fallback."""
    lines = F.transform(F.slice(F.split(body(text), "\n"), 1, 60), lambda x: F.trim(x))
    lines = F.filter(lines, lambda x: (x != "") & ~x.startswith("---"))
    clean = lambda x: F.trim(F.regexp_replace(x, r"^#+|[*_`]", ""))
    plausible = lambda x: (F.length(x) >= 3) & ~x.contains("@") & (F.size(F.split(x, r"\s+")) <= 20) & ~((F.size(F.split(x, r"\s+")) > 10) & x.endswith("."))
    first_heading = F.array_position(F.transform(lines, lambda x: x.startswith("#")), True)
    before = F.when(first_heading > 0, F.slice(lines, 1, F.greatest(first_heading.cast("int") - 1, F.lit(0)))).otherwise(lines)
    pick = lambda xs: F.get(F.filter(F.transform(xs, clean), plausible), F.lit(0))
    return F.coalesce(pick(before), pick(F.filter(lines, lambda x: x.startswith("#"))), pick(F.filter(lines, lambda x: ~x.startswith("#"))), fallback)


def citation_ref(path: Column, kind: Column, index: Column) -> Column:
    return F.when(index.isNull(), path).when(kind == "text_unit", F.concat(path, F.lit("#text-unit-"), index)).otherwise(F.concat(path, F.lit("#chunk-"), index))


def chunk_id(source_id: Column, index: Column, text: Column) -> Column:
    return F.concat(F.lit("chunk:"), source_id, F.lit(":"), index.cast("string"), F.lit(":"), F.substring(F.sha2(text, 256), 1, 12))


def text_unit_id(source_id: Column, index: Column) -> Column:
    return F.concat(F.lit("textunit::"), source_id, F.lit("#"), F.lpad(index.cast("string"), 4, "0"))


def join_capped(parts: Column, cap: int, separator: str = " ") -> Column:
    """Parts joined up to the cap; the first that would overflow ends it."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def add(acc: Column, x: Column) -> Column:
        joined = F.when(acc["text"] == "", x).otherwise(F.concat(acc["text"], F.lit(separator), x))
        over = acc["full"] | (F.length(joined) > cap)
        return F.struct(F.when(over, acc["text"]).otherwise(joined).alias("text"), over.alias("full"))

    return F.aggregate(F.filter(parts, lambda x: x.isNotNull() & (x != "")), start, add)["text"]


def first_text(*cs: Column) -> Column:
    """The first that isn't blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in cs])


def first_number(*cs: Column) -> Column:
    """The first that is a number and not NaN."""
    return F.coalesce(*[F.when(~F.isnan(c.try_cast("double")), c.try_cast("double")) for c in cs])


def number_text(c: Column) -> Column:
    """Whole numbers without a fraction."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def json_payload(c: Column) -> Column:
    """The JSON text of a reply: fenced, or from the first brace or bracket to the last."""
    fenced = F.nullif(F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    return F.coalesce(F.regexp_replace(fenced, r"^\s+|\s+$", ""), F.nullif(F.regexp_extract(c, r"(?s)(\{.*\}|\[.*\])", 1), F.lit("")))


def mentions_insufficient(c: Column) -> Column:
    return F.lower(c).rlike("|".join(INSUFFICIENT))


def parse_time(c: Column) -> Column:
    """An ISO time with Z, an offset or none (UTC)."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(c), "Z$", "+00:00"))


def iso_time(c: Column) -> Column:
    return F.date_format(F.date_trunc("second", c), "yyyy-MM-dd'T'HH:mm:ss+00:00")


def variant_pair(a: Column, b: Column) -> Column:
    """Whether two hyphenated terms may be spellings of one: equal without hyphens, or alike and neither more specific nor negated."""
    ca, cb = F.regexp_replace(a, "-", ""), F.regexp_replace(b, "-", "")
    pa, pb = F.array_distinct(F.filter(F.split(a, "-"), lambda x: x != "")), F.array_distinct(F.filter(F.split(b, "-"), lambda x: x != ""))
    common = F.size(F.array_intersect(pa, pb))
    specific = (common == F.least(F.size(pa), F.size(pb))) & (F.size(pa) != F.size(pb))
    negated = F.lit(False)
    for p in NEGATING:
        negated = negated | (ca == F.concat(F.lit(p), cb)) | (cb == F.concat(F.lit(p), ca))
    prefixed = (F.length(ca) == F.length(cb)) & (F.length(ca) >= 6) & (F.substring(ca, 2, 999) == F.substring(cb, 2, 999)) & (F.substring(ca, 1, 1) != F.substring(cb, 1, 1))
    near = (F.substring(ca, 1, 4) == F.substring(cb, 1, 4)) | (F.split(a, "-")[0] == F.split(b, "-")[0])
    return (ca == cb) | (~specific & ~negated & ~prefixed & near)


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a literal term; of one of one or two characters only as a word."""
    whole = F.regexp_count(text, F.concat(F.lit(r"\b\Q"), term, F.lit(r"\E\b")))
    return F.when(F.length(term) <= 2, whole).otherwise(((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int"))


def content_paragraph(p: Column) -> Column:
    """Whether a paragraph says something: 40 characters or more beside links, and no boilerplate."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(p, r"\[\[[^\]]*\]\]|\[[^\]]*\]\([^)]*\)", ""), r"[\s·|,;-]+", " "))
    return (F.length(bare) >= 40) & ~F.lower(p).rlike(r"^(copyright|all rights reserved|©|doi:|arxiv:|received|accepted|keywords?:|corresponding author)")


def weak_summary(c: Column) -> Column:
    """Empty, a placeholder, an echo of the prompt, or under five words."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return (t == "") | F.lower(t).isin("no summary available yet.", "summary", "n/a", "tbd", "todo") | F.lower(t).rlike(r"^(here is|here's|this is) (a|the) (short |brief )?summary") | (F.size(F.split(t, r"\s+")) < 5)


def clipped(texts: DataFrame, budget: int, per: str = "group", order: str = "pos") -> DataFrame:
    """Texts of each group in order up to a budget of characters; the last is cut to what is left."""
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy(per).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return texts.withColumn("__b", before).where(F.col("__b") < budget).withColumn("text", F.substring("text", F.lit(1), (F.lit(budget) - F.col("__b")).cast("int"))).drop("__b")


# --- queries -------------------------------------------------------------------------------------------------------------


def text_tokens(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return table(spark, folder, "documents").select("doc_id", F.size(terms(t)).alias("n_terms"), F.size(tokens(t)).alias("n_tokens"), F.size(F.array_distinct(tokens(t))).alias("n_distinct"), F.sha2(t, 256).alias("content_hash"))


def text_normal(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("title")
    return table(spark, folder, "documents").select(
        "doc_id", normalize_identifier(c).alias("identifier"), canonical_key(c).alias("canonical"), is_acronym(c).alias("acronym"), one_line(c).alias("one_line"), normalize_entity(c).alias("entity"))


def text_slugs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sources").select("source_id", F.unix_micros("ingested_at").alias("ingested_us"), slugify(F.col("title")).alias("slug"), initials(F.col("title")).alias("initials"))


def text_implicit_acronyms(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sources").select("source_id", F.unix_micros("ingested_at").alias("ingested_us"), F.array_join(implicit_acronyms(F.col("title")), "|").alias("forms"))


def text_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.size(phrases(F.col("text"))).alias("n_phrases"), F.size(acronyms(F.col("text"))).alias("n_acronyms"), F.array_join(F.slice(phrases(F.col("text")), 1, 3), "|").alias("first_phrases"))


def text_links(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", F.explode(wikilinks(F.col("text"))).alias("x"))
    return d.select("doc_id", "x.target", "x.label")


def text_markdown(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id", frontmatter_field(t, "title").alias("fm_title"), frontmatter_field(t, "type").alias("fm_type"), F.size(headings(t)).alias("n_headings"),
        F.get(headings(t), F.lit(0))["title"].alias("first_heading"))


def text_blocks(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return table(spark, folder, "documents").select("doc_id", F.size(paragraphs(t)).alias("n_paragraphs"), F.size(sentences(plain_text(t))).alias("n_sentences"), summary(t).alias("summary"), title_of(t, F.col("title")).alias("found_title"), F.size(section_paragraphs(t, "Summary")).alias("n_summary"))


def text_snippets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", snippet(F.col("text"), F.array(F.lit("graph"), F.lit("cache"))).alias("snippet"))


def text_answers(spark: SparkSession, folder: str) -> DataFrame:
    a = F.col("answer")
    return table(spark, folder, "rag_samples").select(
        "sample_id", clean_citations(a).alias("clean"), mentions_insufficient(a).alias("insufficient"), token_count(a).alias("n_tokens"), first_text(F.col("error"), F.col("provider_mode"), F.lit("none")).alias("note"))


def text_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "text_units").select(
        "source_id", "unit_index", text_unit_id(F.col("source_id"), F.col("unit_index")).alias("unit_id"), chunk_id(F.col("source_id"), F.col("unit_index"), F.col("text")).alias("chunk_id"),
        citation_ref(F.col("normalized_path"), F.lit("text_unit"), F.col("unit_index")).alias("ref"))


def text_quality(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return table(spark, folder, "documents").select("doc_id", F.size(F.filter(paragraphs(t), content_paragraph)).alias("n_content"), weak_summary(frontmatter_field(t, "title")).alias("weak"))


def text_clipped(spark: SparkSession, folder: str) -> DataFrame:
    """The text units of each source up to 5000 characters."""
    u = table(spark, folder, "text_units").groupBy("source_id", "unit_index").agg(F.max("text").alias("text"))
    return clipped(u, 5000, "source_id", "unit_index").select("source_id", "unit_index", F.length("text").alias("n_chars"))


def text_times(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sources").select("source_id", iso_time(F.col("ingested_at")).alias("iso"), (parse_time(iso_time(F.col("ingested_at"))) == F.date_trunc("second", "ingested_at")).alias("same"))


_STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS)
TOKENS_SQL = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: x NOT IN ({_STOP_SQL}))"

#: Structs (level, title) of the headings of `text`, and a field of the front matter `fm`, in SQL.
HEADINGS_SQL = r"""list_transform(list_filter(string_split(regexp_replace(coalesce(text, ''), '(?ms)^[ \t]*```.*?(?:^[ \t]*```[ \t]*$|\z)', '', 'g'), chr(10)), lambda x: regexp_matches(x, '^#{1,6}[ \t]+\S')),
    lambda x: {'level': len(regexp_extract(x, '^(#+)', 1)), 'title': trim(regexp_replace(x, '^#+[ \t]+|[ \t]#+[ \t]*$', '', 'g'))})"""
FIELD_SQL = lambda f: rf"""nullif(trim(regexp_replace(regexp_extract(fm, '(?m)^{f}:[ \t]*(.*)$', 1), '^["'']|["'']$', '', 'g')), '')"""

QUERIES = {f.__name__: f for f in (text_tokens, text_normal, text_slugs, text_implicit_acronyms, text_phrases, text_links, text_markdown, text_blocks, text_snippets, text_answers, text_ids, text_times, text_quality, text_clipped)}
ORACLES = {
    "text_quality": rf"""WITH b AS (SELECT doc_id, nullif(regexp_extract(text, '(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)', 1), '') AS fm, regexp_replace(regexp_replace(text, '(?s)\A---[ \t]*\n.*?\n---[ \t]*(?:\n|\z)', ''), '(?ms)^[ \t]*```.*?(?:^[ \t]*```[ \t]*$|\z)', '', 'g') AS b FROM documents),
        p AS (SELECT doc_id, fm, list_filter(list_transform(regexp_split_to_array(b, '\n[ \t]*\n'), lambda x: trim(regexp_replace(x, '[\s\p{{Z}}]+', ' ', 'g'))), lambda x: x <> '' AND NOT regexp_matches(x, '^(#{{1,6}} |\||---)')) AS ps FROM b),
        t AS (SELECT doc_id, ps, coalesce({FIELD_SQL("title")}, '') AS t FROM p)
        SELECT doc_id, len(list_filter(ps, lambda x: len(trim(regexp_replace(regexp_replace(x, '\[\[[^\]]*\]\]|\[[^\]]*\]\([^)]*\)', '', 'g'), '[\s·|,;-]+', ' ', 'g'))) >= 40 AND NOT regexp_matches(lower(x), '^(copyright|all rights reserved|©|doi:|arxiv:|received|accepted|keywords?:|corresponding author)'))) AS n_content,
          t = '' OR lower(t) IN ('no summary available yet.', 'summary', 'n/a', 'tbd', 'todo') OR regexp_matches(lower(t), '^(here is|here''s|this is) (a|the) (short |brief )?summary') OR len(regexp_split_to_array(t, '\s+')) < 5 AS weak FROM t""",
    "text_answers": r"""SELECT sample_id, regexp_replace(answer, '\s*[\[\(][`\s]*(?:wiki/[A-Za-z0-9._/-]+#chunk-\d+)(?:\s*,\s*(?:wiki/[A-Za-z0-9._/-]+#chunk-\d+))*[`\s]*[\]\)]', '', 'g') AS clean,
        regexp_matches(lower(answer), 'insufficient evidence|not enough evidence|cannot determine|can''t determine|not stated|not available') AS insufficient,
        len(regexp_extract_all(coalesce(answer, ''), '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s\p{Z}\x{85}]')) AS n_tokens, coalesce(nullif(trim(error), ''), nullif(trim(provider_mode), ''), 'none') AS note FROM rag_samples""",
    "text_snippets": r"""WITH x AS (SELECT doc_id, text, coalesce(list_min(list_filter([strpos(lower(text), 'graph') - 1, strpos(lower(text), 'cache') - 1], lambda p: p >= 0)), 0) AS k FROM documents)
        SELECT doc_id, trim(regexp_replace(text[greatest(0, k - 80) + 1:k + 220], '[\s\p{Z}\x{85}\x0b]+', ' ', 'g')) AS snippet FROM x""",
    "text_markdown": rf"""WITH x AS (SELECT doc_id, nullif(regexp_extract(text, '(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)', 1), '') AS fm, {HEADINGS_SQL} AS hs FROM documents)
        SELECT doc_id, {FIELD_SQL('title')} AS fm_title, {FIELD_SQL('type')} AS fm_type, len(hs) AS n_headings, hs[1].title AS first_heading FROM x""",
    "text_clipped": """WITH u AS (SELECT source_id, unit_index, max(text) AS t FROM text_units GROUP BY 1, 2), c AS (SELECT *, coalesce(sum(len(t)) OVER (PARTITION BY source_id ORDER BY unit_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM u)
        SELECT source_id, unit_index, CAST(least(len(t), 5000 - b) AS BIGINT) AS n_chars FROM c WHERE b < 5000""",
    "text_tokens": f"SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_terms, len({TOKENS_SQL}) AS n_tokens, len(list_distinct({TOKENS_SQL})) AS n_distinct, sha256(text) AS content_hash FROM documents",
    "text_normal": r"""SELECT doc_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS identifier,
        trim(regexp_replace(lower(replace(title, 'ß', 'ss')), '[^\p{L}\p{N}]+', ' ', 'g')) AS canonical, regexp_full_match(trim(title), '[A-Z]{2,6}') AS acronym,
        trim(regexp_replace(title, '[\s\p{Z}]+', ' ', 'g')) AS one_line, regexp_replace(trim(regexp_replace(title, '[\s\p{Z}]+', ' ', 'g')), '^[ .,:;]+|[ .,:;]+$', '', 'g') AS entity FROM documents""",
    "text_slugs": r"""SELECT source_id, epoch_us(ingested_at) AS ingested_us, regexp_replace(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
        upper(array_to_string(list_transform(list_filter(regexp_split_to_array(trim(title), '[\s\-]+'), lambda w: w <> ''), lambda w: w[1]), '')) AS initials FROM sources""",
    "text_implicit_acronyms": f"""WITH w AS (SELECT source_id, ingested_at, regexp_extract_all(title, '[A-Za-z0-9]+') AS ws FROM sources),
        f AS (SELECT *, upper(array_to_string(list_transform(list_filter(ws, lambda x: lower(x) NOT IN ({", ".join(f"'{c}'" for c in CONNECTIVES)})), lambda x: x[1]), '')) AS a,
          upper(array_to_string(list_transform(ws, lambda x: x[1]), '')) AS b,
          array_to_string(list_transform(ws, lambda x: CASE WHEN lower(x) IN ({", ".join(f"'{c}'" for c in CONNECTIVES)}) THEN lower(x[1]) ELSE upper(x[1]) END), '') AS c FROM w)
        SELECT source_id, epoch_us(ingested_at) AS ingested_us, CASE WHEN len(ws) = 1 THEN upper(ws[1]) ELSE concat_ws('|', nullif(a, ''), CASE WHEN b <> a THEN b END, CASE WHEN c <> a AND c <> b THEN c END) END AS forms FROM f""",
    "text_phrases": r"""SELECT doc_id, len(p) AS n_phrases, len(regexp_extract_all(regexp_replace(text, '[À-ÖØ-öø-ÿŒœ]', '_', 'g'), '\b([A-Z]{2,6})\b', 1)) AS n_acronyms, array_to_string(p[1:3], '|') AS first_phrases
        FROM (SELECT doc_id, text, regexp_extract_all(regexp_replace(text, '[À-ÖØ-öø-ÿŒœ]', '_', 'g'), '\b([A-Z][A-Za-z0-9][A-Za-z0-9\-]*(?:\s+[A-Z][A-Za-z0-9][A-Za-z0-9\-]*){0,3})\b', 1) AS p FROM documents)""",
    "text_links": r"""SELECT doc_id, trim(string_split(x, '|')[1]) AS target, trim(string_split(x, '|')[-1]) AS label
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\[\[([^\[\]]+)\]\]', 1)) AS x FROM documents)""",
    "text_ids": r"""SELECT source_id, unit_index, 'textunit::' || source_id || '#' || lpad(CAST(unit_index AS VARCHAR), 4, '0') AS unit_id,
        'chunk:' || source_id || ':' || unit_index || ':' || sha256(text)[1:12] AS chunk_id, normalized_path || '#text-unit-' || unit_index AS ref FROM text_units""",
    "text_times": "SELECT source_id, strftime(date_trunc('second', ingested_at) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S+00:00') AS iso, true AS same FROM sources",
}
