"""Composite retrieval over a corpus graph and over entity and relation profiles, for batches of questions; and its routers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrove.functions.fuzzy import token_set_of
from lexigrove.functions.stopwords import STOPWORDS
from lexigrove.functions.text import CAPITALISED, TOKENS_SQL, acronyms, canonical_key, implicit_acronyms, one_line, phrases, terms, tokens
from lexigrove.operators import lexical as lx
from lexigrove.operators.extraction import _MENTION, build_mentions
from lexigrove.operators.fusion import keep_first, rrf
from lexigrove.operators.graph import both_ways, community_records, k_hop, pagerank
from lexigrove.operators.vectors import cosine_top_k
from lexigrove.shared import materialize, number_rows, table

# Words that route a question, and words that a theme is asked with.
GLOBAL_WORDS = ["main theme", "main themes", "overall", "across", "patterns", "landscape", "whole corpus"]
DRIFT_WORDS = ["compare", "differ", "difference", "tradeoff", "trade-off", "relate", "related to", "relationship", "relationship between", " versus ", " vs ", "contrast"]
DIRECT_WORDS = ["where is", "where are", "configured", "configuration", "config", "stale", "freshness", "what should happen"]
GENERIC_TERMS = ["answer", "answers", "corpus", "data", "document", "documents", "generation", "model", "models", "query", "rag", "retrieval", "source", "sources"]
THEME_HINTS = "tradeoff tradeoffs theme themes compare comparison impact limitation limitations architecture overview main ideas across landscape differences difference relationship relationships versus approaches trends challenges advantages benefits".split()
EVIDENCE = ["chunk", "text_unit", "claim"]
PAGES = ["source_page", "concept_page", "analysis_page"]
SEEDS, FUZZY = 6, 82.0


def holds_any(question: Column, words: list[str]) -> Column:
    """Whether any of the words stands in the question, which has a blank at either end."""
    padded = F.concat(F.lit(" "), F.lower(question), F.lit(" "))
    out = F.lit(False)
    for w in words:
        out = out | padded.contains(w)
    return out


def term_in(term: Column, question: Column) -> Column:
    """A term of several words or with a hyphen as a substring, another as a word; without letter case."""
    t, q = F.lower(term), F.lower(question)
    return F.when(t.rlike(r"[\s\-]"), q.contains(t)).otherwise(F.regexp_like(q, F.concat(F.lit(r"\b\Q"), t, F.lit(r"\E\b"))))


def usable_term(term: Column) -> Column:
    return (F.length(term) >= 3) & ~F.lower(term).isin(GENERIC_TERMS)


def auto_method(question: Column, has_seeds: Column) -> Column:
    """The method for a question: comparisons, then themes, then known entities, else basic."""
    return F.when(holds_any(question, DRIFT_WORDS), "drift-lite").when(holds_any(question, GLOBAL_WORDS), "global").when(has_seeds, "local").otherwise("basic")


def route(questions: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """query_id, method, confidence, reason and matched terms of questions (query_id, question, explicit method or null).

    In turn: explicit, comparison, theme, direct look-up, alias in capitals, known graph term (term), else basic. Known terms meet
    questions by an equi-join on their first word.
    """
    q = questions if "explicit" in questions.columns else questions.withColumn("explicit", F.lit(None).cast("string"))
    hit = F.lit(None).cast("array<string>")
    if known is not None:
        t = known.where(usable_term(F.col("term"))).select("term", F.get(terms(F.col("term")), F.lit(0)).alias("first")).where("first is not null").distinct()
        words = q.select("query_id", "question", F.explode(F.array_distinct(terms(F.col("question")))).alias("first"))
        met = words.join(t, "first").where(term_in(F.col("term"), F.col("question"))).groupBy("query_id").agg(F.array_sort(F.collect_set(F.lower("term"))).alias("met"))
        q, hit = q.join(met, "query_id", "left"), F.col("met")
    c = F.col("question")
    matched = lambda words: F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.concat(F.lit(" "), F.lower(c), F.lit(" ")).contains(w))
    capitals = F.filter(acronyms(c), lambda a: F.length(a) >= 2)
    row = lambda m, conf, why, ts: F.struct(F.lit(m).alias("method") if isinstance(m, str) else m.alias("method"), F.lit(conf).alias("confidence"), F.lit(why).alias("reason"), ts.alias("matched"))
    none = F.expr("cast(array() as array<string>)")
    pick = (
        F.when(F.col("explicit").isNotNull(), row(F.col("explicit"), "explicit", "explicit method", none))
        .when(holds_any(c, DRIFT_WORDS), row("drift", "high", "comparison", matched(DRIFT_WORDS)))
        .when(holds_any(c, GLOBAL_WORDS), row("global", "high", "corpus theme", matched(GLOBAL_WORDS)))
        .when(holds_any(c, DIRECT_WORDS), row("basic", "medium", "direct look-up", matched(DIRECT_WORDS)))
        .when(F.size(capitals) > 0, row("local", "medium", "alias", F.array_distinct(capitals)))
        .when(F.size(F.coalesce(hit, none)) > 0, row("local", "medium", "known term", F.coalesce(hit, none)))
        .otherwise(row("basic", "low", "fallback", none))
    )
    return q.select("query_id", pick.alias("r")).select("query_id", "r.method", "r.confidence", "r.reason", F.array_join("r.matched", "|").alias("matched"))


def keywords(questions: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """query_id, low and high keywords: known aliases (alias), capitalised phrases and acronyms; and theme words, else salient tokens.

    Distinct without letter case, the first spelling kept. Aliases come in order of the alphabet.
    """
    c = F.col("question")
    q = questions.select("query_id", "question")
    found = F.concat(F.transform(phrases(c, CAPITALISED), one_line), acronyms(c))
    if aliases is not None:
        a = aliases.select("alias", F.get(terms(F.col("alias")), F.lit(0)).alias("first")).where("first is not null").distinct()
        met = q.select("query_id", "question", F.explode(F.array_distinct(terms(c))).alias("first")).join(a, "first").where(F.lower("question").contains(F.lower("alias"))).groupBy("query_id").agg(F.array_sort(F.collect_set("alias")).alias("known"))
        q = q.join(met, "query_id", "left")
        found = F.concat(F.coalesce("known", F.expr("cast(array() as array<string>)")), found)
    unique = lambda xs: F.filter(xs, lambda x, i: F.array_position(F.transform(xs, F.lower), F.lower(x)) == i + 1)
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[A-Za-z][A-Za-z0-9\-]+"), F.lit(0))
    q = q.withColumn("low", unique(found))
    hints = F.filter(words, lambda w: w.isin(THEME_HINTS))
    salient = F.filter(words, lambda w: ~w.isin(STOPWORDS) & (F.length(w) > 3) & ~F.array_contains(F.transform(F.col("low"), F.lower), w))
    return q.select("query_id", "question", "low", unique(F.when(F.size(hints) > 0, hints).otherwise(salient)).alias("high"))


def match_entities(questions: DataFrame, entities: DataFrame, most: int = SEEDS, fuzzy: float = FUZZY) -> DataFrame:
    """query_id, node, title, score: up to `most` entities (node, title, aliases) that a question names, ties by node.

    100 where the title, an alias or the implicit acronym stands in the question as a word; 98 for a label among the question's
    capitals; else the token-set ratio of the label, where it reaches `fuzzy`. Labels meet questions by an equi-join on any of
    their words, and, as a label without a common word can only be alike at about the same length, on the length of their words.
    """
    empty = F.expr("cast(array() as array<string>)")
    split = lambda c: F.array_distinct(F.split(F.lower(c), r"(?U)\s+"))
    words = lambda c: F.array_union(F.split(canonical_key(c), " "), split(c))
    size = lambda c: F.length(F.array_join(F.filter(split(c), lambda x: x != ""), " "))
    label = entities.select("node", "title", F.explode(F.array_distinct(F.concat(F.array("title"), F.coalesce("aliases", empty), F.slice(implicit_acronyms(F.col("title")), 1, 1)))).alias("label")).where("trim(label) <> ''")
    by_word = label.select("node", "title", "label", F.explode(F.array_union(words(F.col("label")), F.array(F.concat(F.lit("\x1f"), size(F.col("label")))))).alias("w"))
    n = size(F.col("question"))
    sizes = F.transform(F.sequence(F.floor(n * fuzzy / (200 - fuzzy)), F.ceil(n * (200 - fuzzy) / fuzzy)), lambda k: F.concat(F.lit("\x1f"), k))
    asked = questions.select("query_id", "question", F.explode(F.array_union(words(F.col("question")), sizes)).alias("w")).where("w <> ''")
    asked = F.broadcast(asked) if lx.small(questions) else asked
    near = by_word.join(asked, "w").select("query_id", "question", "node", "title", "label").distinct()
    word = F.regexp_like("question", F.concat(F.lit(r"(?i)(?<![A-Za-z0-9_])\Q"), "label", F.lit(r"\E(?![A-Za-z0-9_])")))
    capital = F.array_contains(F.filter(F.regexp_extract_all("question", F.lit(r"[A-Za-z][A-Za-z0-9\-]+"), F.lit(0)), lambda t: (F.length(t) >= 2) & (F.upper(t) == t)), F.col("label"))
    scored = near.withColumn("score", F.when(word, 100.0).when(capital, 98.0).otherwise(token_set_of(F.lower("label"), F.lower("question"))))
    best = scored.where(F.col("score") >= fuzzy).groupBy("query_id", "node", "title").agg(F.max("score").alias("score"))
    return lx.top_k(best, most, [F.col("score").desc(), F.col("node")])


@dataclass
class CorpusGraph:
    """nodes: node, kind, title, text, section, aliases; edges: source, target, weight, kind; ranks: node, pagerank."""

    nodes: DataFrame
    edges: DataFrame
    ranks: DataFrame
    index: lx.LexicalIndex

    @classmethod
    def build(cls, nodes: DataFrame, edges: DataFrame, iterations: int = 20, asked: DataFrame | None = None) -> CorpusGraph:
        """With asked, questions (query_id, question), the index has the postings of their tokens alone."""
        evidence = nodes.where(F.col("kind").isin(EVIDENCE)).select(F.col("node").alias("doc_id"), F.coalesce(F.nullif("text", F.lit("")), "title").alias("text"))
        return cls(nodes, edges, materialize(pagerank(edges, nodes, iterations=iterations, tolerance=None), "pagerank"), lx.LexicalIndex.build(evidence, asked=asked))

    def basic(self, questions: DataFrame, limit: int) -> DataFrame:
        return lx.basic_search(self.index, self.nodes.select(F.col("node").alias("doc_id"), "kind", "section"), questions, limit)

    def local(self, questions: DataFrame, limit: int = lx.TOP_K, hops: int = 2) -> DataFrame:
        """query_id, doc_id, score, rank: evidence around the entities that a question names; basic() for questions that name none.

        A neighbour at distance d of a seed counts 1 / (d + 1) + 5 pagerank: itself if a chunk or text unit, .9 of it if a claim,
        .75 for the chunks of a page, .85 for the units of a document. Half the BM25 score of the best 2 limit is added. The
        section's tenth is added to the score after the order is made.
        """
        seeds = materialize(match_entities(questions, self.nodes.where("kind = 'entity'")), "seeds")
        near = k_hop(self.edges, seeds.select(F.col("node").alias("seed")).distinct(), hops)
        near = materialize(near.join(self.nodes.select("node", "kind"), "node").join(self.ranks, "node").withColumn("s", 1 / (F.col("distance") + 1) + 5 * F.col("pagerank")), "near")
        direct = near.where(F.col("kind").isin(EVIDENCE)).select("seed", F.col("node").alias("doc_id"), (F.col("s") * F.when(F.col("kind") == "claim", 0.9).otherwise(1.0)).alias("s"))
        around = both_ways(self.edges.select("source", "target")).distinct().join(self.nodes.select(F.col("node").alias("target"), F.col("kind").alias("to")), "target")
        via = near.where(F.col("kind").isin(*PAGES, "source_document")).select("seed", F.col("node").alias("source"), "kind", "s").join(around, "source")
        via = via.where(((F.col("kind") == "source_document") & (F.col("to") == "text_unit")) | ((F.col("kind") != "source_document") & (F.col("to") == "chunk")))
        via = via.select("seed", F.col("target").alias("doc_id"), (F.col("s") * F.when(F.col("kind") == "source_document", 0.85).otherwise(0.75)).alias("s"))
        graph = seeds.select("query_id", F.col("node").alias("seed")).join(direct.unionByName(via), "seed").select("query_id", "doc_id", "s")
        named = questions.join(seeds.select("query_id").distinct(), "query_id", "left_semi")
        words = lx.ranked(lx.bm25(self.index, named), 2 * limit).select("query_id", "doc_id", (F.col("score") * 0.5).alias("s"))
        total = graph.unionByName(words).groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 8).alias("score"))  # halves of scores of 6 places are no ties here
        best = lx.top_k(total, limit, [F.col("score").desc(), F.col("doc_id")])
        boost = best.join(self.nodes.select(F.col("node").alias("doc_id"), tokens(F.col("section")).alias("st")), "doc_id").join(questions.select("query_id", tokens(F.col("question")).alias("qt")), "query_id")
        out = boost.select("query_id", "doc_id", (F.col("score") + F.when(F.arrays_overlap("st", "qt"), 0.1).otherwise(0.0)).alias("score"), "rank")
        rest = questions.join(seeds.select("query_id").distinct(), "query_id", "left_anti")
        return out.unionByName(self.basic(rest, limit).select("query_id", "doc_id", "score", "rank"))

    def drift(self, questions: DataFrame, limit: int = lx.TOP_K) -> DataFrame:
        """local() for the question and for up to four that are made of its first two seeds; the first score of a context stays, and each further bundle adds a tenth."""
        seeds = match_entities(questions, self.nodes.where("kind = 'entity'"))
        made = seeds.where("rank <= 2").select("query_id", "rank", F.explode(F.array(
            F.struct(F.lit(0).alias("k"), F.concat(F.lit("What does the corpus say about "), "title", F.lit("?")).alias("q")),
            F.struct(F.lit(1).alias("k"), F.concat(F.lit("How does "), "title", F.lit(" relate to the other key topics in this question?")).alias("q")))).alias("x"))
        subs = questions.select("query_id", F.lit(0).alias("bundle"), "question").unionByName(made.select("query_id", (F.col("rank") * 2 - 1 + F.col("x.k")).alias("bundle"), F.col("x.q").alias("question")))
        subs = materialize(subs.withColumn("sub", F.concat_ws("#", F.col("query_id").cast("string"), F.col("bundle").cast("string"))), "subquestions")
        got = self.local(subs.select(F.col("sub").alias("query_id"), "question"), max(limit // 2, 3)).join(subs.select(F.col("sub").alias("query_id"), F.col("query_id").alias("q"), "bundle"), "query_id")
        got = got.where((F.col("bundle") == 0) | (F.col("rank") <= 3))
        one = got.groupBy("q", "doc_id").agg(F.min_by("score", F.struct("bundle", "rank")).alias("s"), F.count_distinct("bundle").alias("n"))
        return lx.top_k(one.select(F.col("q").alias("query_id"), "doc_id", F.round(F.col("s") + 0.1 * (F.col("n") - 1), 6).alias("score")), limit, [F.col("score").desc(), F.col("doc_id")])

    def global_(self, questions: DataFrame, communities: DataFrame, members: DataFrame, limit: int = lx.TOP_K) -> DataFrame:
        """query_id, rank, node, score: the five communities (id, summary, top_entities) most like a question, or the best one, each with members (id, node).

        A text's likeness is its tokens among the question's by 1 plus the root of its tokens; entities' names count half. Each
        community (1.0) is followed by at most limit / #communities of its evidence in order of id (.75), and all by limit.
        """
        asked = questions.select("query_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("token"))
        parts = communities.select("id", F.lit(1.0).alias("w"), F.lit(-1).alias("part"), F.col("summary").alias("t")).unionByName(communities.select("id", F.lit(0.5).alias("w"), F.posexplode("top_entities").alias("part", "t")))
        held = parts.withColumn("ts", tokens(F.col("t"))).select("id", "w", "part", F.size("ts").alias("n"), F.explode("ts").alias("token"))
        score = held.join(asked, "token").groupBy("query_id", "id", "w", "part", "n").agg(F.count(F.lit(1)).alias("hits")).groupBy("query_id", "id").agg(F.round(F.sum(F.col("w") * F.col("hits") / (1 + F.sqrt("n"))), 6).alias("score"))
        top = lx.top_k(score, 5, [F.col("score").desc(), F.col("id").desc()]).select("query_id", "id", "score", F.col("rank").alias("place"))
        lone = questions.select("query_id").join(top.select("query_id").distinct(), "query_id", "left_anti").join(F.broadcast(communities.agg(F.max("id").alias("id"))))  # the last id is the best where all score 0
        top = top.unionByName(lone.select("query_id", "id", F.lit(0.0).alias("score"), F.lit(1).alias("place")))
        top = top.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
        evidence = members.join(self.nodes.where(F.col("kind").isin(EVIDENCE)).select("node"), "node", "left_semi")
        some = evidence.withColumn("m", F.row_number().over(Window.partitionBy("id").orderBy("node"))).where(F.col("m") <= limit)
        rows = top.select("query_id", "place", F.lit(0).alias("m"), F.col("id").alias("node"), F.lit(1.0).alias("score")).unionByName(
            top.join(some, "id").where(F.col("m") <= F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("many")))).select("query_id", "place", "m", "node", F.lit(0.75).alias("score")))
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "m"))).where(F.col("rank") <= limit).select("query_id", "rank", "node", "score")


def find(graph: CorpusGraph, questions: DataFrame, limit: int = lx.TOP_K, communities: DataFrame | None = None, members: DataFrame | None = None, method: str = "auto") -> DataFrame:
    """query_id, method, doc_id, score, rank with the method chosen for each question, or the one given for all.

    Themes are answered from communities and their members as in global_(), and as basic where none are given.
    """
    if method == "auto":
        seeds = match_entities(questions, graph.nodes.where("kind = 'entity'")).select("query_id").distinct().withColumn("named", F.lit(True))
        chosen = questions.join(seeds, "query_id", "left").select("query_id", "question", auto_method(F.col("question"), F.coalesce("named", F.lit(False))).alias("method"))
    elif method in ("basic", "local", "global", "drift-lite"):
        chosen = questions.select("query_id", "question", F.lit(method).alias("method"))
    else:
        raise ValueError(f"unknown method: {method}")
    chosen = materialize(chosen, "methods")
    of = lambda m: chosen.where(F.col("method") == m).select("query_id", "question")
    themes = graph.basic(of("global"), limit) if communities is None or members is None else graph.global_(of("global"), communities, members, limit).withColumnRenamed("node", "doc_id")
    parts = [graph.drift(of("drift-lite"), limit), graph.local(of("local"), limit), graph.basic(of("basic"), limit), themes]
    out = parts[0].select("query_id", "doc_id", "score", "rank")
    for p in parts[1:]:
        out = out.unionByName(p.select("query_id", "doc_id", "score", "rank"))
    return out.join(chosen.select("query_id", "method"), "query_id")


@dataclass
class Profiles:
    """entities: id, text, chunk_ids; relations: id, text, source, target, chunk_ids; chunks: doc_id, text.

    entity_vectors, relation_vectors: id, vector; and embed, which gives query_id, vector of questions (query_id, question).
    Where all are there, profiles are found by cosine; a question whose vector is missing or of another length than the
    profiles' falls back to their words.
    """

    entities: DataFrame
    relations: DataFrame
    chunks: DataFrame
    entity_vectors: DataFrame | None = None
    relation_vectors: DataFrame | None = None
    embed: Callable[[DataFrame], DataFrame] | None = None

    def _hits(self, rows: DataFrame, keys: DataFrame, column: str, k: int, vectors: DataFrame | None = None) -> DataFrame:
        asked = keys.select("query_id", F.array_join(column, " ").alias("question"))
        words = lambda q: lx.ranked(lx.bm25(lx.LexicalIndex.build(rows.select(F.col("id").alias("doc_id"), "text"), asked=q), q), k)
        if vectors is None or self.embed is None:
            return words(asked)
        length = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
        asked = asked.where(F.trim("question") != "")
        queries = materialize(self.embed(asked).where(F.size("vector") == length).select("query_id", "vector"), "query_vectors")
        near = cosine_top_k(vectors.select(F.col("id").alias("vec_id"), "vector"), queries, k).select("query_id", F.col("vec_id").alias("doc_id"), "score", "rank")
        near = near.join(rows.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
        return near.select("query_id", "doc_id", "score", "rank").unionByName(words(asked.join(queries, "query_id", "left_anti")).select("query_id", "doc_id", "score", "rank"))

    def route(self, keys: DataFrame) -> DataFrame:
        """query_id, method of keys as in retrieve(): comparisons hybrid, themes global, known entities local, else hybrid."""
        known = self._hits(self.entities, keys, "low", 1, self.entity_vectors).select("query_id").distinct().withColumn("known", F.lit(True))
        c = F.col("question")
        return keys.select("query_id", "question").join(known, "query_id", "left").select("query_id", F.when(holds_any(c, DRIFT_WORDS), "hybrid").when(holds_any(c, GLOBAL_WORDS), "global").when(F.col("known"), "local").otherwise("hybrid").alias("method"))

    def local(self, keys: DataFrame, k: int = 12) -> DataFrame:
        """query_id, doc_id, score: chunks of the entities that the low keywords (else the high ones) find, and at half of it those of their relations.

        A chunk has the greatest score of its entities; one that a relation brings before any entity does, the half of that
        entity's score if it is more.
        """
        hits = self._hits(self.entities, keys.withColumn("ks", F.when(F.size("low") > 0, F.col("low")).otherwise(F.col("high"))), "ks", k, self.entity_vectors)
        direct = hits.join(self.entities.select(F.col("id").alias("doc_id"), F.explode("chunk_ids").alias("c")), "doc_id").select("query_id", "c", "rank", F.lit(0).alias("kind"), "score")
        ends = self.relations.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("doc_id"), "chunk_ids").select("doc_id", F.explode("chunk_ids").alias("c"))
        by_relation = hits.join(ends, "doc_id").select("query_id", "c", "rank", F.lit(1).alias("kind"), (F.col("score") * 0.5).alias("score"))
        events = direct.unionByName(by_relation).groupBy("query_id", "c").agg(F.max(F.when(F.col("kind") == 0, F.col("score"))).alias("best"), F.min(F.struct("rank", "kind", "score")).alias("first"))
        score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("first.kind") == 1, F.col("first.score")).otherwise(0.0))
        return events.select("query_id", F.col("c").alias("doc_id"), F.round(score, 8).alias("score"))

    def global_(self, keys: DataFrame, k: int = 16) -> DataFrame:
        """query_id, doc_id, score: chunks of the relations that the high keywords (else the low ones) find, by their greatest score."""
        hits = self._hits(self.relations, keys.withColumn("ks", F.when(F.size("high") > 0, F.col("high")).otherwise(F.col("low"))), "ks", k, self.relation_vectors)
        return hits.join(self.relations.select(F.col("id").alias("doc_id"), F.explode("chunk_ids").alias("c")), "doc_id").groupBy("query_id", "c").agg(F.max("score").alias("score")).select("query_id", F.col("c").alias("doc_id"), "score")

    def retrieve(self, keys: DataFrame, method: str = "auto", limit: int = 12, budget: int = 4000) -> DataFrame:
        """query_id, method, doc_id, score, rank of keys (query_id, question, low, high): local, global and basic chunks, as the method has them.

        local, global and basic are what they say, hybrid and drift-lite all three; lists are fused by reciprocal ranks at 1.2, 1.2
        and .8, and the best `limit` are given within the token budget. With auto, route() chooses.
        """
        uses = {"local": ["local"], "global": ["global"], "basic": ["basic"], "hybrid": ["local", "global", "basic"], "drift-lite": ["local", "global", "basic"]}
        if method != "auto" and method not in uses:
            raise ValueError(f"unknown method: {method}")
        chosen = materialize(self.route(keys), "methods") if method == "auto" else keys.select("query_id", F.lit(method).alias("method"))
        every = None
        for name in ("local", "global", "basic"):
            if method != "auto" and name not in uses[method]:
                continue
            some = keys.join(chosen.where(F.col("method").isin([m for m, of in uses.items() if name in of])), "query_id", "left_semi")
            if name == "basic":
                asked = some.select("query_id", "question")
                part = lx.ranked(lx.bm25(lx.LexicalIndex.build(self.chunks, asked=asked), asked), 2 * limit)
            else:
                part = lx.ranked(self.local(some), 4 * limit, 8) if name == "local" else lx.ranked(self.global_(some), 4 * limit)
            part = part.select("query_id", "doc_id", "score", "rank", F.lit(name).alias("list"), F.col("doc_id").cast("string").alias("title"))
            every = part if every is None else every.unionByName(part)
        fused = lx.top_k(rrf(every, ["doc_id"], weights={"local": 1.2, "global": 1.2, "basic": 0.8}).select("query_id", "doc_id", F.col("rrf").alias("score")), limit, [F.col("score").desc(), F.col("doc_id")])
        return lx.token_budget(fused.join(self.chunks, "doc_id"), budget).join(chosen, "query_id").select("query_id", "method", "doc_id", "score", "rank")

    def hybrid(self, keys: DataFrame, limit: int = 12, budget: int = 4000) -> DataFrame:
        """retrieve() by all three lists."""
        return self.retrieve(keys, "hybrid", limit, budget).drop("method")


def answers(contexts: DataFrame, cap: int = 5) -> DataFrame:
    """query_id, answer, citations: the list of evidence that stands for an answer where no provider writes one; (query_id, rank, title, ref, text)."""
    line = F.concat(F.lit("- "), "title", F.lit(": "), F.substring(one_line(F.col("text")), 1, 200), F.lit(" ["), "ref", F.lit("]"))
    few = contexts.where(F.col("rank") <= cap)
    return few.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("answer"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "ref"))), lambda x: x["ref"]).alias("citations"))


def resolve_citations(cited: DataFrame, contexts: DataFrame) -> DataFrame:
    """query_id, pos, cited, ref, how: a citation by its exact reference, by label [cN], or by its path, which takes the first reference on it; else null."""
    exact = contexts.select("query_id", F.col("ref").alias("cited"), F.col("ref").alias("exact")).distinct()
    label = contexts.select("query_id", F.concat(F.lit("c"), "rank").alias("label"), F.col("ref").alias("by_label"))
    path = contexts.groupBy("query_id", F.substring_index("ref", "#", 1).alias("path")).agg(F.min_by("ref", "rank").alias("by_path"))
    c = cited.withColumn("label", F.regexp_extract(F.lower("cited"), r"^\[?(c\d+)\]?$", 1)).withColumn("path", F.substring_index("cited", "#", 1))
    out = c.join(exact, ["query_id", "cited"], "left").join(label, ["query_id", "label"], "left").join(path, ["query_id", "path"], "left")
    return out.select("query_id", "pos", "cited", F.coalesce("exact", "by_label", "by_path").alias("ref"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("by_label").isNotNull(), "label").when(F.col("by_path").isNotNull(), "path").otherwise("none").alias("how"))


def claim_support(answered: DataFrame) -> DataFrame:
    """answered with support: how far an answer (answer, stale, run_id, input_hash) is known to rest on the index.

    stale-index, no-answer, cited-graph-answer where it cites data, graph-index-answer where run and input are known, else unverified.
    """
    blank = F.coalesce(F.regexp_replace("answer", r"(?U)\s+", ""), F.lit("")) == ""
    known = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    pick = F.when(F.coalesce("stale", F.lit(False)), "stale-index").when(blank, "no-answer").when(F.col("answer").contains("[Data:"), "cited-graph-answer").when(known("run_id") & known("input_hash"), "graph-index-answer")
    return answered.withColumn("support", pick.otherwise("unverified"))


def data_sources(refs: DataFrame, tables: dict[str, DataFrame], units: DataFrame) -> DataFrame:
    """query_id, kind, id, source_id of references (query_id, kind, id) into external tables.

    tables: by kind, rows of id, human_readable_id and text_unit_ids; units: id, source_id. A reference meets either identifier,
    by two equi-joins, and fans out to the sources of its text units.
    """
    out = None
    for kind, t in tables.items():
        r = refs.where(F.col("kind") == kind)
        keys = t.select(F.col("id").cast("string").alias("id"), "text_unit_ids").unionByName(t.select(F.col("human_readable_id").cast("string").alias("id"), "text_unit_ids"))
        met = r.join(keys, "id").select("query_id", "kind", "id", F.explode("text_unit_ids").alias("unit"))
        out = met if out is None else out.unionByName(met)
    return out.join(units.select(F.col("id").alias("unit"), "source_id"), "unit").select("query_id", "kind", "id", "source_id").distinct()


def resolve_all(wanted: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """Known rows of the wanted ids; raises if an id is unknown."""
    lost = wanted.join(known.select(key).distinct(), key, "left_anti").limit(5).collect()
    if lost:
        raise LookupError(f"unknown ids: {[r[key] for r in lost]}")
    return known.join(wanted.select(key).distinct(), key, "left_semi")


# --- queries -------------------------------------------------------------------------------------------------------------


def corpus_graph(spark: SparkSession, folder: str, asked: DataFrame | None = None) -> CorpusGraph:
    """Documents by name of their sources: entities, source documents, text units."""
    s = keep_first(table(spark, folder, "sources"), ["source_id"], [F.col("ingested_at").desc(), F.col("content_hash")])
    none = F.expr("cast(array() as array<string>)")
    name = F.substring_index("title", ":", 1)
    entities = s.groupBy(F.concat(F.lit("entity::"), F.lower(name)).alias("node")).agg(F.min(name).alias("title")).select("node", F.lit("entity").alias("kind"), "title", F.lit("").alias("text"), F.lit("").alias("section"), none.alias("aliases"))
    docs = s.select(F.concat(F.lit("source::"), "source_id").alias("node"), F.lit("source_document").alias("kind"), "title", F.lit("").alias("text"), F.lit("").alias("section"), none.alias("aliases"))
    u = keep_first(table(spark, folder, "text_units").select("source_id", "unit_index", "title", "text"), ["source_id", "unit_index"], [F.col("title"), F.length("text")])
    units = u.select(F.concat_ws("#", "source_id", "unit_index").alias("node"), F.lit("text_unit").alias("kind"), "title", "text", F.col("title").alias("section"), none.alias("aliases"))
    mention = build_mentions(spark, folder).select(F.col("node").alias("source"), F.col("text_id").alias("target"), (F.col("n") * 0.1).alias("weight"), F.lit("mentions").alias("kind"))
    contain = u.select(F.concat(F.lit("source::"), "source_id").alias("source"), F.concat_ws("#", "source_id", "unit_index").alias("target"), F.lit(0.15).alias("weight"), F.lit("contains").alias("kind"))
    return CorpusGraph.build(materialize(entities.unionByName(docs).unionByName(units), "nodes"), materialize(mention.unionByName(contain), "edges"), 10, asked)


def route_questions(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "sources").select(F.substring_index("title", ":", 1).alias("term"))
    return route(table(spark, folder, "rag_samples").select(F.col("sample_id").alias("query_id"), "question"), known)


def route_methods(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "rag_samples")
    return q.select("sample_id", auto_method(F.col("question"), F.size("retrieved_contexts") > 1).alias("method"))


def query_keywords(spark: SparkSession, folder: str) -> DataFrame:
    k = keywords(lx.questions_of(spark, folder))
    return k.select("query_id", F.array_join("low", "|").alias("low"), F.array_join("high", "|").alias("high"))


def query_entities(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "sources").groupBy(F.substring_index("title", ":", 1).alias("title")).agg(F.min("source_id").alias("node")).withColumn("aliases", F.expr("cast(array() as array<string>)"))
    q = table(spark, folder, "rag_samples").groupBy("question").agg(F.min("sample_id").alias("query_id"))
    return match_entities(q, e)


def search_local(spark: SparkSession, folder: str) -> DataFrame:
    questions = lx.questions_of(spark, folder)
    return corpus_graph(spark, folder, questions).local(questions)


def search_drift(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_graph(spark, folder).drift(lx.questions_of(spark, folder))


def search_find(spark: SparkSession, folder: str) -> DataFrame:
    g = corpus_graph(spark, folder)
    return find(g, lx.questions_of(spark, folder), lx.TOP_K, *_source_communities(spark, g, folder))


def _source_labels(spark: SparkSession, g: CorpusGraph, folder: str) -> DataFrame:
    """Each text unit and document with its source as community; an entity with the least source of its name."""
    name = F.concat(F.lit("entity::"), F.lower(F.substring_index("title", ":", 1)))
    s = keep_first(table(spark, folder, "sources"), ["source_id"], [F.col("ingested_at").desc(), F.col("content_hash")])
    entities = s.groupBy(name.alias("node")).agg(F.min(F.concat(F.lit("source::"), "source_id")).alias("community"))
    docs = g.nodes.where("kind = 'source_document'").select("node", F.col("node").alias("community"))
    units = g.nodes.where("kind = 'text_unit'").select("node", F.concat(F.lit("source::"), F.substring_index("node", "#", 1)).alias("community"))
    return entities.unionByName(docs).unionByName(units)


def _source_communities(spark: SparkSession, g: CorpusGraph, folder: str) -> tuple[DataFrame, DataFrame]:
    """Communities that are the sources, and their members."""
    labels = materialize(_source_labels(spark, g, folder), "labels")
    nodes = g.nodes.select("node", "kind", "title", F.expr("cast(array() as array<string>)").alias("source_ids"))
    records = materialize(community_records(labels, nodes, 2), "communities")
    numbered = number_rows(labels.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")), [F.col("n").desc(), F.col("least")], "number").where("n > 1")
    members = labels.join(numbered.select("community", F.concat(F.lit("community-"), "number").alias("id")), "community").select("id", "node")
    return records, members


def search_global(spark: SparkSession, folder: str) -> DataFrame:
    """Over communities that are the sources; those of graph_communities would do as well."""
    questions = lx.questions_of(spark, folder)
    g = corpus_graph(spark, folder, questions)
    return g.global_(questions, *_source_communities(spark, g, folder))


def _profiles(spark: SparkSession, folder: str) -> Profiles:
    rows = table(spark, folder, "extracted_entities").select("name", "description", F.lower("name").alias("id"), F.explode("chunk_ids").alias("c"))
    entities = rows.groupBy("id").agg(F.concat_ws(" ", F.max("name"), F.max("description")).alias("text"), F.array_sort(F.collect_set("c")).alias("chunk_ids"))
    pair = table(spark, folder, "extracted_entities").select(F.lower("name").alias("source"), F.lower("type").alias("target"), "description", F.explode("chunk_ids").alias("c"))
    relations = pair.groupBy("source", "target").agg(F.max("description").alias("d"), F.array_sort(F.collect_set("c")).alias("chunk_ids")).select(F.concat_ws("|", "source", "target").alias("id"), F.concat_ws(" ", "source", "target", "d").alias("text"), "source", "target", "chunk_ids")
    chunks = table(spark, folder, "light_chunks").groupBy(F.col("id").alias("doc_id")).agg(F.max("text").alias("text"))
    return Profiles(materialize(entities, "entities"), materialize(relations, "relations"), materialize(chunks, "chunks"))


def search_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    return _profiles(spark, folder).hybrid(keywords(lx.questions_of(spark, folder)))


def answer_offline(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "rag_samples").select(F.col("sample_id").alias("query_id"), F.posexplode("retrieved_contexts").alias("rank", "c")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("c.source_id").alias("title"), F.col("c.ref").alias("ref"), F.col("c.text").alias("text"))
    return answers(x, 3).select("query_id", "answer", F.array_join("citations", "|").alias("citations"))


def answer_support(spark: SparkSession, folder: str) -> DataFrame:
    """The provider's mode stands for the run, the first citation for the input, an error for staleness."""
    r = table(spark, folder, "rag_samples").select("sample_id", "answer", F.col("error").isNotNull().alias("stale"), F.col("provider_mode").alias("run_id"), F.get("citations", F.lit(0)).alias("input_hash"))
    return claim_support(r).select("sample_id", "support")


def answer_citations(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "rag_samples")
    cited = r.select(F.col("sample_id").alias("query_id"), F.posexplode("citations").alias("pos", "cited"))
    contexts = r.select(F.col("sample_id").alias("query_id"), F.posexplode("retrieved_contexts").alias("p", "c")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("c.ref").alias("ref"))
    return resolve_citations(cited, contexts)


_LIKE = lambda words: " OR ".join(f"contains(' ' || lower(question) || ' ', '{w}')" for w in words)
_HITS = lambda words: "array_to_string(list_filter([" + ", ".join(f"'{w}'" for w in words) + "], lambda w: contains(' ' || lower(question) || ' ', w)), '|')"
_ACR = r"list_distinct(regexp_extract_all(regexp_replace(question, '[À-ÖØ-öø-ÿŒœ]', '_', 'g'), '\b([A-Z]{2,6})\b', 1))"
QUERIES = {f.__name__: f for f in (route_questions, route_methods, query_keywords, query_entities, search_local, search_drift, search_find, search_global, search_hybrid, answer_offline, answer_support, answer_citations)}
_STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS)
_UNIQUE = lambda c: f"list_filter({c}, lambda x, i: list_position(list_transform({c}, lambda y: lower(y)), lower(x)) = i)"
ORACLES = {
    "answer_support": """SELECT sample_id, CASE WHEN error IS NOT NULL THEN 'stale-index' WHEN regexp_replace(coalesce(answer, ''), '[\\s\\x{85}\\p{Z}]+', '', 'g') = '' THEN 'no-answer' WHEN contains(answer, '[Data:') THEN 'cited-graph-answer'
        WHEN coalesce(provider_mode, '') <> '' AND coalesce(citations[1], '') <> '' THEN 'graph-index-answer' ELSE 'unverified' END AS support FROM rag_samples""",
    "query_keywords": rf"""WITH q AS (SELECT item_id AS query_id, list_concat(list_transform(regexp_extract_all(regexp_replace(question, '[À-ÖØ-öø-ÿŒœ]', '_', 'g'), '\b([A-Z][A-Za-z0-9][A-Za-z0-9\-]*(?:\s+[A-Z][A-Za-z0-9][A-Za-z0-9\-]*){{0,3}})\b', 1), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))),
          regexp_extract_all(regexp_replace(question, '[À-ÖØ-öø-ÿŒœ]', '_', 'g'), '\b([A-Z]{{2,6}})\b', 1)) AS l, regexp_extract_all(lower(question), '[A-Za-z][A-Za-z0-9\-]+') AS ws FROM eval_questions),
        r AS (SELECT query_id, {_UNIQUE("l")} AS low, ws, list_filter(ws, lambda w: w IN ({", ".join(f"'{h}'" for h in THEME_HINTS)})) AS hints FROM q),
        t AS (SELECT query_id, low, CASE WHEN len(hints) > 0 THEN hints ELSE list_filter(ws, lambda w: w NOT IN ({_STOP_SQL}) AND len(w) > 3 AND NOT list_contains(list_transform(low, lambda y: lower(y)), w)) END AS h FROM r)
        SELECT query_id, array_to_string(low, '|') AS low, array_to_string({_UNIQUE("h")}, '|') AS high FROM t""",
    "route_methods": f"SELECT sample_id, CASE WHEN {_LIKE(DRIFT_WORDS)} THEN 'drift-lite' WHEN {_LIKE(GLOBAL_WORDS)} THEN 'global' WHEN len(retrieved_contexts) > 1 THEN 'local' ELSE 'basic' END AS method FROM rag_samples",
    "query_entities": r"""WITH e AS (SELECT split_part(title, ':', 1) AS title, min(source_id) AS node FROM sources GROUP BY 1), q AS (SELECT question, min(sample_id) AS query_id FROM rag_samples GROUP BY 1),
        m AS (SELECT query_id, node, title, CAST(100 AS DOUBLE) AS score FROM q JOIN e ON regexp_matches(lower(question), '(^|[^a-z0-9_])' || regexp_escape(lower(title)) || '([^a-z0-9_]|$)'))
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS rank FROM m) WHERE rank <= 6""",
    "answer_offline": r"""WITH x AS (SELECT sample_id AS query_id, unnest(retrieved_contexts) AS c, generate_subscripts(retrieved_contexts, 1) AS rank FROM rag_samples)
        SELECT query_id, string_agg('- ' || c.source_id || ': ' || trim(regexp_replace(c.text, '[\s\p{Z}]+', ' ', 'g'))[1:200] || ' [' || c.ref || ']', chr(10) ORDER BY rank) AS answer, string_agg(c.ref, '|' ORDER BY rank) AS citations FROM x WHERE rank <= 3 GROUP BY 1""",
    "answer_citations": r"""WITH k AS (SELECT sample_id AS query_id, unnest(citations) AS cited, generate_subscripts(citations, 1) - 1 AS pos FROM rag_samples), x AS (SELECT sample_id AS query_id, unnest(retrieved_contexts).ref AS ref, generate_subscripts(retrieved_contexts, 1) AS rank FROM rag_samples),
        p AS (SELECT query_id, split_part(ref, '#', 1) AS path, arg_min(ref, rank) AS by_path FROM x GROUP BY 1, 2), e AS (SELECT DISTINCT query_id, ref FROM x)
        SELECT k.query_id, pos, cited, coalesce(e.ref, by_path) AS ref, CASE WHEN e.ref IS NOT NULL THEN 'exact' WHEN by_path IS NOT NULL THEN 'path' ELSE 'none' END AS how FROM k LEFT JOIN e ON e.query_id = k.query_id AND e.ref = cited LEFT JOIN p ON p.query_id = k.query_id AND p.path = split_part(cited, '#', 1)""",
    "route_questions": rf"""WITH t AS (SELECT DISTINCT split_part(title, ':', 1) AS term FROM sources), u AS (SELECT term FROM t WHERE len(term) >= 3),
        m AS (SELECT sample_id, array_to_string(list_sort(list_distinct(list(lower(term)))), '|') AS met FROM rag_samples JOIN u ON CASE WHEN regexp_matches(term, '[\s\-]') THEN contains(lower(question), lower(term)) ELSE regexp_matches(lower(question), '(^|[^\p{{L}}\p{{N}}_])' || lower(term) || '([^\p{{L}}\p{{N}}_]|$)') END
          AND list_contains(regexp_extract_all(lower(question), '[a-z0-9]+'), regexp_extract(lower(term), '[a-z0-9]+')) GROUP BY 1),
        x AS (SELECT sample_id AS query_id, question, met, CASE WHEN {_LIKE(DRIFT_WORDS)} THEN 1 WHEN {_LIKE(GLOBAL_WORDS)} THEN 2 WHEN {_LIKE(DIRECT_WORDS)} THEN 3 WHEN len({_ACR}) > 0 THEN 4 WHEN met IS NOT NULL THEN 5 ELSE 6 END AS k FROM rag_samples LEFT JOIN m USING (sample_id))
        SELECT query_id, ['drift', 'global', 'basic', 'local', 'local', 'basic'][k] AS method, ['high', 'high', 'medium', 'medium', 'medium', 'low'][k] AS confidence, ['comparison', 'corpus theme', 'direct look-up', 'alias', 'known term', 'fallback'][k] AS reason,
          CASE k WHEN 1 THEN {_HITS(DRIFT_WORDS)} WHEN 2 THEN {_HITS(GLOBAL_WORDS)} WHEN 3 THEN {_HITS(DIRECT_WORDS)} WHEN 4 THEN array_to_string({_ACR}, '|') WHEN 5 THEN met ELSE '' END AS matched FROM x""",
}
# The graph of corpus_graph(), ten iterations of PageRank, seeds, two hops, and BM25 over the text units.
_RANKS = "".join(
    f", g{i} AS MATERIALIZED (SELECT v.node, v.linked, 0.85 * (coalesce(x.got, 0) + (SELECT coalesce(sum(pr), 0) FROM g{i - 1} WHERE NOT linked) / c.n) + 0.15 / c.n AS pr FROM g{i - 1} v LEFT JOIN (SELECT f.target AS node, sum(q.pr * f.part) AS got FROM g{i - 1} q JOIN fl f ON f.source = q.node GROUP BY 1) x USING (node), cn c)"
    for i in range(1, 11))
_LOCAL = rf"""WITH {_MENTION}, src AS (SELECT * FROM sources QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY ingested_at DESC, content_hash) = 1),
 ent AS (SELECT 'entity::' || lower(split_part(title, ':', 1)) AS node, min(split_part(title, ':', 1)) AS title FROM src GROUP BY 1),
 tu AS MATERIALIZED (SELECT source_id, source_id || '#' || unit_index AS node, title, coalesce(nullif(text, ''), title) AS text FROM text_units QUALIFY row_number() OVER (PARTITION BY source_id, unit_index ORDER BY title, len(text)) = 1),
 ed AS MATERIALIZED (SELECT node AS source, text_id AS target, n * 0.1::DOUBLE AS weight FROM m UNION ALL SELECT 'source::' || source_id, node, 0.15::DOUBLE FROM tu),
 se AS (SELECT least(source, target) AS source, greatest(source, target) AS target, sum(weight) AS weight FROM ed GROUP BY 1, 2), bw AS MATERIALIZED (SELECT * FROM se UNION ALL SELECT target, source, weight FROM se WHERE source <> target),
 kd AS MATERIALIZED (SELECT node, 'entity' AS kind FROM ent UNION ALL SELECT 'source::' || source_id, 'source_document' FROM src UNION ALL SELECT node, 'text_unit' FROM tu),
 al AS (SELECT node FROM kd UNION SELECT source FROM bw), st AS (SELECT source, sum(weight) AS total FROM bw GROUP BY 1), fl AS MATERIALIZED (SELECT source, target, weight / total AS part FROM bw JOIN st USING (source)), cn AS (SELECT count(*) AS n FROM al),
 g0 AS MATERIALIZED (SELECT al.node, st.source IS NOT NULL AS linked, 1.0::DOUBLE / n AS pr FROM al LEFT JOIN st ON st.source = al.node, cn){_RANKS},
 qs AS (SELECT item_id AS query_id, question, {TOKENS_SQL.replace("text", "question")} AS qt FROM eval_questions),
 sd AS MATERIALIZED (SELECT query_id, node FROM (SELECT query_id, node, row_number() OVER (PARTITION BY query_id ORDER BY node) AS k FROM qs JOIN ent ON regexp_matches(lower(question), '(^|[^a-z0-9_])' || regexp_escape(lower(title)) || '([^a-z0-9_]|$)')) WHERE k <= 6),
 h1 AS (SELECT DISTINCT sd.node AS seed, bw.target AS node FROM sd JOIN bw ON bw.source = sd.node WHERE bw.target <> sd.node), h2 AS (SELECT DISTINCT seed, bw.target AS node FROM h1 JOIN bw ON bw.source = h1.node WHERE bw.target <> seed),
 nr AS (SELECT seed, h.node, kind, 1.0::DOUBLE / (d + 1) + 5 * pr AS s FROM (SELECT *, 1 AS d FROM h1 UNION ALL SELECT *, 2 FROM h2 ANTI JOIN h1 USING (seed, node)) h JOIN kd USING (node) JOIN g10 USING (node)),
 gs AS (SELECT seed, node AS doc_id, s FROM nr WHERE kind = 'text_unit' UNION ALL SELECT seed, target, s * 0.85 FROM nr JOIN (SELECT DISTINCT source, target FROM bw) b ON b.source = nr.node JOIN kd k ON k.node = target AND k.kind = 'text_unit' WHERE nr.kind = 'source_document'),
 td AS MATERIALIZED (SELECT node, title, {TOKENS_SQL} AS ts FROM tu), ts2 AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM td), tp AS MATERIALIZED (SELECT node, length, token, count(*) AS tf FROM (SELECT node, len(ts) AS length, unnest(ts) AS token FROM td) GROUP BY ALL),
 tf2 AS (SELECT token, count(*) AS df FROM tp GROUP BY 1), qk AS (SELECT query_id, unnest(qt) AS token FROM qs),
 bm AS MATERIALIZED (SELECT query_id, node AS doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / a))), 6) AS score FROM qk JOIN tp USING (token) JOIN tf2 USING (token), ts2 GROUP BY 1, 2),
 br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS k FROM bm), named AS (SELECT DISTINCT query_id FROM sd),
 tt AS (SELECT query_id, doc_id, round(sum(s), 8) AS score FROM (SELECT query_id, doc_id, s FROM sd JOIN gs ON gs.seed = sd.node UNION ALL SELECT query_id, doc_id, score * 0.5 FROM br SEMI JOIN named USING (query_id) WHERE k <= 16) GROUP BY 1, 2),
 tr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM tt),
 lb AS (SELECT query_id, doc_id, score + CASE WHEN len(list_intersect({TOKENS_SQL.replace("text", "td.title")}, qt)) > 0 THEN 0.1::DOUBLE ELSE 0 END AS score, rank FROM tr JOIN td ON td.node = doc_id JOIN qs USING (query_id) WHERE rank <= 8),
 ba AS (SELECT query_id, doc_id, round(score * 1.15 + CASE WHEN len(list_intersect({TOKENS_SQL.replace("text", "td.title")}, qt)) > 0 THEN 0.1 ELSE 0 END, 8) AS score FROM br ANTI JOIN named USING (query_id) JOIN td ON td.node = doc_id JOIN qs USING (query_id) WHERE k <= 24)
 """
ORACLES["search_local"] = _LOCAL + "SELECT * FROM lb UNION ALL SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ba) WHERE rank <= 8"
_TOP = lambda t, k: f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {t} QUALIFY rank <= {k})"
ORACLES["search_hybrid"] = (
    ORACLES["query_keywords"].rsplit("SELECT query_id, array_to_string(low", 1)[0].rstrip()
    + f""", ky AS MATERIALIZED (SELECT query_id, low, {_UNIQUE("h")} AS high FROM t), k1 AS (SELECT query_id, array_to_string(CASE WHEN len(low) > 0 THEN low ELSE high END, ' ') AS question FROM ky), k2 AS (SELECT query_id, array_to_string(CASE WHEN len(high) > 0 THEN high ELSE low END, ' ') AS question FROM ky), k3 AS (SELECT item_id AS query_id, question FROM eval_questions),
 ex AS (SELECT name, description, lower(name) AS id, lower(type) AS tp, unnest(chunk_ids) AS c FROM extracted_entities), en AS MATERIALIZED (SELECT id AS doc_id, concat_ws(' ', max(name), max(description)) AS text, list_distinct(list(c)) AS cs FROM ex GROUP BY 1),
 re AS MATERIALIZED (SELECT id || '|' || tp AS doc_id, id AS source, tp AS target, concat_ws(' ', id, tp, max(description)) AS text, list_distinct(list(c)) AS cs FROM ex GROUP BY id, tp), ch AS MATERIALIZED (SELECT id AS doc_id, max(text) AS text FROM light_chunks GROUP BY 1),
 {lx.bm25_sql("be", "en", "k1")}, {lx.bm25_sql("br", "re", "k2")}, {lx.bm25_sql("bc", "ch", "k3")},
 he AS MATERIALIZED {_TOP("be", 12)}, hr AS MATERIALIZED {_TOP("br", 16)},
 ev AS (SELECT query_id, unnest(cs) AS c, rank, 0 AS kind, score FROM he JOIN en USING (doc_id) UNION ALL SELECT query_id, unnest(cs), rank, 1, score * 0.5 FROM he JOIN (SELECT source AS e, cs FROM re UNION ALL SELECT target, cs FROM re WHERE source <> target) x ON x.e = he.doc_id),
 lo AS (SELECT query_id, c AS doc_id, round(greatest(coalesce(max(score) FILTER (kind = 0), 0), CASE WHEN min({{'r': rank, 'k': kind, 's': score}}).k = 1 THEN min({{'r': rank, 'k': kind, 's': score}}).s ELSE 0 END), 8) AS score FROM ev GROUP BY 1, 2),
 gl AS (SELECT query_id, c AS doc_id, max(score) AS score FROM (SELECT query_id, unnest(cs) AS c, score FROM hr JOIN re USING (doc_id)) GROUP BY 1, 2),
 li AS (SELECT query_id, doc_id, 1.2::DOUBLE / (60 + rank) AS w FROM {_TOP("lo", 48)} UNION ALL SELECT query_id, doc_id, 1.2::DOUBLE / (60 + rank) FROM {_TOP("gl", 48)} UNION ALL SELECT query_id, doc_id, 0.8::DOUBLE / (60 + rank) FROM {_TOP("bc", 24)}),
 fu AS (SELECT query_id, doc_id, round(sum(w), 9) AS score FROM li GROUP BY 1, 2), fr AS {_TOP("fu", 12)},
 bu AS (SELECT query_id, doc_id, score, rank, sum(greatest(1, len(text) // 4)) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM fr JOIN ch USING (doc_id))
 SELECT query_id, doc_id, score, rank FROM bu WHERE so_far <= 4000 OR rank = 1""")
ORACLES["search_global"] = (
    _LOCAL.rstrip() + rf""",
 lab AS MATERIALIZED (SELECT 'entity::' || lower(split_part(title, ':', 1)) AS node, min('source::' || source_id) AS c FROM src GROUP BY 1 UNION ALL SELECT 'source::' || source_id, 'source::' || source_id FROM src UNION ALL SELECT node, 'source::' || source_id FROM tu),
 nu AS (SELECT c, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(node)) AS k FROM lab GROUP BY 1), co AS (SELECT c, 'community-' || k AS id FROM nu WHERE n > 1),
 te AS (SELECT id, list(title ORDER BY node) AS es FROM (SELECT id, node, ent.title, row_number() OVER (PARTITION BY id ORDER BY node) AS k FROM lab JOIN co USING (c) JOIN ent USING (node)) WHERE k <= 8 GROUP BY 1),
 pa AS (SELECT co.id, 1.0::DOUBLE AS w, -1 AS part, CASE WHEN es IS NOT NULL THEN 'Entities: ' || array_to_string(es, ', ') ELSE '(no annotated members)' END AS text FROM co LEFT JOIN te USING (id) UNION ALL SELECT id, 0.5::DOUBLE, generate_subscripts(es, 1), unnest(es) FROM te),
 pt AS (SELECT id, w, part, len(ts) AS n, unnest(ts) AS token FROM (SELECT id, w, part, {TOKENS_SQL} AS ts FROM pa)), aq AS (SELECT query_id, unnest(list_distinct(qt)) AS token FROM qs),
 cs AS (SELECT query_id, id, round(sum(w * hits / (1 + sqrt(n))), 6) AS score FROM (SELECT query_id, id, w, part, n, count(*) AS hits FROM pt JOIN aq USING (token) GROUP BY ALL) GROUP BY 1, 2),
 ct AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS place FROM cs QUALIFY place <= 5), cl AS (SELECT * FROM ct UNION ALL SELECT query_id, (SELECT max(id) FROM co), 1 FROM qs WHERE query_id NOT IN (SELECT query_id FROM ct)),
 cm AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS many FROM cl), me AS (SELECT id, node, row_number() OVER (PARTITION BY id ORDER BY node) AS k FROM lab JOIN co USING (c) SEMI JOIN tu USING (node)),
 ro AS (SELECT query_id, place, 0 AS k, id AS node, 1.0::DOUBLE AS score FROM cm UNION ALL SELECT query_id, place, k, node, 0.75::DOUBLE FROM cm JOIN me USING (id) WHERE k <= greatest(1, 8 // many))
 SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place, k) AS rank, node, score FROM ro QUALIFY rank <= 8""")
