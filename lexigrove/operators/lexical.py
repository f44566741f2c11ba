"""Ranked lexical retrieval over batches of questions.

Postings are counted once per index; a batch of questions meets them in one equi-join on the token, so that the work follows
the postings of the questions' own tokens. The index is three tables: postings, document lengths and the corpus statistics.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrove.functions.stemming import classic_all
from lexigrove.functions.text import TOKENS_SQL, terms, tokens
from lexigrove.shared import materialize, table

K1, B, TOP_K = 1.5, 0.75, 8
#: Questions of at most so many characters in all are broadcast; more are joined by shuffle.
BROADCAST_CHARS = 4_000_000
#: So many questions, of so many characters in all, are looked up at most: their tokens become a filter of the scan, which a stored
#: index answers from few row groups.
LOOKUP_QUESTIONS, LOOKUP_CHARS = 64, 20_000


@dataclass
class LexicalIndex:
    """docs: doc_id, length; postings: doc_id, token, tf, length; frequency: token, df, counted from the postings where it isn't given."""

    docs: DataFrame
    postings: DataFrame
    n_docs: int
    average: float
    frequency: DataFrame | None = None

    def stored(self) -> LexicalIndex:
        """The index with postings in order of the token and their document frequencies, both in the shared folder, for many questions."""
        postings = materialize(self.postings.repartitionByRange("token", "doc_id").sortWithinPartitions("token"), "postings_by_token")
        frequency = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        return LexicalIndex(self.docs, postings, self.n_docs, self.average, materialize(frequency.repartitionByRange("token").sortWithinPartitions("token"), "frequency"))

    @classmethod
    def build(cls, documents: DataFrame, text: str = "text", asked: DataFrame | None = None) -> LexicalIndex:
        """documents: doc_id, text. Null and empty texts count in the average length and have no postings.

        With asked, questions (query_id, question), the index is one for these alone: only postings of their tokens are made.
        Either way the texts are read once: lengths and postings are written together, a length as the posting of an empty token.
        """
        held = documents.select("doc_id", tokens(F.col(text)).alias("ts")).select("doc_id", F.size("ts").alias("length"), F.explode(F.concat(F.array(F.lit("")), "ts")).alias("token"))
        if asked is not None:
            wanted = question_tokens(asked).select("token").unionByName(asked.sparkSession.range(1).select(F.lit("").alias("token"))).distinct()
            held = held.join(F.broadcast(wanted) if small(asked) else wanted, "token", "left_semi")
        both = materialize(held.groupBy("doc_id", "length", "token").agg(F.count(F.lit(1)).alias("tf")), "postings")
        docs = both.where("token = ''")
        docs = docs.select("doc_id", "length", F.explode(F.sequence(F.lit(1), "tf")).alias("k")).drop("k")  # rows of one id and length count each
        n, total = docs.agg(F.count(F.lit(1)), F.sum("length")).first()
        return cls(docs, both.where("token <> ''"), n, (total or 0) / n if n else 0.0)


def question_tokens(questions: DataFrame, of: Column | None = None) -> DataFrame:
    """query_id, token, qtf of questions (query_id, question); repeated tokens count as often as they stand."""
    ts = tokens(F.col("question")) if of is None else of
    return questions.select("query_id", F.explode(ts).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("qtf"))


def n_chars(questions: DataFrame) -> int:
    return questions.agg(F.sum(F.length("question"))).first()[0] or 0


def small(questions: DataFrame) -> bool:
    return n_chars(questions) <= BROADCAST_CHARS


def _local(spark: SparkSession, rows: list, schema: T.StructType) -> DataFrame:
    """Rows of the driver as a relation that needs no job."""
    types = [pa.string() if isinstance(f.dataType, T.StringType) else pa.int64() if isinstance(f.dataType, (T.LongType, T.IntegerType)) else pa.float64() for f in schema]
    held = pa.table({f.name: pa.array([r[f.name] for r in rows], t) for f, t in zip(schema, types, strict=True)})
    return spark.createDataFrame(held)


def _looked_up(questions: DataFrame) -> tuple[DataFrame, list[str]] | None:
    """Tokens of a few short questions with their counts, and all distinct ones, by way of the driver; null where there are more."""
    kind = questions.schema["query_id"].dataType
    if not isinstance(kind, (T.LongType, T.IntegerType, T.StringType)):
        return None
    held = questions.select("query_id", "question").limit(LOOKUP_QUESTIONS + 1).collect()
    if len(held) > LOOKUP_QUESTIONS or sum(len(r.question or "") for r in held) > LOOKUP_CHARS:
        return None
    spark = questions.sparkSession
    split = _local(spark, held, questions.select("query_id", "question").schema).select("query_id", tokens(F.col("question")).alias("ts")).collect()
    n = Counter((r.query_id, t) for r in split for t in r.ts)
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("token", T.StringType()), T.StructField("qtf", T.LongType())])
    rows = [{"query_id": q, "token": t, "qtf": k} for (q, t), k in n.items()]
    return _local(spark, rows, schema), sorted({t for _, t in n})


def bm25(index: LexicalIndex, questions: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, doc_id, score of every document with a token of the question; scores are positive."""
    few, postings, frequency = True, index.postings, index.frequency
    found = _looked_up(questions)
    if found is not None:
        asked, words = found
        of_these = F.col("token").isin(words)
        postings = postings.where(of_these)
        frequency = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")) if frequency is None else frequency.where(of_these)
        frequency = _local(questions.sparkSession, frequency.collect(), frequency.schema)  # a row a token of these questions
    else:
        asked, few = question_tokens(questions), small(questions)
        if frequency is None:
            once = asked.select("token").distinct()
            frequency = postings.join(F.broadcast(once) if few else once, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (index.n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(frequency, "token").select("query_id", "token", (F.col("qtf") * idf).alias("weight"))
    weighed = F.broadcast(weighed) if few else weighed
    norm = 1 - b + b * (F.col("length") / (index.average or 1.0))
    part = F.col("weight") * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * norm)
    return postings.join(weighed, "token").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score")).where(F.col("score") > 0)


def top_k(scored: DataFrame, k: int, by: list[Column], per: str = "query_id") -> DataFrame:
    """The first k rows of each group, with their rank from 1."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy(*by))).where(F.col("rank") <= k)


def ranked(scored: DataFrame, k: int, places: int = 6) -> DataFrame:
    """Top k by score, ties by doc_id; scores to so many places."""
    return top_k(scored.withColumn("score", F.round("score", places)), k, [F.col("score").desc(), F.col("doc_id")])


def token_budget(contexts: DataFrame, budget: int, estimate: Column | None = None) -> DataFrame:
    """The leading contexts (query_id, rank, text) whose estimated tokens stay within the budget; the first is always kept.

    A budget of 0 or less keeps all. Estimates are at least 1, so that the running sum alone decides.
    """
    cost = F.greatest(F.lit(1), F.floor(F.length("text") / 4)) if estimate is None else estimate
    so_far = F.sum(cost).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    out = contexts.withColumn("tokens_so_far", so_far.cast("bigint"))
    return out if budget <= 0 else out.where((F.col("tokens_so_far") <= budget) | (F.col("rank") == 1))


def basic_search(index: LexicalIndex, evidence: DataFrame, questions: DataFrame, limit: int = TOP_K) -> DataFrame:
    """BM25 on evidence (doc_id, kind, section): the best 3 limit, text units by 1.15, plus .1 where the section shares a token with the question; then the best limit."""
    first = ranked(bm25(index, questions), 3 * limit).join(evidence.select("doc_id", "kind", tokens(F.col("section")).alias("st")), "doc_id").join(questions.select("query_id", tokens(F.col("question")).alias("qt")), "query_id")
    score = F.col("score") * F.when(F.col("kind") == "text_unit", 1.15).otherwise(1.0) + F.when(F.arrays_overlap("st", "qt"), 0.1).otherwise(0.0)
    return top_k(first.select("query_id", "doc_id", "kind", F.round(score, 8).alias("score")), limit, [F.col("score").desc(), F.col("doc_id")])


def prefix_score(rows: DataFrame, questions: DataFrame, title: str = "title", body: str = "text") -> DataFrame:
    """query_id, doc_id, score: for each term of the question 10 for each title token it is or begins, and 1 for each of title and body.

    Terms of one or two characters count as whole tokens only. Repeated terms count as often as they stand.
    """
    asked = questions.select("query_id", F.explode(terms(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n"))
    # A token meets the terms with its own first three characters, or itself if it is shorter, and of these the ones that it begins with.
    start = lambda c: F.substring(c, 1, 3).alias("start")
    wanted = asked.select("term").distinct().select("term", start("term"))
    wanted = F.broadcast(wanted) if small(questions) else wanted
    of = lambda c, w: rows.select("doc_id", F.explode(terms(c)).alias("token")).select("doc_id", "token", F.lit(w).alias("v"))
    held = of(F.col(title), 10.0).unionByName(of(F.concat_ws(" ", title, body), 1.0))
    met = held.withColumn("start", start("token")).join(wanted, "start").where(F.when(F.length("term") < 3, F.col("token") == F.col("term")).otherwise(F.startswith("token", "term")))
    hits = met.groupBy("doc_id", "term").agg(F.sum("v").alias("v"))
    return hits.join(asked, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("v") * F.col("n")).alias("score"))


KIND_PRIOR = {"community_reports": 1.10, "text_units": 1.05, "entities": 1.00, "relationships": 0.95}  # Fixed values: priors by kind


def occurrence_score(rows: DataFrame, questions: DataFrame, title: str = "title", body: str = "text", kind: Column | None = None) -> DataFrame:
    """query_id, doc_id, score: (8 title + body occurrences) of the distinct tokens, by the root of the number of tokens met and a prior by kind.

    Occurrences are substrings, which no equi-join finds: each text is read once by an automaton of the questions' tokens. These
    are a stated set of at most BROADCAST_CHARS characters; more questions are asked in blocks.
    """
    total = questions.agg(F.sum(F.length("question"))).first()[0] or 0
    passes = max(1, -(-total // BROADCAST_CHARS))
    prior = F.lit(1.0)
    if kind is not None:
        for k, v in KIND_PRIOR.items():
            prior = F.when(kind == k, v).otherwise(prior)
    of_id = rows.schema["doc_id"].dataType
    texts = rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.lower(F.coalesce(F.col(title), F.lit(""))).alias("t"), F.lower(F.coalesce(F.col(body), F.lit(""))).alias("b"), prior.alias("prior"))
    out = None
    for p in range(passes):
        some = questions if passes == 1 else questions.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p)
        asked = some.select("query_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term"))
        vocabulary = sorted(r.term for r in asked.select("term").distinct().collect())
        met = texts.mapInPandas(_counter(vocabulary), "doc_id string, prior double, term string, v double").withColumn("doc_id", F.col("doc_id").cast(of_id))
        part = met.join(F.broadcast(asked), "term").groupBy("query_id", "doc_id", "prior").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n")).select("query_id", "doc_id", (F.col("v") * F.sqrt("n") * F.col("prior")).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def _counter(vocabulary: list[str]):
    """Occurrences in titles and bodies of each term; those of one or two characters only as words."""
    long, short = [w for w in vocabulary if len(w) > 2], frozenset(w for w in vocabulary if len(w) <= 2)

    def counts(text: str, automaton) -> dict[str, int]:
        n: Counter[str] = Counter()
        if automaton is None:
            n.update({w: k for w in long if (k := text.count(w))})
        elif long:
            last: dict[str, int] = {}
            for end, w in automaton.iter(text):
                if end - len(w) >= last.get(w, -1):  # as str.count, without overlaps
                    last[w] = end
                    n[w] += 1
        if short:
            n.update(w for w in re.findall(r"\w+", text) if w in short)
        return n

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for w in long:
                automaton.add_word(w, w)
            automaton.make_automaton()
        except ImportError:
            automaton = None
        for frame in frames:
            out = []
            for doc, t, b, prior in zip(frame["doc_id"], frame["t"], frame["b"], frame["prior"], strict=True):
                v = counts(b, automaton)
                for w, n in counts(t, automaton).items():
                    v[w] += 8 * n
                out += [(doc, prior, w, float(n)) for w, n in v.items()]
            yield pd.DataFrame(out, columns=["doc_id", "prior", "term", "v"])

    return scan


def fielded_search(chunks: DataFrame, questions: DataFrame, weights: dict[str, float], k1: float = 1.2, b: float = 0.75, stems: bool = False) -> DataFrame:
    """query_id, doc_id, score of chunks (doc_id and the weighted fields): BM25 with each field's term frequency times its weight; stopwords count.

    idf is ln((N - df + .5) / (df + .5)), at least 1e-6. With stems, words count by their classic stem.
    """
    of = (lambda c: classic_all(terms(c))) if stems else terms
    fields = [chunks.select("doc_id", F.lit(w).alias("w"), of(F.col(f)).alias("ts")) for f, w in weights.items()]
    every = fields[0]
    for f in fields[1:]:
        every = every.unionByName(f)
    n = chunks.count()
    lengths = every.groupBy("doc_id").agg(F.sum(F.size("ts")).alias("length"))
    average = lengths.agg(F.avg("length")).first()[0] or 1.0
    tf = every.select("doc_id", "w", F.explode("ts").alias("token")).groupBy("doc_id", "token").agg(F.sum("w").alias("tf"))
    asked = questions.select("query_id", F.explode(F.array_distinct(of(F.col("question")))).alias("token"))
    tf = tf.join(asked.select("token").distinct(), "token", "left_semi")
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.lit(1e-6), F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / average))
    return tf.join(df, "token").join(lengths, "doc_id").join(asked, "token").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def first_per_page(hits: DataFrame, k: int) -> DataFrame:
    """The best chunk of each page (query_id, page, doc_id, score), then the best k pages."""
    best = hits.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "page").orderBy(F.col("score").desc(), "doc_id"))).where("n = 1").drop("n")
    return top_k(best, k, [F.col("score").desc(), F.col("doc_id")])


# --- queries -------------------------------------------------------------------------------------------------------------


def questions_of(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_questions").select(F.col("item_id").alias("query_id"), "question")


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """All evaluation questions over all documents, the best 8 of each under a budget of 2000 tokens."""
    docs = table(spark, folder, "documents")
    questions = questions_of(spark, folder)
    hits = ranked(bm25(LexicalIndex.build(docs, asked=questions), questions), TOP_K)
    return token_budget(hits.join(docs.select("doc_id", "text"), "doc_id"), 2000).select("query_id", "doc_id", "rank", "score", "tokens_so_far")


def lexical_postings(spark: SparkSession, folder: str) -> DataFrame:
    index = LexicalIndex.build(table(spark, folder, "documents"))
    return index.postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"), F.max("tf").alias("most"))


def lexical_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return LexicalIndex.build(table(spark, folder, "documents")).docs


def basic_search_topk(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    evidence = docs.select("doc_id", F.when(F.col("page_type") == "source", "text_unit").otherwise("chunk").alias("kind"), F.col("title").alias("section"))
    questions = questions_of(spark, folder)
    return basic_search(LexicalIndex.build(docs, asked=questions), evidence, questions)


def prefix_search_topk(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(prefix_score(table(spark, folder, "documents"), questions_of(spark, folder)), 10)


def occurrence_search_topk(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(occurrence_score(table(spark, folder, "documents"), questions_of(spark, folder), kind=F.lit("text_units")), 8)


def fielded_search_topk(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    hits = fielded_search(docs.select("doc_id", "title", "page_type", "text"), questions_of(spark, folder), {"title": 6.0, "page_type": 2.0, "text": 1.0})
    hits = hits.join(docs.select("doc_id", F.col("title").alias("page")), "doc_id").withColumn("score", F.round("score", 6))
    return first_per_page(hits, 5).select("query_id", "doc_id", "page", "rank", "score")


def stemmed_search_topk(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return ranked(fielded_search(docs.select("doc_id", "title", "page_type", "text"), questions_of(spark, folder), {"title": 6.0, "page_type": 2.0, "text": 1.0}, stems=True), 5)


_Q = "q AS (SELECT item_id AS query_id, question, " + TOKENS_SQL.replace("text", "question") + " AS qt FROM eval_questions)"
_D = f"d AS (SELECT doc_id, title, page_type, text, {TOKENS_SQL} AS ts, len({TOKENS_SQL}) AS length FROM documents)"
BM25_SQL = f"""{_Q}, {_D}, st AS (SELECT count(*) AS n, avg(length) AS a FROM d),
p AS (SELECT doc_id, length, token, count(*) AS tf FROM (SELECT doc_id, length, unnest(ts) AS token FROM d) GROUP BY ALL),
f AS (SELECT token, count(*) AS df FROM p GROUP BY 1), qq AS (SELECT query_id, unnest(qt) AS token FROM q),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / a))), 6) AS score
      FROM qq JOIN p USING (token) JOIN f USING (token), st GROUP BY 1, 2)"""


def bm25_sql(name: str, docs: str, questions: str) -> str:
    """CTEs in SQL whose last, `name`, is bm25() of docs (doc_id, text) and questions (query_id, question), to 6 places."""
    q = TOKENS_SQL.replace("text", "question")
    return f"""{name}_d AS MATERIALIZED (SELECT doc_id, {TOKENS_SQL} AS ts FROM {docs}), {name}_n AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM {name}_d),
 {name}_p AS MATERIALIZED (SELECT doc_id, length, token, count(*) AS tf FROM (SELECT doc_id, len(ts) AS length, unnest(ts) AS token FROM {name}_d) GROUP BY ALL), {name}_f AS (SELECT token, count(*) AS df FROM {name}_p GROUP BY 1), {name}_q AS (SELECT query_id, unnest({q}) AS token FROM {questions}),
 {name} AS MATERIALIZED (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / a))), 6) AS score FROM {name}_q JOIN {name}_p USING (token) JOIN {name}_f USING (token), {name}_n GROUP BY 1, 2)"""


_TERM_Q = "SELECT item_id AS query_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS term FROM eval_questions"
QUERIES = {f.__name__: f for f in (bm25_topk, lexical_postings, lexical_lengths, basic_search_topk, prefix_search_topk, occurrence_search_topk, fielded_search_topk, stemmed_search_topk)}
ORACLES = {
    "bm25_topk": f"""WITH {BM25_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s),
        b AS (SELECT query_id, doc_id, rank, score, CAST(sum(greatest(1, length(text) // 4)) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS tokens_so_far FROM r JOIN documents USING (doc_id) WHERE rank <= 8)
        SELECT * FROM b WHERE tokens_so_far <= 2000 OR rank = 1""",
    "lexical_postings": f"WITH {BM25_SQL} SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total, max(tf) AS most FROM p GROUP BY 1",
    "lexical_lengths": f"WITH {_D} SELECT doc_id, length FROM d",
    "basic_search_topk": f"""WITH {BM25_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rk FROM s),
        b AS (SELECT query_id, doc_id, CASE WHEN page_type = 'source' THEN 'text_unit' ELSE 'chunk' END AS kind,
          round(score * CASE WHEN page_type = 'source' THEN 1.15 ELSE 1 END + CASE WHEN len(list_intersect({TOKENS_SQL.replace("text", "title")}, qt)) > 0 THEN 0.1 ELSE 0 END, 8) AS score
          FROM r JOIN d USING (doc_id) JOIN q USING (query_id) WHERE rk <= 24)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b) WHERE rank <= 8""",
    "prefix_search_topk": f"""WITH q AS ({_TERM_Q}),
        h AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+')) AS token, 10 AS v FROM documents
              UNION ALL SELECT doc_id, unnest(regexp_extract_all(lower(concat_ws(' ', title, text)), '[a-z0-9]+')), 1 FROM documents),
        hh AS (SELECT doc_id, token, sum(v) AS v FROM h GROUP BY 1, 2), u AS (SELECT DISTINCT term FROM q),
        m AS (SELECT doc_id, term, sum(v) AS v FROM hh JOIN u ON CASE WHEN len(term) <= 2 THEN token = term ELSE starts_with(token, term) END GROUP BY 1, 2),
        s AS (SELECT query_id, doc_id, CAST(sum(v) AS DOUBLE) AS score FROM q JOIN m USING (term) GROUP BY 1, 2)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
    "occurrence_search_topk": f"""WITH {_Q}, u AS (SELECT DISTINCT query_id, unnest(qt) AS term FROM q), w AS (SELECT DISTINCT term FROM u),
        n AS (SELECT doc_id, term, CASE WHEN len(term) <= 2 THEN 8 * len(regexp_extract_all(lower(title), '\\b' || term || '\\b')) + len(regexp_extract_all(lower(text), '\\b' || term || '\\b'))
          ELSE 8 * ((len(lower(title)) - len(replace(lower(title), term, ''))) // len(term)) + (len(lower(text)) - len(replace(lower(text), term, ''))) // len(term) END AS v FROM documents, w),
        s AS (SELECT query_id, doc_id, round(sum(v) * sqrt(count(*)) * 1.05, 6) AS score FROM u JOIN n USING (term) WHERE v > 0 GROUP BY 1, 2)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 8""",
    "fielded_search_topk": f"""WITH x AS (SELECT doc_id, 6.0 AS w, regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+') AS ts FROM documents
          UNION ALL SELECT doc_id, 2.0, regexp_extract_all(lower(coalesce(page_type, '')), '[a-z0-9]+') FROM documents UNION ALL SELECT doc_id, 1.0, regexp_extract_all(lower(text), '[a-z0-9]+') FROM documents),
        l AS (SELECT doc_id, sum(len(ts)) AS length FROM x GROUP BY 1), a AS (SELECT avg(length) AS a, count(*) AS n FROM l),
        tf AS (SELECT doc_id, token, sum(w) AS tf FROM (SELECT doc_id, w, unnest(ts) AS token FROM x) GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
        q AS (SELECT DISTINCT query_id, term AS token FROM ({_TERM_Q})),
        s AS (SELECT query_id, doc_id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / a))), 6) AS score FROM q JOIN tf USING (token) JOIN df USING (token) JOIN l USING (doc_id), a GROUP BY 1, 2),
        b AS (SELECT query_id, doc_id, title AS page, score, row_number() OVER (PARTITION BY query_id, title ORDER BY score DESC, doc_id) AS k FROM s JOIN documents USING (doc_id))
        SELECT query_id, doc_id, page, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b WHERE k = 1) WHERE rank <= 5""",
}
