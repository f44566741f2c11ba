"""Retrieval and answer metrics, their summaries and confidence intervals, over all samples at once."""

from __future__ import annotations

import random
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrove.functions.fuzzy import common_length
from lexigrove.functions.text import mentions_insufficient, normalize_identifier, unicode_words
from lexigrove.operators import lexical as lx
from lexigrove.shared import table

TEXT_CAP = 4000


def fragment_matches(fragment: Column, hay: Column) -> Column:
    """Whether a fragment stands in a text: with a blank, hyphen, slash or dot as a substring, else as a word; without letter case."""
    f = F.lower(F.trim(fragment))
    word = F.regexp_like(hay, F.concat(F.lit(r"(?i)(?<![A-Za-z0-9_])\Q"), f, F.lit(r"\E(?![A-Za-z0-9_])")))
    return (f != "") & F.when(f.rlike(r"[ \t\-/.]"), F.lower(hay).contains(f)).otherwise(word)


def relevance(contexts: DataFrame, questions: DataFrame) -> DataFrame:
    """Each context (query_id, rank, hay) of a question (query_id, expected array) with the expected fragments that it has."""
    return contexts.join(questions.select("query_id", "expected"), "query_id").select("query_id", "rank", F.filter("expected", lambda f: fragment_matches(f, F.col("hay"))).alias("matched"))


def retrieval_scores(relevant: DataFrame, questions: DataFrame, k: int = lx.TOP_K) -> DataFrame:
    """recall, precision, hit, mrr and ndcg at k for each question; null where nothing is expected.

    recall: distinct expected fragments found in the first k; precision divides by k; mrr looks at all ranks; the ideal of ndcg
    has the found contexts first. A question without contexts scores 0.
    """
    rel, top = F.size("matched") > 0, F.col("rank") <= k
    gain = F.when(rel & top, 1 / F.log2(F.col("rank") + 1))
    by = relevant.groupBy("query_id").agg(
        F.count_if(rel & top).alias("n_rel"), F.min(F.when(rel, F.col("rank"))).alias("first"), F.sum(gain).alias("dcg"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.when(top, F.col("matched")))))).alias("n_found"), F.count(F.lit(1)).alias("retrieved"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("n_rel")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    known = F.size("expected") > 0
    zero = lambda c: F.when(known, F.round(F.coalesce(c, F.lit(0.0)), 6))
    return questions.join(by, "query_id", "left").select(
        "query_id", zero(F.col("n_found") / F.size("expected")).alias("recall"), zero(F.col("n_rel") / k).alias("precision"), zero((F.col("n_rel") > 0).cast("double")).alias("hit"),
        zero(1 / F.col("first")).alias("mrr"), zero(F.when(F.col("n_rel") > 0, F.col("dcg") / ideal)).alias("ndcg"), F.coalesce("retrieved", F.lit(0)).alias("retrieved"))


def token_f1(prediction: Column, reference: Column) -> Column:
    """F1 of the multisets of words; 0 where either has none."""
    p, r = unicode_words(prediction), unicode_words(reference)
    common = F.aggregate(F.array_distinct(p), F.lit(0), lambda s, w: s + F.least(F.size(F.filter(p, lambda x: x == w)), F.size(F.filter(r, lambda x: x == w))))
    return F.when(F.size(p) + F.size(r) > 0, 2 * common / (F.size(p) + F.size(r))).otherwise(0.0)


@F.pandas_udf(T.DoubleType())
def rouge_l(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of words."""

    def score(a: str | None, b: str | None) -> float:
        x, y = re.findall(r"\w+", (a or "").lower()), re.findall(r"\w+", (b or "").lower())
        n = common_length(x, y)
        return 2 * n / (len(x) + len(y)) if n else 0.0

    return pd.Series([score(a, b) for a, b in zip(prediction, reference, strict=True)])


def citation_scores(samples: DataFrame) -> DataFrame:
    """sample_id, citations, valid ones, validity and grounded of samples (retrieved_contexts, citations, insufficient_evidence, insufficient_expected).

    A citation is valid if its reference, or its path without the anchor, is one of the contexts'. Without citations validity is 1
    only for a rightly refused answer. Null lists are empty, null flags false.
    """
    refs = F.filter(F.transform(F.coalesce("retrieved_contexts", F.expr("cast(array() as array<struct<text:string,source_id:string,ref:string,score:double>>)")), lambda c: c["ref"]), lambda r: r.isNotNull() & (r != ""))
    path = lambda r: F.substring_index(r, "#", 1)
    paths = F.transform(refs, path)
    cited = F.coalesce("citations", F.expr("cast(array() as array<string>)"))
    valid = F.size(F.filter(cited, lambda c: F.array_contains(refs, c) | F.array_contains(paths, path(c))))
    refused, expected = F.coalesce("insufficient_evidence", F.lit(False)), F.coalesce("insufficient_expected", F.lit(False))
    right = F.when(refused & expected, 1.0).otherwise(0.0)
    n = F.size(cited)
    return samples.select("*", n.alias("n_citations"), valid.alias("n_valid"), F.when(n > 0, valid / n).otherwise(right).alias("validity"), F.when(~refused & (valid > 0), 1.0).otherwise(right).alias("grounded"), (refused == expected).cast("double").alias("refusal_correct"))


def melt_metrics(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, metric, value for each metric that isn't null."""
    return rows.unpivot(keys, [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value").where(F.col("value").isNotNull())


def summarize(melted: DataFrame, by: list[str]) -> DataFrame:
    """n and mean of each metric; nulls don't count."""
    return melted.groupBy(*by, "metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def leaderboard(summary: DataFrame, row: str, metrics: list[str]) -> DataFrame:
    return summary.groupBy(row).pivot("metric", metrics).agg(F.first("mean"))


def percentile_ci(values: list[float], n_boot: int = 1000, seed: int = 0, alpha: float = 0.05) -> tuple[float, float, float]:
    """Mean and the percentile bootstrap interval of one group's values, in the order given, by the seeded generator of the standard library."""
    if not values:
        return 0.0, 0.0, 0.0
    n, mean = len(values), sum(values) / len(values)
    if n == 1:
        return mean, mean, mean
    draw = random.Random(seed).randrange
    means = sorted(sum(values[draw(n)] for _ in range(n)) / n for _ in range(n_boot))
    return mean, means[int(alpha / 2 * n_boot)], means[min(n_boot - 1, int((1 - alpha / 2) * n_boot))]


def bootstrap(melted: DataFrame, by: list[str], n_boot: int = 200, seed: int = 0, alpha: float = 0.05, unit: list[str] | None = None) -> DataFrame:
    """Mean and bootstrap interval of each metric in each group, at any size: every row draws a Poisson weight for each resample.

    The weights come from a hash of (seed, resample, metric, unit), so that resamples are summed by partial aggregation, no group
    is gathered in one place and a rerun gives the same. unit: columns that tell the drawn units apart (by default all); rows
    that agree in them are drawn together. percentile_ci() is the exact resampling for a single small group.
    """
    key = [*by, "metric"]
    of = melted.columns if unit is None else ["metric", *unit]
    u = lambda b: F.pmod(F.xxhash64(F.lit(seed), b, *of), F.lit(1 << 52)) / float(1 << 52)
    # The inverse of the Poisson(1) distribution function.
    cuts = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
    rows = melted.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    rows = rows.withColumn("u", u(F.col("b"))).withColumn("w", sum(((F.col("u") >= c).cast("int") for c in cuts), F.lit(0)))
    means = rows.groupBy(*key, "b").agg((F.sum(F.col("w") * F.col("value")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    ci = means.groupBy(*key).agg(F.percentile("m", F.lit(alpha / 2)).alias("low"), F.percentile("m", F.lit(1 - alpha / 2)).alias("high"))
    return summarize(melted, by).join(ci, key)


def coverage_rates(samples: DataFrame) -> DataFrame:
    """sample_id, share of the question's identifiers in the answer, and comprehensiveness: words / 180, at most 1."""
    q, a = F.array_distinct(F.split(normalize_identifier(F.col("question")), " ")), F.split(normalize_identifier(F.coalesce("answer", F.lit(""))), " ")
    return samples.select("sample_id", F.round(F.size(F.array_intersect(q, a)) / F.size(q), 6).alias("coverage"), F.round(F.least(F.lit(1.0), F.size(F.filter(F.split(F.coalesce("answer", F.lit("")), r"\s+"), lambda w: w != "")) / 180), 6).alias("comprehensiveness"))


# --- queries -------------------------------------------------------------------------------------------------------------


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_questions").select(F.col("item_id").alias("query_id"), "question", F.coalesce("expected_entities", F.expr("cast(array() as array<string>)")).alias("expected"))


def eval_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    docs, questions = table(spark, folder, "documents"), _questions(spark, folder)
    hits = lx.ranked(lx.bm25(lx.LexicalIndex.build(docs, asked=questions), questions), 20)
    contexts = hits.join(docs.select("doc_id", F.concat_ws(" ", "source_id", "title", F.substring("text", 1, TEXT_CAP)).alias("hay")), "doc_id")
    return retrieval_scores(relevance(contexts, questions), questions)


def eval_retrieval_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = eval_retrieval(spark, folder).join(table(spark, folder, "eval_questions").select(F.col("item_id").alias("query_id"), "split"), "query_id")
    return summarize(melt_metrics(rows, ["query_id", "split"], ["recall", "precision", "hit", "mrr", "ndcg"]), ["split"])


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    return citation_scores(table(spark, folder, "rag_samples").withColumn("insufficient_expected", mentions_insufficient(F.coalesce("answer", F.lit("")))))


def eval_citations(spark: SparkSession, folder: str) -> DataFrame:
    return _samples(spark, folder).select("sample_id", "n_citations", "n_valid", F.round("validity", 6).alias("validity"), "grounded", "refusal_correct")


def eval_token_f1(spark: SparkSession, folder: str) -> DataFrame:
    """Answers against their best context."""
    return table(spark, folder, "rag_samples").select("sample_id", F.round(token_f1(F.col("answer"), F.get("retrieved_contexts", F.lit(0))["text"]), 6).alias("token_f1"))


def eval_rouge_l(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "rag_samples").select("sample_id", F.round(rouge_l(F.col("answer"), F.get("retrieved_contexts", F.lit(0))["text"]), 6).alias("rouge_l"))


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    return melt_metrics(_samples(spark, folder), ["sample_id", "backend", "method"], ["validity", "grounded", "refusal_correct", "latency_seconds"])


def eval_summary(spark: SparkSession, folder: str) -> DataFrame:
    return summarize(_metrics(spark, folder), ["backend", "method"])


def eval_leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    return leaderboard(summarize(_metrics(spark, folder), ["backend"]), "backend", ["validity", "grounded", "refusal_correct", "latency_seconds"])


def eval_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    return bootstrap(_metrics(spark, folder), ["backend"], n_boot=100)


def eval_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return coverage_rates(table(spark, folder, "rag_samples"))


def eval_questions_review(spark: SparkSession, folder: str) -> DataFrame:
    """Side by side: the last answer of each backend to each question, backends in order, whatever they are called."""
    r = table(spark, folder, "rag_samples")
    last = r.groupBy("question_id", "backend").agg(F.max_by(F.coalesce("answer", F.lit("")), "sample_id").alias("answer"))
    return last.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_backends"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("backend", "answer"))), lambda x: F.concat(x["backend"], F.lit("\t"), x["answer"])), "\n").alias("answers"))  # a row a backend


def eval_context_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct contexts of each sample by reference, the first kept, with lag and lead of their scores."""
    x = table(spark, folder, "rag_samples").select("sample_id", F.posexplode("retrieved_contexts").alias("pos", "c")).select("sample_id", "pos", "c.ref", "c.score")
    first = x.withColumn("n", F.row_number().over(Window.partitionBy("sample_id", "ref").orderBy("pos"))).where("n = 1")
    w = Window.partitionBy("sample_id").orderBy("pos")
    return first.select("sample_id", "ref", F.row_number().over(w).alias("rank"), F.round(F.col("score") - F.lag("score").over(w), 6).alias("step"))


_HAY = f"concat_ws(' ', source_id, title, text[1:{TEXT_CAP}])"
_REL = f"""WITH {lx.BM25_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s),
 c AS (SELECT query_id, rank, {_HAY} AS hay FROM r JOIN documents USING (doc_id) WHERE rank <= 20), e AS (SELECT item_id AS query_id, split, coalesce(expected_entities, []) AS expected FROM eval_questions),
 m AS (SELECT query_id, rank, f, CASE WHEN trim(f) = '' THEN false WHEN regexp_matches(lower(trim(f)), '[ \\t\\-/.]') THEN contains(lower(hay), lower(trim(f)))
   ELSE regexp_matches(lower(hay), '(^|[^a-z0-9_])' || regexp_escape(lower(trim(f))) || '([^a-z0-9_]|$)') END AS hit FROM c JOIN (SELECT query_id, unnest(expected) AS f FROM e) USING (query_id)),
 k AS (SELECT query_id, rank, bool_or(coalesce(hit, false)) AS rel FROM c LEFT JOIN m USING (query_id, rank) GROUP BY 1, 2),
 a AS (SELECT query_id, count(*) FILTER (rel AND rank <= 8) AS n_rel, min(rank) FILTER (rel) AS first, sum(1 / log2(rank + 1)) FILTER (rel AND rank <= 8) AS dcg, count(*) AS retrieved FROM k GROUP BY 1),
 n AS (SELECT query_id, count(DISTINCT f) FILTER (hit AND rank <= 8) AS n_found FROM m GROUP BY 1),
 o AS (SELECT e.query_id, split, CASE WHEN len(expected) > 0 THEN round(coalesce(n_found / len(expected), 0), 6) END AS recall, CASE WHEN len(expected) > 0 THEN round(coalesce(n_rel / 8, 0), 6) END AS precision,
   CASE WHEN len(expected) > 0 THEN CAST(coalesce(n_rel, 0) > 0 AS DOUBLE) END AS hit, CASE WHEN len(expected) > 0 THEN round(coalesce(1 / first, 0), 6) END AS mrr,
   CASE WHEN len(expected) > 0 THEN round(CASE WHEN n_rel > 0 THEN dcg / list_sum(list_transform(range(1, n_rel + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) END AS ndcg, coalesce(retrieved, 0) AS retrieved
   FROM e LEFT JOIN a USING (query_id) LEFT JOIN n USING (query_id))"""
_EXPECTED = "regexp_matches(lower(coalesce(answer, '')), 'insufficient evidence|not enough evidence|cannot determine|can''t determine|not stated|not available')"
_CITED = f"""WITH x AS (SELECT *, coalesce(insufficient_evidence, false) AS refused, {_EXPECTED} AS expected, list_filter(list_transform(retrieved_contexts, lambda c: c.ref), lambda r: r <> '') AS refs, coalesce(citations, []) AS cited FROM rag_samples),
 y AS (SELECT *, len(cited) AS n_citations, len(list_filter(cited, lambda c: list_contains(refs, c) OR list_contains(list_transform(refs, lambda r: split_part(r, '#', 1)), split_part(c, '#', 1)))) AS n_valid, CASE WHEN refused AND expected THEN 1.0 ELSE 0.0 END AS right_ FROM x),
 z AS (SELECT *, CASE WHEN n_citations > 0 THEN n_valid / n_citations ELSE right_ END AS validity, CAST(CASE WHEN NOT refused AND n_valid > 0 THEN 1.0 ELSE right_ END AS DOUBLE) AS grounded, CAST(refused = expected AS DOUBLE) AS refusal_correct FROM y)"""
_MELT = _CITED + """, u AS (SELECT sample_id, backend, method, unnest(['validity', 'grounded', 'refusal_correct', 'latency_seconds']) AS metric, unnest([CAST(validity AS DOUBLE), CAST(grounded AS DOUBLE), refusal_correct, latency_seconds]) AS value FROM z)"""
_WORDS = lambda c: f"regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}_]+')"
QUERIES = {f.__name__: f for f in (eval_retrieval, eval_retrieval_summary, eval_citations, eval_token_f1, eval_rouge_l, eval_summary, eval_leaderboard, eval_bootstrap, eval_coverage, eval_questions_review, eval_context_ranks)}
ORACLES = {
    "eval_retrieval": _REL + " SELECT query_id, recall, precision, hit, mrr, ndcg, retrieved FROM o",
    "eval_retrieval_summary": _REL + """, u AS (SELECT split, unnest(['recall', 'precision', 'hit', 'mrr', 'ndcg']) AS metric, unnest([recall, precision, hit, mrr, ndcg]) AS value FROM o)
        SELECT split, metric, count(value) AS n, round(avg(value), 6) AS mean FROM u GROUP BY 1, 2 HAVING count(value) > 0""",
    "eval_citations": _CITED + " SELECT sample_id, n_citations, n_valid, round(validity, 6) AS validity, grounded, refusal_correct FROM z",
    # Rows of the table of common subsequences, word by word of the answer; a row grows from the left, so that a running maximum fills it.
    "eval_rouge_l": f"""WITH RECURSIVE w AS MATERIALIZED (SELECT sample_id, {_WORDS("answer")} AS p, {_WORDS("retrieved_contexts[1].text")} AS r FROM rag_samples), c AS MATERIALIZED (SELECT sample_id, unnest(r) AS word, generate_subscripts(r, 1) AS j FROM w), a AS MATERIALIZED (SELECT sample_id, unnest(p) AS word, generate_subscripts(p, 1) AS i FROM w),
        d AS (SELECT sample_id, 0::BIGINT AS i, j, 0::BIGINT AS v FROM c UNION ALL
          SELECT sample_id, i, j, max(greatest(v, g)) OVER (PARTITION BY sample_id ORDER BY j) FROM (SELECT d.sample_id, d.i + 1 AS i, d.j, d.v, CASE WHEN c.word = a.word THEN 1 + lag(d.v, 1, 0) OVER (PARTITION BY d.sample_id ORDER BY d.j) ELSE 0 END AS g FROM d JOIN a ON a.sample_id = d.sample_id AND a.i = d.i + 1 JOIN c ON c.sample_id = d.sample_id AND c.j = d.j) q),
        m AS (SELECT sample_id, max(v) AS n FROM d GROUP BY 1)
        SELECT sample_id, round(CASE WHEN coalesce(n, 0) > 0 THEN 2 * n / (len(p) + len(r)) ELSE 0 END, 6) AS rouge_l FROM w LEFT JOIN m USING (sample_id)""",
    "eval_token_f1": f"""WITH w AS (SELECT sample_id, {_WORDS("answer")} AS p, {_WORDS("retrieved_contexts[1].text")} AS r FROM rag_samples)
        SELECT sample_id, round(CASE WHEN len(p) + len(r) > 0 THEN 2 * coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda a: a = t)), len(list_filter(r, lambda a: a = t))))), 0) / (len(p) + len(r)) ELSE 0 END, 6) AS token_f1 FROM w""",
    "eval_summary": _MELT + " SELECT backend, method, metric, count(value) AS n, round(avg(value), 6) AS mean FROM u GROUP BY 1, 2, 3 HAVING count(value) > 0",
    "eval_leaderboard": _MELT + """ SELECT backend, round(avg(value) FILTER (metric = 'validity'), 6) AS validity, round(avg(value) FILTER (metric = 'grounded'), 6) AS grounded,
        round(avg(value) FILTER (metric = 'refusal_correct'), 6) AS refusal_correct, round(avg(value) FILTER (metric = 'latency_seconds'), 6) AS latency_seconds FROM u GROUP BY 1""",
    "eval_coverage": r"""WITH x AS (SELECT sample_id, coalesce(answer, '') AS a, list_distinct(string_split(trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')), ' ')) AS q FROM rag_samples)
        SELECT sample_id, round(len(list_intersect(q, string_split(trim(regexp_replace(lower(a), '[^a-z0-9]+', ' ', 'g')), ' '))) / len(q), 6) AS coverage,
          round(least(1.0, len(list_filter(regexp_split_to_array(a, '\s+'), lambda w: w <> '')) / 180), 6) AS comprehensiveness FROM x""",
    "eval_questions_review": """WITH l AS (SELECT question_id, backend, arg_max(coalesce(answer, ''), sample_id) AS answer FROM rag_samples GROUP BY 1, 2)
        SELECT question_id, count(*) AS n_backends, string_agg(backend || chr(9) || answer, chr(10) ORDER BY backend) AS answers FROM l GROUP BY 1""",
    "eval_context_ranks": """WITH x AS (SELECT sample_id, unnest(retrieved_contexts) AS c, generate_subscripts(retrieved_contexts, 1) AS pos FROM rag_samples),
        f AS (SELECT sample_id, c.ref AS ref, c.score AS score, pos, row_number() OVER (PARTITION BY sample_id, c.ref ORDER BY pos) AS n FROM x)
        SELECT sample_id, ref, row_number() OVER w AS rank, round(score - lag(score) OVER w, 6) AS step FROM f WHERE n = 1 WINDOW w AS (PARTITION BY sample_id ORDER BY pos)""",
}
