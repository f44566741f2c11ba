"""Fusion of ranked lists: reciprocal ranks under several identities of a result, and merges of bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrove.functions.text import TOKENS_SQL
from lexigrove.operators import lexical as lx
from lexigrove.shared import table

RRF_K = 60


def identity(retriever: Column, path: Column, section: Column, chunk: Column, apart: tuple[str, ...] = ()) -> Column:
    """Namespace, path, section and chunk (else section) of a result, without letter case. Retrievers named in `apart` have namespaces of their own."""
    space = F.when(retriever.isin(*apart), retriever).when(path.startswith("graph://"), "graph").otherwise("wiki") if apart else F.when(path.startswith("graph://"), "graph").otherwise("wiki")
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return F.struct(space.alias("space"), low(path).alias("path"), low(section).alias("section"), low(F.coalesce(chunk.cast("string"), section)).alias("chunk"))


def coarse_identity(retriever: Column, path: Column) -> Column:
    return F.struct(retriever.alias("retriever"), F.lower(path).alias("path"))


def rrf(results: DataFrame, key: list[str], k: int = RRF_K, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of results (query_id, list, rank, score, title and the key columns).

    A row for each query and key: rrf, the sum of weight / (k + rank); and the score, title and list of its best-scored result.
    Ranks count from 1 in each list; lists whose weight is 0 or less are left out, lists without a weight count 1.
    """
    w = F.lit(1.0)
    for name, x in (weights or {}).items():
        w = F.when(F.col("list") == name, float(x)).otherwise(w)
    best = F.struct("score", (-F.col("rank")).alias("near"), "list", "title")
    return (
        results.withColumn("w", w).where("w > 0").groupBy("query_id", *key)
        .agg(F.sum(F.col("w") / (k + F.col("rank"))).alias("rrf"), F.max(best).alias("best"))
        .select("query_id", *key, F.round("rrf", 9).alias("rrf"), F.col("best.score").alias("score"), F.col("best.title").alias("title"))
    )


def fused(results: DataFrame, key: list[str], limit: int, **options) -> DataFrame:
    """The best `limit` of rrf() by rrf, score, title and key, all descending but the key."""
    return lx.top_k(rrf(results, key, **options), limit, [F.col("rrf").desc(), F.col("score").desc(), F.lower("title").desc(), *key])


def merge_first_seen(bundles: DataFrame, bonus: float = 0.10) -> DataFrame:
    """Contexts (query_id, bundle, rank, doc_id, score) of several bundles: the score of the first bundle that has one, plus bonus for each further bundle."""
    return bundles.groupBy("query_id", "doc_id").agg(F.min_by("score", F.struct("bundle", "rank")).alias("first"), F.countDistinct("bundle").alias("n_bundles")).select(
        "query_id", "doc_id", "n_bundles", F.round(F.col("first") + bonus * (F.col("n_bundles") - 1), 6).alias("score"))


def keep_first(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; the union of lists keeps what came first."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def set_operations(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Sizes of the sets of keys: of each alone, in common, and the multiset intersection."""
    left, right = a.groupBy(*key).agg(F.count(F.lit(1)).alias("na")), b.groupBy(*key).agg(F.count(F.lit(1)).alias("nb"))
    both = left.join(right, key, "full_outer")
    return both.agg(F.count_if(F.col("nb").isNull()).alias("only_left"), F.count_if(F.col("na").isNull()).alias("only_right"), F.count_if(F.col("na").isNotNull() & F.col("nb").isNotNull()).alias("common"), F.sum(F.coalesce(F.least("na", "nb") * F.when(F.col("na").isNotNull() & F.col("nb").isNotNull(), 1).otherwise(0), F.lit(0))).alias("multiset"))


# --- queries -------------------------------------------------------------------------------------------------------------


def _lists(spark: SparkSession, folder: str, k: int) -> DataFrame:
    docs, questions = table(spark, folder, "documents"), lx.questions_of(spark, folder)
    one = lx.ranked(lx.bm25(lx.LexicalIndex.build(docs, asked=questions), questions), k).withColumn("list", F.lit("wiki"))
    two = lx.ranked(lx.prefix_score(docs, questions), k).withColumn("list", F.lit("graph"))
    return one.unionByName(two).join(docs.select("doc_id", "title", "page_type"), "doc_id")


def fusion_rrf(spark: SparkSession, folder: str) -> DataFrame:
    return fused(_lists(spark, folder, 20), ["doc_id"], 10)


def fusion_weighted(spark: SparkSession, folder: str) -> DataFrame:
    return fused(_lists(spark, folder, 20), ["doc_id"], 10, weights={"wiki": 1.2, "graph": 0.8})


def fusion_coarse(spark: SparkSession, folder: str) -> DataFrame:
    """Results of one page type are one: the coarser identity."""
    return fused(_lists(spark, folder, 20), ["page_type"], 5)


def fusion_bundles(spark: SparkSession, folder: str) -> DataFrame:
    return merge_first_seen(_lists(spark, folder, 12).withColumn("bundle", F.when(F.col("list") == "wiki", 0).otherwise(1)))


def fusion_sets(spark: SparkSession, folder: str) -> DataFrame:
    lists = _lists(spark, folder, 12)
    return set_operations(lists.where("list = 'wiki'"), lists.where("list = 'graph'"), ["query_id", "doc_id"])


_LISTS = f"""WITH {lx.BM25_SQL}, t AS ({lx._TERM_Q}),
 h AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+')) AS token, 10 AS v FROM documents
       UNION ALL SELECT doc_id, unnest(regexp_extract_all(lower(concat_ws(' ', title, text)), '[a-z0-9]+')), 1 FROM documents),
 hh AS (SELECT doc_id, token, sum(v) AS v FROM h GROUP BY 1, 2), u AS (SELECT DISTINCT term FROM t),
 m AS (SELECT doc_id, term, sum(v) AS v FROM hh JOIN u ON CASE WHEN len(term) <= 2 THEN token = term ELSE starts_with(token, term) END GROUP BY 1, 2),
 g AS (SELECT query_id, doc_id, CAST(sum(v) AS DOUBLE) AS score FROM t JOIN m USING (term) GROUP BY 1, 2),
 lists AS (SELECT *, 'wiki' AS list, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s
           UNION ALL SELECT *, 'graph', row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) FROM g),
 ls AS (SELECT l.*, title, page_type FROM lists l JOIN documents USING (doc_id))"""


def _fused_sql(key: str, limit: int, weight: str = "1.0") -> str:
    return f"""{_LISTS}, r AS (SELECT query_id, {key}, round(sum({weight} / (60 + rank)), 9) AS rrf, max({{'score': score, 'near': -rank, 'list': list, 'title': title}}) AS best FROM ls WHERE rank <= 20 GROUP BY 1, 2),
 o AS (SELECT query_id, {key}, rrf, best.score AS score, best.title AS title FROM r)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, score DESC, lower(title) DESC, {key}) AS rank FROM o) WHERE rank <= {limit}"""


QUERIES = {f.__name__: f for f in (fusion_rrf, fusion_weighted, fusion_coarse, fusion_bundles, fusion_sets)}
ORACLES = {
    "fusion_rrf": _fused_sql("doc_id", 10),
    "fusion_weighted": _fused_sql("doc_id", 10, "CASE list WHEN 'wiki' THEN 1.2 ELSE 0.8 END"),
    "fusion_coarse": _fused_sql("page_type", 5),
    "fusion_bundles": f"""{_LISTS} SELECT query_id, doc_id, count(DISTINCT list) AS n_bundles, round(arg_min(score, {{'b': CASE list WHEN 'wiki' THEN 0 ELSE 1 END, 'r': rank}}) + 0.1 * (count(DISTINCT list) - 1), 6) AS score FROM ls WHERE rank <= 12 GROUP BY 1, 2""",
    "fusion_sets": f"""{_LISTS}, a AS (SELECT query_id, doc_id FROM ls WHERE rank <= 12 AND list = 'wiki'), b AS (SELECT query_id, doc_id FROM ls WHERE rank <= 12 AND list = 'graph')
 SELECT (SELECT count(*) FROM a ANTI JOIN b USING (query_id, doc_id)) AS only_left, (SELECT count(*) FROM b ANTI JOIN a USING (query_id, doc_id)) AS only_right,
   (SELECT count(*) FROM a SEMI JOIN b USING (query_id, doc_id)) AS common, (SELECT count(*) FROM a SEMI JOIN b USING (query_id, doc_id)) AS multiset""",
}
