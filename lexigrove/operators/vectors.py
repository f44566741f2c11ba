"""Vector search: exact cosine top k of a stated query set against all rows, in blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.operators.lexical import top_k
from lexigrove.shared import table

#: Values of query vectors that one pass takes along.
BLOCK_VALUES = 2_000_000


def l2_normalized(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_top_k(rows: DataFrame, queries: DataFrame, k: int, block_values: int = BLOCK_VALUES) -> DataFrame:
    """query_id, vec_id, score, rank of the k rows nearest to each query by cosine, ties by vec_id; scores to 6 places.

    rows: vec_id, vector; queries: query_id, vector; ids are numbers or strings. Null ids and vectors don't take part, zero vectors score 0, vectors of another
    length than the query's raise. Each partition keeps the k best of its own rows for each query before anything is shuffled.
    """
    queries = queries.select("query_id", "vector").where(F.col("vector").isNotNull())
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {rows.schema['vec_id'].dataType.simpleString()}, score double"
    values = queries.agg(F.sum(F.size("vector"))).first()[0] or 0
    passes, out = max(1, -(-values // block_values)), None
    for p in range(passes):
        some = queries if passes == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p)
        held = some.collect()  # one block of the stated query set
        if not held:
            continue
        part = rows.select("vec_id", "vector").where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).mapInPandas(_nearest([r.query_id for r in held], [r.vector for r in held], k), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], f"{schema}, rank int")
    return top_k(out, k, [F.col("score").desc(), F.col("vec_id")])


def _nearest(ids: list, vectors: list, k: int):
    def unit(m: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = unit(np.array(vectors, np.float64))
        best_id, best = None, np.full((len(ids), 0), 0.0)
        for frame in frames:
            if not len(frame):
                continue
            m = np.stack(frame["vector"].to_list()).astype(np.float64)
            if m.shape[1] != q.shape[1]:
                raise ValueError(f"a vector has {m.shape[1]} values, the queries have {q.shape[1]}")
            score = np.concatenate((best, np.round(q @ unit(m).T, 6)), axis=1)
            own = frame["vec_id"].to_numpy()
            own = np.broadcast_to(own.astype(str) if own.dtype == object else own, (len(ids), len(frame)))
            who = own if best_id is None else np.concatenate((best_id, own), axis=1)
            order = np.lexsort((who, -score))[:, :k]
            best, best_id = np.take_along_axis(score, order, 1), np.take_along_axis(who, order, 1)
        if best_id is not None:
            yield pd.DataFrame({"query_id": np.repeat(np.array(ids), best.shape[1]), "vec_id": best_id.ravel(), "score": best.ravel()})

    return scan


def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector whose id is divisible by 50, against all."""
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return cosine_top_k(rows, rows.where(F.col("vec_id") % 50 == 0).withColumnRenamed("vec_id", "query_id"), 8)


def vector_label_quality(spark: SparkSession, folder: str) -> DataFrame:
    """How many of the neighbours have the query's own label, by label."""
    e = table(spark, folder, "embeddings")
    hits = vector_topk(spark, folder).join(e.select("vec_id", "label"), "vec_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), "query_id")
    return hits.groupBy("query_label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("label") == F.col("query_label")).cast("double")), 6).alias("precision"))


def vector_norms(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, folder, "embeddings").select("vec_id", F.round(dot(l2_normalized(v), l2_normalized(v)), 6).alias("unit"), F.size(v).alias("dimension"))


_TOP = """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 s AS (SELECT q.vec_id AS query_id, q.label AS query_label, v.vec_id, v.label, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v AS q, v WHERE q.vec_id % 50 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""
QUERIES = {f.__name__: f for f in (vector_topk, vector_label_quality, vector_norms)}
ORACLES = {
    "vector_topk": _TOP + " SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 8",
    "vector_label_quality": _TOP + " SELECT query_label, count(*) AS n, round(avg(CAST(label = query_label AS DOUBLE)), 6) AS precision FROM r WHERE rank <= 8 GROUP BY 1",
    "vector_norms": "SELECT vec_id, CAST(1 AS DOUBLE) AS unit, len(embedding) AS dimension FROM embeddings",
}
