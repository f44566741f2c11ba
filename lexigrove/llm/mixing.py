"""Mixing sources to target weights.

The total is cut into blocks of equal token count. Sainte-Laguë apportionment gives the blocks to the sources by the
highest quotients share / (2 n + 1), then the blocks of a source to its shards by their size: integer quotas. In each
shard, documents are taken in a seeded order up to the quota; whole rounds first where the source is repeated.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrove.llm.tokens import VOCABULARY, token_count
from lexigrove.shared import materialize, table

BLOCK_TOKENS = 512
#: Shards of each source. The choice depends on their number, so it is a parameter and doesn't follow the rows; billions of documents want thousands.
SHARDS = 64


def source_key(c: Column) -> Column:
    """The name without letter case, outer whitespace and the difference of spaces, underscores and hyphens; null stays null."""
    t = F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", ""), r"(?U)[\s_\-]+", "-")
    return F.when(t != "", t)


def apportion(votes: list[float], seats: int) -> list[int]:
    """Sainte-Laguë: seats by the highest quotients votes / (2 n + 1); ties go to the earlier. Zero votes get none."""
    total = math.fsum(votes)
    if total <= 0 or seats <= 0:
        return [0] * len(votes)
    # Rounding at one common divisor is an apportionment of some number of seats; single seats then lead to the wanted one.
    got = [int(v * seats / total + 0.5) for v in votes]
    spare = seats - sum(got)
    if spare > 0:
        heap = [(-v / (2 * n + 1), i) for i, (v, n) in enumerate(zip(votes, got, strict=True)) if v > 0]
        heapq.heapify(heap)
        for _ in range(spare):
            _, i = heap[0]
            got[i] += 1
            heapq.heapreplace(heap, (-votes[i] / (2 * got[i] + 1), i))
    elif spare < 0:
        heap = [(v / (2 * n - 1), -i) for i, (v, n) in enumerate(zip(votes, got, strict=True)) if n > 0]
        heapq.heapify(heap)
        for _ in range(-spare):
            _, j = heap[0]
            got[-j] -= 1
            if got[-j]:
                heapq.heapreplace(heap, (votes[-j] / (2 * got[-j] - 1), j))
            else:
                heapq.heappop(heap)
    return got


def quotas(shards: dict[str, dict[int, int]], targets: dict[str, tuple[float, int]], total: int, block: int = BLOCK_TOKENS) -> list[tuple[str, int, int, int]]:
    """(source, shard, available tokens, quota in tokens) for each shard that gets any.

    shards: tokens by source and shard; targets: share and greatest number of repeats by source. A source that can't fill
    its blocks with all its repeats is given all it has; what it lacks goes to no other, whose shares are targets too.
    """
    names = sorted(targets)
    out = []
    shares = [max(0.0, targets[x][0] or 0.0) for x in names]
    seats = int(total // block * min(1.0, math.fsum(shares)) + 0.5)  # shares that sum to less than 1 leave the rest out
    for name, n in zip(names, apportion(shares, seats), strict=True):
        have, most = shards.get(name, {}), max(0, targets[name][1] or 0)
        keys = sorted(k for k, v in have.items() if v > 0)
        full = most * sum(have[k] for k in keys)
        if n * block >= full:
            out += [(name, k, have[k], most * have[k]) for k in keys if most]
        else:
            out += [(name, k, have[k], min(q * block, most * have[k])) for k, q in zip(keys, apportion([have[k] for k in keys], n), strict=True) if q]
    return out


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7, block: int = BLOCK_TOKENS, vocabulary: str = VOCABULARY, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """Chosen documents with their repeats, and the shares reached.

    documents: doc_id, text, source; targets: source, target_share, max_repeats. Both sources are compared by source_key.
    The total is the number of tokens of all documents, also of those whose source isn't listed or null; these are never
    chosen. Null and empty texts have no tokens and are never chosen; a null share or max_repeats counts as 0. Repeated
    target rows of one source: the greatest share and repeats hold. Repeated rows of a document are documents of their own.
    Shares differ from the quotas by half a document a shard at most.
    """
    spark = documents.sparkSession
    sized = documents.select("doc_id", source_key(F.col("source")).alias("source"), token_count(F.col("text"), vocabulary).alias("n_tokens"))
    sized = materialize(sized, "sized")
    total = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    wanted = targets.groupBy(source_key(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).where(F.col("source").isNotNull())
    listed = {r.source: (r.target_share or 0.0, r.max_repeats or 0) for r in wanted.collect()}  # one row for each source of the mixture
    draw = F.xxhash64(F.lit(seed), "doc_id")
    sharded = sized.where(F.col("n_tokens") > 0).where(F.col("source").isin(list(listed))).withColumn("shard", F.pmod(draw, F.lit(shards)).cast("int"))
    sums: dict[str, dict[int, int]] = {}
    for r in sharded.groupBy("source", "shard").agg(F.sum("n_tokens").alias("t")).collect():  # at most `shards` for each source
        sums.setdefault(r.source, {})[r.shard] = r.t
    quota = spark.createDataFrame(quotas(sums, listed, total, block), "source string, shard int, available bigint, quota bigint")
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rounds = F.floor(F.col("quota") / F.col("available"))
    rest = F.col("quota") - rounds * F.col("available")
    chosen = (
        sharded.join(F.broadcast(quota), ["source", "shard"])  # at most `shards` rows for each source
        .withColumn("so_far", F.sum("n_tokens").over(order))
        .withColumn("repeats", (rounds + F.when(F.col("so_far") * 2 - F.col("n_tokens") <= rest * 2, F.when(rest > 0, 1).otherwise(0)).otherwise(0)).cast("int"))
        .where(F.col("repeats") > 0)
        .select("doc_id", "source", "n_tokens", "repeats")
    )
    reached = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("chosen_tokens"), F.count(F.lit(1)).alias("n_documents"), F.max("repeats").alias("most_repeats"))
    available = sized.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    shares = (
        wanted.join(available, "source", "left").join(reached, "source", "left")
        .select("source", "target_share", "max_repeats", zero("available_tokens"), zero("chosen_tokens"), zero("n_documents"), zero("most_repeats"))
        .withColumn("share_of_all", F.round(F.col("chosen_tokens") / F.lit(max(total, 1)), 6))
        .withColumn("share_of_mix", F.round(F.col("chosen_tokens") / F.greatest(F.sum("chosen_tokens").over(Window.partitionBy(F.lit(0))), F.lit(1)), 6))  # one row a source
    )
    return chosen, shares


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares}
ORACLES: dict[str, str] = {}
