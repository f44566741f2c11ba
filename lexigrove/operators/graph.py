"""Graph algorithms over edge tables (source, target, weight, kind): undirected unless said otherwise, iterated as joins and
aggregations whose lineage is cut in the shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrove.functions.text import wikilinks
from lexigrove.shared import join_heavy, join_large, materialize, number_rows, table


def simple_edges(edges: DataFrame) -> DataFrame:
    """One edge for each pair of nodes, lesser first, with the sum of the weights; rows with a null end don't count."""
    return edges.where(F.col("source").isNotNull() & F.col("target").isNotNull()).groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.sum("weight").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions; a loop once."""
    flipped = edges.where("source <> target").select(F.col("target").alias("source"), F.col("source").alias("target"), *[c for c in edges.columns if c not in ("source", "target")])
    return edges.select(*flipped.columns).unionByName(flipped)


def dedupe_undirected(edges: DataFrame) -> DataFrame:
    """Edges (source, target, kind, weight, evidence array, ord) merged by unordered pair and kind: weights summed, distinct evidence in order of coming, direction of the first."""
    keyed = edges.withColumn("a", F.least("source", "target")).withColumn("b", F.greatest("source", "target"))
    key = ["a", "b", "kind"]
    merged = keyed.groupBy(*key).agg(F.min_by(F.struct("source", "target"), "ord").alias("first"), F.sum("weight").alias("weight"))
    # Each distinct evidence once, before an edge's are put together: an edge may have any number of rows.
    once = keyed.select(*key, "ord", F.posexplode("evidence").alias("pos", "x")).groupBy(*key, "x").agg(F.min(F.struct("ord", "pos")).alias("at"))
    lists = once.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda v: v["x"]).alias("evidence"))
    same = reduce(lambda c, d: c & d, [merged[k].eqNullSafe(lists[k]) for k in key])
    return merged.join(lists, same, "left").select("first.source", "first.target", merged["kind"], "weight", F.coalesce("evidence", F.array().cast(edges.schema["evidence"].dataType)).alias("evidence"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree and strength (sum of weights) in the simple graph; loops count once."""
    return both_ways(simple_edges(edges)).groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.round(F.sum("weight"), 6).alias("strength"))


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int, kinds: list[str] | None = None) -> DataFrame:
    """seed, node, distance of the nodes within `hops` of each seed (seed), which itself is left out; optionally along edges of some kinds only."""
    if kinds is not None:
        edges = edges.where(F.col("kind").isin(kinds))
    step = both_ways(edges.select("source", "target")).distinct()
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("distance")).distinct()
    frontier = seen
    for d in range(1, hops + 1):
        reached = frontier.select("seed", F.col("node").alias("source")).join(step, "source").select("seed", F.col("target").alias("node")).distinct()
        frontier = reached.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("distance", F.lit(d))
        seen = seen.unionByName(frontier)
    return seen.where("distance > 0")


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, alpha: float = 0.85, iterations: int = 50, tolerance: float | None = 1e-6, cut_every: int = 5) -> DataFrame:
    """node, pagerank by weighted power iteration on the simple undirected graph.

    Nodes without edges spread their rank evenly. With a tolerance it ends once the summed change of an iteration is below
    tolerance times the number of nodes, which is looked at every `cut_every` iterations, where the lineage is cut too; if it
    never is, every node gets 1 / N. With None it does exactly the given iterations.
    """
    simple = materialize(both_ways(simple_edges(edges)), "simple")
    strength = simple.groupBy("source").agg(F.sum("weight").alias("total"))
    flow = materialize(simple.join(strength, "source").select("source", "target", (F.col("weight") / F.col("total")).alias("part")), "flow")
    held = simple.select(F.col("source").alias("node")).distinct()
    every = materialize(held.unionByName(nodes.select("node")).distinct() if nodes is not None else held, "nodes")
    n = every.count()
    if not n:
        return every.select("node", F.lit(0.0).alias("pagerank"))
    loose, lone = n - held.count(), 1.0 / n  # nodes without edges all have one rank, which needs no table
    rank, converged = every.select("node", F.lit(1.0 / n).alias("pagerank")), tolerance is None
    base = every.select("node", F.lit(0.0).alias("got"))
    for i in range(1, iterations + 1):
        look = i % cut_every == 0 or i == iterations
        if look and tolerance is not None:
            rank = materialize(rank, "ranks")
        # The ranks are read once an iteration, so that the plan between two cuts grows by a join and an aggregation each.
        got = rank.select(F.col("node").alias("source"), "pagerank").join(flow, "source").select(F.col("target").alias("node"), (F.col("pagerank") * F.col("part")).alias("got"))
        lone = alpha * loose * lone / n + (1 - alpha) / n
        after = got.unionByName(base).groupBy("node").agg((alpha * F.sum("got") + lone).alias("pagerank"))
        if look:
            after = materialize(after, "ranks")
            if tolerance is not None:
                moved = after.join(rank.select("node", F.col("pagerank").alias("before")), "node").agg(F.sum(F.abs(F.col("pagerank") - F.col("before")))).first()[0]
                converged = moved < n * tolerance
        rank = after
        if converged and tolerance is not None:
            break
    return rank.select("node", F.col("pagerank") if converged else F.lit(1.0 / n).alias("pagerank"))


def components(edges: DataFrame, nodes: DataFrame | None = None, rounds: int = 60) -> DataFrame:
    """node, component (its least node) by least labels of neighbours with pointer jumping; raises if `rounds` don't settle it.

    Nodes are numbered in their order first, so that all rounds go on numbers, whatever the nodes are.
    """
    known = materialize(edges.select("source", "target").where(F.col("source").isNotNull() & F.col("target").isNotNull()).distinct(), "known")
    every = known.select(F.explode(F.array("source", "target")).alias("node"))
    every = every.unionByName(nodes.select("node").where(F.col("node").isNotNull())) if nodes is not None else every
    ids = materialize(number_rows(every.distinct(), ["node"], "id"), "ids")
    of = lambda end: ids.select(F.col("node").alias(end), F.col("id").alias(f"{end}_id"))
    numbered = join_large(join_large(known, of("source"), ["source"]), of("target"), ["target"]).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"))
    step = materialize(both_ways(numbered).distinct(), "steps")
    label = ids.select(F.col("id").alias("node"), F.col("id").alias("label"))
    for _ in range(rounds):
        near = join_large(step, label.select(F.col("node").alias("target"), "label"), ["target"]).groupBy(F.col("source").alias("node")).agg(F.min("label").alias("near"))
        low = materialize(join_large(label, near, ["node"], "left").select("node", "label", F.least("label", "near").alias("low")), "low")
        # A giant component soon has one label: the heaviest labels are broadcast with where they lead, the rest is shuffled.
        leads = join_large(low.groupBy("low").agg(F.count(F.lit(1)).alias("n")), low.select(F.col("node").alias("low"), F.col("low").alias("jump")), ["low"])
        jump = join_heavy(low, materialize(leads, "leads"), ["low"], "n", large=True)
        after = materialize(jump.select("node", F.col("label").alias("before"), F.least("low", "jump").alias("label")), "labels")
        if after.where(F.col("label") != F.col("before")).isEmpty():
            sizes = materialize(join_large(after.groupBy("label").agg(F.count(F.lit(1)).alias("n")), ids.select(F.col("id").alias("label"), F.col("node").alias("component")), ["label"]), "components")
            return join_large(join_heavy(after.select(F.col("node").alias("id"), "label"), sizes, ["label"], "n", large=True), ids, ["id"]).select("node", "component")
        label = after.select("node", "label")
    raise RuntimeError(f"components not settled after {rounds} rounds")


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """node, community by weighted label propagation; ties go to the least label. Nodes take over in two halves by turns, which prevents swinging.

    Communities of a graph have no single right answer; this one is deterministic and needs no order of the nodes.
    """
    step = materialize(both_ways(simple_edges(edges)).where("source <> target"), "steps")
    label = materialize(step.select(F.col("source").alias("node")).distinct().select("node", F.col("node").alias("label")), "labels")
    for i in range(rounds):
        votes = step.join(label.select(F.col("node").alias("target"), "label"), "target").groupBy(F.col("source").alias("node"), "label").agg(F.sum("weight").alias("w"))
        # By weight, then the least label: a minimum of (-weight, label).
        best = votes.groupBy("node").agg(F.min(F.struct((-F.round("w", 9)).alias("w"), "label")).alias("best")).select("node", F.col("best.label").alias("won"))
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == i % 2
        after = materialize(label.join(best, "node", "left").select("node", F.col("label").alias("before"), F.when(turn, F.coalesce("won", "label")).otherwise(F.col("label")).alias("label")), "labels")
        changed = not after.where(F.col("label") != F.col("before")).isEmpty()
        label = after.select("node", "label")
        if not changed and i % 2:
            break
    return label.select("node", F.col("label").alias("community"))


def louvain(edges: DataFrame, levels: int = 6, rounds: int = 12) -> DataFrame:
    """node, community (its least node) by greedy modularity: nodes move to the neighbouring community that gains most, then communities
    become the nodes of the next level, until a level merges nothing.

    Moves are made by half of the nodes at a time, so that neighbours don't change places for ever, and only up to `rounds` a
    level; of two lone nodes the greater moves. Ties go to the least label. It needs no order of nodes, so that its communities
    differ from those of a sequential pass, with about the same modularity. Edges with a null end and weights of 0 don't count.
    """
    simple = materialize(simple_edges(edges).where("weight > 0"), "simple")
    member = materialize(simple.select(F.explode(F.array("source", "target")).alias("node")).distinct().withColumn("community", F.col("node")), "members")
    total = 2 * (simple.agg(F.sum("weight")).first()[0] or 0.0)
    for _ in range(levels):
        step = materialize(both_ways(simple).where("source <> target").select("source", "target", "weight"), "steps")
        ends = simple.select("source", "weight").unionByName(simple.select(F.col("target").alias("source"), "weight"))  # a loop counts twice
        label = materialize(ends.groupBy(F.col("source").alias("node")).agg(F.sum("weight").alias("k")).withColumn("c", F.col("node")), "labels")
        still = 0
        for r in range(rounds):
            of = label.groupBy("c").agg(F.sum("k").alias("tot"), F.count(F.lit(1)).alias("size"))
            links = step.join(label.select(F.col("node").alias("target"), "c"), "target").groupBy(F.col("source").alias("node"), "c").agg(F.sum("weight").alias("w"))
            known = join_heavy(label, materialize(of, "totals"), ["c"], "size").select("node", "k", F.col("c").alias("own"), F.col("tot").alias("own_tot"), F.col("size").alias("own_size"))
            tried = join_heavy(links, materialize(of, "totals"), ["c"], "size").join(known, "node")
            inside = F.col("c") == F.col("own")
            gain = F.round(F.col("w") - F.col("k") * (F.col("tot") - F.when(inside, F.col("k")).otherwise(0.0)) / total, 9)
            stay = F.round(F.coalesce(F.max(F.when(inside, gain)), -F.first("k") * (F.first("own_tot") - F.first("k")) / total), 9)
            allowed = ~inside & ~((F.col("own_size") == 1) & (F.col("size") == 1) & (F.col("c") > F.col("own")))
            best = tried.groupBy("node").agg(F.min(F.when(allowed, F.struct((-gain).alias("g"), "c"))).alias("b"), stay.alias("stay")).where(-F.col("b.g") > F.col("stay") + 1e-9).select("node", F.col("b.c").alias("won"))
            turn = F.pmod(F.xxhash64("node", F.lit(r // 2)), F.lit(2)) == r % 2
            after = materialize(label.join(best, "node", "left").select("node", "k", F.col("c").alias("before"), F.when(turn, F.coalesce("won", "c")).otherwise(F.col("c")).alias("c")), "labels")
            still = still + 1 if after.where("c <> before").isEmpty() else 0
            label = after.select("node", "k", "c")
            if still == 2:  # neither half moves
                break
        names = label.groupBy("c").agg(F.min("node").alias("to"), F.count(F.lit(1)).alias("n"))
        named = materialize(join_heavy(label.select("node", "c"), materialize(names, "names"), ["c"], "n").select("node", "to"), "named")
        if named.where("node <> to").isEmpty():
            break
        weighed = named.join(member.groupBy(F.col("community").alias("node")).agg(F.count(F.lit(1)).alias("n")), "node")
        member = materialize(join_heavy(member.withColumnRenamed("community", "at"), materialize(weighed.withColumnRenamed("node", "at"), "weighed"), ["at"], "n").select("node", F.col("to").alias("community")), "members")
        renamed = simple.join(named.select(F.col("node").alias("source"), F.col("to").alias("a")), "source").join(named.select(F.col("node").alias("target"), F.col("to").alias("b")), "target")
        simple = materialize(renamed.groupBy(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target")).agg(F.sum("weight").alias("weight")), "simple")
    return member


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: modularity of the communities (node, community) on the simple weighted graph."""
    simple = simple_edges(edges)
    of = lambda c, name: labels.select(F.col("node").alias(c), F.col("community").alias(name))
    inside = simple.join(of("source", "a"), "source").join(of("target", "b"), "target").agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("within"))
    ends = simple.select(F.explode(F.array("source", "target")).alias("node"), "weight").join(labels, "node").groupBy("community").agg(F.sum("weight").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("kk"))
    return inside.join(F.broadcast(ends)).select(F.round(F.col("within") / F.col("m") - F.col("kk") / (4 * F.col("m") * F.col("m")), 6).alias("modularity"))  # one row each


def community_records(labels: DataFrame, nodes: DataFrame, min_size: int = 1) -> DataFrame:
    """id, title, members, summary, top_entities and source_ids of communities, numbered by size and then by least member before small ones are dropped.

    nodes: node, kind, title, source_ids. Only the first members of a community are listed in its summary; members counts all.
    """
    sized = labels.groupBy("community").agg(F.count(F.lit(1)).alias("n_members"), F.min("node").alias("least"))
    numbered = number_rows(sized, [F.col("n_members").desc(), F.col("least")], "number")
    rank = F.row_number().over(Window.partitionBy("community", "group").orderBy("node"))
    known = labels.join(nodes, "node").withColumn("group", F.when(F.col("kind") == "entity", "entity").when(F.col("kind").isin("source_page", "concept_page", "analysis_page"), "page").otherwise("other"))
    first = known.withColumn("r", rank).where("r <= 8").groupBy("community").agg(
        *[F.transform(F.array_sort(F.collect_list(F.when(F.col("group") == g, F.struct("r", "title")))), lambda x: x["title"]).alias(name) for g, name in (("entity", "entities"), ("page", "pages"))])
    sources = known.select("community", "node", F.explode("source_ids").alias("s")).groupBy("community", "s").agg(F.min("node").alias("at")).withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy("at", "s"))).where("r <= 8").groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "s"))), lambda x: x["s"]).alias("sources"))
    full = numbered.where(F.col("n_members") >= min_size).join(first, "community", "left").join(sources, "community", "left")
    part = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, ", ")))
    lead = F.when(F.size("entities") > 0, F.col("entities")).otherwise(F.col("pages"))
    return full.select(
        F.concat(F.lit("community-"), "number").alias("id"), "n_members",
        F.concat(F.lit("Community "), "number", F.when(F.size(lead) > 0, F.concat(F.lit(": "), F.array_join(F.slice(lead, 1, 3), ", "))).otherwise("")).alias("title"),
        F.coalesce(F.nullif(F.concat_ws(" | ", part("Entities: ", F.col("entities")), part("Pages: ", F.col("pages")), part("Sources: ", F.col("sources"))), F.lit("")), F.lit("(no annotated members)")).alias("summary"),
        F.coalesce("entities", F.expr("cast(array() as array<string>)")).alias("top_entities"))


def projection(nodes: DataFrame, edges: DataFrame, dropped: tuple[str, ...] = ("source_document", "text_unit")) -> tuple[DataFrame, DataFrame]:
    """The nodes of other kinds, and the edges both of whose ends are among them."""
    kept = nodes.where(~F.col("kind").isin(*dropped))
    for end in ("source", "target"):
        edges = edges.join(kept.select(F.col("node").alias(end)), end, "left_semi")
    return kept, edges


def node_link_json(edges: DataFrame, per: str) -> DataFrame:
    """The simple edges of each group as JSON, in order."""
    return edges.groupBy(per).agg(F.to_json(F.array_sort(F.collect_list(F.struct("source", "target", "weight")))).alias("links"))


# --- queries -------------------------------------------------------------------------------------------------------------


def link_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Links among document titles and the names that they link to."""
    return table(spark, folder, "documents").select(F.col("title").alias("source"), F.explode(wikilinks(F.col("text"))).alias("x")).select("source", F.col("x.target").alias("target"), F.lit(1.0).alias("weight"), F.lit("links_to").alias("kind"))


def mention_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Entities by lower-case name and the sources that they were extracted from."""
    e = table(spark, folder, "extracted_entities").select(F.concat(F.lit("entity::"), F.lower("name")).alias("source"), F.explode("source_ids").alias("s"))
    return e.select("source", F.concat(F.lit("source::"), "s").alias("target"), F.lit(1.0).alias("weight"), F.lit("mentions").alias("kind"))


def graph_simple_edges(spark: SparkSession, folder: str) -> DataFrame:
    return simple_edges(mention_edges(spark, folder))


def graph_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return degrees(mention_edges(spark, folder))


def graph_two_hops(spark: SparkSession, folder: str) -> DataFrame:
    """From the sources whose manifest row was withdrawn."""
    seeds = table(spark, folder, "sources").where(F.col("removed_at").isNotNull()).select(F.concat(F.lit("source::"), "source_id").alias("seed"))
    return k_hop(mention_edges(spark, folder), seeds, 2)


def graph_pagerank(spark: SparkSession, folder: str) -> DataFrame:
    return pagerank(mention_edges(spark, folder), iterations=6, tolerance=None).select("node", F.round("pagerank", 8).alias("pagerank"))


def graph_pagerank_converged(spark: SparkSession, folder: str) -> DataFrame:
    """As graph_pagerank, whose SQL fixes six steps, but with up to 50 to the operator's tolerance, else uniform ranks."""
    return pagerank(mention_edges(spark, folder)).select("node", F.round("pagerank", 8).alias("pagerank"))


def graph_components(spark: SparkSession, folder: str) -> DataFrame:
    return components(link_edges(spark, folder))


def graph_communities(spark: SparkSession, folder: str) -> DataFrame:
    edges = link_edges(spark, folder)
    titles = table(spark, folder, "documents").groupBy(F.col("title").alias("node")).agg(F.first("page_type").alias("t"), F.array_sort(F.collect_set("source_id")).alias("source_ids"))
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct().join(titles, "node", "left").select("node", F.when(F.col("t").isNull(), "entity").otherwise(F.concat("t", F.lit("_page"))).alias("kind"), F.col("node").alias("title"), F.coalesce("source_ids", F.expr("cast(array() as array<string>)")).alias("source_ids"))
    return community_records(label_propagation(edges), nodes, 2)


def graph_louvain(spark: SparkSession, folder: str) -> DataFrame:
    return louvain(link_edges(spark, folder))


def graph_modularity(spark: SparkSession, folder: str) -> DataFrame:
    """Of the partition of the mention graph by component of its links: sources with their entities by first letter of the name."""
    edges = mention_edges(spark, folder)
    labels = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct().select("node", F.substring_index("node", "::", 1).alias("community"))
    return modularity(edges, labels)


_M = "m AS (SELECT 'entity::' || lower(name) AS source, 'source::' || unnest(source_ids) AS target FROM extracted_entities)"
_S = f"{_M}, s AS (SELECT least(source, target) AS source, greatest(source, target) AS target, CAST(count(*) AS DOUBLE) AS weight FROM m WHERE target IS NOT NULL GROUP BY 1, 2)"
_B = f"{_S}, b AS (SELECT source, target, weight FROM s UNION ALL SELECT target, source, weight FROM s WHERE source <> target)"
_STEPS = "".join(f", r{i} AS (SELECT node, 0.85 * coalesce(got, 0) + 0.15 / n AS pr FROM v LEFT JOIN (SELECT f.target AS node, sum(pr * part) AS got FROM r{i - 1} JOIN f ON r{i - 1}.node = f.source GROUP BY 1) USING (node), c)" for i in range(1, 7))
_LINKS = r"l AS (SELECT title AS source, trim(string_split(x, '|')[1]) AS target FROM (SELECT title, unnest(regexp_extract_all(text, '\[\[([^\[\]]+)\]\]', 1)) AS x FROM documents))"
QUERIES = {f.__name__: f for f in (graph_simple_edges, graph_degrees, graph_two_hops, graph_pagerank, graph_pagerank_converged, graph_components, graph_communities, graph_louvain, graph_modularity)}
ORACLES = {
    "graph_simple_edges": f"WITH {_S} SELECT * FROM s",
    "graph_degrees": f"WITH {_B} SELECT source AS node, count(*) AS degree, round(sum(weight), 6) AS strength FROM b GROUP BY 1",
    "graph_two_hops": f"""WITH {_B}, st AS (SELECT DISTINCT source, target FROM b), z AS (SELECT DISTINCT 'source::' || source_id AS seed FROM sources WHERE removed_at IS NOT NULL),
        h1 AS (SELECT DISTINCT seed, target AS node FROM z JOIN st ON st.source = seed WHERE target <> seed),
        h2 AS (SELECT DISTINCT seed, target AS node FROM h1 JOIN st ON st.source = node WHERE target <> seed)
        SELECT *, 1 AS distance FROM h1 UNION ALL SELECT *, 2 FROM h2 ANTI JOIN h1 USING (seed, node)""",
    "graph_pagerank": f"""WITH {_B}, w AS (SELECT source, sum(weight) AS total FROM b GROUP BY 1), f AS (SELECT source, target, weight / total AS part FROM b JOIN w USING (source)),
        v AS (SELECT DISTINCT source AS node FROM b), c AS (SELECT count(*) AS n FROM v), r0 AS (SELECT node, 1.0 / n AS pr FROM v, c){_STEPS} SELECT node, round(pr, 8) AS pagerank FROM r6""",
    "graph_components": f"""WITH RECURSIVE {_LINKS}, e AS (SELECT source, target FROM l UNION SELECT target, source FROM l),
        reach AS (SELECT source AS node, source AS seen FROM e UNION SELECT reach.node, e.target FROM reach JOIN e ON reach.seen = e.source)
        SELECT node, min(seen) AS component FROM reach GROUP BY 1""",
    "graph_modularity": f"""WITH {_S}, m2 AS (SELECT sum(weight) AS m, sum(CASE WHEN split_part(source, '::', 1) = split_part(target, '::', 1) THEN weight ELSE 0 END) AS within_ FROM s),
        k AS (SELECT split_part(node, '::', 1) AS c, sum(weight) AS k FROM (SELECT source AS node, weight FROM s UNION ALL SELECT target, weight FROM s) GROUP BY 1)
        SELECT round(within_ / m - kk / (4 * m * m), 6) AS modularity FROM m2, (SELECT sum(k * k) AS kk FROM k)""",
}
