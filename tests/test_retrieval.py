from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lexigrove.functions.fuzzy import token_set_ratio
from lexigrove.operators import evaluation as ev
from lexigrove.operators import lexical as lx
from lexigrove.operators.fusion import fused, merge_first_seen
from lexigrove.operators.graph import components, graph_pagerank_converged, k_hop, label_propagation, modularity, pagerank
from lexigrove.operators.retrieval import CorpusGraph, Profiles, answers, claim_support, find, keywords, match_entities, resolve_citations, route, query_entities
from lexigrove.operators.vectors import cosine_top_k

NODES = "node string, kind string, title string, text string, section string, aliases array<string>"
EDGES = "source string, target string, weight double, kind string"


def questions(spark, *qs):
    return spark.createDataFrame(list(enumerate(qs)), "query_id bigint, question string")


def test_bm25_ties_budget_and_empty(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, "gamma"), (4, None), (5, "")], "doc_id bigint, text string")
    hits = lx.ranked(lx.bm25(lx.LexicalIndex.build(docs), questions(spark, "alpha the", "of the")), 3).collect()
    assert [(r.query_id, r.doc_id, r["rank"]) for r in sorted(hits, key=lambda r: r["rank"])] == [(0, 1, 1), (0, 2, 2)]
    ctx = spark.createDataFrame([(0, 1, "x" * 400), (0, 2, "y" * 40), (0, 3, "z" * 40)], "query_id bigint, rank int, text string")
    assert [r["rank"] for r in lx.token_budget(ctx, 105).collect()] == [1] and lx.token_budget(ctx, 0).count() == 3 and sorted(r["rank"] for r in lx.token_budget(ctx, 110).collect()) == [1, 2]
    assert lx.bm25(lx.LexicalIndex.build(docs.limit(0)), questions(spark, "alpha")).count() == 0


def test_rrf(spark):
    rows = [(0, f"l{i}", r + 1, 1.0, d, d) for i, ds in enumerate((["a", "b", "c"], ["b", "c", "d"], ["c", "d", "e"])) for r, d in enumerate(ds)]
    df = spark.createDataFrame(rows, "query_id bigint, list string, rank int, score double, title string, doc string")
    got = [r.doc for r in fused(df, ["doc"], 5).orderBy("rank").collect()]
    assert got[0] == "c" and got.index("b") < got.index("d") and fused(df.limit(0), ["doc"], 5).count() == 0
    assert {r.doc for r in fused(df, ["doc"], 5, weights={"l2": 0}).collect()} == {"a", "b", "c", "d"}
    b = spark.createDataFrame([(0, 0, 1, "x", 0.5), (0, 1, 1, "x", 0.9), (0, 1, 2, "y", 0.4)], "query_id bigint, bundle int, rank int, doc_id string, score double")
    assert {(r.doc_id, r.score) for r in merge_first_seen(b).collect()} == {("x", 0.6), ("y", 0.4)}


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "vec_id bigint, vector array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0]), (8, [0.0, 0.0])], "query_id bigint, vector array<double>")
    for block in (1000, 2):
        got = cosine_top_k(rows, q, 4, block).collect()
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == 9), key=lambda r: r["rank"])] == [1, 3, 2, 4]
        assert {r.score for r in got if r.query_id == 8} == {0.0}
    with pytest.raises(Exception, match="values"):
        cosine_top_k(rows, spark.createDataFrame([(9, [1.0])], "query_id bigint, vector array<double>"), 2).collect()


def test_retrieval_scores(spark):
    q = spark.createDataFrame([(1, ["REALM", "RAG"]), (2, ["x"]), (3, []), (4, ["RAG"])], "query_id bigint, expected array<string>")
    c = spark.createDataFrame([(1, 1, "REALM jointly trains a retriever"), (1, 2, "a fragment of text"), (1, 3, "RAG it is"), (2, 1, "nothing"), (4, 1, "no"), (4, 2, "rag")], "query_id bigint, rank int, hay string")
    got = {r.query_id: r for r in ev.retrieval_scores(ev.relevance(c, q), q).collect()}
    assert (got[1].recall, got[1].precision, got[1].hit, got[1].mrr) == (1.0, 0.25, 1.0, 1.0) and 0.9 < got[1].ndcg <= 1
    assert (got[2].recall, got[2].mrr, got[2].ndcg) == (0.0, 0.0, 0.0) and got[3].recall is None and got[3].ndcg is None and got[4].mrr == 0.5


def test_answer_scores(spark):
    df = spark.createDataFrame([("DPR uses a dual encoder for dense passage retrieval", "DPR uses a dual encoder for dense retrieval"), ("", "a"), (None, None), ("a b c", "c b a")], "a string, b string")
    got = df.select(ev.token_f1(F.col("a"), F.col("b")).alias("f"), ev.rouge_l(F.col("a"), F.col("b")).alias("r")).collect()
    assert got[0].f > 0.9 and got[0].r > 0.9 and (got[1].f, got[1].r) == (0, 0) and (got[2].f, got[2].r) == (0, 0) and got[3].f == 1 and got[3].r == pytest.approx(1 / 3)
    ctx = "array<struct<text: string, source_id: string, ref: string, score: double>>"
    s = spark.createDataFrame([(1, [("", "", "a.md#chunk-1", 0.0)], ["a.md#chunk-1", "bogus.md#x"], False, False), (2, [("", "", "a.md#chunk-1", 0.0)], ["a.md#chunk-9"], None, None), (3, None, None, True, True), (4, [], [], True, False)], f"sample_id bigint, retrieved_contexts {ctx}, citations array<string>, insufficient_evidence boolean, insufficient_expected boolean")
    by = {r.sample_id: r for r in ev.citation_scores(s).collect()}
    assert (by[1].validity, by[1].grounded) == (0.5, 1) and by[2].validity == 1 and (by[3].validity, by[3].grounded, by[3].refusal_correct) == (1, 1, 1) and by[4].refusal_correct == 0


def test_bootstrap(spark):
    assert ev.percentile_ci([]) == (0, 0, 0) and ev.percentile_ci([2.0]) == (2, 2, 2)
    values = [float(i % 7) for i in range(80)]
    mean, low, high = ev.percentile_ci(values)
    m = spark.createDataFrame([(i, "b", "m", v) for i, v in enumerate(values)], "sample_id bigint, backend string, metric string, value double")
    r = ev.bootstrap(m, ["backend"], 400).first()
    assert r.mean == pytest.approx(mean, abs=1e-6) and r.low == pytest.approx(low, abs=0.12) and r.high == pytest.approx(high, abs=0.12)


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", 1.0, "x"), ("b", "a", 1.0, "x"), ("b", "c", 1.0, "y"), ("d", "e", 2.0, "x"), ("f", "f", 1.0, "x"), (None, "a", 1.0, "x")], EDGES)
    seeds = spark.createDataFrame([("a",)], "seed string")
    assert {(r.node, r.distance) for r in k_hop(e, seeds, 2).collect()} == {("b", 1), ("c", 2)} and {r.node for r in k_hop(e, seeds, 2, ["x"]).collect()} == {"b"}
    lone = spark.createDataFrame([("z",), ("a",)], "node string")
    assert {r.node: r.component for r in components(e, lone).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f", "z": "z"}
    pr = {r.node: r.pagerank for r in pagerank(e, lone, iterations=120).collect()}
    assert sum(pr.values()) == pytest.approx(1) and pr["b"] > pr["a"] > pr["c"] and pr["z"] < pr["d"] == pytest.approx(pr["e"])
    cliques = [(f"{g}{i}", f"{g}{j}", 1.0, "x") for g in "pq" for i in range(5) for j in range(i)] + [("p0", "q0", 0.1, "x")]
    c = spark.createDataFrame(cliques, EDGES)
    labels = label_propagation(c)
    assert labels.select("community").distinct().count() == 2 and modularity(c, labels).first().modularity > 0.4
    assert components(e.limit(0)).count() == 0 and pagerank(e.limit(0)).count() == 0
    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}", 1.0, "x") for i in range(90)], EDGES)
    assert {r.component for r in components(chain).collect()} == {"n000"}


@pytest.fixture(scope="module")
def small_graph(spark):
    nodes = [("e::dpr", "entity", "Dense Passage Retrieval", "", "", ["dense retriever"]), ("e::rag", "entity", "RAG", "", "", None), ("p::dpr", "source_page", "DPR page", "", "", None), ("c::1", "chunk", "c1", "encoders map passages", "Methods", None), ("c::2", "chunk", "c2", "unrelated words on cats", "", None), ("s::1", "source_document", "doc", "", "", None), ("u::1", "text_unit", "u1", "sentinel phrase only here", "", None), ("k::1", "claim", "claim", "dual encoders win", "", None)]
    edges = [("e::dpr", "p::dpr", 1.0, "mentions"), ("p::dpr", "c::1", 1.0, "contains"), ("p::dpr", "s::1", 1.0, "derived_from"), ("s::1", "u::1", 0.15, "contains"), ("e::rag", "k::1", 0.5, "claims")]
    return CorpusGraph.build(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), 10)


def test_entity_matches(spark, small_graph):
    q = questions(spark, "Explain DPR methods", "what is dense passage retrieval?", "drag it", "Is RAG good", "cats?")
    got = {(r.query_id, r.node, r.score) for r in match_entities(q, small_graph.nodes.where("kind = 'entity'")).collect()}
    assert got == {(0, "e::dpr", 100.0), (1, "e::dpr", 100.0), (3, "e::rag", 100.0)}


def test_local_drift_and_find(spark, small_graph):
    q = questions(spark, "Explain DPR methods", "sentinel phrase", "Compare RAG and others", "what of RAG")
    local = {}
    for r in small_graph.local(q).collect():
        local.setdefault(r.query_id, {})[r.doc_id] = r
    assert local[0]["c::1"]["rank"] == 1 and "u::1" in local[0] and local[1].keys() == {"u::1"} and "k::1" in local[3]
    methods = {r.query_id: r.method for r in find(small_graph, q).collect()}
    assert methods == {0: "local", 1: "basic", 2: "drift-lite", 3: "local"}


def test_global(spark, small_graph):
    communities = spark.createDataFrame([("community-9", "encoders and passages", ["Dense Passage Retrieval"]), ("community-10", "cats", ["cats"])], "id string, summary string, top_entities array<string>")
    members = spark.createDataFrame([("community-9", "c::1"), ("community-9", "e::dpr"), ("community-10", "c::2")], "id string, node string")
    got = small_graph.global_(questions(spark, "cats", "zzz"), communities, members).collect()
    rows = {q: [r.node for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] for q in (0, 1)}
    assert rows == {0: ["community-10", "c::2"], 1: ["community-9", "c::1"]}


def test_profiles(spark):
    entities = spark.createDataFrame([("e1", "RAG retrieval augmented", ["c1", "c2"]), ("e2", "DPR dense passage", ["c2"]), ("e3", "REALM pretraining", ["c3"])], "id string, text string, chunk_ids array<string>")
    relations = spark.createDataFrame([("r1", "RAG USES DPR tradeoff", "e1", "e2", ["c3"])], "id string, text string, source string, target string, chunk_ids array<string>")
    chunks = spark.createDataFrame([("c1", "about rag"), ("c2", "about dpr"), ("c3", "tradeoff")], "doc_id string, text string")
    p = Profiles(entities, relations, chunks)
    k = keywords(questions(spark, "What is RAG", "main tradeoff"))
    assert {(r.query_id, r.doc_id) for r in p.local(k).collect()} >= {(0, "c1"), (0, "c2"), (0, "c3")}
    scores = {r.doc_id: r.score for r in p.local(k).where("query_id = 0").collect()}
    assert scores["c3"] == pytest.approx(scores["c1"] / 2, abs=1e-5)
    assert {r.doc_id for r in p.global_(k).where("query_id = 1").collect()} == {"c3"} and p.hybrid(k, 2).where("rank > 2").count() == 0


def test_keywords_and_routes(spark):
    q = questions(spark, "Compare REALM and RAG retrieval tradeoffs", "where is the config", "overall patterns", "Tell me of DPR", "tell me of sparse stuff", "hello")
    k = {r.query_id: r for r in keywords(q, spark.createDataFrame([("RAG",), ("REALM",)], "alias string")).collect()}
    assert {"REALM", "RAG"} <= set(k[0].low) and k[0].high == ["compare", "tradeoffs"] and k[4].high == ["tell", "sparse", "stuff"]
    r = {x.query_id: (x.method, x.reason) for x in route(q, spark.createDataFrame([("sparse stuff",), ("rag",)], "term string")).collect()}
    assert r == {0: ("drift", "comparison"), 1: ("basic", "direct look-up"), 2: ("global", "corpus theme"), 3: ("local", "alias"), 4: ("local", "known term"), 5: ("basic", "fallback")}


def test_answers_and_citations(spark):
    c = spark.createDataFrame([(0, 1, "T", "a.md#chunk-1", "text  here"), (0, 2, "U", "b.md#chunk-2", "more")], "query_id bigint, rank int, title string, ref string, text string")
    a = answers(c).first()
    assert a.answer == "- T: text here [a.md#chunk-1]\n- U: more [b.md#chunk-2]" and a.citations == ["a.md#chunk-1", "b.md#chunk-2"]
    cited = spark.createDataFrame([(0, 0, "a.md#chunk-1"), (0, 1, "[c2]"), (0, 2, "b.md#chunk-7"), (0, 3, "z.md")], "query_id bigint, pos int, cited string")
    assert {(r.pos, r.ref, r.how) for r in resolve_citations(cited, c).collect()} == {(0, "a.md#chunk-1", "exact"), (1, "b.md#chunk-2", "label"), (2, "b.md#chunk-2", "path"), (3, None, "none")}


def test_entity_matches_are_those_of_brute_force(spark, tmp_path):
    titles = ["Rikodefo", "Zupugilevo Ranker", "Dense Passage Retrieval Index", "what is gamilo", "Besijizopo"]
    asked = ["Rikodfo?", "what is gamillo", "zupugilevo rankers", "passage retrieval dense indexes", "rikodefo and Besijizopo", "cats", "Which uses besijizopo at night?"]
    spark.createDataFrame([(f"s{i}", f"{t}: a title") for i, t in enumerate(titles)], "source_id string, title string").write.parquet(f"{tmp_path}/sources.parquet")
    spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(asked)], "sample_id string, question string").write.parquet(f"{tmp_path}/rag_samples.parquet")
    expected = {}
    for i, q in enumerate(asked):
        for k, t in enumerate(titles):
            score = 100.0 if re.search(rf"(?i)\b{t}\b", q) else token_set_ratio(t.lower(), q.lower())
            if score >= 82:
                expected[f"q{i}", f"s{k}"] = score
    got = {(r.query_id, r.node): r.score for r in query_entities(spark, str(tmp_path)).collect()}
    assert got == pytest.approx(expected) and sum(v < 98 for v in got.values()) >= 3


@pytest.mark.parametrize("n", [400, 4])
def test_registered_pagerank_converges_or_is_uniform(spark, tmp_path, n):
    rows = [(f"E{i}", [f"s{i * i % 97}", f"s{i % 89}"]) for i in range(n)] + [("E0", ["s0"])]
    spark.createDataFrame(rows, "name string, source_ids array<string>").write.parquet(f"{tmp_path}/extracted_entities.parquet")
    near = {}
    for name, sources in rows:
        for s in sources:
            for a, b in ((f"entity::{name.lower()}", f"source::{s}"), (f"source::{s}", f"entity::{name.lower()}")):
                near.setdefault(a, {}).setdefault(b, 0)
                near[a][b] += 1
    pr, moved = {x: 1 / len(near) for x in near}, []
    for _ in range(50 if n == 4 else 400):
        after = {x: 0.15 / len(near) for x in near}
        for a, bs in near.items():
            for b, w in bs.items():
                after[b] += 0.85 * pr[a] * w / sum(bs.values())
        moved.append(sum(abs(after[x] - pr[x]) for x in near))
        pr = after
    settled = min(moved[:50]) < len(near) * 1e-6
    got = {r.node: r.pagerank for r in graph_pagerank_converged(spark, str(tmp_path)).collect()}
    assert settled == (n == 400)
    assert got == pytest.approx(pr if settled else dict.fromkeys(near, 1 / len(near)), abs=2e-5)


def test_profiles_by_vectors_with_words_to_fall_back_to(spark):
    entities = spark.createDataFrame([("e1", "RAG retrieval", ["c1"]), ("e2", "DPR passage", ["c2"])], "id string, text string, chunk_ids array<string>")
    relations = spark.createDataFrame([("r1", "RAG USES DPR", "e1", "e2", ["c3"])], "id string, text string, source string, target string, chunk_ids array<string>")
    chunks = spark.createDataFrame([("c1", "about rag"), ("c2", "about dpr"), ("c3", "tradeoff")], "doc_id string, text string")
    vectors = spark.createDataFrame([("e1", [1.0, 0.0]), ("e2", [0.0, 1.0]), ("gone", [0.0, 1.0])], "id string, vector array<double>")
    keys = spark.createDataFrame([(0, "say rag", ["RAG"], []), (1, "other", ["RAG"], []), (2, "bad", ["DPR"], []), (3, "none", [], [])], "query_id bigint, question string, low array<string>, high array<string>")
    given = {0: [0.1, 1.0], 2: [1.0]}  # question 1 has no vector, that of 2 another length

    def embed(asked):
        assert {r.query_id for r in asked.collect()} == {0, 1, 2}
        return asked.sparkSession.createDataFrame(list(given.items()), "query_id bigint, vector array<double>")

    p = Profiles(entities, relations, chunks, vectors, None, embed)
    hits = {(r.query_id, r.doc_id, round(r.score, 3)) for r in p._hits(entities, keys, "low", 2, vectors).collect() if r.query_id == 0}
    assert hits == {(0, "e2", 0.995), (0, "e1", 0.1)} or hits == {(0, "e2", 0.995)}
    best = {q: max((r for r in p.local(keys).collect() if r.query_id == q), key=lambda r: r.score).doc_id for q in (0, 1, 2)}
    assert best == {0: "c2", 1: "c1", 2: "c2"}


def test_methods_of_retrieval(spark, small_graph):
    entities = spark.createDataFrame([("e1", "RAG retrieval augmented", ["c1"])], "id string, text string, chunk_ids array<string>")
    relations = spark.createDataFrame([("r1", "themes of indexing", "e1", "e1", ["c3"])], "id string, text string, source string, target string, chunk_ids array<string>")
    chunks = spark.createDataFrame([("c1", "about rag"), ("c2", "words nobody has"), ("c3", "themes")], "doc_id string, text string")
    p = Profiles(entities, relations, chunks)
    k = keywords(questions(spark, "What is RAG", "Compare RAG and words", "overall themes", "words nobody has"))
    assert {r.query_id: r.method for r in p.route(k).collect()} == {0: "local", 1: "hybrid", 2: "global", 3: "hybrid"}
    got = {(r.query_id, r.method, r.doc_id) for r in p.retrieve(k).collect()}
    assert {(0, "local", "c1"), (2, "global", "c3"), (3, "hybrid", "c2")} <= got and not any(q == 2 and d != "c3" for q, _, d in got)
    assert {r.doc_id for r in p.retrieve(k, "basic").where("query_id = 3").collect()} == {"c2"}
    with pytest.raises(ValueError, match="unknown method"):
        p.retrieve(k, "nothing")
    communities = spark.createDataFrame([("community-1", "overall cats", ["cats"])], "id string, summary string, top_entities array<string>")
    members = spark.createDataFrame([("community-1", "c::2")], "id string, node string")
    q = questions(spark, "overall cats", "what of RAG")
    assert {(r.query_id, r.method, r.doc_id) for r in find(small_graph, q, 4, communities, members).collect() if r.query_id == 0} == {(0, "global", "community-1"), (0, "global", "c::2")}
    assert {r.method for r in find(small_graph, q, 4, method="basic").collect()} <= {"basic"}
    with pytest.raises(ValueError, match="unknown method"):
        find(small_graph, q, 4, method="nothing")


def test_claim_support(spark):
    rows = [("a", True, "r", "h"), (" \xa0 ", False, "r", "h"), (None, None, None, None), ("see [Data: Entities (1)]", False, None, None), ("a", False, "r", "h"), ("a", None, "r", "")]
    got = [r.support for r in claim_support(spark.createDataFrame(rows, "answer string, stale boolean, run_id string, input_hash string")).collect()]
    assert got == ["stale-index", "no-answer", "no-answer", "cited-graph-answer", "graph-index-answer", "unverified"]
