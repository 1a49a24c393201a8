import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwork.operators import graph, retrieval


def test_vector_search_is_exact(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 8))
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)] + [(900, None), (901, [0.0] * 8), (902, [1.0]), (None, [1.0] * 8), (903, [1.0, None] + [0.0] * 6)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>").repartition(3)
    asked = df.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for block in (2, 1000):
        got = {}
        for r in retrieval.vector_search(df, asked, "id", "v", 5, block=block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == {q: np.lexsort((np.arange(300), -(unit @ unit[q])))[:5].tolist() for q in range(0, 300, 50)}


def test_vector_search_of_nothing(spark):
    df = spark.createDataFrame([], "id bigint, v array<double>")
    assert retrieval.vector_search(df, df.select(F.col("id").alias("query_id"), F.col("v").alias("query_vector")), "id", "v", 3).count() == 0


def test_overlong_vectors_spoil_no_others(spark):
    rows = [(i, [1.0, 0.1 * i]) for i in range(20)] + [(50, [1.0] * 5), (51, [1.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>").coalesce(1)
    asked = df.where("id in (0, 5, 10, 50)").select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"))
    got = retrieval.vector_search(df, asked, "id", "v", 30).collect()
    assert {(r.query_id, r.id) for r in got} == {(q, i) for q in (0, 5, 10) for i in range(20)}
    held = df.select("id", F.col("id").alias("chunk_id"), (F.col("id") % 2).alias("owner"))
    assert {(r.query_id, r.owner, r.chunk_id) for r in retrieval.best_chunks(df, held, asked, "id", "v").where("query_id = 10").collect()} == {(10, 0, 10), (10, 1, 11)}


def test_best_chunks_leave_no_owner_out(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(120, 6))
    # Owner 0 holds 60 chunks near the query, which would fill any 40 nearest; vector 119 is a chunk of two owners.
    v[:60] = v[0] + 0.01 * v[:60]
    chunks = [(i, i, 0 if i < 60 else 1 + i % 7) for i in range(120)] + [(119, 500, 99)]
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(120)] + [(900, [0.0] * 6)], "id bigint, v array<double>").repartition(3)
    held = spark.createDataFrame(chunks + [(900, 900, 1)], "id bigint, chunk_id bigint, owner bigint")
    asked = df.where("id in (0, 30, 70)").select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = set()
    for q in (0, 30, 70):
        for owner in {o for _, _, o in chunks}:
            own = sorted((-(unit[i] @ unit[q]), c) for i, c, o in chunks if o == owner and i != q)
            want |= {(q, owner, c, r) for r, (_, c) in enumerate(own[:2], 1)}
    for block in (1, 1000):
        got = retrieval.best_chunks(df, held, asked, "id", "v", 2, block=block, exclude_self=True).collect()
        assert {(r.query_id, r.owner, r.chunk_id, r.owner_rank) for r in got} == want and len(got) == len(want)


def test_fusion_and_diversity(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, item int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id int, item int, rank int")
    got = retrieval.reciprocal_rank_fusion({"vector": a, "graph": b}, "item", 2).orderBy("hybrid_rank").collect()
    assert [r.item for r in got] == [11, 10] and got[0].sources == "vector+graph" and got[0].rrf_score == pytest.approx(1 / 62 + 1 / 61)
    hits = spark.createDataFrame([(1, 1, 7, 0.90), (1, 2, 7, 0.895), (1, 3, 8, 0.89), (1, 4, None, None)], "query_id int, chunk_id int, paper_id int, similarity double")
    order = [r.chunk_id for r in retrieval.diversity_ranking(hits, "paper_id").orderBy("final_rank").collect()]
    assert order == [1, 3, 2, 4]


def test_evidence_check(spark):
    rows = [(1, p, "text", s) for p, s in ((1, 0.9), (1, 0.2), (2, 0.5), (3, None))] + [(2, 1, "", 0.9), (2, 2, None, 0.9)]
    got = {r.query_id: r for r in retrieval.evidence_check(spark.createDataFrame(rows, "query_id int, paper_id int, content string, similarity double")).collect()}
    assert got[1].can_generate and not got[2].can_generate and got[2].reasons == "evidence_papers,relevant_papers,evidence_chunks"


def test_graph(spark):
    rows = [(1, '["A B", " "]', ["k1", "k2", None], "S"), (2, "A B; C ;", ["k1", "k2"], " "), (3, None, None, None), (2, "A B; C ;", ["k1"], None), (4, "[broken", ["k2"], "S")]
    edges = graph.paper_edges(spark.createDataFrame(rows, "paper_id bigint, authors string, keywords array<string>, source string")).cache()
    got = {tuple(r) for r in edges.collect()}
    assert ("Author:A B", "Paper:1", "WRITTEN_BY") in got and ("Author:C", "Paper:2", "WRITTEN_BY") in got and ("Paper:4", "Source:S", "PUBLISHED_BY") in got
    assert len(got) == edges.count() == 3 + 5 + 2
    seeds = spark.createDataFrame([("Paper:1",), ("Paper:9",), ("Paper:1",)], "seed string")
    assert [(r.related, r.relation_score) for r in graph.related(edges, seeds, ["HAS_KEYWORD"], 5).orderBy("rank").collect()] == [("Paper:2", 2), ("Paper:4", 1)]


def test_related_to_sets_counts_the_paths_of_all_seeds(spark):
    rows = [("Paper:1", "Keyword:a"), ("Paper:2", "Keyword:a"), ("Paper:2", "Keyword:b"), ("Paper:3", "Keyword:a"), ("Paper:3", "Keyword:b"), ("Paper:4", "Keyword:b"), ("Paper:5", "Keyword:c")]
    edges = spark.createDataFrame([(*r, "HAS_KEYWORD") for r in rows] + [("Paper:5", "Source:s", "PUBLISHED_BY"), ("Paper:1", "Source:s", "PUBLISHED_BY")], "src string, dst string, type string")
    seeds = spark.createDataFrame([(7, "Paper:1"), (7, "Paper:2"), (7, "Paper:2"), (8, "Paper:5"), (9, "Paper:4")], "query_id int, seed string")
    got = {(r.query_id, r.related, r.relation_score, r["rank"]) for r in graph.related_to_sets(edges, seeds, ["HAS_KEYWORD"], 5).collect()}
    assert got == {(7, "Paper:3", 3, 1), (7, "Paper:4", 1, 2), (9, "Paper:2", 1, 1), (9, "Paper:3", 1, 2)}
    assert graph.related_to_sets(edges, seeds, ["HAS_KEYWORD"], 1).count() == 2


def test_collapsed_and_first_of_hits(spark):
    hits = spark.createDataFrame([(1, 5, 10, 0.9), (1, 6, 10, 0.95), (1, 7, 11, 0.95), (1, 7, 11, 0.95), (2, 5, 10, None)], "query_id int, chunk_id int, owner int, similarity double")
    once = retrieval.first_of_hits(hits, ["chunk_id"], ["owner"], [-F.coalesce("similarity", F.lit(0.0))])
    assert once.count() == 4
    got = {(r.query_id, r.owner): (r.vector_rank, r.chunks) for r in retrieval.collapsed(once, "owner").collect()}
    assert got == {(1, 10): (1, [6, 5]), (1, 11): (2, [7]), (2, 10): (1, [5])}
    unnamed = hits.withColumn("chunk_id", F.lit(None).cast("int"))
    assert retrieval.first_of_hits(unnamed, ["chunk_id"], ["owner", "similarity"], [F.lit(0)]).count() == 4
    assert retrieval.collapsed(hits.limit(0), "owner").count() == 0


def test_chunks_of_owners(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(60, 4))
    rows = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(60)] + [(60, None), (61, [1.0]), (62, [0.0] * 4)], "id bigint, v array<double>")
    held = spark.createDataFrame([(i, 100 + i, i % 7) for i in range(63)], "id bigint, chunk_id bigint, owner bigint")
    asked = spark.createDataFrame([(0, 3), (0, 3), (1, 4), (1, 99)], "query_id bigint, owner bigint")
    queries = rows.where("id < 2").select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(q, o, 100 + int(i)) for q, o in ((0, 3), (1, 4)) for i in sorted(range(o, 60, 7), key=lambda i: (-unit[i] @ unit[q], i))[:2]}
    assert {(r.query_id, r.owner, r.chunk_id) for r in retrieval.chunks_of_owners(asked, rows, held, queries, "id", "v", 2).collect()} == want


def test_evidence_text(spark):
    rows = [(1, "T  one", None, "a\n b" * 3, 0.9), (1, "U", "S", " ", 0.8), (1, None, "S", "cd", 0.7), (1, "V", "S", "ef", 0.6), (2, "W", "S", None, 0.6)]
    df = spark.createDataFrame(rows, "query_id int, title string, source string, content string, similarity double")
    got = {r.position: r.evidence for r in retrieval.evidence_text(df, "PAPER", [("Title", "title"), ("Source", "source")], [F.desc("similarity")], 2, 4).collect()}
    assert got == {1: "[PAPER 1]\nTitle: T one\nEvidence:\na ba...", 2: "[PAPER 2]\nTitle: \nSource: S\nEvidence:\ncd"}
