import numpy as np
import pytest

from quillwork.plans import reference

N_VECTORS = 101


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """30 papers, 150 news and 101 vectors, with ids that leave gaps."""
    d = str(tmp_path_factory.mktemp("tables"))
    v = np.random.default_rng(7).normal(size=(N_VECTORS, 8))
    spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(N_VECTORS)], "vec_id bigint, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    papers = [(200 + 3 * i, f"[\"A{i}\"]", [f"k{i // 3}"], "S", "text") for i in range(30)]
    spark.createDataFrame(papers, "paper_id bigint, authors string, keywords array<string>, source string, abstract string").write.parquet(f"{d}/papers.parquet")
    spark.createDataFrame([(500 + 7 * i,) for i in range(150)], "news_id bigint").selectExpr("news_id", "timestamp '2025-01-01' as published_at").write.parquet(f"{d}/news.parquet")
    return d


def test_chunks_cover_all_owners_and_vectors(spark, folder):
    for name, key, ids in (("papers", "paper_id", {200 + 3 * i for i in range(30)}), ("news", "news_id", {500 + 7 * i for i in range(150)})):
        got = reference._chunks(spark, folder, name, key).collect()
        assert {r.owner for r in got} == ids and {r.vec_id for r in got} == set(range(N_VECTORS))
        assert len({r.chunk_id for r in got}) == len(got) == max(len(ids), N_VECTORS)


def test_every_paper_and_news_item_can_be_ranked(spark, folder):
    got = reference.best_chunk_per_owner(spark, folder).collect()
    assert {(r.query_id, r.owner) for r in got} == {(q, 200 + 3 * i) for q in (0, 50, 100) for i in range(30)}
    assert reference.news_recency_ranking(spark, folder).count() == 15
    assert reference.evidence_check(spark, folder).where("evidence_chunks = 40 and can_generate").count() == 3


def test_fusion_reaches_papers_through_the_graph(spark, tmp_path):
    """Papers 100 to 149 have chunks far from the query; 149 shares a keyword with the 40 near ones."""
    d = str(tmp_path)
    near, far = [[1.0, 0.001 * i] for i in range(41)], [[-1.0, 0.001 * i] for i in range(9)]
    spark.createDataFrame(list(enumerate(near + far)), "vec_id bigint, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    papers = [(100 + i, None, ["shared"] if i in (3, 5, 49) else [f"own{i}"], None, "text") for i in range(50)]
    spark.createDataFrame(papers, "paper_id bigint, authors string, keywords array<string>, source string, abstract string").write.parquet(f"{d}/papers.parquet")
    got = {r.owner: r for r in reference.hybrid_fusion(spark, d).collect()}
    assert got[149].graph_rank == 1 and got[149].vector_rank is None and got[101].vector_rank == 1 and got[101].graph_rank is None
    assert len(got) == 10


def test_existing_match_takes_all_dois_and_urls_of_a_work(spark, tmp_path):
    d = str(tmp_path)
    raw = [
        ("W1", "10.1000/b", []), ("W1", "10.1000/a", None), ("W2", None, ["https://x.example/1", "http://www.y.example/2/?utm_source=f"]),
        ("W3", "10.1000/none", ["https://z.example"]), ("w4", None, None), ("W5", None, [None]), ("W6", "10.1000/a", ["https://y.example/2"]), ("W7", None, ["https://y.example/2"]), (None, "10.1000/a", None),
    ]
    raw = [(i, doi, urls and [(u,) for u in urls], "T") for i, doi, urls in raw]
    spark.createDataFrame(raw, "openalex_id string, doi string, source_locations array<struct<url string>>, title string").write.parquet(f"{d}/raw_papers.parquet")
    papers = [(1, None, "10.1000/A", None, "T"), (2, None, None, "https://y.example/2", None), (3, "W4", None, None, None), (4, None, None, "https://openalex.org/w3", None), (5, "W7", None, None, None)]
    spark.createDataFrame(papers, "paper_id bigint, openalex_id string, doi string, source_url string, title string").write.parquet(f"{d}/papers.parquet")
    got = {r.openalex_id: r.reason for r in reference.raw_existing_match(spark, d).collect()}
    assert got == {"W1": "doi", "W2": "source_url", "W3": "openalex_id", "w4": "openalex_id", "W5": None, "W6": "doi", "W7": "source_url"}


def test_load_checks_cover_all_stored_columns(spark, tmp_path):
    d = str(tmp_path)
    texts = {"papers": ("title", "authors", "abstract", "introduction", "body", "conclusion", "source", "source_url", "doi", "language"),
             "news": ("original_language", "title_original", "title_en_for_rag", "content_original", "content_en_for_rag", "source", "url", "category")}
    fine = lambda c: "https://h.example/x" if "url" in c else "x"
    for name, key in (("papers", "paper_id"), ("news", "news_id")):
        cols = texts[name]
        rows = [(0, *map(fine, cols), ["k"], "2025-01-01"), *((i, *(fine(c) + "\0" if c == own else fine(c) for c in cols), ["k"], "2025-01-01") for i, own in enumerate(cols, 1))]
        rows += [(90, *map(fine, cols), ["a\0"], "2025-01-01"), (91, *(None for _ in cols), None, None), (92, *("x" * 501 if c == "title_en_for_rag" else fine(c) for c in cols), ["k"], "2025-01-01"), (93, *("x" if "url" in c else "x" for c in cols), ["k"], "2025-01-01")]
        schema = f"{key} bigint, " + ", ".join(f"{c} string" for c in cols) + ", keywords array<string>, published_at string"
        df = spark.createDataFrame(rows, schema).selectExpr("* except (published_at)", "published_at::timestamp as published_at", "current_timestamp() as collected_at", "1 as published_year", "cast(null as string) as content_hash")
        df.write.parquet(f"{d}/{name}.parquet")
    got = {(r.kind, r.id): r.errors for r in reference.load_checks(spark, d).collect()}
    want = {(name, i): f"{c}:nul" for name, cols in texts.items() for i, c in enumerate(cols, 1)} | {(name, 90): "keywords:nul" for name in texts} | {("papers", 93): "source_url:url", ("news", 93): "url:url"}
    missing = {"papers": ("title", "source_url"), "news": ("title_original", "content_original", "url", "title_en_for_rag", "content_en_for_rag", "published_at")}
    assert got == want | {(name, 91): ",".join(f"{c}:required" for c in cols) for name, cols in missing.items()} | {("news", 92): "title_en_for_rag:length"}
