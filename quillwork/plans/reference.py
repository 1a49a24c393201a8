"""Queries of document analytics and retrieval over the project's tables, each over its whole tables."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identity
from ..operators import dedupe, documents, entities, graph, layout, loading, quality, retrieval
from ..operators.skew import spread_join
from ..operators.tables import materialize
from ..sources import feeds
from ..streaming.news import first_deliveries, windowed_counts
from . import training
from .base import table

#: The moment that recency is measured from.
AS_OF = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)
CORE = r"fans?\b|followers"
CONTEXTS = {"platforms": r"online groups|posts", "performance": r"\btour\b|concert", "commerce": r"market|prices", "learning": r"students|teachers"}
TOP_K = 10
# The edges over which papers are related.
RELATIONS = ["CITES", "RELATED_TO", "HAS_TOPIC", "HAS_KEYWORD"]


def _as_of() -> Column:
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


def identity_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select(
        "paper_id", identity.doi_key(F.col("doi")).alias("doi_key"), identity.url_or_doi_key(F.col("source_url")).alias("url_key"),
        identity.hash_key(F.col("content_hash")).alias("hash_key"), dedupe.normalized_title(F.col("title")).alias("title_key"),
    )


def news_url_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "news").select("news_id", identity.url_key(F.col("url")).alias("url_key")).where("url_key is not null")
    return keys.groupBy("url_key").agg(F.count("*").alias("deliveries"), F.min("news_id").alias("first_id"))


def raw_existing_match(spark: SparkSession, d: str) -> DataFrame:
    """Raw papers that are already stored, with the first key that says so: any DOI of the work, any of its URLs, its OpenAlex id."""
    raw = table(spark, d, "raw_papers").where("openalex_id is not null").select("openalex_id", "doi", F.explode_outer("source_locations.url").alias("url"))
    papers = table(spark, d, "papers")
    ids = F.array(F.upper("openalex_id"), *(identity.openalex_key(F.col(c)) for c in ("openalex_id", "source_url")))
    papers = papers.select("doi", "source_url", F.explode(F.array_distinct(ids)).alias("openalex_id"))
    keys = {
        "doi": (identity.doi_key(F.col("doi")), identity.doi_key(F.col("doi"))),
        "source_url": (identity.url_or_doi_key(F.col("url")), identity.url_or_doi_key(F.col("source_url"))),
        "openalex_id": (F.upper("openalex_id"), F.col("openalex_id")),
    }
    return dedupe.existing_match(raw, "openalex_id", papers, keys)


def _flags() -> Column:
    return quality.quality_flags(F.col("title"), F.col("fulltext"), {n: F.col(n) for n in quality.LEAST_SECTION})


def paper_quality_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("paper_id", F.array_join(_flags(), ",").alias("flags"))


def paper_quality_state(spark: SparkSession, d: str) -> DataFrame:
    """Flags, score and state of every paper; the second of equal full texts needs review."""
    papers = table(spark, d, "papers").where("paper_id is not null")
    text_key = F.when(F.length("fulltext") > 0, F.sha2(F.regexp_replace(F.lower("fulltext"), r"[^\p{L}\p{N}]+", ""), 256))
    language, confidence = F.col("language"), F.col("language_detection_confidence")
    status = F.array_compact(F.array(F.when(F.col("fulltext_status") == "unavailable", "source_not_acquired").when(F.col("fulltext_status") == "extraction_failed", "extraction_failed"), F.when(F.coalesce(F.length("fulltext"), F.lit(0)) == 0, "no_extracted_text")))
    flags = F.concat(_flags(), quality.language_flags(language, confidence), status)
    # The texts are read once; what is compared are their hashes.
    slim = materialize(papers.select("paper_id", "language", "language_detection_confidence", "language_metadata", flags.alias("f"), text_key.alias("text_key")), "quality")
    marked = quality.first_of_equal(slim, F.col("text_key"), F.col("paper_id"))
    scored = marked.withColumn("q", quality.quality_state(F.col("f"), language, confidence, F.col("language_metadata"), F.col("is_repeat")))
    listed = F.when(F.col("is_repeat"), F.concat("f", F.array(F.lit("duplicate_fulltext")))).otherwise(F.col("f"))
    return scored.select("paper_id", "is_repeat", F.array_join(listed, ",").alias("flags"), "q.score", "q.state")


def paper_relevance(spark: SparkSession, d: str) -> DataFrame:
    r = quality.relevance(F.col("title"), F.col("abstract"), CORE, CONTEXTS)
    return table(spark, d, "papers").select("paper_id", r.alias("r")).select("paper_id", F.col("r.score").alias("score"), F.array_join("r.topics", ",").alias("topics"))


def abstract_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Abstracts written as inverted indexes and read back."""
    index = quality.inverted_index(F.col("abstract"))
    return table(spark, d, "papers").select("paper_id", quality.abstract_from_index(index).alias("abstract"), F.size(index).alias("n_words"))


def sample_support(spark: SparkSession, d: str) -> DataFrame:
    """How much of each target's vocabulary its evidence has."""
    score = quality.support_score(F.col("target"), F.concat(F.coalesce("paper_evidence", F.array().cast("array<string>")), F.coalesce("news_evidence", F.array().cast("array<string>"))))
    return table(spark, d, "grounded_samples").select("sample_id", F.round(score, 6).alias("support")).distinct()


def unsupported_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of a target that its title, topic, question and evidence lack."""
    s = table(spark, d, "grounded_samples")
    none = F.array().cast("array<string>")
    support = F.concat(F.array("title", "topic", "research_question"), F.coalesce("paper_evidence", none), F.coalesce("news_evidence", none))
    return s.select("sample_id", F.explode(quality.unsupported_numbers(F.col("target"), support)).alias("number")).distinct()


def training_sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of each section that are fit for training, and their words."""
    papers = table(spark, d, "papers")
    fields = ("introduction", "body", "conclusion")
    s = papers.select("paper_id", F.explode(F.array(*(F.struct(F.lit(f).alias("section"), quality.training_sentences(F.col(f)).alias("s")) for f in fields))).alias("x"))
    words = F.aggregate(F.col("x.s"), F.lit(0), lambda a, t: a + F.size(F.split(t, " ")))
    return s.select("paper_id", "x.section", F.size("x.s").alias("sentences"), words.alias("words"))


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings")
    asked = rows.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return rows, asked


def vector_search(spark: SparkSession, d: str) -> DataFrame:
    """The most similar vectors of every vector whose id is divisible by 50."""
    rows, asked = _vectors(spark, d)
    found = retrieval.vector_search(rows, asked, "vec_id", "embedding", TOP_K, exclude_self=True)
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


def _chunks(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    """(vec_id, chunk_id, owner): vectors as chunks of all papers or all news, which are dealt out in order of their ids.

    Every vector has an owner and every owner a chunk: the longer of the two lists goes round the shorter one, so with more owners
    than vectors a vector is a chunk of several owners, each under a chunk_id of its own.
    """
    owners = table(spark, d, name).select(F.col(key).alias("owner")).where("owner is not null").distinct()
    vectors = table(spark, d, "embeddings").where("vec_id is not null and embedding is not null").select("vec_id").distinct()
    owners, vectors = (quality.with_row_ids(x, "place", -1, [F.col(c)]) for x, c in ((owners, "owner"), (vectors, "vec_id")))
    n_owners, n_vectors = owners.count(), vectors.count()
    longer, shorter, n = (owners, vectors, n_vectors) if n_owners > n_vectors else (vectors, owners, n_owners)
    longer = longer.withColumnRenamed("place", "chunk_id").withColumn("place", F.col("chunk_id") % max(n, 1))
    return longer.join(shorter, "place").select("vec_id", "chunk_id", "owner")


def _chunk_hits(spark: SparkSession, d: str, k: int = 40) -> DataFrame:
    """The k most similar chunks of papers for each query (ties: smaller vector, then smaller chunk)."""
    rows, asked = _vectors(spark, d)
    found = retrieval.vector_search(rows, asked, "vec_id", "embedding", k, exclude_self=True).join(_chunks(spark, d, "papers", "paper_id"), "vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id", "chunk_id")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("query_id", "chunk_id", "owner", "similarity")


def _best_chunks(spark: SparkSession, d: str, name: str, key: str, per_owner: int) -> DataFrame:
    """The best chunks of every paper or news item, of all vectors."""
    rows, asked = _vectors(spark, d)
    return retrieval.best_chunks(rows, _chunks(spark, d, name, key), asked, "vec_id", "embedding", per_owner, exclude_self=True)


def best_chunk_per_owner(spark: SparkSession, d: str) -> DataFrame:
    """The two best chunks of every paper for each query."""
    hits = _best_chunks(spark, d, "papers", "paper_id", 2)
    return hits.select("query_id", "owner", "chunk_id", "owner_rank", F.round("similarity", 6).alias("similarity"))


def news_recency_ranking(spark: SparkSession, d: str) -> DataFrame:
    """News by similarity of their best chunk and recency; all news are ranked before any is left out."""
    news = table(spark, d, "news").select("news_id", "published_at")
    hits = _best_chunks(spark, d, "news", "news_id", 1).withColumnRenamed("owner", "news_id").join(news, "news_id")
    best = retrieval.news_ranking(hits, _as_of(), 5)
    return best.select("query_id", "news_id", "chunk_id", "recency_score", F.round("ranking_score", 6).alias("ranking_score"), "news_rank")


def diversity_ranking(spark: SparkSession, d: str) -> DataFrame:
    ranked = retrieval.diversity_ranking(_chunk_hits(spark, d), "owner")
    return ranked.select("query_id", "owner", "chunk_id", F.round("diversity_score", 6).alias("diversity_score"), "final_rank")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.paper_edges(table(spark, d, "papers"))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes(_edges(spark, d)).select("id", "label", "degree")


def graph_related(spark: SparkSession, d: str) -> DataFrame:
    """Papers that share keywords with each paper whose id is divisible by 50."""
    seeds = table(spark, d, "papers").where(F.col("paper_id") % 50 == 0).select(F.concat(F.lit("Paper:"), F.col("paper_id").cast("string")).alias("seed"))
    found = graph.related(_edges(spark, d), seeds, RELATIONS, TOP_K)
    return found.withColumn("relation_paths", F.array_join("relation_paths", ","))


def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Papers found by vectors and papers that share keywords with these, fused by reciprocal ranks.

    The seeds are the papers of a query's nearest chunks; a seed is not found by the graph again.
    """
    best = retrieval.best_per_owner(_chunk_hits(spark, d), "owner")
    by_vector = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id"))).select("query_id", "owner", "rank")
    seeds = by_vector.select("query_id", F.concat(F.lit("Paper:"), F.col("owner").cast("string")).alias("seed"))
    related = graph.related_to_sets(_edges(spark, d), seeds, RELATIONS, TOP_K)
    by_graph = related.select("query_id", F.substring("related", len("Paper:") + 1, 20).cast("bigint").alias("owner"), "rank")
    fused = retrieval.reciprocal_rank_fusion({"vector": by_vector, "graph": by_graph}, "owner", TOP_K)
    return fused.select("query_id", "owner", "vector_rank", "graph_rank", F.round("rrf_score", 9).alias("rrf_score"), "hybrid_rank")


def evidence_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether each query's chunks are enough to write from, or it must be abstained."""
    checked = retrieval.evidence_check(_with_text(spark, d, _chunk_hits(spark, d)), owner="owner")
    return checked.withColumn("action", F.when(F.col("can_generate"), "generate").otherwise("abstain"))


def _with_text(spark: SparkSession, d: str, hits: DataFrame, *more: str) -> DataFrame:
    papers = table(spark, d, "papers").where("paper_id is not null").select(F.col("paper_id").alias("owner"), *more, F.col("abstract").alias("content"))
    return hits.join(papers, "owner", "left")


def collapsed_papers(spark: SparkSession, d: str) -> DataFrame:
    """The papers of each query's chunks, with their chunks."""
    found = retrieval.collapsed(_chunk_hits(spark, d), "owner")
    return found.select("query_id", "owner", "vector_rank", F.round("similarity", 6).alias("similarity"), F.array_join(F.transform("chunks", lambda c: c.cast("string")), ",").alias("chunks"))


def _live(spark: SparkSession, d: str, k: int) -> DataFrame:
    """(query_id, chunk_id, owner, similarity, found_by): the k nearest chunks, and two of each paper that the graph relates to theirs."""
    rows, asked = _vectors(spark, d)
    near = materialize(_chunk_hits(spark, d, k), "near")
    seeds = near.select("query_id", F.concat(F.lit("Paper:"), F.col("owner").cast("string")).alias("seed"))
    related = graph.related_to_sets(_edges(spark, d), seeds, RELATIONS, TOP_K).select("query_id", F.substring("related", len("Paper:") + 1, 20).cast("bigint").alias("owner"))
    by_graph = retrieval.chunks_of_owners(related, rows, _chunks(spark, d, "papers", "paper_id"), asked, "vec_id", "embedding", 2).drop("owner_rank")
    both = near.withColumn("found_by", F.lit("vector")).unionByName(by_graph.withColumn("found_by", F.lit("graph")))
    return retrieval.first_of_hits(both, ["chunk_id"], ["owner"], [F.when(F.col("found_by") == "vector", 0).otherwise(1)])


def live_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Chunks found by vectors and over the graph, each once, ranked with regard to the diversity of papers."""
    ranked = retrieval.diversity_ranking(_live(spark, d, 5), "owner")
    return ranked.select("query_id", "chunk_id", "owner", "found_by", F.round("diversity_score", 6).alias("diversity_score"), "final_rank")


def second_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Per query the chunks of a first narrow search and, where these are too little evidence, those of a second wider one after them, each once."""
    first = materialize(_chunk_hits(spark, d, 3).withColumn("round", F.lit(1)), "first")
    lacking = retrieval.evidence_check(_with_text(spark, d, first), owner="owner").where("not can_generate").select("query_id")
    second = _chunk_hits(spark, d, 12).join(lacking, "query_id", "left_semi").withColumn("round", F.lit(2))
    merged = retrieval.first_of_hits(first.unionByName(second), ["chunk_id"], ["owner"], [F.col("round"), -F.col("similarity"), F.col("chunk_id")])
    return merged.select("query_id", "chunk_id", "owner", "round", F.round("similarity", 6).alias("similarity"))


def evidence_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each query's best five chunks as numbered evidence."""
    hits = _with_text(spark, d, _chunk_hits(spark, d), "title", "published_year", "source", "doi")
    return retrieval.evidence_text(hits, "PAPER", [("Title", "title"), ("Published Year", "published_year"), ("Source", "source"), ("DOI", "doi")], [F.desc("similarity"), F.col("chunk_id")], 5, 600)


#: A name is catalogued if so many titles of papers have it.
LEAST_TITLES = 3


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue made from the tables: the names that several papers' titles have, those in capitals as groups, others as platforms; with a Korean name where a Korean title has it."""
    titles = table(spark, d, "papers").where("paper_id is not null").select("paper_id", "title", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("title", F.lit("")), F.lit(r"\b(?:[A-Z]{3,}|[A-Z][a-z]+[A-Z][A-Za-z]*)\b"), F.lit(0)))).alias("name"))
    names = titles.groupBy("name").agg(F.countDistinct("paper_id").alias("n"), F.min("paper_id").alias("first")).where(F.col("n") >= LEAST_TITLES)
    entries = names.select(
        F.when(F.col("name").rlike("^[A-Z]+$"), "Group").otherwise("Platform").alias("entity_type"), F.lit(None).cast("string").alias("name_ko"), F.col("name").alias("name_en"), F.array(F.lower("name")).alias("aliases"),
        F.concat(F.lit("https://names.example/"), F.col("name")).alias("authority_url"), F.array(F.concat(F.lit("https://papers.example/"), F.col("first").cast("string"))).alias("source_urls"),
    )
    return entities.catalogue(entries)


def entity_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return _catalogue(spark, d).select("entity_id", "entity_type", "canonical_name", F.array_join("aliases", "|").alias("aliases"), "problem")


def entity_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Catalogued names in news, and the documents they are in."""
    news = table(spark, d, "news").select("news_id", F.concat_ws("\n", "title_original", "content_original").alias("text"))
    return entities.mentions(news, "news_id", F.col("text"), _catalogue(spark, d))


def mention_edges(spark: SparkSession, d: str) -> DataFrame:
    """The graph's edges from news to the entities they mention, and those of papers' titles and texts."""
    known = _catalogue(spark, d)
    papers = table(spark, d, "papers").select("paper_id", F.concat_ws("\n", "title", "abstract", "introduction", "body", "conclusion").alias("text"))
    news = table(spark, d, "news").select("news_id", F.concat_ws("\n", "title_original", "content_original").alias("text"))
    edges = entities.mention_graph(entities.mentions(papers, "paper_id", F.col("text"), known), "paper_id", "Paper")[1]
    return edges.union(entities.mention_graph(entities.mentions(news, "news_id", F.col("text"), known), "news_id", "News")[1])


def name_protection(spark: SparkSession, d: str) -> DataFrame:
    """News with their verified names replaced by markers, and whether putting them back gives the names everywhere."""
    found = entity_mentions(spark, d).where("status = 'resolved'").groupBy("news_id").agg(F.collect_list(F.struct(F.col("alias").alias("surface"), F.col("canonical_name").alias("name"))).alias("names"))
    news = table(spark, d, "news").where("news_id is not null and content_original is not null").select("news_id", "title_original", "content_original").join(found, "news_id")
    done = entities.protected(news, F.col("names"), ["title_original", "content_original"])
    source = news.select("news_id", F.col("content_original").alias("source"))
    back = entities.restored(F.col("content_original"), F.col("content_original"), F.col("markers"))
    return done.join(source, "news_id").select("news_id", F.size("markers").alias("n_names"), F.md5(F.lower(back)).alias("restored"))


def korean_titles(spark: SparkSession, d: str) -> DataFrame:
    """Quoted Korean titles in Korean news."""
    news = table(spark, d, "news").where(F.lower(F.trim("original_language")) == "ko")
    return entities.quoted_titles(news, "news_id", F.col("title_original"), F.col("content_original"))


def graph_context(spark: SparkSession, d: str) -> DataFrame:
    """Every paper with its authors, keywords and sources in the graph."""
    found = graph.paper_context(_edges(spark, d), table(spark, d, "papers"))
    return found.select("paper_id", "title", *(F.array_join(c, "|").alias(c) for c in ("authors", "keywords", "sources")))


def article_cleaning(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "news")
    return n.select("news_id", F.md5(documents.clean_article(F.col("content_original"), F.col("title_original"))).alias("digest"))


def load_checks(spark: SparkSession, d: str) -> DataFrame:
    """Rows of papers and news that can't be stored: missing fields, NUL characters, lengths and URLs, with every reason."""
    out = None
    for name, spec in loading.TABLES.items():
        df = loading.prepared(table(spark, d, name), name, _doi_or_own)
        bad = df.select(F.lit(name).alias("kind"), F.col(spec["key"]).alias("id"), F.array_join("errors", ",").alias("errors")).where("errors <> ''")
        out = bad if out is None else out.union(bad)
    return out


def _doi_or_own(doi: Column) -> Column:
    return F.coalesce(identity.doi_key(doi), F.lower(doi))


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """The content hash of every paper and news item as it is loaded."""
    parts = [loading.prepared(table(spark, d, n), n).select(F.lit(n).alias("kind"), F.col(s["key"]).alias("id"), "content_hash") for n, s in loading.TABLES.items()]
    return parts[0].union(parts[1])


def load_plan(spark: SparkSession, d: str) -> DataFrame:
    """What loading the papers that the graph lacks would do, beside those it has as the stored ones."""
    papers = table(spark, d, "papers").withColumn("synced", F.coalesce("graph_synced", F.lit(False)))
    doi, url, digest = identity.doi_key(F.col("doi")), F.when(F.trim("source_url") != "", F.col("source_url")), identity.hash_key(F.col("content_hash"))
    keys = {"doi": (doi, doi), "source_url": (url, url), "content_hash": (digest, digest)}
    return loading.load_plan(papers.where("not synced"), "paper_id", papers.where("synced").withColumnRenamed("paper_id", "stored"), "stored", keys, [F.col("paper_id")]).withColumnRenamed("stored_id", "target_id")


def embedded_texts(spark: SparkSession, d: str) -> DataFrame:
    """The offline embedding of every abstract."""
    v = loading.hashed_embedding(F.col("abstract"), 16)
    return table(spark, d, "papers").select("paper_id", F.array_join(F.transform(v, lambda x: F.round(x, 5).cast("string")), ",").alias("embedding"))


def chunk_index(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of all papers taken into an index that has those of synced papers already; per paper how many, and whether each has a vector and stands in the paper."""
    papers = table(spark, d, "papers").where("paper_id is not null")
    fields = ["abstract", "introduction", "body", "conclusion"]
    chunks = documents.token_chunks(papers, ["paper_id"], fields)
    old = documents.token_chunks(papers.where("graph_synced"), ["paper_id"], fields)
    index = loading.indexed_chunks(chunks, "paper_id", loading.indexed_chunks(old, "paper_id", None))
    whole = papers.select("paper_id", F.concat_ws("\n", *fields).alias("whole")).dropDuplicates(["paper_id"])
    d2 = index.join(whole, "paper_id")
    inside = F.col("content").contains("\ufffd") | F.col("whole").contains(F.col("content"))  # a window may cut a character in two
    return d2.groupBy("paper_id").agg(
        F.bool_and(F.size("embedding") == 64).alias("embedded"), F.bool_and(inside).alias("inside"), (F.max("chunk_index") + 1 == F.count("*")).alias("numbered"), (F.countDistinct("chunk_index") == F.count("*")).alias("once")
    )


def feed_items(spark: SparkSession, d: str) -> DataFrame:
    """News written as RSS items, read again and classified by date and topic."""
    news = table(spark, d, "news").where("news_id is not null")
    stamp = F.date_format(F.col("published_at").cast("timestamp"), "d MMM yyyy HH:mm:ss")
    items = news.select(
        F.col("title_original").alias("title"), F.col("url").alias("link"), F.concat(stamp, F.lit(" +0000")).alias("pubDate"), F.col("content_original").alias("description"), F.col("keywords").alias("category"), "news_id"
    )
    found = feeds.feed_news(items.drop("news_id"), _as_of(), 365, CONTEXTS)
    return found.groupBy("status", "category").agg(F.count("*").alias("n"))


def work_records(spark: SparkSession, d: str) -> DataFrame:
    """Papers written as work records, with inverted abstracts, and normalised again."""
    p = table(spark, d, "papers").where("paper_id is not null")
    place = F.struct(F.lit(True).alias("is_oa"), F.lit(None).cast("string").alias("pdf_url"), F.col("source_url").alias("landing_page_url"), F.lit("cc-by").alias("license"), F.lit(None).cast("string").alias("version"))
    works = p.select(
        F.concat(F.lit("https://works.example/W"), F.col("paper_id").cast("string")).alias("id"), "title", F.lit("article").alias("type"), F.col("published_year").alias("publication_year"), F.lit(False).alias("is_retracted"), "doi", "language",
        quality.inverted_index(F.col("abstract")).alias("abstract_inverted_index"), F.struct(F.lit(True).alias("is_oa"), F.lit("gold").alias("oa_status")).alias("open_access"), place.alias("best_oa_location"), F.array(place).alias("locations"),
        F.transform(graph.author_names(F.col("authors")), lambda a: F.struct(F.struct(a.alias("display_name")).alias("author"))).alias("authorships"), F.transform("keywords", lambda k: F.struct(k.alias("display_name"))).alias("keywords"),
    )
    w = feeds.normalized_works(works, CORE, CONTEXTS, 2026)
    lists = {"authors": "authors", "keywords": "keywords", "matched_topics": "matched_topics"}
    return w.select("id", "title", "published_year", "abstract", "doi", "relevance_score", *(F.array_join(c, "|").alias(n) for n, c in lists.items()), F.array_join(F.transform("source_locations", lambda x: x.url), "|").alias("urls"))


def allocated_ids(spark: SparkSession, d: str) -> DataFrame:
    """Raw papers' works numbered after the largest stored id, in order of their id."""
    works = table(spark, d, "raw_papers").where("openalex_id is not null").select("openalex_id").distinct()
    top = table(spark, d, "papers").agg(F.coalesce(F.max("paper_id"), F.lit(0)).alias("m")).first()["m"]
    return quality.with_row_ids(works, "paper_id", int(top), [F.col("openalex_id")])


def unsynced_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the graph doesn't have yet, per kind and source."""
    out = None
    for name in ("papers", "news"):
        part = table(spark, d, name).where("not coalesce(graph_synced, false)").groupBy("source").agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "source", "n")
        out = part if out is None else out.union(part)
    return out


def news_first_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """The first delivery of each URL."""
    return first_deliveries(table(spark, d, "news").select("news_id", "url", "collected_at")).select("url_key", "news_id", F.unix_seconds(F.col("collected_at").cast("timestamp")).alias("collected_at"))


def streamed_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """The URLs that a stream over the news delivers, each once."""
    from ..streaming.news import stream_to_table

    source = table(spark, d, "news")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "news.parquet").parquet(d)
    done = stream_to_table(first_deliveries(stream.withColumn("collected_at", F.col("collected_at").cast("timestamp")), "36500 days").select("url_key"))
    return done.groupBy("url_key").agg(F.count("*").alias("deliveries"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = windowed_counts(e, "ts", ["event_type"], "1 hour", value=F.col("value"))
    return out.select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def news_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Every news item with the one it repeats: by URL, then title, then content, first come."""
    news = table(spark, d, "news")
    content = F.regexp_replace(F.lower("content_original"), r"[^\p{L}\p{N}_]+", "")
    keys = [identity.url_key(F.col("url")), dedupe.normalized_title(F.col("title_original")), F.when(content != "", F.sha2(content, 256))]
    return dedupe.first_come(news, "news_id", keys, [F.col("news_id")])


def raw_paper_selection(spark: SparkSession, d: str) -> DataFrame:
    """Raw fetches merged into works, open and relevant ones first; retained ones with the queries, places and ids of what was merged into them."""
    none = F.array().cast("array<string>")
    raw = table(spark, d, "raw_papers").where("openalex_id is not null")
    urls = F.array_distinct(F.filter(F.coalesce("source_locations.url", none), lambda u: u.isNotNull()))
    told = F.concat_ws("|", "openalex_id", "title", "doi", F.col("retrieved_at").cast("string"), F.col("loaded_at").cast("string"), F.array_join(F.coalesce("matched_queries", none), "+"), F.array_join(F.array_sort(urls), "+"))
    raw = raw.select("openalex_id", "title", "doi", "is_oa", "relevance_score", "matched_queries", urls.alias("urls"), F.conv(F.substring(F.md5(told), 1, 15), 16, 10).cast("bigint").alias("fetch_id")).dropDuplicates(["fetch_id"])
    raw = materialize(raw, "fetches")
    keys = [F.upper("openalex_id"), dedupe.normalized_title(F.col("title")), identity.doi_key(F.col("doi"))]
    order = [(-F.coalesce("is_oa", F.lit(False)).cast("int")), -F.coalesce("relevance_score", F.lit(0)), F.col("openalex_id")]
    kept = materialize(dedupe.first_come(raw, "fetch_id", keys, order), "kept")
    own = raw.select(F.col("fetch_id").alias("retained_id"), F.upper("openalex_id").alias("retained"))
    merged = spread_join(raw.join(kept, "fetch_id"), own, ["retained_id"], "fetch_id")
    # Each kind of value is made distinct before it is gathered.
    parts = F.array(F.struct(F.lit("q").alias("k"), F.coalesce("matched_queries", none).alias("v")), F.struct(F.lit("u").alias("k"), F.col("urls").alias("v")), F.struct(F.lit("i").alias("k"), F.when(F.upper("openalex_id") != F.col("retained"), F.array(F.upper("openalex_id"))).otherwise(none).alias("v")))
    values = merged.select("retained_id", F.inline(parts)).select("retained_id", "k", F.explode("v").alias("v")).where("v is not null").distinct()
    of = lambda k, name: F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") == k, F.col("v")))), "|").alias(name)
    lists = values.groupBy("retained_id").agg(of("q", "queries"), of("u", "urls"), of("i", "merged_ids"))
    per = merged.groupBy("retained_id").agg(F.count("*").alias("fetches"))
    out = per.join(raw.select(F.col("fetch_id").alias("retained_id"), "openalex_id", "title"), "retained_id").join(lists, "retained_id", "left")
    return out.select("openalex_id", "title", "fetches", *(F.coalesce(c, F.lit("")).alias(c) for c in ("queries", "urls", "merged_ids")))


def paper_chunks(spark: SparkSession, d: str) -> DataFrame:
    return documents.token_chunks(table(spark, d, "papers"), ["paper_id"], ["abstract", "introduction", "body", "conclusion"])


def news_chunks(spark: SparkSession, d: str) -> DataFrame:
    return documents.token_chunks(table(spark, d, "news"), ["news_id"], ["content_en_for_rag"])


def _printed(source: str) -> list[Column]:
    """A paper's fields as pages that each begin with the source and a number and end with the page's number."""
    fields = ("abstract", "introduction", "body", "conclusion")
    return [F.concat_ws("\n", F.concat(F.coalesce(source, F.lit("Printed")), F.lit(f" {i}")), F.coalesce(f, F.lit("")), F.lit(f"Page {i} of {len(fields)}")) for i, f in enumerate(fields, 1)]


def page_cleaning(spark: SparkSession, d: str) -> DataFrame:
    """Papers printed page by page and cleaned: headers and page numbers go, and so do repeated paragraphs."""
    found = layout.cleaned_pages(table(spark, d, "papers"), ["paper_id"], F.array(*_printed("source")))
    return found.select("paper_id", F.md5("text").alias("digest"), "removed_lines", "removed_paragraphs")


def section_finding(spark: SparkSession, d: str) -> DataFrame:
    """Papers written out under headings, and their sections found again."""
    headed = F.concat_ws(
        "\n", F.lit("Abstract"), "abstract", F.lit("1. Introduction"), "introduction", F.lit("Figure 1. What was seen"), F.lit("1.1 The Scope of It"), "title", F.lit("2. Methods"), F.lit("Table 2"), F.lit("Source: own figures"), "body",
        F.lit("3. Conclusion"), "conclusion", F.lit("References"), "source_url", F.lit("Appendix A"), "doi",
    )
    found = layout.sections(table(spark, d, "papers"), ["paper_id"], headed)
    names = ("abstract", "introduction", "body", "conclusion", "references", "appendix")
    return found.select("paper_id", *(F.md5(F.col(c)).alias(c) for c in names), F.array_join(F.transform("captions", lambda c: c.text), "|").alias("captions"), F.array_join(F.transform("sections", lambda x: x.section_type), ",").alias("types"))


ALL = (
    identity_keys, news_url_keys, raw_existing_match, paper_quality_flags, paper_quality_state, paper_relevance, abstract_round_trip, sample_support, unsupported_numbers, training_sentence_counts, vector_search,
    best_chunk_per_owner, news_recency_ranking, diversity_ranking, graph_edges, graph_nodes, graph_related, graph_context, hybrid_fusion, collapsed_papers, live_retrieval, second_retrieval, evidence_texts, evidence_check, entity_catalogue,
    entity_mentions, mention_edges, name_protection, korean_titles, article_cleaning, load_checks, content_hashes, load_plan, embedded_texts, chunk_index, feed_items, work_records, allocated_ids, unsynced_documents, news_first_deliveries,
    streamed_deliveries, event_windows, news_dedupe, raw_paper_selection, paper_chunks, news_chunks, page_cleaning, section_finding,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL} | training.queries()
