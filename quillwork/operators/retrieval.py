"""Vector search, graph expansion, rank fusion and evidence checks over DataFrames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import grid_join, spread_join
from .tables import materialize

# Bonus of recent news, and what a repeated source costs in diversity ranking.
RECENCY_WEIGHT, REPEAT_COST, REPEAT_MOST, RRF_K = 0.08, 0.015, 4, 60


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of a list column, and which of its rows are usable (of that size, no null, not all zero)."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    good = lengths == max(size, 1)
    flat = column.filter(pa.array(good)).flatten()
    whole = np.ones(len(flat), dtype=bool) if not flat.null_count else flat.is_valid().to_numpy(zero_copy_only=False)
    values = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, max(size, 1))
    out = np.zeros((len(column), max(size, 1)))
    out[good] = values
    good[np.flatnonzero(good)[~whole.reshape(values.shape).all(axis=1)]] = False
    norm = np.sqrt((out * out).sum(axis=1))
    good &= norm > 0
    out[good] /= norm[good, None]
    return out, good


def vector_search(
    rows: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int, query_id: str = "query_id", query_vector: str = "query_vector",
    block: int = 2000, exclude_self: bool = False,
) -> DataFrame:
    """(query_id, id_col, similarity, rank): the k rows most cosine-similar to each query, exactly.

    Queries are taken to the tasks in blocks of at most `block`; each task keeps its own k best of
    its rows by one matrix product a batch, so what is shuffled is k rows per query and task, and
    the rows themselves never are. Ties go to the smaller id. Null, all-zero and wrong-length
    vectors match nothing; the right length is the most frequent one of the queries. Queries of null id are left out.
    """
    source = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    found = None
    for own, several in _query_blocks(queries, query_id, query_vector, block):
        part = source.mapInArrow(_searcher(own, k, exclude_self), "query_id bigint, id bigint, similarity double")
        if several:  # the driver and the plan hold one block at a time
            part = materialize(part, "hits")
        found = part if found is None else found.union(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(F.col("query_id").alias(query_id), F.col("id").alias(id_col), "similarity", "rank")


def _query_blocks(queries: DataFrame, query_id: str, query_vector: str, block: int) -> Iterator[tuple[list[tuple[int, Sequence[float]]], bool]]:
    """The queries on the driver, some `block` at a time, each once and in order of their ids, and whether there are several blocks; at least one block, which may be empty.

    Only queries of the most frequent length are taken (of equally frequent ones, the shorter)."""
    asked = queries.select(query_id, query_vector).where(F.col(query_id).isNotNull() & F.col(query_vector).isNotNull())
    sizes = asked.groupBy(F.size(query_vector).alias("width")).agg(F.countDistinct(query_id).alias("n")).where("width > 0").collect()
    best = max(sizes, key=lambda r: (r["n"], -r["width"]), default=None)
    asked = asked.where(F.size(query_vector) == (best["width"] if best else 0)).dropDuplicates([query_id])
    shards = max(1, -(-(best["n"] if best else 0) // block))
    numbered = asked.withColumn("shard", F.pmod(F.xxhash64(query_id), F.lit(shards)))
    for shard in range(shards):
        yield sorted(((r[0], r[1]) for r in numbered.where(F.col("shard") == shard).select(query_id, query_vector).collect()), key=lambda r: r[0]), shards > 1


def _searcher(queries: Sequence[tuple[int, Sequence[float]]], k: int, exclude_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.array([q for q, _ in queries], dtype=np.int64)
        width = len(queries[0][1]) if queries else 0
        asked, good_q = _matrix(pa.array([list(v) for _, v in queries], pa.list_(pa.float64())), width)
        best_id = np.full((len(ids), k), np.iinfo(np.int64).max)
        best = np.full((len(ids), k), -np.inf)
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            vectors, good = _matrix(batch.column(1), width)
            if not len(ids) or not good.any():
                continue
            score = asked @ vectors.T
            score[:, ~good] = -np.inf
            if exclude_self:
                score[ids[:, None] == own[None, :]] = -np.inf
            all_id = np.concatenate([best_id, np.broadcast_to(own, score.shape)], axis=1)
            all_score = np.concatenate([best, score], axis=1)
            top = np.lexsort((all_id, -all_score), axis=1)[:, :k]
            best_id, best = np.take_along_axis(all_id, top, 1), np.take_along_axis(all_score, top, 1)
        keep = np.isfinite(best) & good_q[:, None]
        q = np.broadcast_to(ids[:, None], best.shape)[keep]
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best_id[keep]), pa.array(best[keep])], names=["query_id", "id", "similarity"])

    return run


def best_chunks(
    rows: DataFrame, chunks: DataFrame, queries: DataFrame, id_col: str, vector_col: str, per_owner: int = 1, query_id: str = "query_id",
    query_vector: str = "query_vector", block: int = 2000, exclude_self: bool = False,
) -> DataFrame:
    """(query_id, owner, chunk_id, similarity, owner_rank): the per_owner most similar chunks of every owner for each query, of all vectors.

    chunks: (id_col, chunk_id, owner), the chunks that have a vector. Each batch of vectors is cut to the best of each of its
    owners before anything is shuffled; no owner is left out, however far it is. Ties go to the smaller chunk.
    Unusable vectors match nothing, as in vector_search.
    """
    held = chunks.groupBy(id_col).agg(F.collect_list(F.struct(F.col("chunk_id").cast("bigint").alias("c"), F.col("owner").cast("bigint").alias("o"))).alias("h"))
    source = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).join(held, id_col)
    source = source.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"), F.col("h.c").alias("c"), F.col("h.o").alias("o"))
    found = None
    for own, several in _query_blocks(queries, query_id, query_vector, block):
        part = source.mapInArrow(_owner_searcher(own, per_owner, exclude_self), "query_id bigint, owner bigint, chunk_id bigint, similarity double")
        if several:
            part = materialize(part, "hits")
        found = part if found is None else found.union(part)
    return best_per_owner(found, "owner", "query_id", per_owner=per_owner).withColumnRenamed("query_id", query_id)


#: Similarities that a task ranks at once.
CELLS = 2_000_000


def _owner_searcher(queries: Sequence[tuple[int, Sequence[float]]], per_owner: int, exclude_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.array([q for q, _ in queries], dtype=np.int64)
        width = len(queries[0][1]) if queries else 0
        asked, good_q = _matrix(pa.array([list(v) for _, v in queries], pa.list_(pa.float64())), width)
        ids, asked = ids[good_q], asked[good_q]
        for batch in batches:
            vectors, good = _matrix(batch.column(1), width)
            if not len(ids) or not good.any():
                continue
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            # A vector may be the chunk of several owners; its similarity is computed once, so that they tie.
            at = np.repeat(np.arange(len(own)), batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
            chunk, owner = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
            by_owner = np.argsort(owner, kind="stable")
            at, chunk, owner = at[by_owner], chunk[by_owner], owner[by_owner]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            leads = np.arange(len(owner)) - np.repeat(starts, np.diff(np.r_[starts, len(owner)])) < per_owner
            step = max(1, CELLS // max(len(owner), 1))
            for a in range(0, len(ids), step):
                score = asked[a : a + step] @ vectors.T
                score[:, ~good] = -np.inf
                if exclude_self:
                    score[ids[a : a + step, None] == own[None, :]] = -np.inf
                score = score[:, at]
                top = np.lexsort((np.broadcast_to(chunk, score.shape), -score, np.broadcast_to(owner, score.shape)), axis=1)[:, leads]
                best = np.take_along_axis(score, top, 1)
                keep = np.isfinite(best)
                q = np.broadcast_to(ids[a : a + step, None], best.shape)[keep]
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(owner[top][keep]), pa.array(chunk[top][keep]), pa.array(best[keep])], names=["query_id", "owner", "chunk_id", "similarity"])

    return run


def best_per_owner(hits: DataFrame, owner: str, query_id: str = "query_id", chunk: str = "chunk_id", per_owner: int = 1) -> DataFrame:
    """hits with owner_rank: the per_owner most similar chunks of each owner for each query (ties: smaller chunk)."""
    order = Window.partitionBy(query_id, owner).orderBy(F.desc("similarity"), chunk)
    return hits.withColumn("owner_rank", F.row_number().over(order)).where(F.col("owner_rank") <= per_owner)


def recency_score(published_at: Column, as_of: Column) -> Column:
    """1 for the last three years before as_of, 0.5 for the last five, else 0; null counts as 0."""
    return (
        F.when(published_at >= F.add_months(as_of, -36), 1.0).when(published_at >= F.add_months(as_of, -60), 0.5).otherwise(0.0)
    )


def news_ranking(hits: DataFrame, as_of: Column, k: int, query_id: str = "query_id", multiplier: int = 4) -> DataFrame:
    """The best chunk of each news item, the multiplier * k most similar of these per query, ranked by similarity plus
    a recency bonus; the first k. Columns recency_score, ranking_score and news_rank are added."""
    best = best_per_owner(hits, "news_id", query_id).drop("owner_rank")
    by_similarity = Window.partitionBy(query_id).orderBy(F.desc("similarity"), "news_id")
    candidates = best.withColumn("r", F.row_number().over(by_similarity)).where(F.col("r") <= k * multiplier).drop("r")
    scored = candidates.withColumn("recency_score", recency_score(F.col("published_at"), as_of))
    scored = scored.withColumn("ranking_score", F.col("similarity") + F.col("recency_score") * RECENCY_WEIGHT)
    by_score = Window.partitionBy(query_id).orderBy(F.desc("ranking_score"), F.desc("similarity"), "news_id")
    return scored.withColumn("news_rank", F.row_number().over(by_score)).where(F.col("news_rank") <= k)


def diversity_ranking(hits: DataFrame, owner: str, query_id: str = "query_id", chunk: str = "chunk_id") -> DataFrame:
    """hits with diversity_score and final_rank: each further chunk of one owner costs REPEAT_COST, up to REPEAT_MOST times."""
    similarity = F.coalesce("similarity", F.lit(0.0))
    key = F.coalesce(F.col(owner).cast("string"), F.concat(F.lit("chunk:"), F.col(chunk).cast("string")))
    repeated = F.row_number().over(Window.partitionBy(query_id, key).orderBy(F.desc(similarity), chunk)) - 1
    place = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc(similarity), chunk))
    scored = hits.withColumn("diversity_score", similarity - REPEAT_COST * F.least(repeated, F.lit(REPEAT_MOST))).withColumn("_place", place)
    order = Window.partitionBy(query_id).orderBy(F.desc("diversity_score"), "_place")
    return scored.withColumn("final_rank", F.row_number().over(order)).drop("_place")


def reciprocal_rank_fusion(rankings: dict[str, DataFrame], item: str, k: int, query_id: str = "query_id", rrf_k: int = RRF_K) -> DataFrame:
    """(query_id, item, <name>_rank per ranking, rrf_score, sources, hybrid_rank): the first k by the sum of
    1 / (rrf_k + rank). Each ranking has query_id, item and rank; of equal scores the item found by an earlier ranking,
    then of smaller rank, comes first. An item absent from a ranking adds nothing."""
    names = list(rankings)
    parts = [d.select(query_id, item, F.lit(n).alias("ranking"), F.col("rank").cast("int").alias("rank")) for n, d in rankings.items()]
    long = parts[0]
    for p in parts[1:]:
        long = long.union(p)
    per = long.groupBy(query_id, item).agg(*(F.min(F.when(F.col("ranking") == n, F.col("rank"))).alias(f"{n}_rank") for n in names))
    score = sum((F.coalesce(1.0 / (rrf_k + F.col(f"{n}_rank")), F.lit(0.0)) for n in names[1:]), F.coalesce(1.0 / (rrf_k + F.col(f"{names[0]}_rank")), F.lit(0.0)))
    fused = per.withColumn("rrf_score", score).withColumn("sources", F.concat_ws("+", *(F.when(F.col(f"{n}_rank").isNotNull(), n) for n in names)))
    order = Window.partitionBy(query_id).orderBy(F.desc(F.round("rrf_score", 12)), *(F.asc_nulls_last(f"{n}_rank") for n in names), item)
    return fused.withColumn("hybrid_rank", F.row_number().over(order)).where(F.col("hybrid_rank") <= k)


def evidence_check(
    hits: DataFrame, query_id: str = "query_id", owner: str = "paper_id", min_papers: int = 3, min_relevant: int = 2, min_chunks: int = 4, min_similarity: float = 0.45
) -> DataFrame:
    """Per query: papers with text, papers of at least min_similarity, chunks with text, and whether that suffices
    (can_generate), with the failed criteria in reasons."""
    has_text = F.length(F.coalesce("content", F.lit(""))) > 0
    per_paper = hits.where(has_text).groupBy(query_id, owner).agg(F.max("similarity").alias("best"), F.count("*").alias("chunks"))
    per = per_paper.groupBy(query_id).agg(
        F.count("*").alias("evidence_papers"), F.count_if(F.col("best") >= min_similarity).alias("relevant_papers"), F.sum("chunks").alias("evidence_chunks")
    )
    per = hits.select(query_id).distinct().join(per, query_id, "left").na.fill(0, ["evidence_papers", "relevant_papers", "evidence_chunks"])
    reasons = F.concat_ws(
        ",", F.when(F.col("evidence_papers") < min_papers, "evidence_papers"), F.when(F.col("relevant_papers") < min_relevant, "relevant_papers"),
        F.when(F.col("evidence_chunks") < min_chunks, "evidence_chunks"),
    )
    return per.withColumn("reasons", reasons).withColumn("can_generate", F.col("reasons") == "")


def first_of_hits(hits: DataFrame, ids: Sequence[str], rest: Sequence[str], order: Sequence[Column], query_id: str = "query_id") -> DataFrame:
    """Each hit of a query once: hits are the same if the first non-null one of `ids` is, or, without any, if all of `rest` are. The first in order stays."""
    named = F.coalesce(*(F.concat(F.lit(f"{c}:"), F.col(c).cast("string")) for c in ids), F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rest)))
    place = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    whole = F.struct(*(F.col(c) for c in hits.columns))
    return hits.groupBy(F.col(query_id).alias("_q"), named.alias("_n")).agg(F.min_by(whole, place).alias("h")).select("h.*")


def collapsed(hits: DataFrame, owner: str, query_id: str = "query_id", chunk: str = "chunk_id") -> DataFrame:
    """(query_id, owner, vector_rank, similarity, chunks): the papers of chunk hits, ranked by their best chunk, with their chunks in order of similarity."""
    one = F.struct((-F.coalesce("similarity", F.lit(0.0))).alias("s"), F.col(chunk).alias("c"))
    per = hits.groupBy(query_id, owner).agg(F.array_sort(F.collect_list(one)).alias("m"))  # a query has few hits
    per = per.select(query_id, owner, (-F.get("m", F.lit(0)).s).alias("similarity"), F.transform("m", lambda x: x.c).alias("chunks"))
    order = Window.partitionBy(query_id).orderBy(F.desc("similarity"), F.get("chunks", F.lit(0)))
    return per.withColumn("vector_rank", F.row_number().over(order))


def chunks_of_owners(asked: DataFrame, rows: DataFrame, chunks: DataFrame, queries: DataFrame, id_col: str, vector_col: str, per_owner: int, query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """(query_id, owner, chunk_id, similarity, owner_rank): the per_owner most similar chunks of each owner that a query asks for.

    asked: (query_id, owner). Only the chunks of these owners are compared; an owner with many chunks is dealt out over tasks. Unusable vectors match nothing.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    held = grid_join(asked.select(query_id, "owner").distinct(), chunks.select(id_col, "chunk_id", "owner"), ["owner"], query_id, "chunk_id")
    d = spread_join(held, rows.select(id_col, F.col(vector_col).alias("_v")), [id_col], query_id)
    d = spread_join(d, queries.select(query_id, F.col(query_vector).alias("_w")), [query_id], "chunk_id").where(F.size("_v") == F.size("_w"))
    d = d.withColumn("similarity", dot(F.col("_v"), F.col("_w")) / F.sqrt(dot(F.col("_v"), F.col("_v")) * dot(F.col("_w"), F.col("_w")))).where("similarity is not null and not isnan(similarity)")
    return best_per_owner(d.select(query_id, "owner", "chunk_id", "similarity"), "owner", query_id, per_owner=per_owner)


def evidence_text(hits: DataFrame, label: str, fields: Sequence[tuple[str, str]], order: Sequence[Column], most: int, most_chars: int, query_id: str = "query_id") -> DataFrame:
    """(query_id, position, evidence): the first `most` hits with text, each as a numbered item: `[<label> n]`, a line for each of the fields (name, column) that has a value, and its
    content with single blanks, cut after most_chars characters. Numbers count items with text alone, so that they match what was given."""
    tidy = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"(?U)\s+", " "))
    numbered = hits.where(tidy("content") != "").withColumn("position", F.row_number().over(Window.partitionBy(query_id).orderBy(*order))).where(F.col("position") <= most)
    lines = [F.when((tidy(c) != "") | F.lit(i == 0), F.concat(F.lit(f"{n}: "), tidy(c))) for i, (n, c) in enumerate(fields)]
    cut = F.when(F.char_length(tidy("content")) > most_chars, F.concat(F.rtrim(F.substring(tidy("content"), 1, most_chars)), F.lit("..."))).otherwise(tidy("content"))
    return numbered.select(query_id, "position", F.concat_ws("\n", F.concat(F.lit(f"[{label} "), F.col("position").cast("string"), F.lit("]")), *lines, F.lit("Evidence:"), cut).alias("evidence"))
