"""Queries of linked splits, overlaps, pieces and near duplicates (p3 to p6) over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from ..operators.components import grouped_split, linked_groups
from ..plans.base import paper_keys, table
from .chunking import oversized_pieces
from .neardup import NearDuplicates
from .overlap import cross_split_overlaps

SPLIT_WEIGHTS = {"train": 0.8, "validation": 0.1, "test": 0.1}
PAPER_FIELDS = ("introduction", "body", "conclusion")
#: Size limit, overlap and least size of pieces, in code points.
PIECE_LIMIT, PIECE_OVERLAP, PIECE_LEAST = 4000, 200, 1000


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers tied to another one, with the smallest paper of their group."""
    return linked_groups(table(spark, sf_dir, "papers"), "paper_id", paper_keys())


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paper's split; tied papers share one."""
    return grouped_split(table(spark, sf_dir, "papers"), "paper_id", paper_keys(), SPLIT_WEIGHTS)


def _split_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers with their split; of repeated assignments the latest counts (of equal dates the first split name)."""
    splits = (
        table(spark, sf_dir, "paper_splits")
        .select("paper_id", identity.split_name(F.col("split")).alias("split"), F.coalesce("assigned_at", F.to_timestamp(F.lit("1970-01-01"))).alias("at"))
        .where("split is not null and paper_id is not null")
        .groupBy("paper_id")
        .agg(F.min_by("split", F.struct(-F.unix_micros(F.col("at").cast("timestamp")), "split")).alias("split"))
    )
    papers = table(spark, sf_dir, "papers").select("paper_id", "title", "abstract", "source", "content_hash")
    return papers.join(splits, "paper_id").select(
        F.col("paper_id").alias("id"), (F.col("split") != "train").alias("is_eval"), F.col("abstract").alias("text"), "title",
        identity.hash_key(F.col("content_hash")).alias("hash_key"), "split", "source",
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an evaluation and a training paper that overlap."""
    found = cross_split_overlaps(_split_records(spark, sf_dir))
    return found.select(F.least("eval_id", "train_id").alias("paper_id_a"), F.greatest("eval_id", "train_id").alias("paper_id_b")).distinct()


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping evaluation papers and their pairs per split and source."""
    records = _split_records(spark, sf_dir)
    found = cross_split_overlaps(records).join(records.select(F.col("id").alias("eval_id"), "split", "source"), "eval_id")
    return found.groupBy("split", "source").agg(
        F.countDistinct("eval_id").alias("eval_papers"), F.count("*").alias("pairs"),
        F.count_if("by_hash").alias("by_hash"), F.count_if("by_title").alias("by_title"), F.count_if(F.col("similarity").isNotNull()).alias("by_abstract"),
        F.round(F.max("containment"), 6).alias("max_containment"),
    )


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized field."""
    return oversized_pieces(table(spark, sf_dir, "papers"), ["paper_id"], PAPER_FIELDS, PIECE_LIMIT, PIECE_OVERLAP, PIECE_LEAST)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that were cut."""
    return p5_pieces(spark, sf_dir).where("n_pieces > 1 and piece_no = 0").select("paper_id", "field").distinct()


def _similar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    news = table(spark, sf_dir, "news").select(
        F.lit("news").alias("kind"), F.col("news_id").alias("id"),
        F.when(_words(F.col("content_original")) >= 30, F.concat(F.coalesce("title_original", F.lit("")), F.lit(" "), "content_original")).alias("text"),
    )
    papers = table(spark, sf_dir, "papers").select(F.lit("paper").alias("kind"), F.col("paper_id").alias("id"), F.col("fulltext").alias("text"))
    return news.union(papers)


def _words(text):
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of news and of papers that share at least half of their three-word sequences."""
    return NearDuplicates(_similar_texts(spark, sf_dir), threshold=0.5, width=3).pairs().withColumnRenamed("kind", "record_kind").distinct()


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every news item and paper with its class and group (five words, 0.8)."""
    return NearDuplicates(_similar_texts(spark, sf_dir), threshold=0.8, width=5).groups().withColumnRenamed("kind", "record_kind")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p3_found, p3_splits, p4_found, p4_report, p5_found, p5_pieces, p6_found, p6_groups)}
