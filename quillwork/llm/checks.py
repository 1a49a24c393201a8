"""Queries that hold the llm operators' results against what their definitions leave no choice in."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.base import table
from . import corpus, packing, queries
from .leakage import plain_text


def p1_certain(spark: SparkSession, d: str) -> DataFrame:
    """Defects that need no reading: empty texts, and pairs that were rejected (by their latest delivery)."""
    s = table(spark, d, "grounded_samples").where("sample_id is not null")
    place = F.struct(F.coalesce(F.col("created_at").cast("timestamp"), F.timestamp_seconds(F.lit(0))), F.xxhash64("target"))
    rejected = s.groupBy("sample_id").agg(F.max_by(F.coalesce("reject", F.lit(False)), place).alias("rejected"))
    return queries.p1_found(spark, d).join(rejected, "sample_id").where("rejected or defect = 'empty'").select("sample_id", "defect")


def p2_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Papers by the script of their main language."""
    found = queries._paper_languages(spark, d).where("lang is not null")
    script = F.when(F.col("lang") == "ko", "hangul").when(F.col("lang") == "ja", "kana").otherwise("latin")
    return found.groupBy(script.alias("script")).agg(F.count("*").alias("papers"), F.min("paper_id").alias("first"), F.max("paper_id").alias("last"))


def p5_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Every cut field put together again from its pieces, and whether they keep to the limit and overlap as they should."""
    p = corpus.p5_pieces(spark, d).withColumn("length", F.char_length("piece"))
    by = Window.partitionBy("paper_id", "field").orderBy("piece_no")
    p = p.withColumn("overlaps", F.coalesce(F.lag(F.col("start") + F.col("length")).over(by) - F.col("start") == corpus.PIECE_OVERLAP, F.lit(True)))
    new = F.struct("piece_no", F.when(F.col("piece_no") == 0, F.col("piece")).otherwise(F.substr("piece", F.lit(corpus.PIECE_OVERLAP + 1))).alias("t"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(new)), lambda x: x.t), "")  # the pieces of one field
    return p.groupBy("paper_id", "field").agg(F.md5(whole).alias("digest"), F.bool_and(F.col("length") <= corpus.PIECE_LIMIT).alias("within"), F.bool_and("overlaps").alias("overlap"), (F.count("*") == F.max("n_pieces")).alias("counted"))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every document with text: whether its pieces are all of it, its containers hold no more than they can, and it was only split if it had to be."""
    docs = table(spark, d, "documents")
    placed = packing.packed(docs, queries.CAPACITY)
    fill = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("fill"))
    sizes = packing.document_tokens(docs).where("doc_id is not null").groupBy("doc_id").agg(F.max("n_tokens").alias("own"))
    per = placed.join(fill, "container_id").groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"), F.max("fill").alias("fullest"))
    return per.join(sizes, "doc_id").select("doc_id", (F.col("n") == F.col("own")).alias("whole"), (F.col("fullest") <= queries.CAPACITY).alias("fits"), ((F.col("pieces") == 1) | (F.col("own") > queries.CAPACITY)).alias("split_if_needed"))


@F.pandas_udf(T.BooleanType())
def _has_run(texts: pd.Series, passages: pd.Series) -> pd.Series:
    """Whether 16 words of the passage stand in the text without any change."""

    def one(text: str | None, passage: str | None) -> bool:
        own, other = _words(passage), " " + " ".join(_words(text)) + " "
        return any(f" {' '.join(own[i : i + 16])} " in other for i in range(len(own) - 15))

    return pd.Series([one(t, p) for t, p in zip(texts, passages)], dtype="boolean")


def _words(text: str | None) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in unicodedata.normalize("NFKC", plain_text(text)).lower()).split()


def p8_exact(spark: SparkSession, d: str) -> DataFrame:
    """Leaks with a run of 16 unchanged words."""
    found = queries.p8_found(spark, d)
    docs = table(spark, d, "documents").select("doc_id", "text")
    items = table(spark, d, "eval_items").where("item_id is not null").select("item_id", "passage").dropDuplicates(["item_id"])
    return found.join(docs, "doc_id").join(items, "item_id").where(_has_run("text", "passage")).select("doc_id", "item_id").distinct()


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every document: whether its subjects are known ones, each once, of a tenth of the sentences at least."""
    found = queries._document_subjects(spark, d).where("doc_id is not null")
    names = F.transform("subjects", lambda s: s.subject)
    areas = [r.subject for r in table(spark, d, "subject_areas").where("subject is not null").select("subject").distinct().collect()]  # a fixed, short list
    return found.groupBy("doc_id").agg(F.bool_and(F.forall(names, lambda n: n.isin(*areas))).alias("known"), F.bool_and(F.size(F.array_distinct(names)) == F.size("subjects")).alias("once"), F.bool_and(F.forall("subjects", lambda s: s.share >= 0.1)).alias("shares"))


def all_checks() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_certain, p2_scripts, p5_rebuilt, p7_checks, p8_exact, p9_checks)}
