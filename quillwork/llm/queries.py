"""Queries of the llm operators over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.base import table
from . import language as lang_id
from . import corpus, leakage, oracle, packing, pairs
from . import subjects as topics

#: A second language counts from a passage of so many characters.
LEAST_PASSAGE = 200


def _paper_text():
    return F.concat_ws("\n\n", "introduction", "body", "conclusion")


def _paper_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "papers")
    rows = lang_id.training_sample(papers, "paper_id", _paper_text(), F.col("language"))
    return lang_id.document_languages(papers, ["paper_id", "language", "language_metadata"], _paper_text(), lang_id.fit(rows))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers whose language is missing or wrong, and the languages of mixed ones."""
    known = _paper_languages(spark, sf_dir).where("lang is not null").withColumn("code", lang_id.label_code(F.col("language")))
    long = F.filter("runs", lambda r: (r.stop - r.start >= LEAST_PASSAGE) & (r.lang != F.col("lang")))
    others = F.array_distinct(F.transform(long, lambda r: r.lang))
    case = lambda kind, lang: F.struct(F.lit(kind).alias("kind"), lang.alias("lang"))
    label = F.when(F.col("code").isNull(), case("missing", F.col("lang"))).when(F.col("code") != F.col("lang"), case("wrong", F.col("lang")))
    mixed = F.when(F.size(others) > 0, F.transform(F.concat(F.array("lang"), others), lambda x: case("mixed", x)))
    cases = F.concat(F.array_compact(F.array(label)), F.coalesce(mixed, F.array().cast("array<struct<kind:string,lang:string>>")))
    return known.select("paper_id", F.explode(cases).alias("c")).select("paper_id", "c.kind", "c.lang").distinct()


def p2_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paper with the language found, its confidence and what its label names."""
    return _paper_languages(spark, sf_dir).select("paper_id", "language", lang_id.label_code(F.col("language")).alias("label_code"), "lang", "confidence")


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of one language in introduction, body and conclusion, joined by blank lines."""
    return _paper_languages(spark, sf_dir).select("paper_id", F.posexplode("runs").alias("segment_no", "r")).select("paper_id", "segment_no", "r.start", "r.stop", "r.lang", "r.confidence")


def _tagged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "grounded_samples").select(
        F.col("sample_id").alias("id"), F.col("research_question").alias("question"), "target", "title", "topic", "reject", F.col("created_at").alias("at")
    )
    tagger = pairs.train(pairs.training_sequences(pairs.training_sample(rows)))
    return pairs.tag_pairs(rows, tagger)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective samples with their defect."""
    return _tagged_pairs(spark, sf_dir).where("defect is not null").select(F.col("id").alias("sample_id"), "defect")


def p1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample with the share of its target under each clause label."""
    return _tagged_pairs(spark, sf_dir).withColumnRenamed("id", "sample_id")


#: Tokens of a container.
CAPACITY = 2048


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's container; documents over the capacity in pieces."""
    return packing.packed(table(spark, sf_dir, "documents"), CAPACITY)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, their fill, and the least number that any packing needs."""
    per = p7_containers(spark, sf_dir).groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("items"))
    return per.agg(
        F.count("*").alias("containers"), F.ceil(F.sum("n") / CAPACITY).alias("lower_bound"), F.sum("items").alias("items"), F.max("n").alias("fullest"),
        F.round(F.sum("n") / (F.count("*") * CAPACITY), 6).alias("fill"),
    )


def _leaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an evaluation passage, and the leaked item."""
    return _leaked(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item, how many documents hold its passage, wholly or with its question or answer."""
    return _leaked(spark, sf_dir).groupBy("item_id").agg(
        F.count("*").alias("documents"), F.count_if(F.expr("words = passage_words and edits = 0")).alias("whole"), F.max("words").alias("most_words"),
        F.count_if("has_question").alias("with_question"), F.count_if("has_answer").alias("with_answer"),
    )


def _document_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names = [r.subject for r in table(spark, sf_dir, "subject_areas").where("subject is not null").select("subject").distinct().collect()]
    rows = topics.training_rows(docs, table(spark, sf_dir, "doc_subject_labels"), names)
    return topics.document_subjects(docs, topics.fit(rows, names))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects of every document."""
    return _document_subjects(spark, sf_dir).select("doc_id", F.explode("subjects").alias("s")).select("doc_id", "s.subject").distinct()


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents, and how much of them, each subject has, per source."""
    found = _document_subjects(spark, sf_dir).select("doc_id", F.explode("subjects").alias("s"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.char_length("text").alias("n"))
    return found.join(docs, "doc_id").groupBy("source", "s.subject").agg(F.count("*").alias("documents"), F.round(F.sum(F.col("s.share") * F.col("n")), 0).alias("characters"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import checks

    own = {f.__name__: f for f in (p1_found, p1_coverage, p2_found, p2_papers, p2_segments, p7_containers, p7_fill, p8_found, p8_items, p9_found, p9_mix)}
    return corpus.queries() | own | checks.all_checks()


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
