"""Queries of the training-set operators over papers, news and samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.forms import nfkc_text, plain_words
from ..operators import evidence, gates, quality
from .base import paper_keys, table


def section_targets(spark: SparkSession, d: str) -> DataFrame:
    """Training targets of English papers' sections, within their word limits."""
    parts = [F.struct(F.lit(n).alias("section"), quality.section_target(quality.training_sentences(F.col(f)), a, b).alias("target")) for n, (f, a, b) in evidence.SECTIONS.items()]
    papers = table(spark, d, "papers").where(evidence.is_english(F.col("language"))).select("paper_id", "introduction", "body", "conclusion")
    return evidence.composed(papers, "introduction", "body", "conclusion").select("paper_id", F.explode(F.array(*parts)).alias("x")).select("paper_id", "x.section", "x.target").where("target is not null")


def paper_gates(spark: SparkSession, d: str) -> DataFrame:
    """Every paper with why it can't be prepared for training."""
    return evidence.paper_gate(table(spark, d, "papers"))


def mined_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The evidence sentences of every section target, best first."""
    found = evidence.mined_evidence(table(spark, d, "papers")).select("paper_id", "section", F.posexplode("evidence").alias("i", "e"))
    return found.select("paper_id", "section", (F.col("i") + 1).alias("rank"), "e.sentence", "e.source")


def supported_targets(spark: SparkSession, d: str) -> DataFrame:
    """Targets of the sentences that their evidence supports."""
    return evidence.supported_targets(evidence.mined_evidence(table(spark, d, "papers"))).select("paper_id", "section", "target", F.size("evidence").alias("n_evidence"), "support")


def _news(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "news").select("news_id", F.col("title_en_for_rag").alias("title"), F.col("content_en_for_rag").alias("content"), "source")


def news_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The article that each sample's target and title are about, and the sentence it is quoted with."""
    samples = table(spark, d, "grounded_samples").where("paper_id is not null and section is not null and target is not null and title is not null")
    best = samples.groupBy("paper_id", "section").agg(F.min(F.struct("sample_id", "target", "title")).alias("s"))
    targets = best.select("paper_id", F.concat_ws(":", "section", "s.sample_id").alias("section"), "s.target")
    titles = best.groupBy("paper_id").agg(F.min("s.title").alias("title"))
    return evidence.news_evidence(targets, titles, _news(spark, d))


def near_copies(spark: SparkSession, d: str) -> DataFrame:
    """Samples' evidence items that share words with the target: the largest share, and whether that makes them copies or candidates for comparing characters."""
    s = table(spark, d, "grounded_samples").where("sample_id is not null").select("sample_id", plain_words(nfkc_text(F.col("target"))).alias("t"), F.explode("paper_evidence").alias("e")).where("e is not null")
    s = s.select("sample_id", "t", plain_words(nfkc_text(F.regexp_replace("e", r"^\[PAPER \d+\]", ""))).alias("e"))
    share = evidence.word_share(F.col("t"), F.col("e"))
    return s.groupBy("sample_id").agg(
        F.round(F.max(share), 6).alias("most"), F.count_if((F.col("t") == F.col("e")) | (share >= evidence.COPY_SHARE)).alias("copies"), F.count_if((share >= evidence.MAYBE_SHARE) & (share < evidence.COPY_SHARE)).alias("plausible")
    )


def training_split(spark: SparkSession, d: str) -> DataFrame:
    """English papers split 80/10/10 so that papers of equal key, title or text share a split."""
    english = table(spark, d, "papers").where(evidence.is_english(F.col("language")))
    return evidence.quota_split(evidence.paper_groups(english, paper_keys()), "paper_id", {"validation": 0.1, "test": 0.1}, "train").select("paper_id", "group_id", "split")


def training_samples(spark: SparkSession, d: str) -> DataFrame:
    """The training set: samples with evidence, target and split."""
    s = evidence.training_samples(table(spark, d, "papers"), _news(spark, d), paper_keys())
    lists = ("source_paper_ids", "paper_evidence", "news_evidence", "evidence_sources")
    return s.select(*(c for c in s.columns if c not in lists), *(F.array_join(c, "|").alias(c) for c in lists))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples, of repeated deliveries the latest (of equal dates the one of the least text)."""
    s = table(spark, d, "grounded_samples").where("sample_id is not null")
    latest = s.groupBy("sample_id").agg(F.max_by(F.struct(*(c for c in s.columns if c != "sample_id")), F.struct(F.coalesce("created_at", F.to_timestamp(F.lit("1970-01-01"))), F.md5(F.coalesce("target", F.lit(""))))).alias("s"))
    return latest.select("sample_id", "s.*")


def grounding_gate(spark: SparkSession, d: str) -> DataFrame:
    """Every sample with the reasons for which its target would be rejected, and how well its evidence supports it."""
    g = gates.grounding(_samples(spark, d))
    return g.select("sample_id", F.array_join("reasons", ",").alias("reasons"), F.round("support", 4).alias("support"), (F.size("reasons") == 0).alias("passed"))


def conclusion_gate(spark: SparkSession, d: str) -> DataFrame:
    """Conclusions with the further reasons for which they would be rejected."""
    c = gates.conclusion(_samples(spark, d).where("section = 'Conclusion'"))
    return c.select("sample_id", F.array_join("reasons", ",").alias("reasons"))


def split_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Papers and equal samples that are in more than one split, and samples that can't be trained on."""
    return gates.split_leaks(table(spark, d, "grounded_samples"))


def dataset_report(spark: SparkSession, d: str) -> DataFrame:
    """Per section and split: samples, those that pass, and how often each reason rejects one."""
    return gates.report(gates.grounding(_samples(spark, d)))


ALL = (section_targets, paper_gates, mined_evidence, supported_targets, news_evidence, near_copies, training_split, training_samples, grounding_gate, conclusion_gate, split_leaks, dataset_report)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}
