"""Gates that training targets must pass, and checks of a whole training set."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.forms import single_blanks
from .quality import bound

# Words, numbers and names of a text; words and names that say nothing.
WORD, NUMBER, NAME = r"[A-Za-z][A-Za-z0-9'-]*", r"(?<![\p{L}\p{N}_])(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?(?![\p{L}\p{N}_])", r"(?U)\b(?:[A-Z]{2,}|[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"
STOP = (
    "a", "an", "the", "and", "or", "of", "in", "on", "for", "to", "from", "by", "with", "as", "at", "is", "are", "was", "were", "be", "been", "being", "this", "that", "these", "those", "it", "its", "their", "they", "we", "our",
    "can", "may", "which", "who", "how", "what", "about", "through", "into", "across", "between", "within", "also", "study", "paper", "evidence", "research", "question", "section", "introduction", "body", "conclusion",
)
GENERIC_NAMES = ("The", "This", "These", "However", "Overall", "Furthermore", "Moreover", "Together", "Taken", "Paper", "News", "Introduction", "Body", "Conclusion", "Evidence")
GENERIC_WORDS = (
    "k", "pop", "kpop", "korean", "korea", "music", "culture", "cultural", "paper", "study", "research", "evidence", "findings", "impact", "influence", "effect", "global", "globalization", "fan", "fans", "fandom", "media",
    "digital", "social", "platform", "platforms", "analysis", "conclusion",
)
# Limits of a target's words and tokens, of repeated runs of four words, of support, and of likeness to an evidence sentence.
LEAST_WORDS, LEAST_BODY_WORDS, MOST_WORDS, MOST_TOKENS, REPEATED_SHARE, LEAST_SUPPORT, COPY_RATIO = 35, 40, 170, 384, 0.12, 0.24, 0.80
# How a target may end, a heading before it, and words that open or mark a conclusion.
LAST = tuple(".!?\"'’”")
HEADING = r"(?i)^\s*(?:#{1,6}\s*)?(?:introduction|body|conclusion)\s*:"
CLOSING_START = r"(?i)^(?:in conclusion|to conclude|taken together|overall)\b"
CLOSING_WORD = r"(?i)\b(?:overall|together|therefore|thus|suggest|indicat|conclud|synthesi|implication|evidence)\w*\b"
SYNTHESIS = r"(?i)\b(?:overall|together|therefore|thus|suggest|indicat|conclud|synthesi|implication|evidence|findings|ultimately|supports|underscores)\w*\b"
ANNOUNCING = r"(?i)^(this paper|this study|the study)\s+(examines|explores|aims|focuses)"
DAMAGED = r"(?i)�|\b[A-Za-z]*([A-Za-z])\1{3,}[A-Za-z]*\b"
LEAST_SENTENCES, MOST_SENTENCES = 2, 7
SECTIONS = ("Introduction", "Body", "Conclusion")


def _empty() -> Column:
    return F.array().cast("array<string>")


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def content_words(text: Column) -> Column:
    """The words of three or more characters that say something, in order and in lower case."""
    return F.filter(F.transform(_found(text, WORD), F.lower), lambda w: (F.char_length(w) > 2) & ~w.isin(*STOP))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001"), F.trim), lambda s: s != "")


@F.pandas_udf(T.DoubleType())
def _likeness(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """How like a text is to the most like of some sentences, if that is over COPY_RATIO; else 0. Pairs whose lengths or letters rule it out aren't aligned."""

    def most(text: str | None, others) -> float:
        best = 0.0
        for s in others if text and others is not None else ():
            m = SequenceMatcher(None, text, s)
            if min(m.real_quick_ratio(), 1.0) > COPY_RATIO and m.quick_ratio() > COPY_RATIO:
                best = max(best, m.ratio())
        return best

    for texts, lists in rows:
        yield pd.Series([most(t, o) for t, o in zip(texts, lists)], dtype="float64")


def grounding(samples: DataFrame, n_tokens: Column | None = None) -> DataFrame:
    """samples with reasons (array<string>, sorted, each once), support and unsupported_numbers, unsupported_names: why a target can't be trusted.

    samples: section, title, topic, research_question, paper_evidence, news_evidence, target, reject. empty, too_short, too_long (words, or tokens where n_tokens
    gives them), broken_sentence, heading, repetition (equal sentences, or many equal runs of four words), unsupported_number, unsupported_entity, low_evidence_relevance
    (share of the target's words that the evidence has), section_mismatch, copied_evidence (the target is like a sentence of the evidence) and teacher_reject. Null texts
    count as empty, null lists as without items, a null reject as no rejection. Other columns stay.
    """
    none = _empty()
    lists = F.concat(*(F.filter(F.coalesce(c, none), lambda x: x.isNotNull()) for c in ("paper_evidence", "news_evidence")))
    d = samples.withColumn("_t", single_blanks(F.col("target"))).withColumn("_e", F.array_join(lists, " "))
    d = d.withColumn("_all", F.concat_ws(" ", F.col("title"), F.col("topic"), F.col("research_question"), F.col("_e")))
    d = d.withColumn("_w", content_words(F.col("_t"))).withColumn("_s", sentences(F.col("_t"))).withColumn("_n", F.size(_found(F.col("_t"), WORD)))
    d = d.withColumn("_numbers", F.array_sort(F.array_except(_found(F.col("_t"), NUMBER), _found(F.col("_all"), NUMBER))))
    lowered = F.lower("_all")
    d = d.withColumn("_low", lowered)
    generic = lambda name: F.forall(F.split(name, r"\s+"), lambda p: p.isin(*GENERIC_NAMES))
    names = F.filter(F.array_distinct(_found(F.col("_t"), NAME)), lambda n: ~F.col("_low").contains(F.lower(n)) & ~generic(n))
    d = d.withColumn("_names", F.array_sort(names))
    own = F.array_distinct("_w")
    d = d.withColumn("support", F.size(F.array_intersect(own, F.array_distinct(content_words(F.col("_e"))))) / F.greatest(F.size(own), F.lit(1)))
    runs = F.when(F.size("_w") >= 12, F.transform(F.sequence(F.lit(1), F.size("_w") - 3), lambda i: F.array_join(F.slice("_w", i, 4), " ")))
    repeated = bound(runs, lambda r: (F.size(r) - F.size(F.array_distinct(r))) / F.size(r) > REPEATED_SHARE)
    same = bound(F.transform("_s", lambda s: F.lower(F.regexp_replace(s, r"(?U)\W+", " "))), lambda k: F.size(F.array_distinct(k)) < F.size(k))
    quoted = F.filter(sentences(F.col("_e")), lambda s: F.size(F.split(s, r"\s+")) >= 8)
    copied = _likeness(F.lower("_t"), F.transform(quoted, F.lower)) > COPY_RATIO
    t, section = F.col("_t"), F.coalesce("section", F.lit(""))
    long = (F.col("_n") > MOST_WORDS) | (n_tokens > MOST_TOKENS if n_tokens is not None else F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(F.coalesce(copied, F.lit(False)), "copied_evidence"),
            F.when((t != "") & ~F.right(t, F.lit(1)).isin(*LAST), "broken_sentence"),
            F.when(t == "", "empty"), F.when(t.rlike(HEADING), "heading"), F.when(F.col("support") < LEAST_SUPPORT, "low_evidence_relevance"),
            F.when(same | F.coalesce(repeated, F.lit(False)), "repetition"),
            F.when(((section != "Conclusion") & t.rlike(CLOSING_START)) | ((section == "Conclusion") & ~t.rlike(CLOSING_WORD)), "section_mismatch"),
            F.when(F.coalesce("reject", F.lit(False)), "teacher_reject"), F.when(long, "too_long"),
            F.when((t != "") & (F.col("_n") < F.when(section == "Body", LEAST_BODY_WORDS).otherwise(LEAST_WORDS)), "too_short"),
            F.when(F.size("_names") > 0, "unsupported_entity"), F.when(F.size("_numbers") > 0, "unsupported_number"),
        )
    )
    out = d.withColumn("reasons", F.array_sort(reasons)).withColumn("unsupported_numbers", F.array_distinct("_numbers")).withColumn("unsupported_names", F.col("_names"))
    return out.drop("_t", "_e", "_all", "_w", "_s", "_n", "_numbers", "_low", "_names")


def important_words(text: Column) -> Column:
    """Distinct content words of four or more characters that aren't about the field as a whole."""
    return F.array_distinct(F.filter(content_words(text), lambda w: (F.char_length(w) >= 4) & ~w.isin(*GENERIC_WORDS)))


def conclusion(samples: DataFrame, n_tokens: Column | None = None) -> DataFrame:
    """grounding, with the further reasons of conclusions: conclusion_structure (two to seven sentences), research_question_not_answered (no important word of it), body_or_introduction_style,
    missing_synthesis (in the last two sentences) and corrupt_text."""
    d = grounding(samples, n_tokens).withColumn("_t", single_blanks(F.col("target")))
    d = d.withColumn("_s", sentences(F.col("_t")))
    ending = F.array_join(F.slice("_s", F.greatest(F.size("_s") - 1, F.lit(1)), 2), " ")
    answered = F.size(F.array_intersect(important_words(F.coalesce("research_question", F.lit(""))), important_words(F.col("_t")))) > 0
    more = F.array_compact(
        F.array(
            F.when(~F.size("_s").between(LEAST_SENTENCES, MOST_SENTENCES), "conclusion_structure"), F.when(~answered, "research_question_not_answered"), F.when(F.col("_t").rlike(ANNOUNCING), "body_or_introduction_style"),
            F.when((F.size("_s") > 0) & ~ending.rlike(SYNTHESIS), "missing_synthesis"), F.when(F.col("_t").rlike(DAMAGED), "corrupt_text"),
        )
    )
    return d.withColumn("reasons", F.array_sort(F.array_distinct(F.concat("reasons", more)))).drop("_t", "_s")


def split_leaks(samples: DataFrame) -> DataFrame:
    """(kind, key, splits): `paper` for each paper_id in samples of several splits, `sample` for each (input, target) in several, by its digest, and `invalid` for samples
    without paper, known section, title, target or evidence, by their reason (splits: how many)."""
    text = lambda c: single_blanks(F.col(c))
    items = lambda c: F.array_join(F.filter(F.coalesce(c, _empty()), lambda x: x.isNotNull()), "\u0001")
    digest = F.md5(F.concat_ws("\u0002", text("section"), text("title"), text("topic"), text("research_question"), items("paper_evidence"), items("news_evidence"), text("target")))
    reason = F.coalesce(
        F.when(F.col("paper_id").isNull(), "paper_id"), F.when(text("title") == "", "title"), F.when((items("paper_evidence") == "") & (items("news_evidence") == ""), "evidence"), F.when(~text("section").isin(*SECTIONS), "section"), F.when(text("target") == "", "target")
    )
    s = samples.select("paper_id", "split", digest.alias("digest"), reason.alias("reason"))
    splits = F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits")  # a handful of names
    ok = s.where("reason is null and split is not null")
    papers = ok.groupBy(F.lit("paper").alias("kind"), F.col("paper_id").cast("string").alias("key")).agg(splits).where("splits like '%,%'")
    same = ok.groupBy(F.lit("sample").alias("kind"), F.col("digest").alias("key")).agg(splits).where("splits like '%,%'")
    bad = s.where("reason is not null").groupBy(F.lit("invalid").alias("kind"), F.col("reason").alias("key")).agg(F.count("*").cast("string").alias("splits"))
    return papers.union(same).union(bad)


def report(checked: DataFrame) -> DataFrame:
    """(section, split, reason, n) of samples that went through grounding: how many there are (`all`), pass (`passed`), and are rejected for each reason."""
    kinds = F.concat(F.array(F.lit("all")), F.when(F.size("reasons") == 0, F.array(F.lit("passed"))).otherwise(F.col("reasons")))
    return checked.select("section", "split", F.explode(kinds).alias("reason")).groupBy("section", "split", "reason").agg(F.count("*").alias("n"))
