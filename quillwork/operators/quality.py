"""Quality of extracted papers, topical relevance, and lexical support of written text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import ranged, spread_join

# Least lengths, shares and score steps of the quality rules.
LEAST_FULLTEXT, LEAST_SECTION = 5000, {"introduction": 300, "body": 1000, "conclusion": 200}
TITLE_WINDOW, TITLE_SHARE, DAMAGE_SHARE = 12000, 0.6, 0.005
FLAG_COST, FLAG_COST_MOST, LANGUAGE_COST, ABSTRACT_COST, LEAST_CONFIDENCE = 0.15, 0.75, 0.15, 0.1, 0.9
REJECTING = ("source_not_acquired", "extraction_failed", "source_title_mismatch", "no_extracted_text")

# Words that say nothing about the support of a sentence.
SUPPORT_STOPWORDS = (
    "about", "across", "after", "also", "among", "based", "been", "between", "could", "from", "have", "into", "more", "most", "other", "over", "paper", "research",
    "result", "results", "show", "shows", "study", "such", "than", "that", "their", "there", "these", "this", "those", "through", "under", "using", "were", "what",
    "when", "where", "which", "while", "with", "would", "kpop", "korean", "culture", "social", "media", "global", "music", "fandom", "fans", "digital", "online",
    "analysis", "the", "and", "for", "are", "not", "its", "can", "has", "was", "one",
)


def _terms(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0)))


def quality_flags(title: Column, fulltext: Column, sections: dict[str, Column]) -> Column:
    """array<string>: insufficient_fulltext, source_title_mismatch, missing_or_short_<section>, text_encoding_damage."""
    text = F.coalesce(fulltext, F.lit(""))
    words = _terms(title, r"[\p{L}\p{N}_]{3,}")
    shared = F.size(F.array_intersect(words, _terms(F.substring(text, 1, TITLE_WINDOW), r"[\p{L}\p{N}_]{3,}")))
    damaged = F.char_length(text) - F.char_length(F.replace(text, F.lit("�"), F.lit("")))
    flags = [
        F.when(F.char_length(text) < LEAST_FULLTEXT, "insufficient_fulltext"),
        F.when((F.size(words) > 0) & (shared / F.size(words) < TITLE_SHARE), "source_title_mismatch"),
        *(F.when(F.char_length(F.coalesce(c, F.lit(""))) < LEAST_SECTION[n], f"missing_or_short_{n}") for n, c in sections.items()),
        F.when(damaged / F.greatest(F.char_length(text), F.lit(1)) > DAMAGE_SHARE, "text_encoding_damage"),
    ]
    return F.array_compact(F.array(*flags))


def language_flags(language: Column, confidence: Column) -> Column:
    """array<string>: language_needs_review where the language is unknown or uncertain, non_english_fulltext where it is another one for sure."""
    unsure = language.isNull() | confidence.isNull() | (confidence < LEAST_CONFIDENCE)
    return F.array_compact(F.array(F.when(unsure, "language_needs_review").when(language != "en", "non_english_fulltext")))


def quality_state(flags: Column, language: Column, confidence: Column, abstract_language: Column, is_repeat: Column | None = None) -> Column:
    """struct<state, score>. The score is 1 less a step per flag, for an uncertain or other language than English, and for another
    abstract's; 0 at least. A flag of REJECTING rejects; without flags and steps a paper is ready; all else needs review.
    A repeat of an earlier full text needs review whatever its state was, and loses one step more."""
    sure = F.coalesce((language == "en") & (confidence >= LEAST_CONFIDENCE), F.lit(False))
    english = F.coalesce(abstract_language == "en", F.lit(False))
    steps = F.least(F.lit(FLAG_COST_MOST), F.size(flags) * FLAG_COST) + F.when(sure, 0.0).otherwise(LANGUAGE_COST) + F.when(english, 0.0).otherwise(ABSTRACT_COST)
    score = F.round(F.greatest(F.lit(0.0), 1.0 - steps), 2)
    state = F.when(F.arrays_overlap(flags, F.array(*map(F.lit, REJECTING))), "rejected").when((F.size(flags) == 0) & sure & english, "ready").otherwise("review_required")
    if is_repeat is not None:
        state, score = F.when(is_repeat, "review_required").otherwise(state), F.when(is_repeat, F.round(F.greatest(F.lit(0.0), score - FLAG_COST), 2)).otherwise(score)
    return F.struct(state.alias("state"), score.alias("score"))


def first_of_equal(df: DataFrame, key: Column, order: Column, flag: str = "is_repeat") -> DataFrame:
    """df with flag: whether an earlier row has the same non-null key. The earliest of each key comes from an aggregate with
    map-side combine; rows without a key meet nothing, and those of a hot key are dealt out over tasks."""
    keyed = df.withColumn("_k", key).withColumn("_o", order)
    some = keyed.where("_k is not null")
    first = some.groupBy("_k").agg(F.min("_o").alias("_first"))
    known = spread_join(some, first, ["_k"], "_o").withColumn(flag, F.col("_o") > F.col("_first")).drop("_first")
    return known.unionByName(keyed.where("_k is null").withColumn(flag, F.lit(False))).drop("_k", "_o")


def relevance(title: Column, abstract: Column, core: str, contexts: dict[str, str]) -> Column:
    """struct<score int, topics array<string>>: 0 unless the core pattern and some context occur in title or abstract; then 5 for
    the core in the title, 1 for each context anywhere and 1 for each in the title. Patterns ignore case."""
    t, both = F.coalesce(title, F.lit("")), F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit("")))
    has = lambda c, p: c.rlike("(?i)" + p)
    topics = F.array_compact(F.array(*(F.when(has(both, p), n) for n, p in contexts.items())))
    in_title = sum((has(t, p).cast("int") for p in contexts.values()), F.lit(0))
    fits = has(both, core) & (F.size(topics) > 0)
    score = F.when(fits, 5 * has(t, core).cast("int") + F.size(topics) + in_title).otherwise(0)
    return F.struct(score.cast("int").alias("score"), F.when(fits, topics).otherwise(F.array().cast("array<string>")).alias("topics"))


def abstract_from_index(index: Column) -> Column:
    """The text of an inverted index map<word, array<position>>: its words in order of position. Null for null and empty."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e.value, lambda p: F.struct(p.alias("p"), e.key.alias("w")))))
    text = F.array_join(F.transform(F.array_sort(pairs), lambda x: x.w), " ")
    return F.when(text != "", text)


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once: inside a lambda an expression would be computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def inverted_index(text: Column) -> Column:
    """map<word, array<position>> of the words between blanks. Null for null and blank texts."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    entries = bound(
        F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
        lambda ws: F.transform(
            F.array_distinct(F.transform(ws, lambda x: x.w)), lambda k: F.struct(k.alias("key"), F.transform(F.filter(ws, lambda x: x.w == k), lambda x: x.i).alias("value"))
        ),
    )
    return F.when(F.size(words) > 0, F.map_from_entries(entries))


def content_terms(text: Column) -> Column:
    """Distinct words of four or more ASCII letters or digits that aren't stop words."""
    return F.filter(_terms(text, "[a-z0-9]{4,}"), lambda w: ~w.isin(*SUPPORT_STOPWORDS))


def support_score(target: Column, evidence: Column) -> Column:
    """The share of the target's content terms that the evidence (array<string>) has; 0 for a target without any."""
    own = content_terms(target)
    theirs = content_terms(F.array_join(F.coalesce(evidence, F.array().cast("array<string>")), " "))
    return F.size(F.array_intersect(own, theirs)) / F.greatest(F.size(own), F.lit(1))


def numeric_claims(text: Column) -> Column:
    """Distinct numbers that stand alone in a text, without thousands commas: 1,200 and 1200 are one claim."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![\p{L}\p{N}_])(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?(?![\p{L}\p{N}_])"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(""))))


def unsupported_numbers(text: Column, support: Column) -> Column:
    """The text's numeric claims that occur nowhere in the support (array<string>), sorted."""
    return F.array_sort(F.array_except(numeric_claims(text), numeric_claims(F.array_join(F.coalesce(support, F.array().cast("array<string>")), "\n"))))


# Lines and sentences that are layout or metadata, not prose.
METADATA = (
    r"^\s*(?:abstract|keywords?|references?|bibliography)\s*:?\s*$", r"^\s*(?:received|accepted|published|copyright|corresponding author)\b",
    r"^\s*(?:vol(?:ume)?\.?|issue|pages?|pp\.?|issn)\s*[:\d]", r"https?://", r"\bdoi\s*:", r"©", r"all rights reserved", r"\b(?:table|figure|appendix|contents)\s+\d+\b",
    r"\b(?:references|bibliography)\b", r"\b(?:university|department|faculty)\s+of\b.*\bemail\b", r"\b(?:bachelor.?s student|department of|faculty of|university of)\b", r"\b(?:CFI|TLI|RMSEA|SRMR)\b",
)


# Citations that are taken out of sentences, rules and dots of tables, and limits of a sentence.
BRACKET_CITATION, YEAR_CITATION = r"\[(?:\d+[\s,;–-]*)+\]", r"\([^)]*\b(?:19|20)\d{2}[a-z]?[^)]*\)"
RULED, SENTENCE_END = r"(?:\.{3,}|[_=]{3,}|\s[,;:]\s[,;:])", "[.!?][\"'”’]?\\s*$"
LEAST_WORDS, MOST_WORDS, MOST_NUMBERS, NUMBER_SHARE, LETTER_SHARE = 8, 70, 4, 0.12, 0.55


def training_sentences(text: Column) -> Column:
    """array<string>: English sentences fit for training: citations removed, 8 to 70 words, ended by . ! or ?, no metadata, no dotted
    or ruled lines, few numbers, more than 55 % ASCII letters. Null texts give an empty array."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    t = F.regexp_replace(F.regexp_replace(t, BRACKET_CITATION, ""), YEAR_CITATION, "")
    parts = F.transform(F.split(F.regexp_replace(t, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))

    def fit(s: Column) -> Column:
        words = F.size(F.split(s, " "))
        numbers = F.size(F.filter(F.split(s, " "), lambda w: w.rlike(r"\d")))
        letters = F.char_length(s) - F.char_length(F.regexp_replace(s, "[a-zA-Z]", ""))
        return (
            (s != "") & words.between(LEAST_WORDS, MOST_WORDS) & s.rlike(SENTENCE_END) & ~s.rlike(RULED)
            & ~((numbers >= MOST_NUMBERS) & (numbers / words >= NUMBER_SHARE)) & (letters / F.char_length(s) > LETTER_SHARE) & ~s.rlike("(?i)" + "|".join(f"(?:{p})" for p in METADATA))
        )

    return F.filter(parts, fit)


def section_target_sentences(sentences: Column, least: int, most: int) -> Column:
    """array<string>: the first sentences, taken while under `least` words or within `most`; null if they come to fewer than `least`."""
    # A sentence has a word at least, so no more than most + 1 can matter.
    sizes = F.transform(F.slice(sentences, 1, most + 1), lambda s: F.size(F.split(s, " ")))
    ends = bound(sizes, lambda n: F.transform(F.sequence(F.lit(0), F.size(n)), lambda i: F.aggregate(F.slice(n, 1, i), F.lit(0), lambda a, x: a + x)))

    def taken(e: Column) -> Column:
        # e[i]: the words of the first i sentences. The next one is taken if they are too few, or if it ends within `most`.
        refused = F.filter(F.sequence(F.lit(1), F.size(e)), lambda i: (i == F.size(e)) | ((F.get(e, i - 1) >= least) & (F.get(e, i) > most)) | (F.get(e, i - 1) >= most))
        count = F.get(refused, F.lit(0)) - 1
        return F.when(F.get(e, count) >= least, F.slice(sentences, 1, count))

    return bound(ends, taken)


def section_target(sentences: Column, least: int, most: int) -> Column:
    """The sentences of section_target_sentences as one text."""
    return F.array_join(section_target_sentences(sentences, least, most), " ")


def with_row_ids(df: DataFrame, column: str, start: int, order: list[Column]) -> DataFrame:
    """df with consecutive ids from `start` + 1 in the given order, without one global window: rows are range-partitioned by
    the order, numbered inside their partition, and shifted by the sizes of the partitions before."""
    placed = ranged(df, order)
    local = placed.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy("_m")))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    return local.join(F.broadcast(sizes.select("_p", before.alias("_s"))), "_p").withColumn(column, F.lit(start) + F.col("_s") + F.col("_n")).drop("_p", "_m", "_n", "_s")
