"""Training samples from papers: section targets, the sentences that support them, news on the same subject, groups and splits."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.forms import nfkc_text, plain_words, single_blanks
from ..functions.labels import label_code
from .components import linked_groups
from .quality import SUPPORT_STOPWORDS, section_target_sentences, training_sentences, with_row_ids
from .skew import grid_join, spread_join
from .tables import materialize

# The sections, the field of each and the least and most words of its target.
SECTIONS = {"Introduction": ("introduction", 50, 130), "Body": ("body", 100, 180), "Conclusion": ("conclusion", 40, 110)}
# Shares of common words from which a sentence is a copy, or may be one, and the likeness of characters that decides then.
COPY_SHARE, MAYBE_SHARE, COPY_RATIO = 0.82, 0.55, 0.84
# Evidence sentences of a target, terms they share with it, and how well a target's sentences and the target must be supported.
MOST_EVIDENCE, LEAST_TERMS, LEAST_SUPPORT = 4, 2, 0.16
# Sentences of an article that may be quoted, names in titles, names that are none, and platforms.
NEWS_SENTENCES = 8
NAME_IN_TITLE = r"\b(?:[A-Z]{2,}|[A-Z][a-z]+[A-Z][A-Za-z]*)\b"
NO_NAMES = ("kpop", "korean", "hallyu", "ip", "pop")
PLATFORMS = ("tiktok", "youtube", "instagram", "facebook", "twitter", "netflix")
# Words of a title that don't tell papers apart.
TITLE_STOPWORDS = ("a", "an", "the", "in", "on", "of", "and", "to")
# The parts of an evidence item and of a prompt.
NO_NEWS = "[NO_NEWS_EVIDENCE]"
MOST_KEYWORDS = 4


def composed(df: DataFrame, *columns: str) -> DataFrame:
    """df with the columns' texts in NFKC form."""
    return df.withColumns({c: nfkc_text(F.col(c)) for c in columns})


def terms_of(plain: Column) -> Column:
    """Distinct words of four or more characters of a text in the form of plain_words that say something."""
    return F.array_distinct(F.filter(F.split(plain, " "), lambda w: (F.char_length(w) >= 4) & ~w.isin(*SUPPORT_STOPWORDS)))


def word_share(a: Column, b: Column) -> Column:
    """The distinct words that two texts (in the form of plain_words) share, of all distinct words of both; 0 if one has none."""
    x, y = (F.array_distinct(F.filter(F.split(t, " "), lambda w: w != "")) for t in (a, b))
    return F.when((a != "") & (b != ""), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


def is_near_copy(a: str, b: str) -> bool:
    """Whether two texts (in the form of plain_words) are the same but for a few words: equal, or with many common words, or with some and like characters."""
    if a == b:
        return True
    x, y = set(a.split()), set(b.split())
    share = len(x & y) / len(x | y) if x and y else 0.0
    return share >= COPY_SHARE or (share >= MAYBE_SHARE and SequenceMatcher(None, a, b).ratio() >= COPY_RATIO)


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row's candidates, best first, the first MOST_EVIDENCE that copy no sentence of the target; of equal ones the one first in the paper."""
    kind = pa.list_(pa.struct([("sentence", pa.string()), ("source", pa.string())]))
    for batch in batches:
        out = []
        lists = batch.column("candidates")
        at, (sentences, sources, plains, places) = lists.offsets.to_pylist(), (x.to_pylist() for x in lists.values.flatten())
        for row, targets in enumerate(batch.column("targets").to_pylist()):
            first: dict[str, int] = {}
            for i in range(at[row], at[row + 1]):
                if places[i] < first.get(plains[i], 1 << 60):
                    first[plains[i]] = places[i]
            chosen: list[dict] = []
            for i in range(at[row], at[row + 1]):
                if len(chosen) == MOST_EVIDENCE:
                    break
                if first[plains[i]] == places[i] and not any(is_near_copy(plains[i], t) for t in targets):
                    chosen.append({"sentence": sentences[i], "source": sources[i]})
            out.append(chosen)
        yield pa.RecordBatch.from_arrays([batch.column("paper_id"), batch.column("section"), batch.column("sentences"), pa.array(out, kind)], names=["paper_id", "section", "sentences", "evidence"])


def mined_evidence(papers: DataFrame) -> DataFrame:
    """(paper_id, section, sentences, evidence) of the papers whose sections all have a target long enough: the target's sentences, and up to
    MOST_EVIDENCE sentences of the abstract and the sections that share most terms with it without being copies of its sentences.

    A sentence's rank is its common terms' share of its own terms plus their share of the target's; of equal ones the abstract comes first and
    the target's own section last, then earlier sentences. A paper is one row until its candidates are ranked, so nothing is shuffled; Python sees the
    ranked candidates alone, as only it can compare characters. Null ids are left out; null texts have no sentences.
    """
    fields = ("abstract", *(f for f, _, _ in SECTIONS.values()))
    p = composed(papers.where("paper_id is not null").select("paper_id", *fields), *fields)
    p = p.select("paper_id", *(training_sentences(F.col(c)).alias(c) for c in fields))
    p = p.select("*", *(section_target_sentences(F.col(f), least, most).alias(f"t_{f}") for f, least, most in SECTIONS.values()))
    known = lambda c: F.transform(c, lambda s, i: F.struct(s.alias("sentence"), i.alias("order"), plain_words(s).alias("plain"), terms_of(plain_words(s)).alias("terms")))
    p = p.select("paper_id", *(known(F.col(c)).alias(c) for c in fields), *(f"t_{f}" for f, _, _ in SECTIONS.values()))
    rows = []
    for name, (field, _, _) in SECTIONS.items():
        others = [f for f, _, _ in SECTIONS.values() if f != field]
        sources = [("abstract", 2), *((f, 1) for f in others), (field, 0)]
        rows.append(F.struct(F.lit(name).alias("section"), F.col(f"t_{field}").alias("sentences"), F.array(*(F.struct(F.lit(f).alias("source"), F.lit(b).alias("bonus"), F.lit(i).alias("nth"), F.col(f).alias("s")) for i, (f, b) in enumerate(sources))).alias("sources")))
    # Not a filter, which would be moved below the projections and compute all of them once more.
    whole = F.when(F.forall(F.array(*(F.col(f"t_{f}").isNotNull() for f, _, _ in SECTIONS.values())), lambda x: x), F.array(*rows))
    d = p.select("paper_id", F.explode(whole).alias("r")).select("paper_id", "r.*").withColumn("wanted", terms_of(plain_words(F.array_join("sentences", " "))))

    def scored(source: Column) -> Column:
        def of(s: Column) -> Column:
            common = F.size(F.array_intersect(F.col("wanted"), s.terms))  # the second one is hashed
            score = common / F.greatest(F.size(s.terms), F.lit(1)) + common / F.greatest(F.size("wanted"), F.lit(1))
            return F.struct(score.alias("score"), source.bonus.alias("bonus"), (-s.order).alias("back"), s.sentence.alias("sentence"), source.source.alias("source"), s.plain.alias("plain"), (source.nth * 1_000_000 + s.order).alias("place"), common.alias("common"))

        return F.filter(F.transform(source.s, of), lambda x: x.common >= LEAST_TERMS)

    ranked = F.sort_array(F.flatten(F.transform("sources", scored)), asc=False)
    slim = F.transform(ranked, lambda x: F.struct(x.sentence.alias("sentence"), x.source.alias("source"), x.plain.alias("plain"), x.place.alias("place")))
    d = d.select("paper_id", "section", "sentences", F.transform("sentences", plain_words).alias("targets"), slim.alias("candidates"))
    return d.mapInArrow(_choose, "paper_id bigint, section string, sentences array<string>, evidence array<struct<sentence:string,source:string>>")


def supported_targets(mined: DataFrame) -> DataFrame:
    """(paper_id, section, target, evidence, support): targets of the sentences that the evidence supports. Sections without evidence,
    and those whose supported sentences are too few words or too weakly supported as a whole, are left out."""
    have = terms_of(plain_words(F.array_join(F.transform("evidence", lambda e: e.sentence), " ")))
    d = mined.where(F.size("evidence") > 0).withColumn("have", have)

    def backed(s: Column) -> Column:
        own = terms_of(plain_words(s))
        common = F.size(F.array_intersect(own, F.col("have")))
        return (common >= LEAST_TERMS) & (common / F.greatest(F.size(own), F.lit(1)) >= LEAST_SUPPORT)

    d = d.withColumn("target", F.array_join(F.filter("sentences", backed), " "))
    own = terms_of(plain_words(F.col("target")))
    d = d.withColumn("support", F.size(F.array_intersect(own, F.col("have"))) / F.greatest(F.size(own), F.lit(1)))
    least = F.create_map(*[F.lit(x) for n, (_, a, _) in SECTIONS.items() for x in (n, a)])
    return d.where((F.size(F.split("target", " ")) >= least[F.col("section")]) & (F.col("support") >= LEAST_SUPPORT)).select("paper_id", "section", "target", "evidence", F.round("support", 4).alias("support"))


def names_in_title(title: Column) -> Column:
    """Names of two or more capitals, or with a capital inside, in lower case."""
    found = F.transform(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(NAME_IN_TITLE), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*NO_NAMES)))


def news_evidence(targets: DataFrame, titles: DataFrame, news: DataFrame) -> DataFrame:
    """(paper_id, section, news_id, title, source, sentence, score): for each target the article that is most about a name that the paper's title and the target
    share, where there is one that shares enough terms with both, and its sentence that does so most.

    targets: paper_id, section, target. titles: paper_id, title. news: news_id, title, content, source. Targets meet articles by the name alone, so
    only articles that name it are compared; a name that many articles have is joined in cells. Ties go to the smaller news_id as text.
    """
    n = composed(news.select("news_id", "title", "content", "source"), "title", "content")
    n = n.select("news_id", single_blanks(F.col("title")).alias("title"), single_blanks(F.col("source")).alias("source"), F.slice(training_sentences(F.col("content")), 1, NEWS_SENTENCES).alias("s"))
    n = n.where("news_id is not null and title <> '' and source <> '' and size(s) > 0").withColumn("title_terms", terms_of(plain_words(F.col("title")))).withColumn("title_names", names_in_title(F.col("title")))
    n = n.withColumn("s", F.transform("s", lambda x: F.struct(x.alias("sentence"), terms_of(plain_words(x)).alias("terms"))))
    n = n.withColumn("terms", F.array_distinct(F.concat("title_terms", F.flatten(F.transform("s", lambda x: x.terms)))))
    n = materialize(n, "news")
    t = targets.select("paper_id", "section", terms_of(plain_words(F.col("target"))).alias("target_terms")).join(titles.where("paper_id is not null").dropDuplicates(["paper_id"]).select("paper_id", F.col("title").alias("own")), "paper_id")
    t = t.withColumn("anchors", terms_of(plain_words(F.col("own")))).withColumn("own_names", names_in_title(F.col("own")))
    named = F.filter(F.array_intersect("own_names", "target_terms"), lambda w: ~w.isin(*PLATFORMS))
    t = materialize(t.select("paper_id", "section", "target_terms", "anchors", "own_names", named.alias("named")), "targets")
    asked = t.select("paper_id", "section", F.explode("named").alias("name"))
    held = n.select("news_id", F.explode("terms").alias("name"))
    met = materialize(grid_join(asked, held, ["name"], "paper_id", "news_id").select("paper_id", "section", "news_id").distinct(), "met")
    d = spread_join(spread_join(met, t, ["paper_id", "section"], "news_id"), n, ["news_id"], "paper_id")
    both = lambda a, b: F.size(F.array_intersect(a, b))
    platforms = F.array_intersect(F.array_intersect("own_names", "title_names"), F.array_intersect(F.col("target_terms"), F.array(*map(F.lit, PLATFORMS))))
    on_subject = F.arrays_overlap("named", "title_terms") | (F.size(platforms) > 0)
    in_text, in_target, in_title = both("anchors", "terms"), both("target_terms", "terms"), both("anchors", "title_terms")
    d = d.where(on_subject & (in_text >= LEAST_TERMS) & (in_target >= LEAST_TERMS) & ((in_title > 0) | (in_text >= LEAST_TERMS + 1)))
    told = F.transform("s", lambda x, i: F.struct(both(x.terms, F.array_union("anchors", "target_terms")).alias("n"), (-i).alias("i"), x.sentence.alias("sentence")))
    d = d.withColumn("best", F.array_max(told)).where(F.col("best.n") >= LEAST_TERMS)
    d = d.select("paper_id", "section", "news_id", "title", "source", F.col("best.sentence").alias("sentence"), (in_text + in_target + in_title).alias("score"))
    order = Window.partitionBy("paper_id", "section").orderBy(F.desc("score"), F.col("news_id").cast("string"))
    return d.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def is_english(language: Column) -> Column:
    """Whether a label, however it is written, names English."""
    return F.coalesce(label_code(language) == "en", F.lit(False))


def paper_gate(papers: DataFrame) -> DataFrame:
    """(paper_id, reason): why a paper can't be prepared, null if it can: the first of non_english_or_unknown_language, missing_title,
    section_too_short_<section>. (Whether its evidence supports a section is decided by supported_targets.) Null ids are missing_paper_id."""
    papers = composed(papers.select("paper_id", "language", "title", *(f for f, _, _ in SECTIONS.values())), *(f for f, _, _ in SECTIONS.values()))
    short = [
        F.when(section_target_sentences(training_sentences(F.col(f)), least, most).isNull(), f"section_too_short_{name.lower()}") for name, (f, least, most) in SECTIONS.items()
    ]
    reason = F.coalesce(
        F.when(F.col("paper_id").isNull(), "missing_paper_id"), F.when(~is_english(F.col("language")), "non_english_or_unknown_language"), F.when(single_blanks(F.col("title")) == "", "missing_title"), *short
    )
    return papers.select("paper_id", reason.alias("reason"))


def title_identity(title: Column) -> Column:
    """The words of a title that tell it apart; null if there are none."""
    words = F.array_join(F.filter(F.split(plain_words(title), " "), lambda w: ~w.isin(*TITLE_STOPWORDS) & (w != "")), " ")
    return F.when(words != "", words)


def quota_split(groups: DataFrame, id_col: str, shares: dict[str, float], rest: str, seed: int = 42) -> DataFrame:
    """(id_col, group_id, split) for (id_col, group_id): whole groups, in an order that a hash of their name and the seed gives, fill each of the shares'
    splits to exactly the rounded share of the number of groups (one at least); the rest comes first. Ids keep their group."""
    names = groups.select("group_id").distinct().withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("group_id").cast("string"))))
    placed = with_row_ids(names, "nth", 0, [F.col("h"), F.col("group_id")])
    total = names.count()
    counts = {s: max(1, int(total * share + 0.5)) for s, share in shares.items()}
    split, end = F.lit(rest), total
    for s in reversed(list(counts)):
        end -= counts[s]
        split = F.when((F.col("nth") > end) & (F.col("nth") <= end + counts[s]), s).otherwise(split)
    return spread_join(groups, placed.select("group_id", split.alias("split")), ["group_id"], id_col)


def paper_groups(papers: DataFrame, keys: list[Column]) -> DataFrame:
    """(paper_id, group_id) of all papers: one group for papers that share a key, their title's telling words, or the text of their sections."""
    papers = composed(papers, "title", *(f for f, _, _ in SECTIONS.values()))
    text = F.concat_ws("\n", *(plain_words(F.col(f)) for f, _, _ in SECTIONS.values()))
    own = [F.concat(F.lit("title:"), title_identity(F.col("title"))), F.when(text.rlike("[a-z0-9]"), F.concat(F.lit("text:"), F.sha2(text, 256)))]
    ids = papers.where("paper_id is not null")
    return ids.select("paper_id").distinct().join(linked_groups(ids, "paper_id", [*keys, *own]), "paper_id", "left").withColumn("group_id", F.coalesce("group_id", "paper_id"))


def training_samples(papers: DataFrame, news: DataFrame, keys: list[Column], seed: int = 42) -> DataFrame:
    """(paper_id, source_paper_ids, section, title, topic, research_question, paper_evidence, news_evidence, target, evidence_sources, support, split): the samples of one paper of each
    group of tied papers that can be prepared, the one of the smallest id as text.

    A paper one of whose targets another paper has too, earlier in the order that the splits are dealt in, gives none. The splits are dealt to groups of papers
    that can be prepared, 80, 10 and 10 of a hundred.
    """
    fit = materialize(papers.join(paper_gate(papers).where("reason is null").select("paper_id").distinct(), "paper_id", "left_semi"), "papers")
    targets = materialize(supported_targets(mined_evidence(fit)), "supported")
    able = fit.join(targets.select("paper_id").distinct(), "paper_id", "left_semi")
    groups = materialize(quota_split(paper_groups(able, keys), "paper_id", {"validation": 0.1, "test": 0.1}, "train", seed), "groups")
    chosen = groups.groupBy("group_id", "split").agg(F.min(F.struct(F.col("paper_id").cast("string").alias("s"), F.col("paper_id").alias("id"))).alias("m"), F.array_sort(F.collect_set(F.col("paper_id").cast("string"))).alias("source_paper_ids"))
    chosen = chosen.select(F.col("m.id").alias("paper_id"), "split", "source_paper_ids", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("group_id").cast("string"))).alias("h"))
    own = targets.join(chosen, "paper_id")
    first = own.groupBy(plain_words(F.col("target")).alias("t")).agg(F.min(F.struct("h", "paper_id")).alias("first"))
    late = spread_join(own.withColumn("t", plain_words(F.col("target"))), first, ["t"], "paper_id").where("first.paper_id <> paper_id").select("paper_id").distinct()
    own = own.join(late, "paper_id", "left_anti").drop("h")
    quoted = news_evidence(own, fit.select("paper_id", "title"), news)
    titles = fit.select("paper_id", single_blanks(F.col("title")).alias("title"), F.coalesce("keywords", F.array().cast("array<string>")).alias("k")).dropDuplicates(["paper_id"])
    d = own.join(titles, "paper_id").join(quoted.withColumnsRenamed({"title": "news_title", "source": "news_source"}), ["paper_id", "section"], "left")
    item = lambda kind, i, title, source, text: F.concat_ws("\n", F.concat(F.lit(f"[{kind} "), i.cast("string"), F.lit("]")), F.concat(F.lit("Title: "), title), source, F.concat(F.lit("Evidence: "), text))
    topic = F.array_join(F.slice("k", 1, MOST_KEYWORDS), ", ")
    paper_items = F.transform("evidence", lambda e, i: item("PAPER", i + 1, F.col("title"), F.lit(None).cast("string"), e.sentence))
    news_items = F.when(F.col("news_id").isNotNull(), F.array(item("NEWS", F.lit(1), F.col("news_title"), F.concat(F.lit("Source: "), F.col("news_source")), F.col("sentence")))).otherwise(F.array(F.lit(NO_NEWS)))
    sources = F.concat(F.transform("evidence", lambda e: F.concat_ws(":", F.lit("paper"), F.col("paper_id").cast("string"), e.source)), F.when(F.col("news_id").isNotNull(), F.array(F.concat(F.lit("news:"), F.col("news_id").cast("string")))).otherwise(F.array().cast("array<string>")))
    question = F.concat(F.lit("What does the evidence show about "), F.regexp_replace("title", "[.?]+$", ""), F.lit("?"))
    return d.select(
        "paper_id", "source_paper_ids", "section", "title", F.when(topic != "", topic).otherwise(F.col("title")).alias("topic"), question.alias("research_question"), paper_items.alias("paper_evidence"), news_items.alias("news_evidence"),
        "target", sources.alias("evidence_sources"), "support", "split",
    )
