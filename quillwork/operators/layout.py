"""Page cleaning and section finding as column expressions: a document is one row throughout, so its text is never shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.forms import nfkc
from .quality import bound

# Headings of sections in English, Indonesian and Korean.
HEADINGS = {
    "abstract": r"abstract|abstrak|초록|요약",
    "introduction": r"introduction|preface|서론|서 론|pendahuluan",
    "conclusion": r"conclusions?(?: and (?:discussion|implications|recommendations?|research limitations|future work))?|discussion and conclusions?|결론(?: 및 제언)?|결 론|(?:kesimpulan|simpulan)(?: dan saran)?|penutup",
    "references": r"references|bibliography|works cited|literature cited|참고문헌|참고 문헌|daftar pustaka|referensi",
    "appendix": r"appendix(?: [A-Z])?|appendices|supplementary material|supporting information|부록",
    "backmatter": r"acknowledg(?:e)?ments?|funding|disclosure statement|conflict(?:s)? of interest|notes|endnotes",
    "keywords": r"keywords?|key words|kata[- ]kata kunci|kata kunci|주제어|핵심어",
    "literature_review": r"literature review|review of (?:the )?literature|related work|previous studies|background and related work|선행연구|선행 연구",
    "background": r"(?:theoretical|conceptual) (?:framework|background)|background|이론적 배경",
    "methodology": r"research (?:method|design|methodology)s?|methods?|methodology|materials and methods|연구 방법|연구방법|metode(?: penelitian)?",
    "results": r"results?|experimental results|findings|연구 결과|연구결과|hasil",
    "discussion": r"(?:results?|findings) and discussion|discussion(?: and implications)?|implications|논의|pembahasan|hasil dan pembahasan",
    "other": r"case study|case\s+\d+|example",
}
# Numbers before headings, what no heading has, words that may be small in a title, and limits of headings.
HEADING_NUMBER = r"^(?:\d{1,2}(?:\.\d{1,2}){0,3}[.)]?\s+|[IVX]+[.)]\s+|[A-H][.)]\s+|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ][.\s]*)"
NO_HEADING = r"https?://|\bISSN\b|\bISBN\b|\bDOI\b|@"
SMALL_WORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")
MOST_CHARACTERS, MOST_WORDS, MOST_UNKNOWN_WORDS, TITLE_CASE, LEAST_CAPITALS = 140, 18, 12, 0.65, 10
# Captions of figures and tables, and the notes below them.
CAPTION = r"(?:fig(?:ure)?\.?|table)[^\S\n]+\d+[A-Za-z]?(?:[.:][^\n]*)?"
CAPTION_NOTE = r"(?:source|note)[^\S\n]*[:：][^\n]{0,200}"
# Lines that are layout, whatever is around them (letter case aside).
LAYOUT_LINES = (
    r"^(?:page\s*)?\d+(?:\s*(?:of|/)\s*\d+)?$",
    r"^(?:[PE]-)?ISSN[-\s\w:.,\d]+$",
    r"^(?:https?://(?:dx\.)?doi\.org/|doi\s*[:：]|\*?\s*corresponding author[,;:]|downloaded from\b|©|copyright\s+\d{4})",
)
MAIL = r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b"
# Lines at a page's edge, pages on which one must recur, its length, and the length of a paragraph that may not recur.
EDGE_LINES, LEAST_PAGES, EDGE_LENGTH, LEAST_PARAGRAPH = 5, 3, 180, 80

BODY = ("literature_review", "background", "methodology", "results", "discussion", "other")
END = ("references", "appendix", "backmatter")
TYPED = ("introduction", "literature_review", "background", "methodology", "results", "discussion", "conclusion")

LINE_END = "\r\n|[\n\r\u000b\f\u001c-\u001e\u0085  ]"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _lines(text: Column) -> Column:
    return F.split(text, LINE_END)


def cleaned_pages(df: DataFrame, keys: Sequence[str], pages: Column) -> DataFrame:
    """(keys, text, removed_lines, removed_paragraphs) of array<string> pages.

    Gone are the lines that recur, numbers aside, among the first and last EDGE_LINES lines of at least half of the
    pages (LEAST_PAGES or more); LAYOUT_LINES and short lines with a mail address; and later copies of paragraphs of
    LEAST_PARAGRAPH or more characters. Words broken at line ends are joined and wrapped prose is reflowed. Null pages and
    null arrays count as empty. Repeated rows stay repeated; other columns are ignored.
    """
    no_text = F.array().cast("array<string>")
    tidy = lambda line: F.trim(F.regexp_replace(F.replace(line, F.lit("\0"), F.lit("")), r"(?U)\s+", " "))
    d = df.select(*keys, nfkc(F.transform(F.coalesce(pages, no_text), lambda p: F.coalesce(p, F.lit("")))).alias("_p"))
    d = d.withColumn("_p", F.transform("_p", lambda p: F.transform(_lines(p), tidy)))

    key = lambda line: F.regexp_replace(line, r"\d+", "#")
    edge = lambda x: F.concat(F.slice(x, 1, EDGE_LINES), F.slice(x, F.greatest(F.size(x) - EDGE_LINES + 1, F.lit(1)), EDGE_LINES))
    edges = F.flatten(F.transform("_p", lambda p: bound(F.filter(p, lambda x: x != ""), lambda x: F.array_distinct(F.transform(edge(x), key)))))
    need = F.greatest(F.lit(LEAST_PAGES), F.floor(F.size("_p") / 2).cast("int"))
    # In sorted order a key that occurs `need` times is the same at two places that far apart.
    again = bound(F.array_sort(edges), lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - need), lambda i: F.when(F.get(s, i) == F.get(s, i + need - 1), F.get(s, i))))
    recurring = F.when(F.size(edges) >= need, F.filter(F.array_distinct(again), lambda k: F.char_length(k) < EDGE_LENGTH)).otherwise(no_text)
    layout = lambda x: x.rlike("(?i)" + "|".join(LAYOUT_LINES)) | (x.contains("@") & (F.char_length(x) < EDGE_LENGTH) & x.rlike(MAIL))
    # Bound, so that it is computed once a document and not once a line.
    d = d.withColumn("_k", bound(recurring, lambda r: F.transform("_p", lambda p: F.filter(p, lambda x: ~(F.array_contains(r, key(x)) | layout(x))))))
    text = F.array_join(F.transform("_k", lambda p: F.array_join(p, "\n")), "\n\n")
    text = F.regexp_replace(F.regexp_replace(text, "(?<=[a-z])-\n(?=[a-z])", ""), "(?<=[a-z,;])\n(?=[a-z])", " ")
    d = d.withColumn("_g", F.split(text, r"\n\s*\n"))
    d = d.withColumn("_h", F.transform("_g", lambda g: F.lower(F.trim(F.regexp_replace(g, r"(?U)\s+", " ")))))
    copy = lambda i: (F.char_length(F.get("_h", i)) >= LEAST_PARAGRAPH) & (F.array_position(F.col("_h"), F.get("_h", i)) <= i)
    kept = F.filter("_g", lambda g, i: (F.get("_h", i) != "") & ~copy(i))
    return d.select(
        *keys, F.array_join(F.transform(kept, _strip), "\n\n").alias("text"), (F.size(F.flatten("_p")) - F.size(F.flatten("_k"))).alias("removed_lines"),
        F.size(F.filter("_g", lambda g, i: copy(i))).alias("removed_paragraphs"),
    )


def heading_kind(line: Column) -> Column:
    """The section that a line heads, `other` for a heading of no known section, null for any other line."""
    cased = lambda x, own, otherwise: (x == own(x)) & (x != otherwise(x))

    def kind(head: Column, bare: Column) -> Column:
        known = F.coalesce(*(F.when(bare.rlike(rf"(?i)^(?:{p})(?:\s*[:：]\s*[^.!?]+)?$"), k) for k, p in HEADINGS.items()))
        words = F.regexp_extract_all(bare, F.lit(r"[A-Za-z]+(?:[-'][A-Za-z]+)*"), F.lit(0))
        long = F.filter(words, lambda w: ~F.lower(w).isin(*SMALL_WORDS))
        titled = (F.size(long) > 0) & (F.size(F.filter(long, lambda w: w.rlike("^[A-Z]"))) / F.size(long) >= TITLE_CASE)
        shouted = cased(bare, F.upper, F.lower) & (F.size(words) >= 2) & (F.char_length(bare) >= LEAST_CAPITALS)
        plain = ~bare.rlike(r"[.!?]$|[,;%=]|\d") & (F.size(F.split(F.trim(bare), r"\s+")) <= MOST_UNKNOWN_WORDS)
        return F.coalesce(known, F.when(plain & ((head.rlike(HEADING_NUMBER) & titled) | shouted), "other"))

    def of(head: Column) -> Column:
        fits = (head != "") & (F.char_length(head) <= MOST_CHARACTERS) & (F.size(F.split(head, r"\s+")) <= MOST_WORDS) & ~head.rlike("(?i)" + NO_HEADING)
        named = F.regexp_replace(_strip(F.regexp_replace(head, HEADING_NUMBER, "")), ":+$", "")
        # A word in small letters with a full stop is prose; a number after a heading is a footnote's.
        ended = F.when(~(named.endswith(".") & cased(named, F.lower, F.upper)), F.regexp_replace(F.regexp_replace(named, r"\.+$", ""), r"\s+\d{1,2}$", ""))
        return F.when(fits, bound(ended, lambda bare: kind(head, bare)))

    return bound(_strip(F.regexp_replace(_strip(line), "^#+", "")), of)


def sections(df: DataFrame, keys: Sequence[str], text: Column) -> DataFrame:
    """(keys, abstract, introduction, body, conclusion, references, appendix, abstract_variants, captions, sections) of a text, from its headings.

    What has no heading stays null; nothing is guessed. The introduction runs to the first heading of a body section that isn't one of its
    own subsections, else to the conclusion, else to the end matter; the body from there to the conclusion or the end
    matter; the conclusion to the end matter. `abstract` is the last of the variants before the introduction. Captions and
    the notes below them are taken out of the texts. sections: every heading with its kind, its section_type (that of the numbered section
    it is part of, if it has no kind of its own) and its text. Null and empty texts have no sections.
    """
    d = df.select(*keys, F.filter(_lines(F.coalesce(text, F.lit(""))), lambda x: x.isNotNull()).alias("_l"))
    marks = F.transform("_l", lambda x, i: F.struct(i.alias("at"), _strip(x).alias("heading"), heading_kind(x).alias("kind")))
    d = d.withColumn("_m", F.filter(marks, lambda m: m.kind.isNotNull()))

    def content(m: Column, j: Column) -> Column:
        end = F.coalesce(F.get("_m", j + 1).at, F.size("_l"))
        lead = F.when(m.kind.isin("abstract", "keywords"), F.regexp_extract(F.get("_l", m.at), "^[^:：]*[:：](.*)$", 1))
        return F.concat(F.lit("\n"), F.coalesce(lead, F.lit("")), F.lit("\n"), F.array_join(F.slice("_l", m.at + 2, end - m.at - 1), "\n"))

    def kind_of(m: Column, j: Column) -> Column:
        major = F.regexp_extract(m.heading, r"^(\d+)\.\d", 1)
        owner = F.element_at(F.filter(F.slice("_m", 1, j), lambda x: F.regexp_extract(x.heading, r"^(\d+)[.)]?\s", 1) == major), -1).kind
        return F.when((m.kind == "other") & (major != "") & (j > 0), F.when(owner.isin(*TYPED), owner)).otherwise(m.kind)

    block = rf"(?i)\n[^\S\n]*{CAPTION}[^\S\n]*(?=\n|\z)(?:\n[^\S\n]*{CAPTION_NOTE}(?=\n|\z))*"
    part = lambda m, j: bound(
        content(m, j),
        lambda c: F.struct(
            m.at.alias("at"), m.heading.alias("heading"), m.kind.alias("kind"), F.coalesce(kind_of(m, j), m.kind).alias("section_type"), _strip(F.regexp_replace(c, block, "")).alias("text"),
            F.transform(F.flatten(F.transform(F.regexp_extract_all(c, F.lit(block), F.lit(0)), lambda b: F.split(F.substr(b, F.lit(2)), "\n"))), _strip).alias("captions"),
        ),
    )
    d = d.withColumn("_s", F.transform("_m", part)).withColumn("_end", F.size("_l"))

    first = lambda test: F.get(F.filter("_s", test), F.lit(0))
    d = d.withColumn("_i", first(lambda s: s.kind == "introduction"))
    after_start = lambda s: F.coalesce(s.at > F.col("_i.at"), F.lit(True))
    d = d.withColumn("_c", first(lambda s: (s.kind == "conclusion") & after_start(s)).at)
    d = d.withColumn("_t", F.coalesce(first(lambda s: s.kind.isin(*END) & (s.at > F.col("_i.at"))).at, F.col("_end")))
    stop = F.least(F.coalesce("_c", "_end"), F.col("_t"))
    own = F.regexp_extract("_i.heading", r"^(\d+)\.", 1)
    inside = lambda s: (own != "") & (F.regexp_extract(s.heading, r"^(\d+)\.\d", 1) == own)
    d = d.withColumn("_b", first(lambda s: s.kind.isin(*BODY) & (s.at > F.col("_i.at")) & (s.at < stop) & ~inside(s)).at)
    d = d.withColumn("_f", first(lambda s: s.kind == "references").at)
    closing = F.coalesce(first(lambda s: s.kind.isin(*END) & (s.at > F.col("_c"))).at, F.col("_end"))
    listed = F.coalesce(first(lambda s: s.kind.isin("appendix", "backmatter") & (s.at > F.col("_f"))).at, F.col("_end"))

    def joined(test) -> Column:
        found = F.array_join(F.transform(F.filter("_s", lambda s: test(s) & (s.text != "")), lambda s: s.text), "\n\n")
        return F.when(found != "", found)

    between = lambda a, b: joined(lambda s: (s.at >= a) & (s.at < b))
    abstracts = F.transform(F.filter("_s", lambda s: (s.kind == "abstract") & F.coalesce(s.at < F.col("_i.at"), F.lit(True))), lambda s: F.struct(s.heading.alias("heading"), s.text.alias("text")))
    return d.select(
        *keys, F.try_element_at(abstracts, F.lit(-1)).text.alias("abstract"), between(F.col("_i.at"), F.coalesce("_b", "_c", "_t")).alias("introduction"), between(F.col("_b"), stop).alias("body"),
        between(F.col("_c"), closing).alias("conclusion"), between(F.col("_f"), listed).alias("references"), joined(lambda s: s.kind == "appendix").alias("appendix"),
        abstracts.alias("abstract_variants"),
        F.flatten(F.transform("_s", lambda s: F.transform(s.captions, lambda c: F.struct(s.kind.alias("section_type"), c.alias("text"))))).alias("captions"),
        F.transform("_s", lambda s: F.struct(s.heading.alias("heading"), s.kind.alias("kind"), s.section_type.alias("section_type"), s.text.alias("text"))).alias("sections"),
    )
