import pytest
from pyspark.sql import functions as F

from quillwork.operators import layout


def find(spark, text):
    rows = layout.sections(spark.createDataFrame([(1, text, "clash")], "id int, t string, sections string"), ["id"], F.col("t")).collect()
    assert len(rows) == 1
    return rows[0]


def clean(spark, pages):
    return layout.cleaned_pages(spark.createDataFrame([(1, pages, "clash")], "id int, p array<string>, text string"), ["id"], F.col("p")).first()


KINDS = {
    "Ⅰ. 서론": "introduction", "V. KESIMPULAN DAN SARAN": "conclusion", "Conclusion: what was left": "conclusion", "A. INTRODUCTION": "introduction", "2. Preface 3": "introduction",
    "Review of the Literature": "literature_review", "Background and Related Work": "literature_review", "Supplementary Material": "appendix", "Works cited": "references", "## Methods:": "methodology",
    "3. A Study of Things": "other", "THE LONG WALK HOME": "other", "Case 4: harbours": "other", "Findings and discussion": "discussion", "Kata kunci": "keywords",
    "method.": None, "In conclusion, the walks were long.": None, "Results show that walks are long.": None, "3. walks are long in the evening": None, "12 May 2021": None, "ROOFS": None, "": None,
    "P-ISSN: 1111-2222": None, "4. See https://x.example": None, "Table of 3 = 4": None, "word " * 19: None, "x" * 141: None, "2. Costs, Means and Ways": None, "1. All Is Well.": "other",
}


def test_heading_kinds(spark):
    df = spark.createDataFrame([(k,) for k in KINDS], "t string").select("t", layout.heading_kind(F.col("t")).alias("kind"))
    assert {r.t: r.kind for r in df.collect()} == KINDS


def test_sections_of_a_paper(spark):
    text = (
        "A Title Of Some Length\nAbstract: First words\nmore words\nKeywords: a, b\n1. Introduction\nWe begin.\n1.1. Scope of It\nScoped.\n2. Methods\nWe do.\nFigure 1. A picture\n"
        "Figure 2 shows the rest.\n2.2 Measured Things Here\nMeasured.\n3. Results\nTable 3.\nSource: a survey\nNote: small\nSource: gone is the caption\nWe find.\nNote: stays\n4. Conclusion\nWe end.\n1. Some Final Words\nfinal\n"
        "Acknowledgements\nThanks.\nReferences\nDoe, J.\nAppendix A\nTables.\n"
    )
    r = find(spark, text)
    assert (r.abstract, r.introduction) == ("First words\nmore words", "We begin.\n\nScoped.")
    assert r.body == "We do.\nFigure 2 shows the rest.\n\nMeasured.\n\nWe find.\nNote: stays"
    assert (r.conclusion, r.references, r.appendix) == ("We end.\n\nfinal", "Doe, J.", "Tables.")
    assert [(c.section_type, c.text) for c in r.captions] == [("methodology", "Figure 1. A picture"), *(("results", x) for x in ("Table 3.", "Source: a survey", "Note: small", "Source: gone is the caption"))]
    types = {s.heading: (s.kind, s.section_type) for s in r.sections}
    assert types["2.2 Measured Things Here"] == ("other", "methodology") and types["1. Some Final Words"] == ("other", "other") and types["1.1. Scope of It"] == ("other", "introduction")


def test_sections_that_are_not_there(spark):
    for text in (None, "", "No headings here. " * 50):
        r = find(spark, text)
        assert [r[c] for c in ("abstract", "introduction", "body", "conclusion", "references", "appendix")] == [None] * 6 and r.sections == r.captions == r.abstract_variants == []
    r = find(spark, "Abstract\nOne\nAbstrak\nDua\nMethods\nDone")
    assert r.abstract == "Dua" and [v.text for v in r.abstract_variants] == ["One", "Dua"] and r.body is None
    r = find(spark, "Introduction\nStart\nReferences\nx\nConclusion\nLate")
    assert (r.introduction, r.body, r.conclusion) == ("Start\n\nx", None, "Late")


def test_page_cleaning(spark):
    pages = ["Journal 1\nAlpha beta gam-\nma delta,\nand more.\n1", "Journal  2\nmail me@host.example\nText two.\n2", "Journal 3\nText three.\npage 3 of 9", None]
    r = clean(spark, pages)
    assert r.text == "Alpha beta gamma delta, and more.\n\nText two.\n\nText three." and (r.removed_lines, r.removed_paragraphs) == (7, 0)
    long = "A paragraph that is repeated word for word and is long enough to be counted as a copy of itself."
    r = clean(spark, [f"{long}\n\nshort\n\n{long.upper()}\n \nshort"])
    assert r.text == f"{long}\n\nshort\n\nshort" and r.removed_paragraphs == 1
    assert clean(spark, ["ISSN 1234-5678\n© Someone\nDownloaded from a host\nCopyright 2020 us\nDOI: 10.1/x\n* Corresponding author: me\nⅣ ﬁne"]).text == "IV fine"
    assert clean(spark, ["Issues\nCopyright law\nsee doi.org\nPage one"]).removed_lines == 0
    # Two pages are too few for an edge to recur, and a line inside a page is no edge.
    assert clean(spark, ["Head\na", "Head\nb"]).removed_lines == 0
    middle = "\n".join(["1 a b c", "d e", "f g", "h i", "j k", "Same here", "l m", "n o", "p q", "r s", "t u"])
    assert "Same here" in clean(spark, [middle, middle.replace("a", "x"), middle.replace("e", "y"), "Same here"]).text


@pytest.mark.parametrize("pages", [[], None, [""], [None]])
def test_no_pages(spark, pages):
    r = clean(spark, pages)
    assert (r.text, r.removed_lines, r.removed_paragraphs) == ("", 0, 0)


def test_empty_table(spark):
    df = spark.createDataFrame([], "id int, p array<string>, t string")
    assert layout.cleaned_pages(df, ["id"], F.col("p")).count() == layout.sections(df, ["id"], F.col("t")).count() == 0
