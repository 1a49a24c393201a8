import pytest
from pyspark.sql import functions as F

from quillwork.operators import evidence, gates, quality

PAPERS = "paper_id bigint, title string, keywords array<string>, abstract string, introduction string, body string, conclusion string, language string, doi string, content_hash string, source_url string, section string"


def prose(words, n, k=0):
    """n sentences of ten words each that share the given words."""
    return " ".join(f"Alpha{k} {words} number{i} runs over the harbour near bridge{i} today." for i in range(n))


def paper(i, words="walkers lanterns", **kw):
    row = dict(paper_id=i, title=f"Walks Of ULFINE {i}", keywords=["a", "b", "c", "d", "e"], abstract=prose(words + " summary", 3, i), introduction=prose(words, 8, i), body=prose(words + " bodies", 12, i), conclusion=prose(words + " endings", 6, i),
               language="en-GB", doi=None, content_hash=None, source_url=f"https://x.example/{i}", section="clash")
    return tuple((row | kw)[c] for c in row)


def test_near_copies():
    assert evidence.is_near_copy("a b c", "a b c") and not evidence.is_near_copy("a b c", "") and evidence.is_near_copy("", "")
    base = "the small red boat went over the long bridge near the old town"
    assert evidence.is_near_copy(base, base.replace("small", "little") + " again") and not evidence.is_near_copy(base, "a boat is not a bridge and a town is no harbour")
    # Half of the words in common and the characters alike, or not.
    assert evidence.is_near_copy("walkers followed lanterns slowly", "walkers followed lanterns slowl") and not evidence.is_near_copy("one two three four five six", "six five four nine three eight")


def test_word_share(spark):
    df = spark.createDataFrame([("a b b c", "b c d"), ("", "b"), (None, "b")], "a string, b string")
    assert [r[0] for r in df.select(evidence.word_share(evidence.plain_words(F.col("a")), F.col("b"))).collect()] == [0.5, 0.0, 0.0]


def test_target_sentences(spark):
    s = [" ".join("w" * 10) for _ in range(9)]

    def got(rows, least, most):
        return spark.createDataFrame([(rows,)], "s array<string>").select(quality.section_target_sentences(F.col("s"), least, most)).first()[0]

    assert got(s, 20, 30) == s[:3] and got(s, 20, 29) == s[:2] and got(s, 95, 120) is None and got([], 1, 2) is None and got(s, 85, 120) == s and got(None, 1, 2) is None


def test_gate_names_the_first_reason(spark):
    rows = [paper(1), paper(2, language="ko"), paper(3, title=" "), paper(4, body=None), paper(5, introduction="", conclusion=""), paper(None), paper(6, language=None)]
    got = {r.paper_id: r.reason for r in evidence.paper_gate(spark.createDataFrame(rows, PAPERS)).collect()}
    assert got == {1: None, 2: "non_english_or_unknown_language", 3: "missing_title", 4: "section_too_short_body", 5: "section_too_short_introduction", None: "missing_paper_id", 6: "non_english_or_unknown_language"}


def brute(row):
    """The evidence of a paper's introduction, by the definition."""
    own = dict(zip((c.split()[0] for c in PAPERS.split(", ")), row))
    cut = lambda t: [x for x in (t or "").replace(". ", ".\n").split("\n") if x]
    target = cut(own["introduction"])[:8]
    plain = lambda t: " ".join("".join(c if c.isalnum() and c.isascii() else " " for c in t.lower()).split())
    terms = lambda t: {w for w in plain(t).split() if len(w) >= 4 and w not in quality.SUPPORT_STOPWORDS}
    wanted, ranked, seen = terms(" ".join(target)), [], set()
    for source, bonus in (("abstract", 2), ("body", 1), ("conclusion", 1), ("introduction", 0)):
        for i, s in enumerate(cut(own[source])):
            n = len(terms(s) & wanted)
            if n >= 2 and plain(s) not in seen and not any(evidence.is_near_copy(plain(s), plain(t)) for t in target):
                seen.add(plain(s))
                ranked.append((n / len(terms(s)) + n / len(wanted), bonus, -i, s, source))
    return [(s, source) for *_, s, source in sorted(ranked, reverse=True)[:4]]


def test_mining_against_brute_force(spark):
    rows = [paper(1, abstract="Walkers saw seven lanterns and a quiet tower of old stone there. " * 2 + "Nothing of this has to do with the rest of it all."), paper(2, abstract=None), paper(3, body=None)]
    df = spark.createDataFrame(rows, PAPERS)
    got = {(r.paper_id, r.section): [(e.sentence, e.source) for e in r.evidence] for r in evidence.mined_evidence(df).collect()}
    assert set(got) == {(i, s) for i in (1, 2) for s in evidence.SECTIONS}
    for i in (1, 2):
        assert got[i, "Introduction"] == brute(rows[i - 1])
    assert evidence.mined_evidence(df.limit(0)).count() == 0


def test_samples(spark):
    said = "People with lanterns and walkers crossed {} the harbour bridge in a long summary of bodies and endings there."
    rows = [paper(i, abstract=" ".join(said.format(f"street{i}{k}") for k in range(3))) for i in range(1, 12)]
    rows += [paper(20, abstract=rows[0][3], doi="10.1234/x"), paper(21, doi="https://doi.org/10.1234/X", title="Other ULFINE", abstract=rows[0][3]), paper(22, language="es"), paper(None)]
    news = spark.createDataFrame([(7, "ULFINE lanterns for walkers", "ULFINE showed lanterns to walkers near the harbour bridge on a long evening.", "S"), (8, None, "x", "S"), (9, "t", None, None)], "news_id bigint, title string, content string, source string")
    df = spark.createDataFrame(rows, PAPERS)
    got = evidence.training_samples(df, news, [F.when(F.col("doi").isNotNull(), F.lower(F.regexp_extract("doi", r"(10\..*)$", 1)))]).collect()
    assert got and {r.paper_id for r in got} <= set(range(1, 22)) - {21}
    tied = [r for r in got if r.paper_id == 20]
    assert all(r.source_paper_ids == ["20", "21"] for r in tied)
    assert len({(r.paper_id, r.section) for r in got}) == len(got) and {r.split for r in got} <= {"train", "validation", "test"}
    for r in got:
        assert r.topic == "a, b, c, d" and r.research_question == f"What does the evidence show about {r.title}?" and r.paper_evidence[0].startswith(f"[PAPER 1]\nTitle: {r.title}\nEvidence: ")
        assert len(r.target.split()) >= evidence.SECTIONS[r.section][1] and 0.16 <= r.support <= 1


def test_quota_split_is_exact(spark):
    df = spark.range(1000).select(F.col("id").alias("paper_id"), (F.col("id") % 100).alias("group_id"))
    got = evidence.quota_split(df, "paper_id", {"validation": 0.1, "test": 0.1}, "train").collect()
    assert len(got) == 1000 and {s: len({r.group_id for r in got if r.split == s}) for s in ("train", "validation", "test")} == {"train": 80, "validation": 10, "test": 10}


GATE = "section string, title string, topic string, research_question string, paper_evidence array<string>, news_evidence array<string>, target string, reject boolean, reasons string"
SAID = ["The quiet harbour walkers carried paper lanterns over the northern bridge until morning came.", "Members of the rowing circle measured river levels near the tower for eleven weeks."]


@pytest.mark.parametrize("section, target, expected", [
    ("Body", None, {"empty", "low_evidence_relevance"}), ("Body", "Introduction: few words", {"heading", "too_short", "broken_sentence", "low_evidence_relevance"}),
    ("Body", " ".join(["Harbour walkers carried paper lanterns."] * 9), {"repetition"}), ("Introduction", "Overall the walkers carried lanterns, and members measured river levels near the quiet tower, while the rowing circle crossed a northern bridge until morning came over the harbour "
     "with eleven weeks of paper and more river levels for the members.", {"section_mismatch"}), ("Conclusion", SAID[0], {"section_mismatch", "too_short", "copied_evidence"}),
    ("Body", "In 1999 members of BRESTA measured 12 levels.", {"too_short", "unsupported_number", "unsupported_entity"}),
])
def test_grounding(spark, section, target, expected):
    df = spark.createDataFrame([(section, "T", None, "What of it?", SAID, None, target, None, "clash")], GATE)
    assert set(gates.grounding(df).first().reasons) == expected


def test_conclusions(spark):
    good = "Overall, the harbour walkers carried lanterns over the northern bridge. The evidence suggests that members of the rowing circle measured river levels near the tower for weeks, and therefore that morning walkers carried paper over it all until they came home again safely."
    rows = [("Conclusion", "T", None, "Did walkers carry lanterns?", SAID, [], t, False, "") for t in (good, "This study explores walkers.", "Walkers!" + "o" * 9, None)]
    got = [set(r.reasons) for r in gates.conclusion(spark.createDataFrame(rows, GATE).coalesce(1)).collect()]
    assert got[0] == set() and {"conclusion_structure", "body_or_introduction_style", "missing_synthesis"} <= got[1] and "corrupt_text" in got[2] and "research_question_not_answered" in got[3]


def test_leaks_and_report(spark):
    schema = "sample_id int, paper_id bigint, split string, " + GATE
    rows = [(1, 5, "train"), (2, 5, "test"), (3, 6, "train"), (4, 7, "validation"), (5, None, "train"), (6, 8, None)]
    body = ("Body", "T", "x", "Q?", ["e"], None, "One text.", None, "")
    df = spark.createDataFrame([(*r, *body) for r in rows] + [(7, 9, "train", "Body", " ", None, None, None, None, "t", None, "")], schema)
    got = {(r.kind, r.key if r.kind != "sample" else "", r.splits) for r in gates.split_leaks(df).collect()}
    assert got == {("paper", "5", "test,train"), ("sample", "", "test,train,validation"), ("invalid", "paper_id", "1"), ("invalid", "title", "1")}
    report = {(r.split, r.reason): r.n for r in gates.report(gates.grounding(df)).collect()}
    assert report["train", "all"] == 4 and ("train", "passed") not in report
    assert gates.split_leaks(df.limit(0)).count() == gates.report(gates.grounding(df.limit(0))).count() == 0
