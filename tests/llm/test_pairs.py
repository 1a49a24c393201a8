import random

import numpy as np
import pytest

from quillwork.llm import pairs as P


def sound(rng, n=400):
    nouns = "gardens rivers schools markets letters bridges songs villages".split()
    verbs = "changed reached shaped followed measured protected".split()
    rows = []
    for i in range(n):
        text = " ".join(f"{rng.choice(['Over time', 'In most cases', 'By contrast', 'Later'])}, the {rng.choice(nouns)} {rng.choice(verbs)} {rng.choice(['some of the', 'the', 'many'])} {rng.choice(nouns)}{f' in {2000 + rng.randrange(20)}' if rng.random() < 0.5 else ''}." for _ in range(rng.randrange(2, 5)))
        q = f"How did old {rng.choice(nouns)} affect new {rng.choice(nouns)} near the {rng.choice(nouns)} of the coast?"
        rows.append({"id": i, "question": q, "target": text, "reject": False, "title": f"A study of {rng.choice(nouns)} and {rng.choice(nouns)}", "topic": rng.choice(nouns)})
    return rows


@pytest.fixture(scope="module")
def tagger():
    return P.train(P.training_sequences(sound(random.Random(1))))


def test_defects(tagger):
    q, title = "How did quiet harbours affect loud cities near the border?", "Harbours and cities"
    a = "Over time, the harbours changed some of the cities in 2010. Later, the cities followed the harbours."
    cases = {
        a: None, a + " [PAPER 2]": None, a + " Members called this “the turn.”": None, "": "empty", " \n": "empty", "​": "empty", "N/A": "empty", "...": "empty", "(blank)": "empty",
        "I'm sorry, but I cannot help with that.": "refusal", "Cannot comply. The evidence about harbours is too thin.": "refusal",
        "Over time, the harbours changed some of the": "truncated", a + " By contrast, several (see also": "truncated", a + " In most cases, the cities,": "truncated",
        q: "copy", q.lower().rstrip("?"): "copy", "Good question. " + q: "copy",
        "Con el tiempo, los puertos cambiaron algunas de las ciudades. Más tarde, las ciudades siguieron a los puertos.": "language",
        "시간이 지나면서 항구는 도시를 바꾸었다. 나중에 도시는 항구를 따랐다.": "language",
    }
    got = {t: P.defect(t, False, q, title, tagger)[0] for t in cases}
    assert {t: (got[t], e) for t, e in cases.items() if got[t] != e} == {}
    assert P.defect(None, None, q, title, tagger)[0] == "empty" and P.defect(None, True, q, title, tagger)[0] == "refusal" and P.defect(a, True, q, title, tagger)[0] == "refusal"
    assert P.defect(a, False, None, None, tagger)[0] is None and P.defect(a * 300, False, q, title, tagger)[0] is None


def test_viterbi_is_the_best_sequence(tagger):
    import itertools

    feats = P.features(P.clauses("The rivers changed. Sorry, I cannot. Los puertos."), "q", "t")
    emit = np.array([tagger.weights[f].sum(axis=0) for f in feats])

    def score(s):
        return tagger.starts[s[0]] + tagger.ends[s[-1]] + sum(emit[i, k] for i, k in enumerate(s)) + sum(tagger.moves[a, b] for a, b in zip(s, s[1:]))

    best = max(itertools.product(range(5), repeat=3), key=score)
    assert tuple(tagger.tag(feats)) == best


def test_training_gradient_fits_a_separable_set():
    seqs = [([[1], [2]], [0, 1]), ([[2], [3]], [1, 2])] * 20
    t = P.train(seqs, epochs=80)
    assert t.tag([[1], [2]]) == [0, 1] and t.tag([[2], [3]]) == [1, 2] and t.tag([]) == []


def test_table(spark, tagger):
    rows = [(1, "q", "The old answer", "t", False, None), (1, "q", "", "t", False, "2024-01-02"), (None, "q", "x", "t", None, None), (2, None, "Over time, the rivers changed the songs.", None, None, "2024-01-01")]
    df = spark.createDataFrame(rows, "id bigint, question string, target string, title string, reject boolean, at string").withColumn("defect", __import__("pyspark").sql.functions.lit("clash"))
    got = {r.id: r.defect for r in P.tag_pairs(df, tagger).collect()}
    assert got == {1: "empty", 2: None}
    assert P.tag_pairs(df.limit(0), tagger).count() == 0


def test_all_words_of_a_long_clause_are_features():
    head, tail = " ".join(f"word{i}x" for i in range(80)), " harbours and cities"
    refused, answered = (P.features([head + middle + tail], "", "")[0] for middle in (" i cannot comply with", " they often traded with"))
    assert {P._h("w=cannot"), P._h("b=cannot comply")} <= set(refused) and refused != answered
