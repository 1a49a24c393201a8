import random

import numpy as np

from quillwork.llm import subjects as S

NOUNS = {"a": ["guitars", "chorus lines", "드럼연주"], "b": ["court rulings", "statutes", "재판소"], "c": ["goalkeepers", "ski slopes", "경기장"]}


def document(rng, subjects, n=10):
    out = []
    for k in range(n):
        if rng.random() < 0.2:
            noun = rng.choice(["fans", "posts", "visitors"])
        else:
            noun = rng.choice(NOUNS[subjects[k % len(subjects)]])
        out.append(f"{rng.choice(['Over time', 'Later', 'By contrast'])}, some {rng.choice(['old', 'new', 'quiet'])} {noun} {rng.choice(['changed', 'met'])} many fans.")
    return " ".join(out)


def rows(seed, n, noise=0.05, unlabelled=0.0):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        s = rng.sample("abc", rng.choice([1, 1, 2]))
        label = [rng.choice("abc")] if rng.random() < noise else sorted(s)
        out.append((document(rng, s), f"s{rng.randrange(5)}", "news", None if rng.random() < unlabelled else label, sorted(s)))
    return out


def accuracy(model, test):
    terms = S.sentence_terms([r[0] for r in test])
    x, won = S.document_features(terms, model.evidence, [r[1] for r in test], [r[2] for r in test])
    y, p = model.chain.decode(x, won >= S.LEAST_SHARE)
    assert ((p > 0) & (p <= 1)).all()
    return np.mean([[s for c, s in enumerate(model.subjects) if y[i, c]] == r[4] for i, r in enumerate(test)])


def test_held_out_accuracy():
    model = S.fit([r[:4] for r in rows(1, 500)], ["a", "b", "c"])
    assert accuracy(model, rows(2, 200, 0)) > 0.93


def test_few_labels():
    model = S.fit([r[:4] for r in rows(3, 600, unlabelled=0.7)], ["a", "b", "c"])
    assert accuracy(model, rows(4, 200, 0)) > 0.85


def test_beam_search_with_all_beams_is_exact():
    import itertools

    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 8))
    y = (x[:, :3] + rng.normal(size=(80, 3)) > 0.3).astype(float)
    chain = S.train_chain(x, y)
    got, p = chain.decode(x, np.ones((80, 3), bool), beams=8)
    for i in range(80):
        best = max(itertools.product((0.0, 1.0), repeat=3), key=lambda b: prob(chain, x[i], b))
        assert got[i, chain.order].tolist() == list(best) and abs(prob(chain, x[i], best) - p[i]) < 1e-6


def prob(chain, x, labels):
    out = 1.0
    for k, v in enumerate(labels):
        q = chain._probability(k, x[None], np.array([labels[:k]]).reshape(1, k))[0]
        out *= q if v else 1 - q
    return out


def test_sentences():
    t = S.sentence_terms(["One two three. Four five six seven!\nHeading\n<p>Eight nine ten.</p>", None, "", "漢字漢字。漢字漢字漢字。"])
    assert np.diff(t.docs).tolist() == [3, 0, 0, 2]


def test_table(spark):
    data = rows(5, 200)
    docs = spark.createDataFrame([(i, r[0], r[1], r[2], "clash") for i, r in enumerate(data)] + [(900, None, None, None, ""), (901, "", None, None, "")], "doc_id bigint, text string, source string, doc_type string, subjects string")
    labels = spark.createDataFrame([(i, s) for i, r in enumerate(data) for s in r[3]] + [(0, data[0][3][0]), (1, None), (1, "unknown"), (None, "a")], "doc_id bigint, subject string")
    got = S.training_rows(docs, labels, ["a", "b", "c"], most=50)
    assert 0 < len(got) <= 50
    model = S.fit(S.training_rows(docs, labels, ["a", "b", "c"], most=400), ["a", "b", "c"])
    out = {r.doc_id: r for r in S.document_subjects(docs, model).collect()}
    assert len(out) == 202 and out[900].subjects == [] and out[901].subjects == []
    assert np.mean([[x.subject for x in out[i].subjects] == r[4] for i, r in enumerate(data)]) > 0.85
    assert S.document_subjects(docs.limit(0), model).count() == 0


def test_long_tags_and_comments_are_markup():
    style = f'<p style="{"m " * 300}">'
    assert S._plain(f"One.{style}Two <a href='{'w ' * 300}'>three</a><!-- {'n ' * 300} -->.") == "One.\nTwo three."
