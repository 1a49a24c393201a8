import random

import numpy as np
import pytest

from quillwork.llm import leakage as G


def words(rng, n):
    return [f"w{rng.randrange(120)}" for _ in range(n)]


def brute(passage, text, least=16):
    """Longest stretch by a plain dynamic programme over (edits, passage word, text word)."""
    m, n = len(passage), len(text)
    none, best = -(10**6), 0
    prev = None
    for e in range(m // 5 + 1):
        cur = [[none] * (n + 1) for _ in range(m + 1)]
        for i in range(1, m + 1):
            for j in range(1, n + 1):
                v = none
                if passage[i - 1] == text[j - 1]:
                    v = max(cur[i - 1][j - 1], 0 if e == 0 else none) + 1
                if prev is not None:
                    v = max(v, prev[i - 1][j - 1] + 1, prev[i - 1][j] + 1, prev[i][j - 1])
                cur[i][j] = v
                if v >= least and 5 * e <= v and passage[i - 1] == text[j - 1]:
                    best = max(best, v)
        prev = cur
    return best


def spoil(rng, stretch, edits):
    out = list(stretch)
    for p in sorted(rng.sample(range(1, len(out) - 1), edits), reverse=True):
        kind = rng.randrange(3)
        if kind == 0:
            out[p] = "changed"
        elif kind == 1:
            del out[p]
        else:
            out.insert(p, "added")
    return out


def test_alignment_matches_brute_force():
    rng = random.Random(7)
    for _ in range(40):
        p = words(rng, rng.randrange(16, 40))
        a = rng.randrange(0, len(p) - 12)
        s = p[a : a + rng.randrange(12, len(p) - a + 1)]
        t = words(rng, 10) + spoil(rng, s, min(rng.randrange(0, 8), len(s) - 2)) + words(rng, 10)
        code = {w: i for i, w in enumerate({*p, *t})}
        got = G.aligned(np.array([code[w] for w in p]), np.array([code[w] for w in t]), 16)[0]
        assert got == brute(p, t)


@pytest.fixture(scope="module")
def items():
    rng = random.Random(9)
    common = ["by", "a", "margin", "of", "over", "time", "the"]
    out = []
    for i in range(40):
        p = [w for _ in range(12) for w in (*words(rng, 2), *(common[:4] if rng.random() < 0.3 else [rng.choice(common)]))]
        out.append((i, " ".join(p)))
    return out


def test_every_leak_is_found(items):
    """Recall of index, windows and alignment together against aligning every document with every item."""
    rng = random.Random(4)
    index = G.Index(items)
    docs = []
    for _ in range(60):
        parts = words(rng, rng.randrange(0, 150))
        if rng.random() < 0.8:
            p = items[rng.randrange(40)][1].split()
            n = rng.randrange(16, min(len(p), 40))
            a = rng.randrange(0, len(p) - n + 1)
            parts += spoil(rng, p[a : a + n], rng.randrange(0, n // 5 + 1))
        docs.append(" ".join(parts + words(rng, rng.randrange(0, 150))))
    got = {(d, i) for d, hits in enumerate(G.scan(docs, index)) for i, _, _ in hits}
    code = {w: n for n, w in enumerate({w for t in (*docs, *(p for _, p in items)) for w in t.split()})}
    coded = lambda t: np.array([code[w] for w in t.split()])
    truth = {(d, i) for d, t in enumerate(docs) for i, p in items if G.aligned(coded(p), coded(t), 16)[0]}
    assert got <= truth and len(truth) > 35
    assert len(got) >= 0.98 * len(truth)


def test_wand_equals_full_scoring(items):
    index = G.Index(items)
    rng = random.Random(2)
    for _ in range(60):
        terms = sorted({rng.randrange(len(index.terms)) for _ in range(30)} | set(np.searchsorted(index.terms, [])))
        own = rng.randrange(40)
        terms = sorted({*terms, *[k for k in range(len(index.terms)) if own in index.postings(k)[0]][: rng.randrange(3, 40)]})
        total, count = {}, {}
        for t in terms:
            for i, s in zip(*index.postings(t)[:2]):
                total[i] = total.get(i, 0) + s
                count[i] = count.get(i, 0) + 1
        assert sorted(index.retrieve(terms)) == sorted(i for i in total if total[i] >= 1 and count[i] >= index.needs[i])


def test_table(spark, items):
    text = "<p>" + items[3][1].replace(" ", "&#44; ", 3).upper() + "</p>"
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "word " * 5000 + items[5][1], "x"), (1, text, "x"), (None, text, "x")], "doc_id bigint, text string, item_id string")
    rows = [(i, p, "Which one?", None) for i, p in items] + [(90, None, None, None), (91, "too short", None, None), (92, "", "q", "a")]
    table = spark.createDataFrame(rows, "item_id bigint, passage string, question string, answer string")
    for block in (20, 5000):
        got = sorted((r.doc_id, r.item_id, r.edits) for r in G.leaked(docs, table, block=block).collect())
        assert got == [(1, 3, 0), (1, 3, 0), (4, 5, 0)]
    assert G.leaked(docs.limit(0), table).count() == 0 and G.leaked(docs, table.limit(0)).count() == 0


def test_long_tags_and_comments_are_markup():
    link = f'<a href="https://x.example/{"w " * 300}">'
    style = f'<p style="{"m " * 300}">'
    assert G.plain_text(f"one {link}two</a> th<!-- <b> {'n ' * 300} -->ree{style}four <!-- open").split() == ["one", "two", "three", "four", "<!--", "open"]
    assert G.plain_text("<!--> a <b -->") == "" and G.plain_text("a --> b < c") == "a --> b < c"
    assert len(G.plain_text("<!-- <a " * 100_000)) == 800_000
