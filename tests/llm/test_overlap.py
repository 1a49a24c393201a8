import random

import numpy as np
import pytest

from quillwork.llm import overlap
from quillwork.llm.overlap import cross_split_overlaps

SCHEMA = "id bigint, is_eval boolean, text string, title string, hash_key string, split string"


def brute(rows):
    def grams(t):
        w = (t or "").lower().split()
        return frozenset(zip(w, w[1:], w[2:])), len(w)

    out = set()
    for a in rows:
        for b in rows:
            if a[1] is True and b[1] is False and None not in (a[0], b[0]) and a[0] != b[0]:
                (x, nx), (y, ny) = grams(a[2]), grams(b[2])
                title = lambda r: "".join(c for c in (r[3] or "").lower() if c.isalnum())
                if (a[4] and a[4] == b[4]) or (nx >= 20 <= ny and len(x & y) >= 0.5 * len(x | y)) or (min(nx, ny) < 20 and title(a) and title(a) == title(b)):
                    out.add((a[0], b[0]))
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(1, 160):
        if i % 4 and rows:
            t = (rows[rng.randrange(len(rows))][2] or "").split()
            for _ in range(rng.randrange(0, 8)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(words)
        else:
            t = [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        rows.append((i, rng.random() < 0.3, " ".join(t) or None, rng.choice([None, "", "Erratum", "An Erratum!", f"T {i // 3}"]), rng.choice([None, None, f"h{i // 5}"]), "x"))
    rows += [(500, None, "a " * 30, "Erratum", "h1", "x"), (None, True, "a " * 30, "Erratum", "h1", "x"), rows[0]]
    got = cross_split_overlaps(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.eval_id, r.train_id) for r in got} == brute(rows) and len(got) == len(brute(rows)) > 20


def test_empty(spark):
    assert cross_split_overlaps(spark.createDataFrame([], SCHEMA)).count() == 0


def phrased(seed, n):
    """Texts of sentences over few words, so unrelated ones share many grams, and altered copies of some of them."""
    rng = random.Random(seed)
    kinds = [[f"{k}{i}" for i in range(m)] for k, m in (("d", 4), ("a", 9), ("n", 12), ("v", 9))]
    texts = []
    for i in range(n):
        if i % 5 == 4:
            t = list(rng.choice(texts))
            del t[: rng.randrange(0, len(t) // 3)]
            for _ in range(rng.randrange(0, 8)):
                t[rng.randrange(len(t))] = rng.choice(kinds[2])
        else:
            t = [rng.choice(k) for _ in range(rng.randrange(6, 20)) for k in (*kinds, *kinds[:3])]
        texts.append(t)
    return [(i, i % 4 == 1, " ".join(t), None, None, "x") for i, t in enumerate(texts)]


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7, 1.0])
def test_few_unrelated_pairs_are_written_and_none_is_lost(spark, monkeypatch, threshold):
    rows, met = phrased(5, 400), []
    write = overlap.materialize

    def counted(df, name):
        out = write(df, name)
        if name == "met":
            met.append(out.count())
        return out

    monkeypatch.setattr(overlap, "materialize", counted)
    grams = {r[0]: frozenset(zip(w := r[2].split(), w[1:], w[2:])) for r in rows}
    want = {
        (a[0], b[0]): len(x & y) / len(x | y)
        for a in rows if a[1] for b in rows if not b[1]
        for x, y in [(grams[a[0]], grams[b[0]])] if len(x & y) >= threshold * len(x | y)
    }
    got = cross_split_overlaps(spark.createDataFrame(rows, SCHEMA), threshold).collect()
    assert {(r.eval_id, r.train_id): r.similarity for r in got} == pytest.approx(want) and len(got) == len(want)
    assert threshold == 1 or len(want) > 10
    assert sum(met) <= 2 * len(want) + 20  # 30,000 pairs could be; most share some gram


def test_sketches_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(1)
    for n in (1, 40, 300):
        sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for _ in range(2)]
        sets[1] = np.unique(np.concatenate([sets[0][: n // 2], sets[1]]))
        a, b = overlap.odd_sketches(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
        assert sum(int(x).bit_count() for x in (a ^ b).view(np.uint64)) <= len(np.setxor1d(*sets))
