import random

import numpy as np
import pytest

from quillwork.llm.neardup import BITS, NearDuplicates, band_hashes, minhash, odd_sketch, recall_at
from quillwork.operators.skew import bucket_pairs, grid_join


def shingles(t, n):
    w = t.lower().split()
    return frozenset(zip(*[w[i:] for i in range(n)]))


def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(900)]
    rows, i = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(40, 160))]
        for edits in (0, 0, 2, 5):
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(len(t))] = rng.choice(words)
            i += 1
            rows.append(("a" if i % 7 else "b", i, " ".join(t), "x"))
    return rows


def brute(rows, t, n):
    out = set()
    sets = [(k, i, shingles(x, n)) for k, i, x, _ in rows if x]
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            (ka, ia, sa), (kb, ib, sb) = sets[a], sets[b]
            if ka == kb and sa and sb and len(sa & sb) >= t * len(sa | sb):
                out.add((ka, min(ia, ib), max(ia, ib)))
    return out


@pytest.fixture(scope="module")
def found(spark):
    rows = corpus() + [("a", 900, None, "x"), ("a", 901, "", "x"), ("a", 902, "two words", "x"), corpus()[0]]
    df = spark.createDataFrame(rows, "kind string, id bigint, text string, rep string")
    return rows, NearDuplicates(df, threshold=0.7, width=3)


def test_pairs_match_brute_force(found):
    rows, n = found
    assert {tuple(r) for r in n.pairs().collect()} == brute(rows[:-1], 0.7, 3)


def test_groups(found):
    rows, n = found
    groups = {(r.kind, r.id): r for r in n.groups().collect()}
    assert len(groups) == 100
    for kind, a, b in brute(rows[:-1], 0.7, 3):
        assert groups[kind, a].group_id == groups[kind, b].group_id <= a
    assert all(r.class_id <= r.id and r.group_id <= r.class_id for r in groups.values())


def test_empty(spark):
    df = spark.createDataFrame([], "kind string, id bigint, text string")
    n = NearDuplicates(df)
    assert n.pairs().count() == 0 and n.groups().count() == 0


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.7, 0.9):
        common = rng.integers(0, 1 << 63, int(400 * share)).astype(np.uint64)
        rest = (400 - len(common)) // 2
        a = np.concatenate([common, rng.integers(0, 1 << 63, rest).astype(np.uint64)])
        b = np.concatenate([common, rng.integers(0, 1 << 63, rest).astype(np.uint64)])
        m = minhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 256)
        s = odd_sketch(m).view(np.uint64)
        z = sum(int(x).bit_count() for x in (s[0] ^ s[1]).tolist())
        estimate = 1 + BITS / (4 * 256) * np.log(1 - 2 * z / BITS)
        assert abs(estimate - len(common) / (len(common) + 2 * rest)) < 0.15
    assert band_hashes(m, 4).shape == (2, 64)
    assert recall_at(0.8) > 0.9999 and recall_at(0.55) > 0.99


def test_hot_groups_are_joined_whole(spark, monkeypatch):
    from quillwork.operators import skew as pairing

    monkeypatch.setattr(pairing, "BLOCK", 7)
    left = spark.createDataFrame([(1, i) for i in range(40)] + [(2, 100), (None, 5)], "k int, x bigint")
    right = spark.createDataFrame([(1, i) for i in range(25)] + [(2, 7), (3, 1)], "k int, y bigint")
    got = sorted((r.k, r.x, r.y) for r in grid_join(left, right, ["k"], "x", "y").collect())
    assert got == sorted((r.k, r.x, r.y) for r in left.join(right, "k").collect())
    pairs = [(r.a, r.b) for r in bucket_pairs(left, ["k"], "x").collect()]
    assert sorted(pairs) == [(a, b) for a in range(40) for b in range(a + 1, 40)]
