import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillwork.llm import packing as K


def check(items, capacity, bins):
    assert sorted(i for b in bins for i in b) == list(range(len(items)))
    assert all(sum(items[i] for i in b) <= capacity for b in bins)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=14), st.integers(20, 30))
def test_packs_all_and_no_worse_than_best_fit(items, capacity):
    bins = K.pack(items, capacity)
    check(items, capacity, bins)
    assert K.lower_bound(items, capacity) <= len(bins) <= len(K.best_fit(items, capacity))


def optimum(items, capacity):
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for i, r in enumerate(rooms):
            if r >= items[k] and r not in rooms[:i]:
                go(k + 1, [*rooms[:i], r - items[k], *rooms[i + 1 :]])
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best[0]


def test_finds_the_optimum_of_small_sets():
    rng = random.Random(5)
    worse = 0
    for _ in range(60):
        items = [rng.randrange(15, 60) for _ in range(rng.randrange(3, 11))]
        bins = K.pack(items, 100, K.EXACT)
        check(items, 100, bins)
        worse += len(bins) > optimum(items, 100)
        assert K.lower_bound(items, 100) <= len(bins)
    assert worse == 0
    # Best fit needs four containers here, three are enough.
    items = [60, 50, 30, 20, 40, 50, 30, 20]
    assert len(K.pack(items, 100)) == optimum(items, 100) == 3


def test_bound_sees_items_that_nothing_fits_beside():
    # The sum says 2 containers and only one item is over half, but no two of these fit together with a third.
    assert K.lower_bound([40, 40, 40, 40, 40], 100) == 2 and K.lower_bound([70, 70, 35, 35], 100) == 3 and K.lower_bound([], 5) == 0
    rng = random.Random(1)
    items = [rng.randrange(20, 2047) for _ in range(4000)]
    assert K.lower_bound(items, 2048) == len(K.best_fit(items, 2048)) or K.lower_bound(items, 2048) > -(-sum(items) // 2048)


def test_completions_are_undominated():
    sizes, counts = [50, 30, 20, 10], [1, 2, 1, 1]
    for waste, filling in K.completions(75, sizes, counts, 0, 75, 100, 10000):
        used = dict(filling)
        assert waste == 75 - sum(sizes[k] * n for k, n in filling)
        assert all(sizes[k] > waste for k in range(4) if counts[k] > used.get(k, 0))


def test_table(spark):
    rng = random.Random(3)
    rows = [(i, "word " * rng.randrange(1, 400), "x") for i in range(300)] + [(900, "word " * 3000, "x"), (901, None, "x"), (902, "", "x"), (None, "a b", "x"), (5, None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, container_id string")
    got = K.packed(df, capacity=1000, block=100).collect()
    fill, per = {}, {}
    for r in got:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        per.setdefault(r.doc_id, []).append(r)
    assert set(per) == {*range(300), 900} and max(fill.values()) <= 1000
    assert all(len(v) == 1 for k, v in per.items() if k != 900)
    pieces = sorted(per[900], key=lambda r: r.piece_no)
    assert [r.start for r in pieces] == [1000 * i for i in range(len(pieces))] and [r.n_tokens for r in pieces][:-1] == [1000] * (len(pieces) - 1)
    assert len(fill) <= 1.03 * -(-sum(fill.values()) // 1000) + 1
    assert {r.container_id for r in got if r.n_tokens == 1000} == {f"full.{r.doc_id}.{r.piece_no}" for r in got if r.n_tokens == 1000}
    assert K.packed(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        K.packed(df, capacity=0)
