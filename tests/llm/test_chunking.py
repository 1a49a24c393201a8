import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillwork.llm.chunking import _boundaries, cut_points, oversized_pieces, rolling_hash

import numpy as np


def prose(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    out = []
    while sum(map(len, out)) < n:
        out.append(" ".join(rng.choice(words) for _ in range(rng.randrange(4, 14))).capitalize() + ". ")
    return "".join(out)


def pieces(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id bigint, body string, piece string")
    found = {}
    for r in oversized_pieces(df, ["id"], ["body"], **kw).collect():
        found.setdefault(r.id, []).append(r)
    return {k: sorted(v, key=lambda r: r.piece_no) for k, v in found.items()}


def test_pieces_give_the_text_back(spark):
    texts = {1: prose(1, 15000), 2: "x" * 9000, 3: "단어 " * 4000, 4: "漢字。" * 3000, 5: "short", 6: "", 7: None, 8: "y" * 4000, 9: "z" * 4001}
    found = pieces(spark, [(k, v, "clash") for k, v in texts.items()])
    assert set(found) == {1, 2, 3, 4, 9}
    for k, rows in found.items():
        assert all(len(r.piece) <= 4000 and r.n_pieces == len(rows) > 1 for r in rows)
        assert rows[0].piece + "".join(r.piece[200:] for r in rows[1:]) == texts[k]
        assert all(texts[k][r.start : r.start + len(r.piece)] == r.piece for r in rows)
    assert all(r.piece.rstrip().endswith(".") for r in found[1])
    assert all(r.piece.endswith("。") for r in found[4][:-1])


def test_an_edit_alters_only_pieces_beside_it(spark):
    text = prose(5, 60000)
    edited = text[:20000] + " inserted words here " + text[20000:]
    a, b = (pieces(spark, [(1, t, "")])[1] for t in (text, edited))
    kept = {r.piece for r in a} & {r.piece for r in b}
    assert len(kept) >= len(a) - 3


def test_empty_table_and_bad_parameters(spark):
    assert pieces(spark, []) == {}
    with pytest.raises(ValueError):
        pieces(spark, [(1, "a", "")], limit=1000, overlap=900, least=200)


@settings(max_examples=60, deadline=None)
@given(st.text(min_size=0, max_size=3000), st.integers(40, 200), st.integers(10, 300))
def test_cuts_stay_in_range(text, least, more):
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    marks = np.flatnonzero((rolling_hash(cps) & np.uint64(63)) == 0) + 1
    cuts = [0, *cut_points(cps, marks, *_boundaries(cps), 0, len(cps), least, least + more), len(cps)]
    assert all(b - a <= least + more for a, b in zip(cuts, cuts[1:]))
    assert all(b - a >= least for a, b in zip(cuts[:-2], cuts[1:-1]))
