import re
import unicodedata

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillwork.functions import textvec as tv

texts = st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=8)


def brute_words(t):
    folded = unicodedata.normalize("NFKC", t or "").lower()
    out, run = [], ""
    for c in folded:
        if c.isalnum():
            run += c
        elif run:
            out.append(run)
            run = ""
    return [*out, run] if run else out


@settings(max_examples=150, deadline=None)
@given(texts)
def test_words_match_one_by_one(batch):
    h, at = tv.hashed_words(pa.array(batch, pa.string()))
    seen = {}
    for i, t in enumerate(batch):
        own = brute_words(t)
        assert at[i + 1] - at[i] == len(own)
        for word, value in zip(own, h[at[i] : at[i + 1]].tolist()):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=80, deadline=None)
@given(texts)
def test_a_text_does_not_depend_on_its_batch(batch):
    h, at = tv.hashed_words(pa.array(batch, pa.string()))
    s, sa = tv.distinct_sorted(*tv.shingle_hashes(h, at, 3))
    sets = tv.set_hash(s, sa)
    for i, t in enumerate(batch):
        h1, at1 = tv.hashed_words(pa.array([t], pa.string()))
        s1, sa1 = tv.distinct_sorted(*tv.shingle_hashes(h1, at1, 3))
        assert s1.tolist() == s[sa[i] : sa[i + 1]].tolist()
        assert tv.set_hash(s1, sa1)[0] == sets[i]


def test_shingles_count():
    h, at = tv.hashed_words(pa.array(["a b c a b c", "a b", "", None]))
    s, sa = tv.distinct_sorted(*tv.shingle_hashes(h, at, 3))
    assert np.diff(sa).tolist() == [3, 0, 0, 0]


def test_slices_keep_every_row_and_whole_texts():
    rows = ["x" * n for n in (0, 10, 5000, 3, 0)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(rows)], names=["i", "text"])
    parts = list(tv.slices(iter([batch]), "text", 100))
    assert [x for p in parts for x in p.column(1).to_pylist()] == rows
    assert len(parts) > 1
    assert re.fullmatch("x+", parts[1].column(1).to_pylist()[0])


def test_composed_and_decomposed_letters_are_one():
    h, at = tv.hashed_words(pa.array(["Été 각 ｶﾞ", "E\u0301te\u0301 \u1100\u1161\u11a8 ガ"]))
    assert at.tolist() == [0, 3, 6] and h[:3].tolist() == h[3:].tolist()
