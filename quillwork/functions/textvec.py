"""Word and shingle kernels over Arrow string columns.

A batch of texts is handled as one array of code points, so that the cost per
character is a few vector operations and no Python object is made per word.
Every function works on whole texts; batches are cut by size, never texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
#: Odd multipliers of the polynomial word hash and of the shingle hash.
_WORD_BASE = _U(0x9E3779B97F4A7C15)
_SHINGLE_BASE = _U(0xD6E8FEB86659FD93)

_alnum: np.ndarray | None = None
_powers = np.ones(1, dtype=np.uint64)


def alnum_table() -> np.ndarray:
    """For each code point, whether it is a letter or a digit."""
    global _alnum
    if _alnum is None:
        table = np.zeros(0x110000, dtype=bool)
        for cp in range(0x110000):
            if chr(cp).isalnum():
                table[cp] = True
        _alnum = table
    return _alnum


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _word_powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        out = np.empty(max(n, 2 * len(_powers)), dtype=np.uint64)
        out[0] = 1
        out[1:] = _WORD_BASE
        _powers = np.multiply.accumulate(out)
    return _powers


def fold(texts: pa.Array) -> pa.Array:
    """NFKC form in lower case; null becomes the empty text. (Arrow's own normalization leaves letters and their marks apart.)"""
    return pa.array([unicodedata.normalize("NFKC", t).lower() if t else "" for t in texts.to_pylist()], pa.string())


def codepoints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts, and where each text starts (n + 1 offsets)."""
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), out=offsets[1:])
    cps = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return cps, offsets


def word_spans(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each run of letters and digits, and the
    number of words before each text (n + 1 offsets)."""
    is_word = alnum_table()[cps]
    before = np.empty_like(is_word)
    before[:1] = False
    before[1:] = is_word[:-1]
    inner = offsets[:-1]
    before[inner[inner < len(cps)]] = False
    after = np.empty_like(is_word)
    after[-1:] = False
    after[:-1] = is_word[1:]
    ends_at = offsets[1:] - 1
    after[ends_at[ends_at >= 0]] = False
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of cps[start:end] for disjoint ascending spans."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    first = np.zeros(len(starts), dtype=np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    within = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    chars = cps[np.repeat(starts, lengths) + within].astype(np.uint64) + _U(1)
    chars *= _word_powers(int(lengths.max()))[within]
    return mix(np.add.reduceat(chars, first))


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of each text, and the texts' word offsets."""
    cps, offsets = codepoints(fold(texts))
    starts, ends, words_at = word_spans(cps, offsets)
    return hash_spans(cps, starts, ends), words_at


def shingle_hashes(words: np.ndarray, words_at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each sequence of `width` words inside one text, in text order,
    and the texts' offsets into them. A text of fewer words has none."""
    counts = np.maximum(np.diff(words_at) - width + 1, 0)
    at = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=at[1:])
    index = np.arange(at[-1], dtype=np.int64) - np.repeat(at[:-1] - words_at[:-1], counts)
    out = np.zeros(len(index), dtype=np.uint64)
    for k in range(width):
        out = out * _SHINGLE_BASE + words[index + k]
    return mix(out), at


def distinct_sorted(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text in ascending order, and new offsets."""
    owner = np.repeat(np.arange(len(at) - 1, dtype=np.int64), np.diff(at))
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    v, o = v[keep], o[keep]
    return v, np.searchsorted(o, np.arange(len(at)))


def set_hash(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each text's set of distinct values."""
    total = np.zeros(len(at) - 1, dtype=np.uint64)
    some = np.flatnonzero(np.diff(at) > 0)
    if len(some):
        total[some] = np.add.reduceat(mix(values ^ _U(0xA0761D6478BD642F)), at[some])
    return mix(total + np.diff(at).astype(np.uint64))


def slices(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about max_bytes of column `text` at
    most (one row at least), which bounds a worker's memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + max_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


def list_column(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array over values, without copying them row by row."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, type=kind))
