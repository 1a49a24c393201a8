"""Content-defined cutting of oversized texts at natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import textvec as tv

#: Code points a landmark's rolling hash looks back over.
WINDOW = 32


def rolling_hash(cps: np.ndarray) -> np.ndarray:
    """A hash of the last WINDOW code points up to each position, by doubling."""
    h = tv.mix(cps.astype(np.uint64) + np.uint64(0x51))
    span = 1
    while span < WINDOW:
        nxt = h.copy()
        nxt[span:] += h[:-span] * np.uint64(pow(0x2545F4914F6CDD1D, span, 1 << 64))
        h, span = nxt, 2 * span
    return h


def _boundaries(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (cut before them) at ends of sentences or lines, and at ends of words."""
    space = (cps == 32) | ((cps >= 9) & (cps <= 13)) | (cps == 0xA0) | (cps == 0x3000) | (cps == 0x2028) | (cps == 0x2029)
    newline = (cps == 10) | (cps == 13) | (cps == 0x2028) | (cps == 0x2029)
    wide_end = np.isin(cps, (0x3002, 0xFF01, 0xFF1F, 0xFF61))
    end = np.isin(cps, (0x2E, 0x21, 0x3F, 0x2026)) | wide_end
    close = np.isin(cps, (0x22, 0x27, 0x29, 0x5D, 0x201D, 0x2019, 0x300D, 0x300F, 0xFF09))
    n = len(cps)
    space_next = np.zeros(n, dtype=bool)
    space_next[:-1] = space[1:]
    close_next = np.zeros(n, dtype=bool)
    close_next[:-1] = close[1:]
    before = np.zeros(n, dtype=bool)
    before[1:] = end[:-1]
    # Where blanks were lost, a capital after a full stop begins a sentence.
    capital_next = np.zeros(n, dtype=bool)
    capital_next[:-1] = (cps[1:] >= 0x41) & (cps[1:] <= 0x5A)
    capital_before = np.zeros(n, dtype=bool)
    capital_before[1:] = (cps[:-1] >= 0x41) & (cps[:-1] <= 0x5A)
    sentence = (end & space_next) | (close & before & space_next) | (wide_end & ~close_next) | newline | (end & capital_next & ~capital_before)
    return np.flatnonzero(sentence) + 1, np.flatnonzero(space) + 1


def cut_points(
    cps: np.ndarray, landmarks: np.ndarray, sentences: np.ndarray, words: np.ndarray, start: int, end: int, least: int, most: int
) -> list[int]:
    """Where to end the pieces of cps[start:end], each of least..most code points.

    The first landmark at least `least` after the last cut snaps to the nearest end
    of a sentence or line inside the allowed range, else to the nearest end of a
    word, else it is the cut. Without a landmark the range's far end takes its place.
    """
    cuts, at = [], start
    while end - at > most:
        lo, hi = at + least, at + most
        k = np.searchsorted(landmarks, lo)
        mark = int(landmarks[k]) if k < len(landmarks) and landmarks[k] <= hi else hi
        cut = mark
        for marks in (sentences, words):
            a, b = np.searchsorted(marks, lo), np.searchsorted(marks, hi, side="right")
            if a < b:
                inside = marks[a:b]
                j = int(np.searchsorted(inside, mark))
                near = [int(x) for x in inside[max(0, j - 1) : j + 1]]
                cut = min(near, key=lambda x: (abs(x - mark), x))
                break
        cuts.append(cut)
        at = cut
    return cuts


def _piece_batches(key_names: Sequence[str], limit: int, overlap: int, least: int, mask_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.slices(batches, "text"):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            cps, at = tv.codepoints(pa.array(texts, type=pa.string()))
            marks = np.flatnonzero((rolling_hash(cps) & np.uint64((1 << mask_bits) - 1)) == 0) + 1
            sentences, words = _boundaries(cps)
            rows, number, total, starts, pieces = [], [], [], [], []
            for i, text in enumerate(texts):
                s, e = int(at[i]), int(at[i + 1])
                ends = [c - s for c in cut_points(cps, marks, sentences, words, s, e, least, limit - overlap)] if e - s > limit else []
                begins = [0, *(c - overlap for c in ends)]
                ends.append(e - s)
                rows += [i] * len(ends)
                number += range(len(ends))
                total += [len(ends)] * len(ends)
                starts += begins
                pieces += [text[a:b] for a, b in zip(begins, ends)]
            take = pa.array(rows, type=pa.int64())
            columns = [batch.column(batch.schema.get_field_index(k)).take(take) for k in key_names]
            columns += [pa.array(number, pa.int32()), pa.array(total, pa.int32()), pa.array(starts, pa.int64()), pa.array(pieces, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*key_names, "piece_no", "n_pieces", "start", "piece"])

    return run


def oversized_pieces(
    df: DataFrame, keys: Sequence[str], fields: Sequence[str], limit: int = 4000, overlap: int = 200, least: int = 1000, mask_bits: int = 10
) -> DataFrame:
    """(keys, field, piece_no, n_pieces, start, piece) of every field value over `limit` code points.

    Every piece has at most `limit` code points; piece k + 1 begins exactly `overlap`
    before the end of piece k, so dropping the first `overlap` of all but the first
    gives the text back. Cuts depend only on nearby text (see cut_points): an edit
    alters the pieces beside it. Texts are cut as stored; null, empty and shorter
    values give no rows; repeated rows are cut once each. Other columns of df are
    ignored. The length filter runs in the JVM, so only oversized values reach Python.
    """
    if not 0 <= overlap < limit - least or least <= WINDOW:
        raise ValueError("need WINDOW < least and 0 <= overlap < limit - least")
    named = [F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields]
    over = [F.when(F.char_length(F.col(f)) > limit, s) for f, s in zip(fields, named)]
    items = df.select(*keys, F.explode(F.array_compact(F.array(*over))).alias("i")).select(*keys, "i.field", "i.text")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "field string, piece_no int, n_pieces int, start bigint, piece string"])
    return items.mapInArrow(_piece_batches([*keys, "field"], limit, overlap, least, mask_bits), schema)
