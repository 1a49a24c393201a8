"""Evaluation passages inside training texts: BM25 with block-max WAND, then alignment."""

from __future__ import annotations

import html
import pickle
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import textvec as tv
from ..operators.tables import materialize

K1 = 1.2
BLOCK = 32
#: Ranges of items for which a term's largest impact is kept.
RANGES = 40
#: Words of an index term.
WIDTH = 3
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_COMMENT = re.compile(r"<!--.*?-->", re.DOTALL)
_INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|a|sub|sup|mark|font|small)(?:\s[^<>]*)?>", re.IGNORECASE)


def without_comments(text: str) -> str:
    """The text without <!-- comments -->; one that isn't closed stays. Linear, as nothing is searched beyond the last end."""
    end = text.rfind("-->") + 3
    return _COMMENT.sub("", text[:end]) + text[end:] if end > 2 else text


def plain_text(text: str | None) -> str:
    """The text without markup and with character references resolved."""
    if not text:
        return ""
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", without_comments(text)))
    return html.unescape(text) if "&" in text else text


def _hashed(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    return tv.hashed_words(pa.array(texts, type=pa.string()))


class Index:
    """A BM25 inverted index of items (id, passage); terms are sequences of WIDTH words.

    Scores have no length norm, as passages are found in parts. An item's floor is the
    least score that a leaked stretch of its passage can have (see stretch_floor): every
    leak reaches it. Impacts are kept as shares of their item's floor, so that the
    threshold is 1 for every item.
    """

    def __init__(self, items: Sequence[tuple[int, str]], least: int = 16):
        self.least = least
        self.ids = [i for i, _ in items]
        words, at = _hashed([plain_text(p) for _, p in items])
        self.words = [words[a:b] for a, b in zip(at[:-1], at[1:])]
        terms, terms_at = tv.shingle_hashes(words, at, WIDTH)
        self.own_terms = [terms[a:b] for a, b in zip(terms_at[:-1], terms_at[1:])]
        owner = np.repeat(np.arange(len(items)), np.diff(terms_at))
        key, counts = np.unique(np.stack([terms, owner.astype(np.uint64)], axis=1), axis=0, return_counts=True)
        term, item = key[:, 0], key[:, 1].astype(np.int64)
        self.terms, first, df = np.unique(term, return_index=True, return_counts=True)
        idf = np.log(1 + (len(items) - df + 0.5) / (df + 0.5))
        impact = np.repeat(idf, df) * (counts * (K1 + 1) / (counts + K1))
        lookup = np.searchsorted(self.terms, terms)
        score = dict(zip(zip(term.tolist(), item.tolist()), impact.tolist()))
        flat = np.array([score[t, i] for t, i in zip(terms.tolist(), owner.tolist())])
        floor = stretch_floor(flat, lookup, terms_at, least)
        #: How many distinct terms of each item a leaked stretch has at least, and the least of these.
        self.needs = np.ceil(stretch_floor(np.ones(len(flat)), lookup, terms_at, least)).astype(int).tolist() if len(items) else []
        self.need = max(1, min((x for x in self.needs if x < 1 << 30), default=1))
        self.first, self.df, self.item = first, df, item
        self.impact = impact / floor[item]
        self.most = np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0)
        #: The largest impact of each term (rows) in each range of items (columns).
        ranges = max(1, min(RANGES, len(items)))
        self.range_most = np.zeros((len(self.terms), ranges))
        np.maximum.at(self.range_most, (np.repeat(np.arange(len(self.terms)), df), item * ranges // max(len(items), 1)), self.impact)
        self._lists: dict[int, tuple[list[int], list[float], list[float]]] = {}

    def postings(self, t: int) -> tuple[list[int], list[float], list[float]]:
        """Items, impacts and the largest impact of each block of a term's list."""
        if t not in self._lists:
            a, b = int(self.first[t]), int(self.first[t] + self.df[t])
            impacts = self.impact[a:b].tolist()
            self._lists[t] = (self.item[a:b].tolist(), impacts, [max(impacts[k : k + BLOCK]) for k in range(0, len(impacts), BLOCK)])
        return self._lists[t]

    def retrieve(self, terms: Sequence[int]) -> list[int]:
        """Block-max WAND: every item whose score for the distinct terms reaches its floor.

        Lists are walked in item order. The pivot is the first item at which the sum of
        the lists' largest impacts reaches the threshold and enough lists meet; where the blocks around the
        pivot can't reach it, the lists skip to the next block border, and only else is
        the item scored.
        """
        lists = []
        for t in terms:
            items, impacts, blocks = self.postings(t)
            lists.append([items[0], 0, items, impacts, blocks, float(self.most[t])])
        found = []
        lists.sort(key=_first)
        while lists:
            total, p = 0.0, -1
            for k, x in enumerate(lists):
                total += x[5]
                if total >= 1 and k + 1 >= self.need:
                    p = k
                    break
            if p < 0:
                break
            pivot = lists[p][0]
            while p + 1 < len(lists) and lists[p + 1][0] == pivot:
                p += 1
            bound, border = 0.0, lists[p + 1][0] if p + 1 < len(lists) else len(self.ids)
            for x in lists[: p + 1]:
                items, b = x[2], x[1] // BLOCK
                while (b + 1) * BLOCK <= len(items) - 1 and items[(b + 1) * BLOCK - 1] < pivot:
                    b += 1
                last = items[min((b + 1) * BLOCK, len(items)) - 1]
                if last >= pivot:
                    bound += x[4][b]
                    border = min(border, last + 1)
            if bound < 1:
                goal = max(border, pivot + 1)
            elif lists[0][0] == pivot:
                if p + 1 >= self.needs[pivot] and sum(x[3][x[1]] for x in lists[: p + 1]) >= 1:
                    found.append(pivot)
                goal = pivot + 1
            else:
                goal = pivot
            for x in lists[: p + 1]:
                if x[0] < goal:
                    x[1] = bisect_left(x[2], goal, x[1])
                    x[0] = x[2][x[1]] if x[1] < len(x[2]) else -1
            lists = sorted((x for x in lists if x[0] >= 0), key=_first)
        return found


def stretch_floor(scores: np.ndarray, terms: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """For each passage the least sum of scores of the terms that survive in a leaked stretch.

    A leak has a part of least .. 2 * least - 1 words with at most one edit in five, and an
    edit spoils the WIDTH terms it lies in. The least sum over all stretches and all places of
    the edits comes from dynamic programming over words, edits so far and words since the
    last edit, for all passages and starts at once. Of a term's repeats in one stretch's
    reach only the first counts, as a query has each term once.
    """
    longest, most = 2 * least - 1, (2 * least - 1) // 5
    n = len(at) - 1
    counts = np.diff(at)
    once = scores.copy()
    for i in range(n):
        seen: dict[int, int] = {}
        for k in range(int(at[i]), int(at[i + 1])):
            t = int(terms[k])
            if t in seen and k - seen[t] < longest:
                once[k] = 0.0
            else:
                seen[t] = k
    words = np.where(counts > 0, counts + WIDTH - 1, 0)
    starts = np.maximum(words - least + 1, 0)
    owner = np.repeat(np.arange(n), starts)
    begin = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts)
    floor = np.full(n, np.inf)
    # state[:, e, a]: least sum with e edits, the last one a words ago (WIDTH: that or more).
    state = np.full((len(owner), most + 1, WIDTH + 1), np.inf)
    state[:, 0, WIDTH] = 0.0
    for k in range(longest):
        moved = np.full_like(state, np.inf)
        moved[:, 1:, 0] = state[:, :-1].min(axis=2)
        moved[:, :, 1:] = state[:, :, :-1]
        moved[:, :, WIDTH] = np.minimum(moved[:, :, WIDTH], state[:, :, WIDTH])
        if k >= WIDTH - 1:  # a term ends with this word: it survives where no edit lies in it
            ends = at[owner] + begin + k - WIDTH + 1
            moved[:, :, WIDTH] += np.where(ends < at[owner + 1], once[np.minimum(ends, len(once) - 1)], np.inf)[:, None]
        state = moved
        if k + 1 >= least:
            live = begin + k + 1 <= words[owner]
            np.minimum.at(floor, owner[live], state[live][:, : (k + 1) // 5 + 1].min(axis=(1, 2)))
    return np.where(np.isfinite(floor), np.maximum(floor, 1e-6) - 1e-9, 1e18)


def _first(x: list) -> int:
    return x[0]


def _may_align(equal: np.ndarray, least: int) -> bool:
    """Whether some `least` passage words have enough equals in a band of diagonals of the text.

    Needed for any stretch of least .. 2 * least - 1 words with one edit in five: its edits
    move it by at most `most` diagonals, and one of its ends of `least` words misses at most
    `most - 1` of them (that many edits are in both ends only if these overlap by as many).
    """
    most = (2 * least - 1) // 5
    m, n = equal.shape
    if m < least:
        return False
    i, j = np.nonzero(equal)
    # near[i, d]: word i has an equal on one of the diagonals d - most .. d + most.
    near = np.zeros((m + 1, n + m + 2 * most), dtype=np.int16)
    for shift in range(2 * most + 1):
        near[i + 1, j - i + m - 1 + shift] = 1
    sums = np.cumsum(near, axis=0, dtype=np.int16)
    return bool((sums[least:] - sums[:-least]).max() >= least - most + 1)


def _on_diagonals(passage: np.ndarray, text: np.ndarray, need: int, least: int) -> bool:
    """Whether enough of the passage's terms stand on as few neighbouring diagonals of the text as a stretch with its edits keeps to."""
    most = (2 * least - 1) // 5
    i, j = np.nonzero(passage[:, None] == text[None, :])
    total = np.concatenate([[0], np.cumsum(np.bincount(j - i + len(passage), minlength=len(passage) + len(text) + 2 * most + 1))])
    return bool((total[2 * most + 1 :] - total[: -(2 * most + 1)]).max(initial=0) >= need)


def aligned(passage: np.ndarray, text: np.ndarray, least: int) -> tuple[int, int]:
    """(words, edits) of the longest stretch of the passage that stands in the text in order,
    with at most one edit (changed, dropped or added word) in five; (0, 0) if under `least` words.

    reach[i, j] at e edits is the most passage words of an alignment that ends with passage
    word i and text word j. A stretch that keeps to one edit in five has a part of least to
    2 * least - 1 words that does, so if none is found with (2 * least - 1) // 5 edits, there is none.
    """
    m = len(passage)
    equal = passage[:, None] == text[None, :]
    if not _may_align(equal, least):
        return 0, 0
    none = -(1 << 20)
    best = (0, 0)
    prev = None
    for e in range(m // 5 + 1):
        if 5 * e > 2 * least - 1 and not best[0]:
            break
        if prev is None:
            base = np.full((m, len(text)), none, dtype=np.int32)
        else:
            base = np.maximum(np.maximum(prev[:-1, :-1], prev[:-1, 1:]) + 1, prev[1:, :-1])
        cur = np.full((m + 1, len(text) + 1), none, dtype=np.int32)
        start = 0 if e == 0 else none
        for i in range(m):
            step = np.maximum(cur[i, :-1], start) + 1
            cur[i + 1, 1:] = np.maximum(base[i], np.where(equal[i], step, none))
        top = int(cur[1:, 1:][equal].max(initial=none))  # a stretch ends with a word that stands in the text
        if top >= least and 5 * e <= top and top > best[0]:
            best = (top, e)
        prev = cur
    return best


def scan(texts: Sequence[str], index: Index, span: int = 48, stride: int = 24, around: int = 48) -> list[list[tuple[int, int, int]]]:
    """For each text its leaked items (item number, words, edits).

    Windows of `span` words every `stride` words are the queries; span - stride is more
    than the least stretch with its edits, so some window holds all of it. A window whose
    terms can't reach the threshold in any range of items, even with their largest impacts there, asks nothing. Around
    the windows that retrieved an item, its passage is aligned with the text, if enough of its terms stand on neighbouring diagonals.
    """
    words, at = _hashed([plain_text(t) for t in texts])
    terms, terms_at = tv.shingle_hashes(words, at, WIDTH)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(index.terms) or not len(terms):
        return out
    place = np.searchsorted(index.terms, terms)
    place[place == len(index.terms)] = 0
    known = index.terms[place] == terms
    weight = np.concatenate([np.zeros((1, index.range_most.shape[1])), np.cumsum(index.range_most[place[known]], axis=0)])
    number_known = np.concatenate([[0], np.cumsum(known)])
    counts = np.diff(terms_at)
    # Window k of a text covers its terms k * stride .. k * stride + span - WIDTH.
    windows = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - (span - WIDTH + 1)) // stride)), 0)
    owner = np.repeat(np.arange(len(texts)), windows)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = terms_at[owner] + number * stride
    stops = np.minimum(starts + span - WIDTH + 1, terms_at[owner + 1])
    spots: dict[tuple[int, int], list[tuple[int, int]]] = {}
    enough = np.flatnonzero(number_known[stops] - number_known[starts] >= index.need)
    reach = (weight[number_known[stops[enough]]] - weight[number_known[starts[enough]]]).max(axis=1, initial=0.0)
    for k in enough[reach >= 1 - 1e-6]:
        i, s, e = int(owner[k]), int(starts[k]), int(stops[k])
        for item in index.retrieve(np.unique(place[s:e][known[s:e]]).tolist()):
            spots.setdefault((i, item), []).append((s - int(terms_at[i]), e - int(terms_at[i]) + WIDTH - 1))
    for (i, item), regions in sorted(spots.items()):
        n = int(at[i + 1] - at[i])
        merged: list[list[int]] = []
        for lo, hi in regions:
            lo, hi = max(0, lo - around), min(n, hi + around)
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = hi
            else:
                merged.append([lo, hi])
        near = [(lo, hi) for lo, hi in merged if _on_diagonals(index.own_terms[item], terms[terms_at[i] + lo : terms_at[i] + max(lo, hi - WIDTH + 1)], index.needs[item], index.least)]
        found = [aligned(index.words[item], words[at[i] + lo : at[i] + hi], index.least) for lo, hi in near]
        best = max(found, key=lambda x: (x[0], -x[1]), default=(0, 0))
        if best[0]:
            out[i].append((item, *best))
    return out


def _contains(words: np.ndarray, phrase: np.ndarray) -> bool:
    k = len(phrase)
    if not k or k > len(words):
        return False
    return bool(np.any(np.all(np.lib.stride_tricks.sliding_window_view(words, k) == phrase, axis=1)))


def leaked(docs: DataFrame, items: DataFrame, block: int = 5000, least: int = 16) -> DataFrame:
    """(doc_id, item_id, passage_words, words, edits, has_question, has_answer): every document
    that holds at least `least` words of an item's passage in order, with at most one in five
    changed, dropped or added; and whether it also holds the whole question and answer.

    docs: doc_id bigint, text. items: item_id bigint, passage, question, answer. Markup, character
    references, case, punctuation and white space are ignored. Documents never shuffle: the items
    are indexed in blocks of at most `block`, each of which scans all documents whole, so the
    index that the driver or a task holds is bounded however many items there are; with several blocks each one's result is written before the next is collected. Null texts and passages and
    passages under `least` words match nothing; items repeated under other ids are all reported;
    repeated documents are all reported.
    """
    rows = items.where("item_id is not null and passage is not null").select("item_id", "passage", "question", "answer").dropDuplicates(["item_id"])
    total = rows.count()
    shards = max(1, -(-total // block))
    numbered = rows.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards)))
    schema = "doc_id bigint, item_id bigint, passage_words int, words int, edits int, has_question boolean, has_answer boolean"
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    found = None
    for shard in range(shards):
        own = sorted(map(tuple, numbered.where(F.col("shard") == shard).drop("shard").collect()), key=lambda r: r[0])
        part = source.mapInArrow(_scanner(own, least), schema)
        if shards > 1:
            part = materialize(part, "leaks")
        found = part if found is None else found.union(part)
    return found


def _scanner(items: Sequence[tuple[int, str, str | None, str | None]], least: int):
    # Built once on the driver; a task unpacks it.
    packed = pickle.dumps((Index([(i, p) for i, p, _, _ in items], least), [_hashed([plain_text(q), plain_text(a)]) for _, _, q, a in items]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, extra = pickle.loads(packed)
        for batch in tv.slices(batches, "text", 2_000_000):
            ids = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            out: list[tuple] = []
            for doc, text, hits in zip(ids, texts, scan(texts, index)):
                if hits:
                    words = _hashed([plain_text(text)])[0]
                for item, n, e in hits:
                    own, at = extra[item]
                    out.append((doc, index.ids[item], len(index.words[item]), n, e, _contains(words, own[at[0] : at[1]]), _contains(words, own[at[1] : at[2]])))
            columns = list(zip(*out)) if out else [[] for _ in range(7)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "passage_words", "words", "edits", "has_question", "has_answer"]
            )

    return run
