"""Filling containers of fixed capacity with documents: bin completion in blocks."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import textvec as tv
from ..functions import tokens as tk
from ..operators.tables import materialize

def token_counts(texts: Sequence[str | None], encoding) -> list[int]:
    return [len(x) for x in encoding.encode_ordinary_batch([t or "" for t in texts], num_threads=1)]


def document_tokens(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every row's whole text; 0 for null and empty texts."""
    vocabulary = tk.vocabulary(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tk.encoding(vocabulary)
        for batch in tv.slices(batches, "text"):
            counts = token_counts(batch.column(1).to_pylist(), encoding)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")


def lower_bound(sizes: Sequence[int], capacity: int) -> int:
    """No packing has fewer containers. For each least size that is looked at, items over the capacity less that size are alone, those over half of it are
    in containers of their own, and the smaller ones must fit into what these leave or need more; the largest of these counts (Martello and Toth's second bound)."""
    if not sizes:
        return 0
    v = np.sort(np.asarray(sizes, dtype=np.int64))
    total = np.concatenate([[0], np.cumsum(v)])
    half = np.searchsorted(v, capacity // 2, side="right")  # items from here on are over half
    least = np.unique(np.concatenate([[0], v[:half]]))
    alone = np.searchsorted(v, capacity - least, side="right")
    small = np.searchsorted(v, least, side="left")
    left = (np.maximum(alone, half) - half) * capacity - (total[np.maximum(alone, half)] - total[half])
    more = np.maximum(0, -(-(total[half] - total[np.minimum(small, half)] - left) // capacity))
    return int((len(v) - half + more).max())


def best_fit(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing; each container as the numbers of its items."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = bisect_left(rooms, (sizes[i], -1))
        if k == len(rooms):
            bins.append([i])
            insort(rooms, (capacity - sizes[i], len(bins) - 1))
        else:
            room, b = rooms.pop(k)
            bins[b].append(i)
            insort(rooms, (room - sizes[i], b))
    return bins


def completions(room: int, sizes: Sequence[int], counts: Sequence[int], first: int, most_waste: int, keep: int | None, nodes: int | None) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """(waste, ((place, number), ...)): undominated fillings of `room` from sizes[first:], which fall,
    with `counts` of each; the least waste first, then larger items first.

    A filling that leaves room for an item it left out is dominated by the one that has
    it and is not listed. Branches that can't come to most_waste or under, even with all that
    is left, are cut. Stops at the first without waste. `keep` of them are kept and `nodes` nodes seen at most; None: all.
    """
    total = [0] * (len(sizes) + 1)
    for k in range(len(sizes) - 1, first - 1, -1):
        total[k] = total[k + 1] + sizes[k] * counts[k]
    found: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    limit = [most_waste, 1 << 62 if nodes is None else nodes]
    chosen: list[tuple[int, int]] = []

    def go(k: int, left: int, skipped: int) -> bool:
        # skipped: the smallest size that was left out somewhere; it must not fit at the end.
        limit[1] -= 1
        while k < len(sizes) and (sizes[k] > left or not counts[k]):
            k += 1
        if k == len(sizes) or left == 0:
            if left < skipped and left <= limit[0]:
                found.append((left, tuple(chosen)))
                if left == 0:
                    return True
                if keep is not None and len(found) >= keep:
                    found.sort(key=lambda f: f[0])
                    del found[keep:]
                    limit[0] = min(limit[0], found[-1][0])
            return limit[1] <= 0
        if left - total[k] > limit[0] or limit[1] <= 0:
            return limit[1] <= 0
        for n in range(min(counts[k], left // sizes[k]), -1, -1):
            if n:
                chosen.append((k, n))
            stop = go(k + 1, left - n * sizes[k], min(skipped, sizes[k]) if n < counts[k] else skipped)
            if n:
                chosen.pop()
            if stop:
                return True
        return False

    go(first, room, room + 1)
    return sorted(found, key=lambda f: f[0])


@dataclass(frozen=True)
class Search:
    """How far a block's search goes: fillings kept and nodes seen for each container, and containers tried in a row without a better packing. None: without end."""

    keep: int | None = 6
    nodes: int | None = 400
    patience: int | None = 4000


#: Ends with a packing of the fewest containers, in time that grows exponentially with the items: for small blocks.
EXACT = Search(None, None, None)


def pack(items: Sequence[int], capacity: int, search: Search = Search()) -> list[list[int]]:
    """Containers as lists of item numbers; every item is at most `capacity`.

    Bin completion: the largest item left is put with each of its undominated fillings in
    turn, depth first, best-fit's packing being the first incumbent. A branch whose waste
    so far leaves no better packing than the incumbent is cut; the search ends at the lower
    bound or where `search` says. With EXACT the result has the fewest containers that there are.
    """
    patience = left_to_try = 1 << 62 if search.patience is None else search.patience
    incumbent = best_fit(items, capacity)
    goal = lower_bound(items, capacity)
    if len(incumbent) <= goal:
        return incumbent
    sizes = sorted({s for s in items}, reverse=True)
    counts = [0] * len(sizes)
    at = {s: k for k, s in enumerate(sizes)}
    for s in items:
        counts[at[s]] += 1
    total = sum(items)
    best: list[tuple[tuple[int, int], ...]] | None = None
    best_n = len(incumbent)
    # One frame per container: its choices, which comes next, the waste before it, and its largest item's place.
    stack: list[list] = []
    waste = 0

    def frame() -> list | None:
        k = next((k for k, c in enumerate(counts) if c), None)
        if k is None:
            return None
        counts[k] -= 1
        room = (best_n - 1) * capacity - total - waste
        if room < 0:
            choices = []
        else:
            choices = completions(capacity - sizes[k], sizes, counts, k, room, search.keep, search.nodes)
        return [choices, 0, waste, k, None]

    stack.append(frame())
    while stack and left_to_try > 0 and best_n > goal:
        top = stack[-1]
        choices, nxt, before, k, taken = top
        if taken is not None:
            for place, n in taken:
                counts[place] += n
            top[4] = None
        waste = before
        if nxt >= len(choices) or before + choices[nxt][0] > (best_n - 1) * capacity - total:
            counts[k] += 1
            stack.pop()
            continue
        left_to_try -= 1
        lost, filling = choices[nxt]
        top[1], top[4] = nxt + 1, filling
        for place, n in filling:
            counts[place] -= n
        waste = before + lost
        below = frame()
        if below is None:
            if len(stack) < best_n:
                best_n, left_to_try = len(stack), patience
                best = [((f[3], 1), *f[4]) for f in stack]
        else:
            stack.append(below)
    if best is None:
        return incumbent
    pool: dict[int, list[int]] = {}
    for i, s in enumerate(items):
        pool.setdefault(at[s], []).append(i)
    return [[pool[k].pop() for k, n in filling for _ in range(n)] for filling in best]


_PLACED = "doc_id bigint, piece_no int, start bigint, n_tokens bigint, container_id string, room bigint"


def _packer(capacity: int, level: int, search: Search):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        sizes = group["n_tokens"].tolist()
        number, room = [""] * len(sizes), [0] * len(sizes)
        base = f"{level}.{int(group['block'].iloc[0])}"
        for b, members in enumerate(pack(sizes, capacity, search)):
            left = capacity - sum(sizes[i] for i in members)
            for i in members:
                number[i], room[i] = f"{base}.{b}", left
        return group[["doc_id", "piece_no", "start", "n_tokens"]].assign(container_id=number, room=room)

    return run


def _blocks(items: DataFrame, block: int) -> DataFrame:
    count = max(1, -(-items.count() // block))
    # A fixed number of partitions: the rows are few bytes but much work, so they must not be merged by size.
    return items.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(count))).repartition(count, "block")


def packed(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, block: int = 2000, slack: float = 0.01, search: Search = Search()) -> DataFrame:
    """(doc_id, piece_no, start, n_tokens, container_id): every document's place.

    A document over the capacity is cut into pieces of `capacity` tokens and a rest; no other is cut.
    Full pieces are containers of their own. The other items are spread by hash over blocks of
    about `block`, each packed by `pack` in one task; the items of containers with more than `slack`
    of their capacity free are gathered and packed once more. Only ids and sizes are
    shuffled, never texts. Null ids, null and empty texts take no place and have no row; repeated
    rows of a document count once, as its longest text. Containers are named by what fills them: `full.<doc_id>.<piece_no>`, or level,
    block and number.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    sizes = materialize(document_tokens(docs, tokenizer).where("doc_id is not null and n_tokens > 0"), "tokens")
    sizes = sizes.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
    number = F.explode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / capacity).cast("int"))).alias("piece_no")
    pieces = sizes.select("doc_id", "n_tokens", number).select(
        "doc_id", "piece_no", (F.col("piece_no").cast("bigint") * capacity).alias("start"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece_no") * capacity).cast("bigint").alias("n_tokens")
    )
    pieces = materialize(pieces, "pieces")
    rest = _blocks(pieces.where(F.col("n_tokens") < capacity), block)
    first = materialize(rest.groupBy("block").applyInPandas(_packer(capacity, 0, search), _PLACED), "packed")
    good = first.where(F.col("room") <= slack * capacity)
    loose = _blocks(first.where(F.col("room") > slack * capacity).drop("container_id", "room"), block)
    again = loose.groupBy("block").applyInPandas(_packer(capacity, 1, search), _PLACED)
    full = pieces.where(F.col("n_tokens") == capacity)
    named = full.withColumn("container_id", F.concat_ws(".", F.lit("full"), F.col("doc_id").cast("string"), F.col("piece_no").cast("string")))
    return good.drop("room").unionByName(again.drop("room")).unionByName(named)
