"""Records of evaluation splits that occur, exactly or almost, in the training split."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import textvec as tv
from ..operators.skew import grid_join, hot_keys, spread_join
from ..operators.tables import discard, materialize


def _gram_batches(width: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.slices(batches, "text"):
            col = lambda c: batch.column(batch.schema.get_field_index(c))
            words, words_at = tv.hashed_words(col("text"))
            values, at = tv.distinct_sorted(*tv.shingle_hashes(words, words_at, width))
            enough = (np.diff(words_at) >= min_words) & (np.diff(at) > 0)
            sizes = np.where(enough, np.diff(at), 0)
            kept = values[np.repeat(enough, np.diff(at))]
            new_at = np.concatenate([[0], np.cumsum(sizes)])
            title = pc.replace_substring_regex(tv.fold(col("title")), r"[^\p{L}\p{N}]+", "")
            yield pa.RecordBatch.from_arrays(
                [
                    col("id"),
                    col("is_eval"),
                    pc.if_else(pc.equal(title, ""), pa.scalar(None, pa.string()), title),
                    col("hash_key"),
                    pa.array(enough),
                    pa.array(tv.set_hash(kept, new_at).view(np.int64)),
                    tv.list_column(kept, new_at, pa.int64()),
                ],
                names=["id", "is_eval", "title_key", "hash_key", "has_text", "set_hash", "grams"],
            )

    return run


_GRAMS = "id bigint, is_eval boolean, title_key string, hash_key string, has_text boolean, set_hash bigint, grams array<bigint>"

#: Buckets of grams whose training texts are counted together, a power of two. They only order grams, so grams that share a bucket cost time, never pairs.
BUCKETS = 1 << 20
BLOCK_BUCKETS = 1 << 12
#: 64-bit words of a class's odd sketch.
SKETCH_WORDS = 8
BITS = 64 * SKETCH_WORDS
_SKETCH = [f"s{k}" for k in range(SKETCH_WORDS)]
_POSTING = "gram bigint, c bigint, n int, place int, " + ", ".join(f"{s} bigint" for s in _SKETCH)


def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, bucket, level) as one text of bytes a block."""
    levels, seen = np.zeros(BUCKETS, dtype=np.uint8), set()
    for batch in batches:
        block, bucket, level = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        levels[bucket] = level
        seen.update(np.unique(block).tolist())
    blocks = sorted(seen)
    texts = [levels[k * BLOCK_BUCKETS : (k + 1) * BLOCK_BUCKETS].tobytes() for k in blocks]
    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(texts, pa.binary())], names=["block", "levels"])


def _gram_levels(train: DataFrame) -> np.ndarray:
    """A byte for each bucket of grams: 8 log2(1 + its rows in train), 0 where there are none. The driver gets BUCKETS bytes, however large train is."""
    counts = train.groupBy(F.col("gram").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("bucket")).count()
    level = F.round(8 * F.log2(1.0 + F.col("count"))).cast("smallint").alias("level")
    rows = counts.select(F.floor(F.col("bucket") / BLOCK_BUCKETS).cast("int").alias("block"), "bucket", level).repartition("block")
    out = np.zeros(BUCKETS, dtype=np.uint8)
    for r in rows.mapInArrow(_dense, "block int, levels binary").collect():
        part = out[r["block"] * BLOCK_BUCKETS :][:BLOCK_BUCKETS]
        np.maximum(part, np.frombuffer(r["levels"], dtype=np.uint8), out=part)
    return out


def odd_sketches(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SKETCH_WORDS words a set: bit b is the parity of the number of values that hash to b, so two sketches differ in
    at most as many bits as their sets have values that the other lacks."""
    rows = len(at) - 1
    bit = (values >> np.uint64(40)).astype(np.int64) % BITS + np.repeat(np.arange(rows, dtype=np.int64) * BITS, np.diff(at))
    parity = (np.bincount(bit, minlength=rows * BITS) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(rows, BITS), axis=1).view(np.int64)


def _posting_batches(threshold: float, levels: np.ndarray, grams_a_batch: int = 100_000):
    """A row for each gram of a class's prefix that may be in a training text: its place among the class's grams from rare to frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ends = np.cumsum(pc.list_value_length(whole.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
            first = 0
            while first < whole.num_rows:
                to = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + grams_a_batch, side="right")))
                batch = whole.slice(first, to - first)
                first = to
                n = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
                at = np.concatenate([[0], np.cumsum(n)])
                values = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                owner = np.repeat(np.arange(len(n)), n)
                level = levels[(values & np.uint64(BUCKETS - 1)).astype(np.int64)]
                order = np.lexsort((values, level, owner))
                place = np.arange(len(values)) - np.repeat(at[:-1], n)
                places = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
                kept = np.flatnonzero((place < places[owner]) & (level[order] > 0))
                own = owner[kept]
                sketch = odd_sketches(values, at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(values[order[kept]].view(np.int64)),
                        batch.column(0).take(pa.array(own)),
                        pa.array(n[own].astype(np.int32)),
                        pa.array(place[kept].astype(np.int32)),
                        *(pa.array(sketch[own, k]) for k in range(SKETCH_WORDS)),
                    ],
                    names=["gram", "c", "n", "place", *_SKETCH],
                )

    return run


def _met(sets: DataFrame, threshold: float) -> DataFrame:
    """(e, t): pairs of an evaluation and a training class that share a gram of both prefixes and aren't ruled out by sizes, places and sketches."""
    levels = _gram_levels(sets.where("in_train").select(F.explode("grams").alias("gram")))

    def side(where: str, c: str) -> DataFrame:
        rows = sets.where(where).select("set_hash", "grams").mapInArrow(_posting_batches(threshold, levels), _POSTING)
        return rows.select("gram", F.col("c").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n", "place", *_SKETCH)))

    total = F.col("n_e") + F.col("n_t")
    common = total * (threshold / (1 + threshold)) - 1e-6  # what a pair at the threshold shares
    odd = functools.reduce(operator.add, (F.bit_count(F.col(f"{s}_e").bitwiseXOR(F.col(f"{s}_t"))) for s in _SKETCH))
    both = grid_join(side("in_eval", "e"), side("in_train", "t"), ["gram"], "e", "t")
    both = both.where((F.least(F.col("n_e") - F.col("place_e"), F.col("n_t") - F.col("place_t")) >= common) & (odd <= total - 2 * common))
    return both.select("e", "t").distinct()


def cross_split_overlaps(records: DataFrame, threshold: float = 0.5, width: int = 3, min_words: int = 20) -> DataFrame:
    """(eval_id, train_id, by_hash, by_title, containment, similarity) of every pair of
    an evaluation and a training record that overlap. One row per pair.

    records: id bigint, is_eval boolean, text, title, hash_key. A pair overlaps if the
    hash keys are equal; or if both texts have at least `min_words` words and their
    distinct `width`-word grams have `threshold` similarity (common / in either); or if
    a text is missing or shorter and the titles are equal in letters and digits. The
    containment (common / grams of the evaluation text) and the similarity are null for
    pairs found by hash or title alone. Nulls in hash, title and text match nothing;
    rows without id or is_eval are left out; repeated rows count once.

    Texts with equal gram sets are one class, and only classes are compared, so copies
    cost nothing. Grams are ordered from rare to frequent ones in the training texts.
    Two classes at the threshold share a gram among the first n - ceil(threshold * n) + 1
    of both, and the first one that they share leaves room behind it in both for all they
    must share; and their odd sketches differ in no more bits than their sets may in grams.
    All three bounds hold for every such pair, so nothing is lost. They are tested
    where grams meet, and only the few pairs that pass are written and verified.
    """
    items = records.select("id", "is_eval", "text", "title", "hash_key").where("id is not null and is_eval is not null")
    known = materialize(items.mapInArrow(_gram_batches(width, min_words), _GRAMS).dropDuplicates(["id", "is_eval"]), "grams")

    texts = known.where("has_text")
    classes = texts.groupBy("set_hash").agg(
        F.min("id").alias("rep"), F.bool_or("is_eval").alias("in_eval"), F.bool_or(~F.col("is_eval")).alias("in_train")
    )
    # The sets themselves come from the representative's row alone.
    sets = materialize(
        texts.select("set_hash", F.col("id").alias("rep"), "grams").join(classes, ["set_hash", "rep"]).dropDuplicates(["set_hash"]), "classes"
    )
    met = materialize(_met(sets, threshold), "met")
    near = spread_join(met, sets.where("in_eval").select(F.col("set_hash").alias("e"), F.col("grams").alias("x")), ["e"], "t", hot=hot_keys(["e"], met)[0])
    near = (
        spread_join(near, sets.where("in_train").select(F.col("set_hash").alias("t"), F.col("grams").alias("y")), ["t"], "e", hot=hot_keys(["t"], met)[0])
        .withColumn("common", F.size(F.array_intersect("x", "y")))
        .withColumn("containment", F.col("common") / F.size("x"))
        .withColumn("similarity", F.col("common") / (F.size("x") + F.size("y") - F.col("common")))
        .where(F.col("similarity") >= threshold)
        .select("e", "t", "containment", "similarity")
    )
    near = materialize(near, "near")  # read several times below
    discard(met, sets)
    ev, tr = known.where("is_eval"), known.where("not is_eval")
    slim = lambda d, who, *c: d.select(F.col("id").alias(who), *c)
    no = F.lit(None).cast("double")
    by_text = grid_join(
        grid_join(near, slim(ev.where("has_text"), "eval_id", F.col("set_hash").alias("e")), ["e"], "t", "eval_id"),
        slim(tr.where("has_text"), "train_id", F.col("set_hash").alias("t")), ["t"], "eval_id", "train_id",
    ).select("eval_id", "train_id", F.lit(False).alias("by_hash"), F.lit(False).alias("by_title"), "containment", "similarity")
    hashed = lambda d, who: slim(d, who, "hash_key").where("hash_key is not null")
    by_hash = grid_join(hashed(ev, "eval_id"), hashed(tr, "train_id"), ["hash_key"], "eval_id", "train_id").select(
        "eval_id", "train_id", F.lit(True).alias("by_hash"), F.lit(False).alias("by_title"), no.alias("containment"), no.alias("similarity")
    )
    titled = lambda d, who: slim(d, who, "title_key").where("title_key is not null")
    # Every pair of equal titles but those where both have a text: a hot title's members with text never meet each other.
    short = grid_join(titled(ev.where("not has_text"), "eval_id"), titled(tr, "train_id"), ["title_key"], "eval_id", "train_id")
    long = grid_join(titled(ev.where("has_text"), "eval_id"), titled(tr.where("not has_text"), "train_id"), ["title_key"], "eval_id", "train_id")
    by_title = short.union(long).select(
        "eval_id", "train_id", F.lit(False).alias("by_hash"), F.lit(True).alias("by_title"), no.alias("containment"), no.alias("similarity")
    )
    return (
        by_text.union(by_hash).union(by_title).where("eval_id <> train_id").groupBy("eval_id", "train_id")
        .agg(F.bool_or("by_hash").alias("by_hash"), F.bool_or("by_title").alias("by_title"), F.max("containment").alias("containment"), F.max("similarity").alias("similarity"))
    )


def prefix_places(n: int, threshold: float) -> int:
    """How many of a set's n grams must be asked for so that no match is lost."""
    return n - math.ceil(threshold * n) + 1
