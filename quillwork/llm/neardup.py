"""Near-duplicate texts: MinHash bands for candidates, odd sketches to verify them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import textvec as tv
from ..operators.components import components
from ..operators.skew import bucket_pairs, grid_join, hot_keys, spread_join
from ..operators.tables import discard, materialize

#: 64-bit words of an odd sketch.
SKETCH_WORDS = 16
BITS = 64 * SKETCH_WORDS


def _seeds(samples: int) -> tuple[np.ndarray, np.ndarray]:
    s = tv.mix(np.arange(1, 2 * samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (s[:samples] >> np.uint64(32)).astype(np.uint32), ((s[samples:] >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)


def minhash(values: np.ndarray, at: np.ndarray, samples: int) -> np.ndarray:
    """A row of `samples` minima for each of the sets values[at[i]:at[i+1]]; all must be non-empty."""
    xor, times = _seeds(samples)
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((samples, len(at) - 1), dtype=np.uint32)
    for k in range(samples):
        out[k] = np.minimum.reduceat((x ^ xor[k]) * times[k], at[:-1])
    return out.T


def odd_sketch(minima: np.ndarray) -> np.ndarray:
    """Each row's samples folded into a bitmap: bit b is the parity of the number of
    (sample number, minimum) pairs that hash to b. Returned as SKETCH_WORDS words a row."""
    rows, samples = minima.shape
    pair = tv.mix(minima.astype(np.uint64) + (np.arange(samples, dtype=np.uint64) << np.uint64(32)) + np.uint64(1))
    bit = (pair % np.uint64(BITS)).astype(np.int64) + np.arange(rows, dtype=np.int64)[:, None] * BITS
    parity = (np.bincount(bit.ravel(), minlength=rows * BITS) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(rows, BITS), axis=1).view(np.int64)


def band_hashes(minima: np.ndarray, width: int) -> np.ndarray:
    """A hash of each `width` consecutive samples."""
    rows, samples = minima.shape
    parts = minima.reshape(rows, samples // width, width).astype(np.uint64)
    h = np.arange(samples // width, dtype=np.uint64)[None, :] + np.uint64(7)
    for k in range(width):
        h = tv.mix(h * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, k])
    return h


def _signature_batches(width: int, samples: int, band_width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.slices(batches, "text", 2_000_000):
            words, words_at = tv.hashed_words(batch.column(batch.schema.get_field_index("text")))
            values, at = tv.distinct_sorted(*tv.shingle_hashes(words, words_at, width))
            has = np.flatnonzero(np.diff(at) > 0)
            if not len(has):
                continue
            starts = np.append(at[has], at[-1])
            minima = minhash(values, starts, samples)
            bands = band_hashes(minima, band_width)
            rows = pa.array(has)
            flat_at = np.arange(len(has) + 1) * bands.shape[1]
            sketch = odd_sketch(minima)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("kind")).take(rows),
                    batch.column(batch.schema.get_field_index("id")).take(rows),
                    pa.array(tv.set_hash(values, at)[has].view(np.int64)),
                    pa.array(np.diff(at)[has].astype(np.int32)),
                    *(pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(SKETCH_WORDS)),
                    tv.list_column(np.ascontiguousarray(bands).ravel(), flat_at, pa.int64()),
                ],
                names=["kind", "id", "set_hash", "n_shingles", *(f"s{k}" for k in range(SKETCH_WORDS)), "bands"],
            )

    return run


_SKETCH = [f"s{k}" for k in range(SKETCH_WORDS)]
_SIGNATURE = "kind string, id bigint, set_hash bigint, n_shingles int, " + ", ".join(f"{s} bigint" for s in _SKETCH) + ", bands array<bigint>"


def sketch_similarity(a: str, b: str, samples: int) -> Column:
    """Similarity from the XOR of two odd sketches (columns of structs a and b).

    Of the XOR, z of n bits are odd; the symmetric difference of the k-sample sets is
    estimated by -n/2 ln(1 - 2z/n), and the similarity by 1 - that / 2k.
    """
    odd = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in _SKETCH[1:]), F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))
    share = F.least(2.0 * odd / float(BITS), F.lit(1 - 1e-9))
    return 1.0 + F.log(1.0 - share) * (BITS / (4.0 * samples))


def _shingle_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.slices(batches, "text"):
            words, words_at = tv.hashed_words(batch.column(batch.schema.get_field_index("text")))
            values, at = tv.distinct_sorted(*tv.shingle_hashes(words, words_at, width))
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("kind", "id")]
            yield pa.RecordBatch.from_arrays([*keep, tv.list_column(values, at, pa.int64())], names=["kind", "id", "shingles"])

    return run


class NearDuplicates:
    """The near-duplicates of (kind, id, text): texts of one kind whose word shingles
    have at least `threshold` similarity (distinct common / distinct in either).

    Texts with equal shingle sets form a class, represented by its smallest id. Class
    representatives meet where one of the MinHash bands agrees; the XOR population
    count of their odd sketches discards pairs estimated more than `margin` below the
    threshold; the rest is verified on the shingle sets themselves. The margin is over four
    standard errors of the estimate, and the bands find a pair at the threshold t with
    probability 1 - (1 - t^band_width)^(samples / band_width). No task gets a whole hot class, bucket or
    representative (see operators.skew).

    Null texts and texts of fewer than `width` words have no shingles and are in no
    pair or group. Repeated (kind, id) rows of one text count once.
    """

    def __init__(self, texts: DataFrame, threshold: float = 0.8, width: int = 5, samples: int = 320, band_width: int = 4, margin: float = 0.15):
        if samples % band_width:
            raise ValueError("band_width must divide samples")
        items = texts.select(F.col("kind").cast("string"), F.col("id").cast("bigint"), "text").where("text is not null and id is not null")
        self.threshold, self.samples = threshold, samples
        self.signatures = materialize(items.mapInArrow(_signature_batches(width, samples, band_width), _SIGNATURE), "signatures")
        #: (kind, rep, id): every text with shingles and its class.
        slim = self.signatures.select("kind", "id", "set_hash")
        heads = slim.groupBy("kind", "set_hash").agg(F.min("id").alias("rep"))
        self.members = materialize(spread_join(slim, heads, ["kind", "set_hash"], "id").select("kind", "rep", "id").distinct(), "members")
        # One row a class, its representative's: an aggregate with map-side combine, so no list of representatives is joined or broadcast.
        reps = self.signatures.groupBy("kind", "set_hash").agg(F.min_by(F.struct("id", *_SKETCH, "bands"), "id").alias("r")).select("kind", "r.*")
        reps = materialize(reps, "classes")
        buckets = reps.select("kind", "id", F.explode("bands").alias("band"))
        met = materialize(bucket_pairs(buckets, ["kind", "band"], "id").select("kind", "a", "b").distinct(), "met")
        sketches = reps.select("kind", "id", F.struct(*_SKETCH).alias("sk"))
        near = self._with_both(met, sketches, "sk").withColumn("estimate", sketch_similarity("sk_a", "sk_b", samples))
        near = near.where(F.col("estimate") >= threshold - margin).select("kind", "a", "b", "estimate")
        candidates = materialize(near, "candidates")
        discard(met)
        ends = candidates.select("kind", F.explode(F.array("a", "b")).alias("id")).distinct()
        sets = items.join(ends, ["kind", "id"], "left_semi").dropDuplicates(["kind", "id"]).mapInArrow(_shingle_batches(width), "kind string, id bigint, shingles array<bigint>")
        both = self._with_both(candidates, sets, "shingles").withColumn("common", F.size(F.array_intersect("shingles_a", "shingles_b")))
        both = both.withColumn("similarity", F.col("common") / (F.size("shingles_a") + F.size("shingles_b") - F.col("common")))
        #: (kind, a, b, similarity, estimate): verified pairs of class representatives, a < b.
        self.links = materialize(both.where(F.col("similarity") >= threshold).select("kind", "a", "b", "similarity", "estimate"), "links")
        discard(self.signatures, reps, candidates)

    @staticmethod
    def _with_both(pairs: DataFrame, of: DataFrame, value: str) -> DataFrame:
        """pairs (kind, a, b) with value_a and value_b, the values of both ends in (kind, id, value); an end may be in any number of pairs."""
        out = pairs
        for end, other in (("a", "b"), ("b", "a")):
            own = of.select("kind", F.col("id").alias(end), F.col(value).alias(f"{value}_{end}"))
            out = spread_join(out, own, ["kind", end], other, hot=hot_keys(["kind", end], pairs)[0])
        return out

    def pairs(self) -> DataFrame:
        """(kind, id_a, id_b), id_a < id_b: all pairs, those inside classes included."""
        one = self.members.select("kind", F.col("rep").alias("a"), F.col("id").alias("x"))
        two = self.members.select("kind", F.col("rep").alias("b"), F.col("id").alias("y"))
        across = grid_join(grid_join(self.links.select("kind", "a", "b"), one, ["kind", "a"], "b", "x"), two, ["kind", "b"], "x", "y").select("kind", "x", "y")
        inside = bucket_pairs(self.members, ["kind", "rep"], "id").select("kind", F.col("a").alias("x"), F.col("b").alias("y"))
        return across.union(inside).select("kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    def groups(self) -> DataFrame:
        """(kind, id, class_id, group_id, n_links): one row per text with shingles. The
        class is of equal shingle sets, the group of transitively similar classes (both
        named by their smallest id); n_links counts the text's similar other classes."""
        node = lambda c: F.concat_ws(":", "kind", F.col(c))
        named = components(self.links.select(node("a").alias("v"), node("b").alias("u")))
        ends = self.links.select("kind", F.explode(F.array("a", "b")).alias("rep"))
        classes = ends.groupBy("kind", "rep").agg(F.count("*").alias("n_links")).withColumn("v", node("rep")).join(named, "v").drop("v")
        # The component's name is its smallest string; its smallest id comes from an aggregate.
        classes = materialize(classes, "classes")
        least = classes.groupBy("component").agg(F.min("rep").alias("least"))
        classes = spread_join(classes, least, ["component"], "rep").select("kind", "rep", "n_links", "least")
        return spread_join(self.members, classes, ["kind", "rep"], "id", "left").select(
            "kind", "id", F.col("rep").alias("class_id"), F.coalesce("least", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")
        )


def recall_at(similarity: float, samples: int = 320, band_width: int = 4) -> float:
    """The probability that the bands find a pair of this similarity."""
    return 1 - math.pow(1 - similarity**band_width, samples / band_width)
