"""Connected components of records that share keys, and splits that respect them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import spread_join
from .tables import discard, materialize


def star_links(records: DataFrame, id_col: str, keys: Sequence[Column]) -> DataFrame:
    """(v, u): each record with the smallest record that has the same key.

    A key of n records gives n - 1 links, never all pairs. The smallest record of a
    key comes from an aggregate with map-side combine, and the records of a hot key
    are dealt out over tasks before they meet it.
    """
    pairs = records.select(F.col(id_col).alias("v"), F.explode(F.array_compact(F.array_distinct(F.array(*keys)))).alias("k")).where(F.col("v").isNotNull())
    pairs = materialize(pairs.distinct(), "keys")
    heads = pairs.groupBy("k").agg(F.min("v").alias("u"), F.max("v").alias("top")).where("top > u").drop("top")
    return spread_join(pairs, heads, ["k"], "v").where("v <> u").select("v", "u").distinct()


def components(links: DataFrame) -> DataFrame:
    """(v, component): for each node of the links (v, u), the smallest node connected to it.

    Hash-to-min: each node holds a cluster, at first itself and its neighbours; in
    a round it sends its cluster to the cluster's minimum and the minimum to all
    members, and every node unites what it receives, until nothing changes. A
    cluster is kept as rows (v, u), not as one array, and the rows of a giant
    component's minimum are dealt out over tasks. Each round's rows are written to
    the shared folder. Empty links give an empty result.
    """
    both = links.select("v", "u").union(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
    loops = both.select("v", F.col("v").alias("u"))
    clusters = materialize(both.union(loops).distinct(), "clusters")
    seen = None
    while True:
        least = clusters.groupBy("v").agg(F.min("u").alias("m"))
        # One pass over the rows for both messages: to each member its minimum, to the minimum each member.
        sent = spread_join(clusters, least, ["v"], "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u").alias("v"), F.col("m").alias("u")),
                    F.struct(F.col("m").alias("v"), F.col("u").alias("u")),
                )
            ).alias("e")
        ).select("e.v", "e.u")
        new = materialize(sent.distinct(), "clusters")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        discard(clusters)
        clusters = new
        if state == seen:
            return clusters.groupBy("v").agg(F.min("u").alias("component"))
        seen = state


def linked_groups(records: DataFrame, id_col: str, keys: Sequence[Column], group_col: str = "group_id") -> DataFrame:
    """(id_col, group_col) of the records in groups of two or more, linked transitively
    by any equal non-null key. Null ids and keys link nothing; repeated rows count once."""
    return components(star_links(records, id_col, keys)).select(F.col("v").alias(id_col), F.col("component").alias(group_col))


def rendezvous_split(key: Column, weights: Mapping[str, float], seed: int = 0) -> Column:
    """The split of a key by weighted rendezvous hashing.

    Each split scores -weight / ln(u), u in (0, 1) a hash of key, split and seed; the
    highest wins. A split added or reweighted later moves only the keys it wins or
    loses. Weights need not sum to 1; those of 0 get nothing.
    """
    positive = {s: w for s, w in weights.items() if w > 0}
    if not positive:
        raise ValueError("no split has a weight above 0")
    scores = []
    for split, weight in sorted(positive.items()):
        # 52 bits of a hash that other engines have too.
        bits = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(split), F.lit(str(seed)))), 1, 13), 16, 10).cast("double")
        u = (bits + F.lit(0.5)) / F.lit(float(1 << 52))
        scores.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(split).alias("split")))
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["split"]


def grouped_split(records: DataFrame, id_col: str, keys: Sequence[Column], weights: Mapping[str, float], seed: int = 0) -> DataFrame:
    """(id_col, group_id, split): every record once; linked records share group and split.

    A record without links is its own group. Null ids are left out.

    The proportions hold for groups, and so nearly for records as long as no group is large. A group of more than a
    hundredth of all records is too large to be left to chance: there are at most 100 of them, and each, the
    largest first, goes to the split that is furthest below its share.
    """
    groups = linked_groups(records, id_col, keys)
    ids = records.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    whole = materialize(ids.join(groups, id_col, "left").withColumn("group_id", F.coalesce("group_id", id_col)), "groups")
    total = whole.count()
    large = whole.groupBy("group_id").agg(F.count("*").alias("n")).where(F.col("n") * 100 > total).orderBy(F.desc("n"), "group_id").limit(100).collect()
    split = rendezvous_split(F.col("group_id"), weights, seed)
    if large:
        positive = {s: w for s, w in sorted(weights.items()) if w > 0}
        room = {s: w / sum(positive.values()) * total for s, w in positive.items()}
        for r in large:
            best = max(room, key=lambda s: (room[s], s))
            room[best] -= r["n"]
            split = F.when(F.col("group_id") == F.lit(r["group_id"]), best).otherwise(split)
    return whole.withColumn("split", split)
