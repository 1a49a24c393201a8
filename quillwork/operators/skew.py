"""Joins that give no task a whole hot key.

A key is hot if more than BLOCK rows hold it. Hot keys are found by a heavy-hitter sketch of fixed
size, in one pass and without a shuffle; at most HOT of them are told to the tasks, as 64-bit hashes, so what
is broadcast is under 1 MB however large the tables are. Any other key holds at most BLOCK rows or, if there
are more than HOT hot ones, under four HOTs of all rows, and is joined plainly. A hash that a cold key shares with
a hot one only spreads the cold key too.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialize

BLOCK = 2000
HOT = 16384
#: Counters of the heavy-hitter sketch: it misses no key above 3.5 / TRACKED of the rows.
TRACKED = 65536


def hot_keys(keys: Sequence[str], *tables: DataFrame) -> list[dict[int, int]]:
    """For each table its hot keys: hash of the key -> number of blocks. Rows with a null in a key meet nothing and aren't counted."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    tops = None
    for i, df in enumerate(tables):
        top = df.where(whole).select(F.xxhash64(*keys).alias("_h")).agg(F.expr(f"approx_top_k(_h, {HOT}, {TRACKED})").alias("top"))
        top = top.select(F.lit(i).alias("i"), F.filter("top", lambda x: x["count"] > BLOCK).alias("hot"))
        tops = top if tops is None else tops.union(top)
    found: list[dict[int, int]] = [{} for _ in tables]
    for r in tops.collect():  # one row a table, HOT keys in each at most
        found[r["i"]] = {int(x["item"]): -(-int(x["count"]) // BLOCK) for x in r["hot"] or []}
    return found


def _told(df: DataFrame, keys: Sequence[str], hot: Sequence[tuple], columns: str) -> DataFrame:
    """df with the hot keys' columns, null for other keys."""
    names = [c.split()[0] for c in columns.split(",")]
    rows = json.dumps([dict(zip(["_h", *names], r)) for r in hot])
    table = df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(rows), f"array<struct<_h:bigint,{columns.replace(' ', ':')}>>")))
    return df.withColumn("_h", F.xxhash64(*keys)).join(F.broadcast(table), "_h", "left").drop("_h")


def _place(by: Column, blocks: Column) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(by), blocks).cast("int"), F.lit(0))


def _all_places(blocks: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), F.coalesce(blocks, F.lit(1)) - 1))


def spread_join(many: DataFrame, one: DataFrame, keys: Sequence[str], by: str, how: str = "inner", hot: dict[int, int] | None = None) -> DataFrame:
    """many.join(one, keys, how), for `one` of few rows a key: a hot key's rows of `many` are dealt out by the hash of
    column `by` over as many tasks as it has blocks, and its rows of `one` are copied to each. how: inner, left or left_semi.
    hot: the hot keys, where they are known; else `many` is computed once more to find them."""
    keys = list(keys)
    found = sorted((hot_keys(keys, many)[0] if hot is None else hot).items())
    if not found:
        return many.join(one, keys, how)
    dealt = _told(many, keys, found, "_n int").withColumn("_s", _place(F.col(by), F.col("_n"))).drop("_n")
    copied = _told(one, keys, found, "_n int").withColumn("_s", _all_places(F.col("_n"))).drop("_n")
    return dealt.join(copied, [*keys, "_s"], how).drop("_s")


def grid_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str) -> DataFrame:
    """left.join(right, keys), where both sides may have hot keys.

    A key with l rows on the left and r on the right is cut into ceil(l / BLOCK) by ceil(r / BLOCK)
    cells; a left row goes to each cell of its row, a right one to each of its column, so no task
    lists more than about BLOCK * BLOCK pairs of one key. Rows of other keys are sent once.
    """
    keys = list(keys)
    rows, columns = hot_keys(keys, left, right)
    hot = [(h, rows.get(h, 1), columns.get(h, 1)) for h in sorted(rows.keys() | columns.keys())]
    if not hot:
        return left.join(right, keys)
    a = _told(left, keys, hot, "_l int,_r int").withColumn("_i", _place(F.col(left_id), F.col("_l"))).withColumn("_j", _all_places(F.col("_r"))).drop("_l", "_r")
    b = _told(right, keys, hot, "_l int,_r int").withColumn("_j", _place(F.col(right_id), F.col("_r"))).withColumn("_i", _all_places(F.col("_l"))).drop("_l", "_r")
    return a.join(b, [*keys, "_i", "_j"]).drop("_i", "_j")


def bucket_pairs(members: DataFrame, bucket: Sequence[str], member: str) -> DataFrame:
    """(bucket, a, b) with a < b: the pairs of distinct members that meet in a bucket; members of repeated rows meet as often.

    Members are sent once, by bucket, and those alone in theirs are dropped where they arrive; the pairs come from a join
    that needs no further exchange. Hot buckets are cut into cells as in grid_join.
    """
    bucket = list(bucket)
    hot = sorted(hot_keys(bucket, members)[0].items())
    known = members.select(*bucket, F.col(member).alias("m"))
    cold = (_told(known, bucket, hot, "_n int").where("_n is null").drop("_n") if hot else known).repartition(*bucket)
    cold = cold.withColumn("_c", F.count("*").over(Window.partitionBy(*bucket))).where("_c > 1").drop("_c")
    out = cold.withColumnRenamed("m", "a").join(cold.withColumnRenamed("m", "b"), bucket).where("a < b")
    if hot:
        sent = _told(known, bucket, hot, "_n int").where("_n is not null").withColumn("mine", _place(F.col("m"), F.col("_n"))).withColumn("o", _all_places(F.col("_n")))
        keyed = sent.select(*bucket, "m", "mine", F.least("mine", "o").alias("i"), F.greatest("mine", "o").alias("j"))
        left = keyed.select(*bucket, "i", "j", F.col("m").alias("a"), F.col("mine").alias("x"))
        right = keyed.select(*bucket, "i", "j", F.col("m").alias("b"), F.col("mine").alias("y"))
        out = out.select(*bucket, "a", "b").union(left.join(right, [*bucket, "i", "j"]).where("a < b and (i = j or x <> y)").select(*bucket, "a", "b"))
    return out.select(*bucket, "a", "b")


def ranged(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """df written in ranges of the order, with the number _p of each row's range and its place _m in it. Ranges are of even size, also where
    many rows share the first column of the order, as long as they differ in the others."""
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(sorted_rows.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()), "ranged")


def previous_of_key(df: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """df with out: the value of the row before among those of the same key, by the order; null for a key's first row.

    A lag over ranges of (key, order) instead of over keys, so a hot key is spread over many ranges; where a range begins inside a key, the last
    row of the range before is looked up in a table of one row a range."""
    placed = ranged(df, [key, order])
    by_place = Window.partitionBy("_p").orderBy("_m")
    last = placed.groupBy("_p").agg(F.max_by(F.struct(F.col(key).alias("k"), F.col(value).alias("v")), "_m").alias("_e"))
    before = last.select("_p", F.lag("_e").over(Window.orderBy("_p")).alias("_e"))  # one row a range
    own = F.lag(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))).over(by_place)
    d = placed.withColumn("_b", own).join(F.broadcast(before), "_p").withColumn("_b", F.coalesce("_b", "_e"))
    return d.withColumn(out, F.when(F.col("_b.k") == F.col(key), F.col("_b.v"))).drop("_p", "_m", "_b", "_e")
