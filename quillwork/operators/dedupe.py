"""First-come deduplication of records that share any of several keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import previous_of_key, spread_join
from .tables import discard, materialize


def first_come(records: DataFrame, id_col: str, keys: Sequence[Column], order: Sequence[Column], own: Column | None = None) -> DataFrame:
    """(id_col, retained_id): for each record, in the given order, the retained record it joins: that of its first
    key, by precedence, already taken; else itself. All its keys then lead to that record.

    A taken key leads where the last record before that has it went. So each record follows one earlier record, which needs no
    walk to be known: the one before it by its first key that any earlier record has. What all follow in the end comes from
    doubling these steps (as many rounds as the logarithm of the longest chain), each round in a table of its own. No
    task holds a key's, or a chain's, records. Null ids are left out; null keys match nothing; a record without keys is
    retained; repeated ids count once. Records for which `own` holds join none: they lead to themselves.
    """
    rows = records.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.col(id_col).alias("last")).alias("o"),
        F.array_compact(F.array(*(F.when(k.isNotNull(), F.struct(F.lit(i).alias("place"), F.xxhash64(F.lit(i), k.cast("string")).alias("k"))) for i, k in enumerate(keys)))).alias("ks"),
        F.coalesce(own if own is not None else F.lit(False), F.lit(False)).alias("own"),
    ).dropDuplicates(["id"])
    rows = materialize(rows, "keys")
    held = previous_of_key(rows.select("id", "o", "own", F.inline("ks")), "k", "o", "id", "before")
    steps = materialize(held.where("before is not null and not own").groupBy("id").agg(F.min_by("before", "place").alias("to")), "steps")
    while True:
        further = spread_join(steps, steps.select(F.col("id").alias("to"), F.col("to").alias("next")), ["to"], "id", "left")
        new = materialize(further.select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "steps")
        done = new.where("moved").isEmpty()
        discard(steps)
        steps = new.drop("moved") if done else new.select("id", "to")
        steps._table_path = new._table_path
        if done:
            break
    return rows.select("id").join(steps, "id", "left").select(F.col("id").alias(id_col), F.coalesce("to", "id").alias("retained_id"))


def existing_match(incoming: DataFrame, id_col: str, existing: DataFrame, keys: dict[str, tuple[Column, Column]]) -> DataFrame:
    """incoming's ids with reason: the first of the keys (in order) whose value some existing record has, else null.

    keys: name -> (key of an incoming record, key of an existing one). One shuffle: all keys are looked up together.
    An id may have several rows, one for each value of its keys; any of them can match.
    """
    known = None
    for name, (_, theirs) in keys.items():
        part = existing.select(F.lit(name).alias("name"), theirs.alias("key")).where("key is not null")
        known = part if known is None else known.union(part)
    asked = incoming.select(
        F.col(id_col), F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(n).alias("name"), mine.alias("key")) for i, (n, (mine, _)) in enumerate(keys.items())))).alias("q")
    ).select(id_col, "q.*")
    hits = spread_join(asked.where("key is not null"), known.distinct(), ["name", "key"], id_col, "left_semi")
    first = hits.groupBy(id_col).agg(F.min_by("name", "place").alias("reason"))
    return incoming.select(id_col).distinct().join(first, id_col, "left")


def normalized_title(title: Column) -> Column:
    """The letters and digits of a title in lower case; null if there are none."""
    bare = F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", "")
    return F.when(bare != "", bare)

