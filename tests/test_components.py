import random

import pytest
from pyspark.sql import functions as F

from quillwork.operators import components as C


def union_find(rows):
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for i, *keys in rows:
        for k in enumerate(keys):
            if k[1] is not None:
                a, b = find(first.setdefault(k[1], i)), find(i)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for x in parent:
        groups.setdefault(find(x), []).append(x)
    return {(x, min(g)) for g in groups.values() if len(g) > 1 for x in g}


def test_against_union_find(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, f"a{rng.randrange(40)}"]), rng.choice([None, None, f"b{rng.randrange(30)}"])) for i in range(1, 80)]
    rows += [(i, "hot", None) for i in range(200, 240)] + [(300 + i, f"p{i}", f"p{i + 1}") for i in range(25)] + rows[:5]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "id bigint, a string, b string, component string")
    found = {tuple(r) for r in C.linked_groups(df, "id", [F.col("a"), F.col("b")]).collect()}
    assert found == union_find(rows)


def test_empty_and_null(spark):
    df = spark.createDataFrame([(None, "a"), (1, None), (2, "a")], "id bigint, a string")
    assert C.linked_groups(df, "id", [F.col("a")]).count() == 0
    assert C.linked_groups(df.limit(0), "id", [F.col("a")]).count() == 0
    split = C.grouped_split(df, "id", [F.col("a")], {"train": 0.8, "test": 0.2}).collect()
    assert sorted(r.id for r in split) == [1, 2]


def test_split_keeps_groups_and_proportions(spark):
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, (F.col("id") / 12).cast("int").cast("string")).alias("k"))
    out = C.grouped_split(df, "id", [F.col("k")], {"train": 8, "validation": 1, "test": 1, "unused": 0}).cache()
    assert out.count() == 6000
    assert out.groupBy("group_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    share = {r["split"]: r["count"] / 6000 for r in out.groupBy("split").count().collect()}
    assert abs(share["train"] - 0.8) < 0.03 and abs(share["test"] - 0.1) < 0.03 and "unused" not in share


def test_rendezvous_moves_only_what_changes(spark):
    df = spark.range(3000)
    a = df.select("id", C.rendezvous_split(F.col("id"), {"train": 8, "test": 2}).alias("a"), C.rendezvous_split(F.col("id"), {"train": 8, "test": 2, "new": 1}).alias("b"))
    assert a.where("a <> b and b <> 'new'").count() == 0
    with pytest.raises(ValueError):
        C.rendezvous_split(F.col("id"), {"train": 0})
