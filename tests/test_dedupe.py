import random

from pyspark.sql import functions as F

from quillwork.operators import dedupe


def walk(rows):
    index, out, seen = {}, {}, set()
    for i, *keys in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        if i in seen:
            continue
        seen.add(i)
        keys = [(n, k) for n, k in enumerate(keys) if k is not None]
        at = next((index[k] for k in keys if k in index), i)
        for k in keys:
            index[k] = at
        out[i] = at
    return out


def test_first_come_matches_the_walk(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, f"u{rng.randrange(60)}"]), rng.choice([None, f"t{rng.randrange(50)}"]), rng.choice([None, f"c{rng.randrange(60)}"])) for i in range(1, 140)]
    rows += [(i, None, None, None) for i in range(200, 230)] + [(i, "same", "same", "same") for i in range(300, 330)] + [(None, "same", None, None)]
    df = spark.createDataFrame(rows, "id bigint, k0 string, b string, head string")
    got = {r.id: r.retained_id for r in dedupe.first_come(df, "id", [F.col("k0"), F.col("b"), F.col("head")], [F.col("id")]).collect()}
    assert got == walk(rows)


def test_first_come_empty(spark):
    df = spark.createDataFrame([], "id bigint, a string")
    assert dedupe.first_come(df, "id", [F.col("a")], [F.col("id")]).count() == 0


def test_existing_match_takes_the_first_key(spark):
    new = spark.createDataFrame([(1, "d1", "u1"), (2, "x", "u1"), (3, None, None), (3, None, None)], "id bigint, doi string, url string")
    old = spark.createDataFrame([("d1", "u1"), ("d1", None), (None, None)], "doi string, url string")
    got = dedupe.existing_match(new, "id", old, {"doi": (F.col("doi"), F.col("doi")), "url": (F.col("url"), F.col("url"))}).collect()
    assert {r.id: r.reason for r in got} == {1: "doi", 2: "url", 3: None} and len(got) == 3
