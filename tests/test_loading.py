import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillwork.functions.forms import content_hash
from quillwork.operators import loading, skew


def test_content_hash(spark):
    df = spark.createDataFrame([(" a\n ﬁ b ",), ("",), (None,)], "t string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert [r[0] for r in df.select(content_hash(F.col("t"))).collect()] == [sha("a fi b"), sha(""), None]


def test_schema_errors(spark):
    columns = loading.TABLES["papers"]["columns"]
    good = spark.createDataFrame([], "paper_id bigint, " + ", ".join(f"{c} {'array<string>' if k == 'texts' else 'int' if k == 'integer' else 'string'}" for c, k in columns.items()))
    assert loading.schema_errors(good.schema, "papers") == []
    assert loading.schema_errors(good.drop("doi").withColumn("keywords", F.lit("x")).schema, "papers") == ["keywords:type", "doi:missing"]


def walk(incoming, stored):
    """Loads one record after the other."""
    out, seen, top = {}, {}, max((s[0] for s in stored), default=0)
    actions = {}
    for i, *keys in sorted(incoming):
        keys = [(n, k) for n, k in enumerate(keys) if k is not None]
        ids = {s[0] for s in stored for k in keys if s[1 + k[0]] == k[1]}
        if ids:
            actions[i], where = ("existing", ids.pop()) if len(ids) == 1 else ("conflict", None)
            root = ("stored", i)
        else:
            root = next((seen[k] for k in keys if k in seen), ("new", i))
            actions[i], where = ("insert" if root == ("new", i) else "batch_duplicate"), root
        for k in keys:
            seen[k] = root
        out[i] = where
    new = {i: top + n for n, i in enumerate(sorted(i for i, a in actions.items() if a == "insert"), 1)}
    find = lambda w: new[w[1]] if w[0] == "new" else (None if actions[w[1]] == "conflict" else out[w[1]])
    return {i: (actions[i], find(w) if isinstance(w, tuple) else w) for i, w in out.items()}


@pytest.mark.parametrize("seed", range(3))
def test_load_plan_against_a_walk(spark, seed):
    rng = random.Random(seed)
    row = lambda i: (i, rng.choice([None, f"d{rng.randrange(25)}"]), rng.choice([None, f"u{rng.randrange(25)}"]))
    stored, incoming = [row(i) for i in range(1, 8)], [row(100 + i) for i in range(40)]
    schema = "id bigint, a string, b string"
    new, old = spark.createDataFrame(incoming + [(None, "d1", "u1")], schema), spark.createDataFrame(stored, schema).withColumnRenamed("id", "stored_id")
    plan = loading.load_plan(new, "id", old, "stored_id", {"a": (F.col("a"), F.col("a")), "b": (F.col("b"), F.col("b"))}, [F.col("id")])
    assert {r.id: (r.action, r.stored_id) for r in plan.collect()} == walk(incoming, stored)


def test_load(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", 5)], "k string, stored_id bigint").select(F.col("k"), F.col("stored_id").alias("paper_id")).write.parquet(path)
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "id bigint, k string")
    stored = spark.read.parquet(path)
    plan = loading.load_plan(new, "id", stored, "paper_id", {"k": (F.col("k"), F.col("k"))}, [F.col("id")])
    assert loading.load(new, plan, "id", path, "paper_id") == {"existing": 1, "insert": 2, "batch_duplicate": 1} and spark.read.parquet(path).count() == 1
    loading.load(new, plan, "id", path, "paper_id", apply=True)
    assert {(r.paper_id, r.k) for r in spark.read.parquet(path).collect()} == {(5, "a"), (6, "b"), (7, None)}
    with pytest.raises(ValueError):
        loading.load(new, plan.withColumn("action", F.lit("conflict")), "id", path, "paper_id", apply=True)


def test_hashed_embedding(spark):
    df = spark.createDataFrame([("b a B",), ("  .",), (None,)], "t string")
    a, b, c = (r[0] for r in df.select(loading.hashed_embedding(F.col("t"), 32)).collect())
    place = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 32
    assert b is c is None and len(a) == 32 and a[place("b")] == pytest.approx(2 / math.sqrt(5)) and a[place("a")] == pytest.approx(1 / math.sqrt(5))


def test_index(spark):
    schema = "doc int, section string, chunk_index int, content string, token_count int"
    old = loading.indexed_chunks(spark.createDataFrame([(1, "a", 0, "old one", 2), (1, "a", 1, "old two", 2)], schema), "doc", None)
    new = spark.createDataFrame([(1, "a", 0, "new one", 2), (2, "a", 0, "two", 1), (2, "a", 0, "longer two", 2), (None, "a", 0, "x", 1)], schema)
    rows = lambda d: sorted((r.doc, r.chunk_index, r.content) for r in d.collect())
    assert rows(loading.indexed_chunks(new, "doc", old)) == [(1, 0, "old one"), (1, 1, "old two"), (2, 0, "longer two")]
    forced = loading.indexed_chunks(new, "doc", old, force=True)
    assert rows(forced) == [(1, 0, "new one"), (2, 0, "longer two")] and all(len(r.embedding) == 64 for r in forced.collect())
    assert loading.indexed_chunks(new.limit(0), "doc", None).count() == 0


def test_prepared_errors(spark):
    columns = loading.TABLES["news"]["columns"]
    rows = [(i, {"url": u}) for i, u in enumerate(("https://h.example/a", "ftp://h.example", "https://user@h.example", "https://", " HTTP://h.example "), 1)]
    kinds = {"texts": "array<string>", "timestamp": "timestamp"}
    df = spark.createDataFrame([(i, r["url"]) for i, r in rows], "news_id bigint, url string")
    df = df.select("news_id", *(F.col("url") if c == "url" else F.lit("x" if k not in kinds else None if k == "texts" else "2025-01-01").cast(kinds.get(k, "string")).alias(c) for c, k in columns.items()))
    got = {r.news_id: r.errors for r in loading.prepared(df, "news").collect()}
    assert got == {1: [], 2: ["url:url"], 3: ["url:url"], 4: ["url:url"], 5: []} and all(re.fullmatch("[0-9a-f]{64}", r.content_hash) and r.keywords == [] for r in loading.prepared(df, "news").collect())


def test_hot_keys_are_spread(spark, monkeypatch):
    monkeypatch.setattr(skew, "BLOCK", 50)
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 1000).alias("k"), "id", F.lit("x").alias("n"))
    one = df.groupBy("k").agg(F.min("id").alias("least"))
    for how in ("inner", "left", "left_semi"):
        got = skew.spread_join(df, one.where("k <> 1001"), ["k"], "id", how)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.join(one.where("k <> 1001"), "k", how).collect()))
    largest = skew.spread_join(df, one, ["k"], "id").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        sizes = [r["count"] for r in skew.spread_join(df, one, ["k"], "id").groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 2 * 3000 / 16 and largest
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_previous_of_key(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, rng.randrange(40)]), i) for i in range(400)]
    got = {r.o: r.before for r in skew.previous_of_key(spark.createDataFrame(rows, "k int, o int").repartition(5), "k", "o", "o", "before").collect()}
    last, want = {}, {}
    for k, o in rows:
        want[o] = last.get(k)
        last[k] = o
    assert got == want
