from pyspark.sql import functions as F

from quillwork.functions import identity


def values(spark, f, items):
    return [r[0] for r in spark.createDataFrame([(x,) for x in items], "x string").select(f(F.col("x"))).collect()]


def test_doi(spark):
    same = ["10.1234/Ab.c", "https://doi.org/10.1234/ab.C", "http://dx.doi.example/10.1234/ab.c", "DOI: 10.1234/AB.C", " 10.1234%2Fab.c ", "https://www.doi.example/10.1234/ab.c"]
    assert set(values(spark, identity.doi_key, same)) == {"10.1234/ab.c"}
    assert set(values(spark, identity.doi_key, [None, "", " ", "n/a", "10.", "0", "pending", "%", "10.12"])) == {None}


def test_url(spark):
    same = ["https://a.example/x?b=2&a=1", "http://www.A.example/x/?a=1&b=2&utm_source=f#top", "a.example/x?gclid=9&a=1&b=2", "https://a.example/x?fbclid=1&a=1&b=2"]
    assert set(values(spark, identity.url_key, same)) == {"a.example/x?a=1&b=2"}
    assert set(values(spark, identity.url_key, [None, "", "n/a", "none"])) == {None}
    assert values(spark, identity.url_or_doi_key, ["https://doi.example/10.1234%2FX?utm_a=1", "https://b.example/"]) == ["doi:10.1234/x", "url:b.example"]


def test_hash_and_split(spark):
    h = "A" * 63 + "b"
    assert values(spark, identity.hash_key, [h, h.lower() + " ", identity.EMPTY_SHA256, "0" * 64, "abc", None]) == [h.lower(), h.lower(), None, None, None, None]
    assert values(spark, identity.split_name, ["TEST", " valid", "dev", "train", "x", None]) == ["test", "validation", "validation", "train", None, None]
