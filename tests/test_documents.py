import datetime

import pytest
from pyspark.sql import functions as F

from quillwork.operators import documents, quality
from quillwork.sources import feeds
from quillwork.streaming import news


def one(spark, column, schema, row):
    return spark.createDataFrame([row], schema).select(column).first()[0]


def test_token_windows():
    assert documents.token_windows(10, 4, 1) == [(0, 4), (3, 7), (6, 10)] and documents.token_windows(0, 4, 1) == [] and documents.token_windows(4, 4, 1) == [(0, 4)]
    with pytest.raises(ValueError):
        documents.token_windows(5, 4, 4)


def test_token_chunks(spark):
    df = spark.createDataFrame([(1, "word " * 1000, "end"), (2, None, "  "), (3, "", None)], "id bigint, a string, section string")
    rows = documents.token_chunks(df, ["id"], ["a", "section"], 300, 50).orderBy("chunk_index").collect()
    assert {r.id for r in rows} == {1} and [r.chunk_index for r in rows] == list(range(len(rows))) and rows[-1].content == "end"
    assert all(r.token_count <= 300 for r in rows)


def test_numbers_and_support(spark):
    got = one(spark, quality.unsupported_numbers(F.col("t"), F.col("s")), "t string, s array<string>", ("1,200 fans, 35% and v2 in 2024; 7", ["about 1200 in 2024", None]))
    assert got == ["35%", "7"]
    assert one(spark, quality.unsupported_numbers(F.col("t"), F.col("s")), "t string, s array<string>", (None, None)) == []
    assert one(spark, quality.support_score(F.col("t"), F.col("s")), "t string, s array<string>", ("guitars sounded loudly", ["Guitars, loudly"])) == pytest.approx(2 / 3)


def test_sentences_and_targets(spark):
    good = "The members of the club answered every question that we asked them [12] (Smith, 2020). "
    text = good * 3 + "Too short. " + "https://x.example is a link in a sentence that is long enough to count. " + "No end to this sentence at all it just goes on"
    kept = one(spark, quality.training_sentences(F.col("t")), "t string", (text,))
    assert kept == ["The members of the club answered every question that we asked them ."] * 3
    assert one(spark, quality.training_sentences(F.col("t")), "t string", (None,)) == []
    target = quality.section_target(quality.training_sentences(F.col("t")), 20, 30)
    assert len(one(spark, target, "t string", (text,)).split()) == 26
    assert one(spark, target, "t string", (good,)) is None


def test_inverted_index(spark):
    for t in ("b a b  c", "x", None, "  "):
        index = quality.inverted_index(F.col("t"))
        assert one(spark, quality.abstract_from_index(index), "t string", (t,)) == (" ".join(t.split()) or None if t else None)


def test_row_ids_and_repeats(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k"), F.lit("x").alias("_p2"))
    got = quality.with_row_ids(df, "n", 100, [F.col("k")]).orderBy("n").collect()
    assert [(r.k, r.n) for r in got] == [(i, 101 + i) for i in range(500)]
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "id bigint, k string")
    assert [r.is_repeat for r in quality.first_of_equal(rows, F.col("k"), F.col("id")).orderBy("id").collect()] == [False, True, False, False]


def test_load_errors(spark):
    df = spark.createDataFrame([("한국", ["a"]), ("abc", ["x\0"]), (None, None)], "t string, k array<string>")
    got = [r[0] for r in df.select(documents.load_errors(df, {"t": 2, "k": None}, ["t"])).collect()]
    assert got == [[], ["t:length", "k:nul"], ["t:required"]]


def test_article(spark):
    got = one(spark, documents.clean_article(F.col("c"), F.col("t"), r"^watch .* below"), "c string, t string", ("My Title!\n\n  one \t two\nWatch it below now\nrest", "my title"))
    assert got == "one two"


def test_feed(spark, tmp_path):
    item = "<item><title>{t}</title><link>{u}</link><pubDate>{d}</pubDate><description>{s}</description><category>c</category></item>"
    items = [
        item.format(t="Fans &amp; tours", u="https://n.example/a?utm_source=x", d="Mon, 05 Jan 2026 10:00:00 +0900", s="a &lt;b&gt;tour&lt;/b&gt;"),
        item.format(t="Old tour", u="https://n.example/b", d="Mon, 06 Jan 2020 10:00:00 GMT", s=""), item.format(t="tour", u="https://n.example/c", d="yesterday", s=""),
        item.format(t="Other", u="https://n.example/d", d="Mon, 05 Jan 2026 10:00:00 GMT", s="nothing"),
    ]
    (tmp_path / "f.xml").write_text("<rss><channel>" + "".join(items) + "</channel></rss>")
    as_of = F.lit(datetime.datetime(2026, 1, 10, tzinfo=datetime.timezone.utc))
    rows = feeds.feed_news(feeds.read_feed(spark, str(tmp_path / "f.xml")), as_of, 365, {"tour": "tour"}).collect()
    assert sorted(r.status for r in rows) == ["accepted", "invalid", "outside_date_window", "outside_topics"]
    ok = next(r for r in rows if r.status == "accepted")
    assert ok.title_original == "Fans & tours" and ok.published_at == datetime.datetime(2026, 1, 5, 1, 0) and len(ok.id) == 29


def test_works(spark, tmp_path):
    (tmp_path / "w.json").write_text(
        '{"id": "https://w.example/W12", "title": "Fans online", "type": "article", "publication_year": 2020, "doi": "https://doi.org/10.1234/AB", '
        '"abstract_inverted_index": {"posts": [1], "many": [0, 2]}, "best_oa_location": {"is_oa": true, "pdf_url": "https://p.example/a.pdf"}, '
        '"authorships": [{"author": {"display_name": "A"}}, {"author": null}]}\n{"id": "https://w.example/W13", "title": "Fans", "type": "book", "publication_year": 2020}\nnot json\n'
    )
    rows = feeds.normalized_works(feeds.read_works(spark, str(tmp_path / "w.json")), "fans", {"p": "posts"}, 2026).collect()
    assert len(rows) == 1 and rows[0].id == "W12" and rows[0].abstract == "many posts many" and rows[0].doi == "10.1234/ab" and rows[0].authors == ["A"]
    assert [x.url for x in rows[0].source_locations] == ["https://p.example/a.pdf"] and rows[0].relevance_score == 6


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"https://n.example/{i % 5}?utm_x={i}", datetime.datetime(2026, 1, 1, 0, i)) for i in range(12)]
    df = spark.createDataFrame(rows, "url string, collected_at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    news.run_once(news.first_deliveries(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == news.first_deliveries(df).count() == 5
    counts = news.windowed_counts(df, "collected_at", [], "5 minutes").orderBy("window_start").collect()
    assert [r.n for r in counts] == [5, 5, 2]
