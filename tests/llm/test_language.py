import pickle

from pyspark.sql import functions as F

from quillwork.llm import language as L


def mixed():
    en, es, ko, ja, id_ = (L.SEEDS[k] for k in ("en", "es", "ko", "ja", "id"))
    return en, es, ko, ja, id_


def test_labels(spark):
    cases = {"en": "en", "EN": "en", "en-GB": "en", "eng": "en", " English ": "en", "ko_KR": "ko", "Korean": "ko", "jpn": "ja", "es-MX": "es", "ind": "id", "fr": "fr", "한국어": "ko"}
    cases |= {None: None, "": None, " ": None, "und": None, "unknown": None, "xx": None, "n/a": None}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r.x: r.c for r in df.select("x", L.label_code(F.col("x")).alias("c")).collect()} == cases


def test_runs_cover_the_text_and_find_the_passage():
    en, es, ko, ja, id_ = mixed()
    c = L.Compressors({k: L.squeezed(v) for k, v in L.SEEDS.items()})
    texts = [en + "\n\n" + es[:400] + "\n\n" + en, ko, ja, id_, "", "   ", "12 34 -- 56", en.replace(" ", ""), es.lower().replace(".", ""), en.upper()]
    runs = L.segment_languages(texts, c)
    names = [[c.languages[r[2]] for r in x] for x in runs]
    assert names[0] == ["en", "es", "en"] and names[1:4] == [["ko"], ["ja"], ["id"]] and names[4:6] == [[], []]
    assert names[7] == ["en"] and names[8] == ["es"] and names[9] == ["en"]
    for t, r in zip(texts, runs):
        assert not r or (r[0][0] == 0 and r[-1][1] == len(t) and all(a[1] == b[0] for a, b in zip(r, r[1:])))
    assert abs(runs[0][1][0] - len(en)) < 10


def test_fit_survives_wrong_labels():
    en, es, ko, ja, id_ = mixed()
    rows = [("ko", en), ("en", es), (None, ko), ("es", ja), ("ja", id_)] * 4
    c = L.Compressors(L.fit(rows))
    assert [c.languages[r[0][2]] for r in L.segment_languages([en, es, ko, ja, id_], c)] == ["en", "es", "ko", "ja", "id"]


def test_documents(spark):
    en, es, ko, *_ = mixed()
    rows = [(1, en * 5, "x"), (2, None, "x"), (3, "", "x"), (4, en + "\n" + ko, None), (4, en + "\n" + ko, None)]
    df = spark.createDataFrame(rows, "id bigint, t string, lang string")
    content = {k: L.squeezed(v) for k, v in L.SEEDS.items()}
    got = L.document_languages(df, ["id"], F.col("t"), content).collect()
    by = {r.id: r for r in got}
    assert len(got) == 5 and by[1].lang == "en" and 0 < by[1].confidence <= 1 and by[2].lang is None and by[3].runs == [] and {r.lang for r in by[4].runs} == {"en", "ko"}
    assert L.document_languages(df.limit(0), ["id"], F.col("t"), content).count() == 0
    assert pickle.loads(pickle.dumps(content)) == content


def test_sample_is_bounded(spark):
    df = spark.range(400).select("id", F.lit("some text").alias("t"), F.when(F.col("id") % 2 == 0, "en").otherwise("zz").alias("l"))
    rows = L.training_sample(df, "id", F.col("t"), F.col("l"), per_label=8)
    assert len(rows) == 16 and {r[0] for r in rows} == {"en", None}
