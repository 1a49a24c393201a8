import pytest
from pyspark.sql import functions as F

from quillwork.operators import entities, graph

ENTRY = "entity_type string, name_ko string, name_en string, aliases array<string>, authority_url string, source_urls array<string>"


def known(spark, *rows):
    return entities.catalogue(spark.createDataFrame([(t, ko, en, al, f"https://a.example/{i}", ["https://e.example"]) for i, (t, ko, en, al) in enumerate(rows)], ENTRY))


def test_catalogue_problems(spark):
    ok = ("Group", None, "X", None, "https://a.example/1", ["https://e.example"])
    rows = [ok, ("Group", None, "Y", [" ", "X2", None], "https://a.example/2", ["https://e.example"]), ("Town", *ok[1:]), (None, *ok[1:]), (*ok[:4], "http://a.example", ok[5]), (*ok[:4], None, ok[5]), (*ok[:5], []), (*ok[:5], None),
            (*ok[:5], ["http://e.example"]), ("Group", None, None, ["  "], "https://a.example/3", ok[5]), ("Album", *ok[1:4], "https://a.example/9", ok[5]), ("Album", None, "Z", None, "https://a.example/9", ok[5])]
    got = entities.catalogue(spark.createDataFrame(rows, ENTRY)).collect()
    assert sorted((r.problem or "") for r in got) == sorted(["", "", "type", "type", "authority", "authority", "evidence", "evidence", "evidence", "name", "repeated", "repeated"])
    y = next(r for r in got if r.canonical_name == "Y")
    assert y.aliases == ["Y", "X2"] and y.entity_id.startswith("group_") and len(y.entity_id) == 6 + 24
    assert entities.catalogue(spark.createDataFrame([], ENTRY)).count() == 0


def test_mentions(spark):
    cat = known(spark, ("Group", None, "BTS", ["Blue Whale"]), ("Group", None, "Twin", None), ("Person", None, "twin", None), ("Drama", "푸른 바다", "Blue Sea", None))
    texts = ["The Blue  Whale and bts.", "bluewhale BTSX BTS의 xBlue Whale", None, "Twin", "푸른 바다는 좋다. Blue whale's song", "새푸른 바다", ""]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id int, t string, alias string")
    got = {(r.id, r.alias, r.entity_type, r.status, r.confidence) for r in entities.mentions(df.union(df), "id", F.col("t"), cat).collect()}
    assert got == {(0, "bts", "Group", "resolved", 1.0), (3, "twin", None, "unresolved", 0.0), (4, "푸른 바다", "Drama", "resolved", 1.0), (4, "blue whale", "Group", "resolved", 1.0)}
    assert entities.mentions(df, "id", F.col("t"), cat.limit(0)).count() == entities.mentions(df.limit(0), "id", F.col("t"), cat).count() == 0
    nodes, edges = entities.mention_graph(entities.mentions(df, "id", F.col("t"), cat), "id", "News")
    assert {(e.src, e.type) for e in edges.collect()} == {("News:0", "MENTIONS"), ("News:4", "MENTIONS")} and {n.label for n in nodes.collect()} == {"Group", "Drama"}


def test_too_many_aliases(spark, monkeypatch):
    monkeypatch.setattr(entities, "MOST_ALIASES", 1)
    with pytest.raises(ValueError):
        entities.mentions(spark.createDataFrame([(1, "x")], "id int, t string"), "id", F.col("t"), known(spark, ("Group", None, "A", ["B"])))


def test_quoted_titles(spark):
    df = spark.createDataFrame([(1, "‘푸른 밤’ and “an English one”", "《바다》 " + "x" * 2100 + "《하늘》"), (2, None, None)], "id int, a string, b string")
    assert {(r.id, r.surface) for r in entities.quoted_titles(df, "id", F.col("a"), F.col("b")).collect()} == {(1, "푸른 밤"), (1, "바다")}


def test_protection_round_trip(spark):
    names = [("BTS", "Bangtan"), ("BTS Army", "The Army"), ("푸른", "Blue"), ("bts", "again"), ("absent", "Absent"), ("x", None)]
    df = spark.createDataFrame([(1, names, "BTS Army and bts", "푸른은 BTSX [BTS]"), (2, None, "t", None), (3, [], None, "")], "id int, n array<struct<surface:string,name:string>>, title string, body string")
    got = {r.id: r for r in entities.protected(df, F.col("n"), ["title", "body"]).collect()}
    m = entities.MARKER
    assert (got[1].title, got[1].body) == (f"{m}0000 and {m}0001", f"{m}0002은 BTSX [{m}0001]") and [x["name"] for x in got[1].markers] == ["The Army", "Bangtan", "Blue"]
    assert (got[2].title, got[2].body, got[2].markers) == ("t", None, []) and got[3].body == ""
    moved = spark.createDataFrame([(got[1].markers, got[1].title, f"{m}0001 und {m}0000"), (got[1].markers, got[1].title, f"{m}0000")], "m array<struct<marker:string,name:string>>, s string, t string")
    assert [r[0] for r in moved.select(entities.restored(F.col("t"), F.col("s"), F.col("m"))).collect()] == ["Bangtan und The Army", None]


def test_graph_context_and_sync(spark):
    rows = [(1, "T", '["A: B"]', ["k"], "S", True), (2, None, None, None, None, None), (3, "U", "C", None, " ", False)]
    papers = spark.createDataFrame(rows, "paper_id bigint, title string, authors string, keywords array<string>, source string, graph_synced boolean")
    got = {r.paper_id: (r.authors, r.keywords, r.sources) for r in graph.paper_context(graph.paper_edges(papers), papers).collect()}
    assert got == {1: (["A: B"], ["k"], ["S"]), 2: ([], [], []), 3: (["C"], [], [])}
    assert {r.paper_id for r in graph.unsynced(papers, "paper_id").collect()} == {2, 3}
    done = graph.mark_synced(papers, "paper_id", papers.where("paper_id = 2"))
    assert {r.paper_id: r.graph_synced for r in done.collect()} == {1: True, 2: True, 3: False} and {r.paper_id for r in graph.unsynced(papers, "paper_id", papers.where("paper_id < 3")).collect()} == {3}
