from quillwork.llm import checks, queries


def test_runs_of_sixteen_words(spark):
    words = [f"w{i}" for i in range(20)]
    rows = [(" ".join(words), " ".join(words[2:])), ("x " + " ".join(words[:16]) + " y", "<b>" + ", ".join(words).upper()), (" ".join(words[:15]), " ".join(words)), (None, "a"), ("a", None), ("", "")]
    df = spark.createDataFrame(rows, "t string, p string")
    assert [r[0] for r in df.select(checks._has_run("t", "p")).collect()] == [True, True, False, False, False, False]


def test_the_found_queries_come_first():
    first = {}
    for name in queries.queries():
        first.setdefault(name.split("_")[0], name)
    assert first["p7"] == "p7_containers" and all(first[f"p{n}"] == f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 8, 9))
    assert set(queries.oracle_sql()) <= set(queries.queries())
