"""The property graph of papers, news and what they name, as node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import grid_join
from .tables import materialize


def author_names(authors: Column) -> Column:
    """The names of a JSON array of strings or of a list separated by `;`, trimmed, blank ones left out. Null: empty."""
    parsed = F.from_json(authors, "array<string>")
    listed = F.when(F.trim(authors).startswith("["), F.coalesce(parsed, F.array().cast("array<string>"))).otherwise(F.split(authors, ";"))
    trimmed = F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda x: F.trim(x))
    return F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))


def paper_edges(papers: DataFrame) -> DataFrame:
    """(src, dst, type), each once: Author -WRITTEN_BY-> Paper, Paper -HAS_KEYWORD-> Keyword, Paper -PUBLISHED_BY-> Source.

    Nodes are named `<label>:<key>`. Null and blank names make no edge; repeated rows and names make one."""
    paper = F.concat(F.lit("Paper:"), F.col("paper_id").cast("string"))
    named = lambda label, c: F.concat(F.lit(label + ":"), c)
    base = papers.where("paper_id is not null")
    keywords = F.filter(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: k.isNotNull() & (F.trim(k) != ""))
    edge = lambda src, dst, kind: F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"))
    all_edges = F.concat(
        F.transform(author_names(F.col("authors")), lambda a: edge(named("Author", a), paper, "WRITTEN_BY")),
        F.transform(keywords, lambda k: edge(paper, named("Keyword", F.trim(k)), "HAS_KEYWORD")),
        F.when(F.trim(F.coalesce("source", F.lit(""))) != "", F.array(edge(paper, named("Source", F.trim("source")), "PUBLISHED_BY"))).otherwise(
            F.array().cast("array<struct<src:string,dst:string,type:string>>")
        ),
    )
    return base.select(F.explode(all_edges).alias("e")).select("e.src", "e.dst", "e.type").distinct()


def nodes(edges: DataFrame) -> DataFrame:
    """(id, label, degree): every node of the edges, with how many it has."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree")).withColumn("label", F.substring_index("id", ":", 1))


def related(edges: DataFrame, seeds: DataFrame, types: list[str], limit: int) -> DataFrame:
    """(seed, related, relation_score, relation_paths, rank): related_to_sets with each seed as a set of its own. seeds: one column `seed`."""
    return related_to_sets(edges, seeds.select(F.col("seed").alias("own"), "seed"), types, limit, "own").withColumnRenamed("own", "seed")


def related_to_sets(edges: DataFrame, seeds: DataFrame, types: list[str], limit: int, set_id: str = "query_id") -> DataFrame:
    """(set_id, related, relation_score, relation_paths, rank): the papers within one or two hops of any seed of a set over edges of the types, in
    either direction, without the seeds themselves, by their number of paths from all seeds; the first `limit` per set (ties:
    smaller name). relation_paths: the edge types of these paths, joined by `>`, in order. seeds: set_id and `seed`; repeated and unknown ones add nothing.

    Paths that meet at one node are counted together before the second hop is joined, and a node that many papers share is joined in cells."""
    used = edges.where(F.col("type").isin(*types)).select("src", "dst", "type").distinct()
    both = materialize(used.union(used.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type")), "both")
    seeds = seeds.select(set_id, "seed").where(F.col("seed").isNotNull()).distinct()
    first = grid_join(seeds.withColumnRenamed("seed", "src"), both, ["src"], set_id, "dst").groupBy(set_id, F.col("dst").alias("src"), F.col("type").alias("by")).agg(F.count("*").alias("n"))
    first = materialize(first, "first")
    second = grid_join(first, both, ["src"], set_id, "dst").select(set_id, F.col("dst").alias("related"), F.concat_ws(">", "by", "type").alias("path"), "n")
    paths = first.select(set_id, F.col("src").alias("related"), F.col("by").alias("path"), "n").union(second).where("related like 'Paper:%'")
    per_path = paths.groupBy(set_id, "related", "path").agg(F.sum("n").alias("n"))  # fewer than the square of the types for each paper
    counted = per_path.groupBy(set_id, "related").agg(F.sum("n").alias("relation_score"), F.array_sort(F.collect_set("path")).alias("relation_paths"))
    counted = counted.join(seeds.withColumnRenamed("seed", "related"), [set_id, "related"], "left_anti")
    order = Window.partitionBy(set_id).orderBy(F.desc("relation_score"), "related")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def paper_context(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """(paper_id, title, authors, keywords, sources): every paper with the sorted names of its neighbours; empty lists for what it lacks."""
    named = lambda c: F.regexp_replace(c, "^[A-Za-z]+:", "")
    ends = edges.select(
        F.when(F.col("type") == "WRITTEN_BY", F.col("dst")).otherwise(F.col("src")).alias("paper"), "type", named(F.when(F.col("type") == "WRITTEN_BY", F.col("src")).otherwise(F.col("dst"))).alias("name")
    )
    of = lambda kind, name: F.array_sort(F.collect_set(F.when(F.col("type") == kind, F.col("name")))).alias(name)
    per = ends.groupBy("paper").agg(of("WRITTEN_BY", "authors"), of("HAS_KEYWORD", "keywords"), of("PUBLISHED_BY", "sources"))
    none = F.array().cast("array<string>")
    own = papers.where("paper_id is not null").select("paper_id", "title", F.concat(F.lit("Paper:"), F.col("paper_id").cast("string")).alias("paper"))
    return own.join(per, "paper", "left").select("paper_id", "title", *(F.coalesce(c, none).alias(c) for c in ("authors", "keywords", "sources")))


def unsynced(docs: DataFrame, id_col: str, synced: DataFrame | None = None) -> DataFrame:
    """docs that the graph doesn't have: those not marked graph_synced or, with a table of synced ids, those not in it."""
    if synced is None:
        return docs.where(~F.coalesce("graph_synced", F.lit(False)))
    return docs.join(synced.select(id_col).distinct(), id_col, "left_anti")


def mark_synced(docs: DataFrame, id_col: str, done: DataFrame) -> DataFrame:
    """docs with graph_synced set for the ids in `done` and left as it is for others."""
    marks = done.select(id_col).distinct().withColumn("_done", F.lit(True))
    return docs.join(marks, id_col, "left").withColumn("graph_synced", F.coalesce("_done", "graph_synced", F.lit(False))).drop("_done")
