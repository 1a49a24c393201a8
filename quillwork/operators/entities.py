"""Named entities: a checked catalogue, mentions in documents, names protected in translation, and the graph of mentions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import bound

# The types of entities.
TYPES = ("Artist", "Group", "Person", "Work", "Drama", "Movie", "Album", "Song", "Fandom", "Platform", "Company", "Topic")
# Quoted Korean titles, and how far into a text they are looked for.
QUOTED_TITLE, TITLE_REACH = r"[‘“〈《]([^’”〉》\n]{2,40})[’”〉》]", 2000
MARKER = "ENTITYPROTECTTOKEN"
#: A catalogue travels with the plan, so it may have so many aliases at most.
MOST_ALIASES = 20_000


def alias_key(name: Column) -> Column:
    """A name in lower case with single blanks."""
    return F.lower(F.trim(F.regexp_replace(name, r"(?U)\s+", " ")))


def catalogue(entries: DataFrame) -> DataFrame:
    """(entity_id, entity_type, name_ko, name_en, canonical_name, aliases, source_urls, problem) of entries: entity_type, name_ko, name_en, aliases, authority_url, source_urls.

    The id is the type with a hash of the authority. problem says why an entry can't be used, and is null if it can: type, authority (no https URL), evidence (none, or one without https),
    name (no name or alias), repeated (several entries of one id; all of them have it)."""
    names = F.array_distinct(F.filter(F.concat(F.array("name_ko", "name_en"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: F.trim(x) != ""))
    secure = lambda u: F.coalesce(u.rlike(r"^https://[^/\s:@]+"), F.lit(False))
    entity_id = F.concat_ws("_", F.lower("entity_type"), F.substring(F.sha2("authority_url", 256), 1, 24))
    problem = F.coalesce(
        F.when(~F.coalesce(F.col("entity_type").isin(*TYPES), F.lit(False)), "type"), F.when(~secure(F.col("authority_url")), "authority"),
        F.when((F.coalesce(F.size("source_urls"), F.lit(0)) < 1) | ~F.forall(F.coalesce("source_urls", F.array().cast("array<string>")), secure), "evidence"), F.when(F.size(names) == 0, "name"),
    )
    rows = entries.select(entity_id.alias("entity_id"), "entity_type", "name_ko", "name_en", F.coalesce("name_en", "name_ko").alias("canonical_name"), names.alias("aliases"), "source_urls", problem.alias("p"))
    again = rows.where("p is null").groupBy("entity_id").agg(F.count("*").alias("n")).where("n > 1").select("entity_id", F.lit("repeated").alias("r"))
    return rows.join(again, "entity_id", "left").withColumn("problem", F.coalesce("p", "r")).drop("p", "r")


def _around(alias: str) -> str:
    """The alias as a pattern of its own: a Korean name may have particles after it, a Latin one ends with its word."""
    after = "A-Za-z0-9" if re.search("[가-힣]$", alias) else "A-Za-z0-9가-힣"
    return rf"(?iu)(?<![A-Za-z0-9가-힣])(?:{re.escape(alias)})(?![{after}])"


def mentions(docs: DataFrame, id_col: str, text: Column, known: DataFrame) -> DataFrame:
    """(id_col, alias, entity_id, entity_type, canonical_name, status, confidence): the catalogue's names that stand in a document, letter case aside.

    A name of one entity is resolved (confidence 1); one that several entities have is unresolved (0, no entity). known: rows of catalogue without
    problem. Its aliases are collected, MOST_ALIASES at most; names of one Latin word are looked up among the document's words, only others are searched for one by one.
    Null texts mention nothing; a document mentions a name once.
    """
    usable = known.where("problem is null").select(F.explode("aliases").alias("a"), "entity_id", "entity_type", "canonical_name")
    per = usable.groupBy(alias_key(F.col("a")).alias("alias")).agg(F.countDistinct("entity_id").alias("n"), F.min(F.struct("entity_id", "entity_type", "canonical_name")).alias("e"))
    rows = per.select("alias", F.when(F.col("n") == 1, F.col("e")).alias("e")).limit(MOST_ALIASES + 1).collect()
    if len(rows) > MOST_ALIASES:
        raise ValueError(f"a catalogue may have {MOST_ALIASES} aliases at most")
    words = sorted(r["alias"] for r in rows if re.fullmatch("[a-z0-9]+", r["alias"]))
    others = sorted(r["alias"] for r in rows if not re.fullmatch("[a-z0-9]+", r["alias"]))
    of_words = F.filter(F.split(F.lower(text), "[^a-z0-9가-힣]+"), lambda w: w.isin(*words)) if words else F.array().cast("array<string>")
    searched = F.array_compact(F.array(*(F.when(text.rlike(_around(a)), a) for a in others))) if others else F.array().cast("array<string>")
    found = docs.select(id_col, F.explode(F.array_distinct(F.concat(of_words, searched))).alias("alias")).distinct()
    resolved = [r for r in rows if r["e"]]
    if resolved:
        table = F.create_map(*[F.lit(x) if isinstance(x, str) else x for r in resolved for x in (r["alias"], F.struct(*(F.lit(r["e"][c]).alias(c) for c in ("entity_id", "entity_type", "canonical_name"))))])
        found = found.withColumn("e", F.try_element_at(table, F.col("alias")))
    else:
        found = found.withColumn("e", F.lit(None).cast("struct<entity_id:string,entity_type:string,canonical_name:string>"))
    done = F.col("e").isNotNull()
    return found.select(id_col, "alias", "e.entity_id", "e.entity_type", "e.canonical_name", F.when(done, "resolved").otherwise("unresolved").alias("status"), F.when(done, 1.0).otherwise(0.0).alias("confidence"))


def quoted_titles(docs: DataFrame, id_col: str, title: Column, text: Column) -> DataFrame:
    """(id_col, surface): quoted Korean titles near the beginning of a document, as candidates that no catalogue asserts."""
    found = F.regexp_extract_all(F.concat_ws("\n", title, F.substring(text, 1, TITLE_REACH)), F.lit(QUOTED_TITLE), F.lit(1))
    return docs.select(id_col, F.explode(F.array_distinct(F.transform(found, lambda x: F.trim(x)))).alias("surface")).where(F.col("surface").rlike("[가-힣]"))


def protected(docs: DataFrame, names: Column, columns: list[str]) -> DataFrame:
    """docs with the columns' names replaced by numbered markers, longest names first, and `markers`, array<struct<marker, name>> of those that occur.

    names: array<struct<surface, name>>, the verified names of the row and what they become in the translation. Null texts stay null."""
    by_length = F.array_sort(names, lambda a, b: F.when(F.char_length(a.surface) > F.char_length(b.surface), -1).when(F.char_length(a.surface) < F.char_length(b.surface), 1).when(a.surface < b.surface, -1).when(a.surface > b.surface, 1).otherwise(0))
    once = bound(F.filter(by_length, lambda x: (F.trim(x.surface) != "") & x["name"].isNotNull()), lambda s: F.filter(s, lambda x, i: F.array_position(F.transform(s, lambda y: alias_key(y.surface)), alias_key(x.surface)) == i + 1))
    after = lambda s: F.when(s.rlike("[가-힣]$"), F.lit(r"(?![A-Za-z0-9])")).otherwise(F.lit("(?![A-Za-z0-9가-힣])"))
    pattern = lambda s: F.concat(F.lit(r"(?iu)(?<![A-Za-z0-9가-힣])\Q"), s, F.lit(r"\E"), after(s))
    start = F.struct(*(F.col(c).alias(c) for c in columns), F.lit(0).alias("n"), F.array().cast("array<struct<marker:string,name:string>>").alias("markers"))

    def step(acc: Column, x: Column) -> Column:
        marker = F.concat(F.lit(MARKER), F.lpad(acc.n.cast("string"), 4, "0"))
        new = {c: F.regexp_replace(acc[c], pattern(x.surface), marker) for c in columns}
        changed = F.lit(False)
        for c in columns:
            changed = changed | F.coalesce(new[c] != acc[c], F.lit(False))
        return F.struct(*(new[c].alias(c) for c in columns), F.when(changed, acc.n + 1).otherwise(acc.n).alias("n"), F.when(changed, F.concat(acc.markers, F.array(F.struct(marker.alias("marker"), x["name"].alias("name"))))).otherwise(acc.markers).alias("markers"))

    done = docs.withColumn("_a", F.aggregate(F.coalesce(once, F.array().cast("array<struct<surface:string,name:string>>")), start, step))
    return done.drop(*columns).select("*", *(F.col(f"_a.{c}").alias(c) for c in columns), F.col("_a.markers").alias("markers")).drop("_a")


def restored(translated: Column, source: Column, markers: Column) -> Column:
    """The translation with its markers replaced by their names; null if it doesn't have each of the source's markers exactly as often."""
    often = lambda t, m: (F.char_length(t) - F.char_length(F.replace(t, m, F.lit("")))) / F.char_length(m)
    kept = F.forall(markers, lambda m: often(translated, m.marker) == often(source, m.marker))
    return F.when(kept, F.aggregate(markers, translated, lambda acc, m: F.replace(acc, m.marker, m["name"])))


def mention_graph(found: DataFrame, id_col: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of resolved mentions: nodes (id, label, name) of entities, with their type as label; edges (src, dst, type) from the documents, each once."""
    done = found.where("status = 'resolved'")
    entity = F.concat(F.lit("Entity:"), F.col("entity_id"))
    nodes = done.select(entity.alias("id"), F.col("entity_type").alias("label"), F.col("canonical_name").alias("name")).distinct()
    edges = done.select(F.concat(F.lit(f"{label}:"), F.col(id_col).cast("string")).alias("src"), entity.alias("dst"), F.lit("MENTIONS").alias("type")).distinct()
    return nodes, edges
