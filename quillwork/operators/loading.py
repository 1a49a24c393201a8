"""Loading records into a stored table: preparation, schema check, matching against stored rows, ids, and an index of chunks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.forms import content_hash
from .dedupe import first_come
from .documents import load_errors
from .quality import bound, with_row_ids
from .skew import spread_join
from .tables import materialize

# The stored columns of each table with their kinds (a number is a limit in characters), what a row must have, and which text names it.
TABLES = {
    "papers": {
        "key": "paper_id",
        "columns": {
            "title": 500, "authors": "text", "published_year": "integer", "abstract": "text", "introduction": "text", "body": "text", "conclusion": "text", "keywords": "texts", "source": 200, "source_url": "text", "doi": 255,
            "language": 10, "content_hash": 64,
        },
        "required": ("title", "source_url"), "url": "source_url", "hashed": ("title", "abstract", "introduction", "body", "conclusion"),
    },
    "news": {
        "key": "news_id",
        "columns": {
            "original_language": 10, "title_original": 500, "title_en_for_rag": 500, "content_original": "text", "content_en_for_rag": "text", "published_at": "timestamp", "source": 200, "url": "text", "category": 100, "keywords": "texts",
            "content_hash": 64, "collected_at": "timestamp",
        },
        "required": ("title_original", "content_original", "url", "title_en_for_rag", "content_en_for_rag", "published_at"), "url": "url", "hashed": ("content_original",),
    },
}
_KINDS = {"text": T.StringType, "integer": (T.IntegerType, T.LongType), "texts": T.ArrayType, "timestamp": (T.TimestampType, T.TimestampNTZType)}


def schema_errors(schema: T.StructType, table: str) -> list[str]:
    """What a stored table lacks to be loaded: `<column>:missing` and `<column>:type`, in the columns' order."""
    own = {f.name: f.dataType for f in schema.fields}
    found = []
    for name, kind in {TABLES[table]["key"]: "integer", **TABLES[table]["columns"]}.items():
        if name not in own:
            found.append(f"{name}:missing")
        elif not isinstance(own[name], _KINDS["text" if isinstance(kind, int) else kind]):
            found.append(f"{name}:type")
    return found


def prepared(df: DataFrame, table: str, bare_doi: Callable[[Column], Column] | None = None) -> DataFrame:
    """df's stored columns as they are loaded, with its key and `errors` (array<string>, empty for rows that can be loaded).

    The content hash is that of the full text where df has one, else of the fields by which a row is named; a null list of keywords is empty; DOIs lose their prefix. errors: those of
    load_errors, and `<column>:url` for a URL that isn't http(s), has no host or has credentials. Timestamps are taken as they are typed: text without an offset can't be one.
    """
    spec = TABLES[table]
    joined = F.concat_ws("\n", *(F.coalesce(c, F.lit("")) for c in spec["hashed"]))
    named = F.coalesce(F.when(F.col("fulltext") != "", F.col("fulltext")), joined) if "fulltext" in df.columns else joined
    d = df.withColumn("content_hash", content_hash(named)).withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    if "doi" in spec["columns"] and bare_doi:
        d = d.withColumn("doi", bare_doi(F.col("doi")))
    limits = {c: k if isinstance(k, int) else None for c, k in spec["columns"].items() if k in ("text", "texts") or isinstance(k, int)}
    url = F.when(~F.coalesce(F.col(spec["url"]).rlike(r"(?i)^\s*https?://[^/?#@\s]+(?:[/?#]|\s*$)"), F.lit(True)), f"{spec['url']}:url")
    return d.select(spec["key"], *spec["columns"], F.array_compact(F.concat(load_errors(d, limits, spec["required"]), F.array(url))).alias("errors"))


def load_plan(incoming: DataFrame, id_col: str, stored: DataFrame, stored_id: str, keys: dict[str, tuple[Column, Column]], order: Sequence[Column]) -> DataFrame:
    """(id_col, action, stored_id): what loading does with each incoming record. keys: name -> (key of an incoming record, key of a stored one), by precedence.

    `conflict`: its keys belong to several stored records (such a batch must not be loaded; stored_id is null). `existing`: to one. `batch_duplicate`: an
    earlier record of the batch, in the given order, has one of its keys; stored_id is where that one is or will be. `insert`: none of these; it gets the ids after the largest stored one, in
    the order of id_col. Null ids are left out; null keys match nothing.
    """
    own = incoming.where(F.col(id_col).isNotNull())
    asked = own.select(F.col(id_col).alias("id"), F.explode(F.array(*(F.struct(F.lit(n).alias("name"), mine.cast("string").alias("key")) for n, (mine, _) in keys.items()))).alias("q")).select("id", "q.*").where("key is not null").distinct()
    known = stored.select(F.col(stored_id).alias("s"), F.explode(F.array(*(F.struct(F.lit(n).alias("name"), theirs.cast("string").alias("key")) for n, (_, theirs) in keys.items()))).alias("q")).select("s", "q.*").where("key is not null")
    # Of a key's stored records the least and the largest tell whether there are several.
    known = known.groupBy("name", "key").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    met = materialize(spread_join(asked, known, ["name", "key"], "id").groupBy("id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "met")
    marked = own.join(met.select(F.col("id").alias(id_col), F.lit(True).alias("_met")), id_col, "left")
    led = materialize(first_come(marked, id_col, [mine for mine, _ in keys.values()], list(order), own=F.coalesce("_met", F.lit(False))).withColumnsRenamed({id_col: "id"}), "led")
    roots = led.where("retained_id = id").join(met, "id", "left_anti").select("id")
    top = stored.agg(F.coalesce(F.max(stored_id), F.lit(0)).alias("m")).first()["m"]
    places = with_row_ids(roots, "place", int(top), [F.col("id")]).union(met.where("lo = hi").select("id", "lo"))
    d = spread_join(led, places.select(F.col("id").alias("retained_id"), "place"), ["retained_id"], "id", "left").join(met, "id", "left")
    action = F.when(F.col("lo") < F.col("hi"), "conflict").when(F.col("lo").isNotNull(), "existing").when(F.col("retained_id") != F.col("id"), "batch_duplicate").otherwise("insert")
    return d.select(F.col("id").alias(id_col), action.alias("action"), F.when(F.col("lo").isNotNull() & (F.col("lo") < F.col("hi")), None).otherwise(F.coalesce("lo", "place")).alias("stored_id"))


def load(incoming: DataFrame, plan: DataFrame, id_col: str, path: str, stored_id: str, apply: bool = False) -> dict[str, int]:
    """How many records have each action; with `apply` the new ones are appended to the Parquet table at path, in one commit. Raises before anything is written if there are conflicts."""
    counts = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
    if counts.get("conflict"):
        raise ValueError(f"{counts['conflict']} records belong to several stored ones")
    if apply and counts.get("insert"):
        new = incoming.drop(stored_id).join(plan.where("action = 'insert'").select(id_col, "stored_id"), id_col) if id_col != stored_id else incoming.join(plan.where("action = 'insert'").select(id_col, "stored_id"), id_col).drop(stored_id)
        new.withColumnRenamed("stored_id", stored_id).drop(*({id_col} - {stored_id})).write.mode("append").parquet(path)
    return counts


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """array<double>: an embedding that needs no model: how often the text's words fall in each of `size` buckets, by their hash, at length 1. Null for texts without words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    places = F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"), F.lit(size)).cast("int"))

    counted = lambda ps: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda b: F.size(F.filter(ps, lambda p: p == b)).cast("double"))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    unit = lambda v: bound(norm(v), lambda n: F.transform(v, lambda x: x / n))
    return F.when(F.size(words) > 0, bound(bound(places, counted), unit))


def indexed_chunks(chunks: DataFrame, key: str, index: DataFrame | None, embed: Callable[[Column], Column] = hashed_embedding, model: str = "hashed-64", force: bool = False) -> DataFrame:
    """The index (key, section, chunk_index, content, token_count, embedding, embedding_model) after chunks were taken in.

    Without force only documents that the index doesn't have yet are embedded; with force every document in chunks is replaced as a whole, so no chunk of an earlier, longer text
    stays behind. Of repeated (key, chunk_index) the longest content counts. embed: a column expression from content to a vector.
    """
    own = chunks.where(F.col(key).isNotNull())
    if index is not None and not force:
        own = own.join(index.select(key).distinct(), key, "left_anti")
    best = own.groupBy(key, "chunk_index").agg(F.max_by(F.struct("section", "content", "token_count"), F.struct(F.char_length("content"), "content")).alias("c")).select(key, "c.section", "chunk_index", "c.content", "c.token_count")
    new = best.withColumn("embedding", embed(F.col("content"))).withColumn("embedding_model", F.lit(model))
    if index is None:
        return new
    kept = index.join(own.select(key).distinct(), key, "left_anti") if force else index
    return kept.select(*new.columns).union(new)
