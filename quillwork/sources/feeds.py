"""News feeds (RSS) and scholarly work records (JSON) as DataFrames, and atomic JSON and Parquet sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from ..operators.quality import abstract_from_index, relevance

FEED_ITEM = "title string, link string, pubDate string, description string, category array<string>, `content:encoded` string, _corrupt_record string"
WORK = (
    "id string, title string, type string, publication_year int, is_retracted boolean, doi string, language string, abstract_inverted_index map<string,array<int>>, "
    "open_access struct<is_oa:boolean,oa_status:string>, best_oa_location struct<is_oa:boolean,pdf_url:string,landing_page_url:string,license:string,version:string>, "
    "locations array<struct<is_oa:boolean,pdf_url:string,landing_page_url:string,license:string,version:string>>, authorships array<struct<author:struct<display_name:string>>>, "
    "keywords array<struct<display_name:string>>, _corrupt_record string"
)


def plain(html: Column) -> Column:
    """Text without tags, with the common character references resolved and single blanks. Null: empty."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def feed_time(value: Column) -> Column:
    """An RFC 822 date with an offset as a timestamp; null for anything else, dates without an offset included."""
    v = F.regexp_replace(F.regexp_replace(F.trim(value), r"^[A-Za-z]{3},\s*", ""), r"([+-]\d{2}):(\d{2})$", "$1$2")
    v = F.regexp_replace(v, r"\s(?:GMT|UTC|UT|Z)$", " +0000")
    return F.try_to_timestamp(F.when(v.rlike(r"[+-]\d{4}$"), v), F.lit("d MMM yyyy HH:mm:ss Z"))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """The items of RSS files; items that can't be read have _corrupt_record alone."""
    return spark.read.format("xml").option("rowTag", "item").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").schema(FEED_ITEM).load(path)


def feed_news(items: DataFrame, as_of: Column, lookback_days: int, topics: dict[str, str], core: str | None = None) -> DataFrame:
    """(id, title_original, url, published_at, keywords, category, status) of every item. status is `accepted`, or why not: `invalid` (no
    title, link or time with offset), `outside_date_window`, `outside_topics` (no topic pattern, or no core pattern where one is given)."""
    title, url, published = plain(F.col("title")), F.trim("link"), feed_time(F.col("pubDate"))
    text = F.concat_ws(" ", title, plain(F.col("description")), F.array_join(F.coalesce("category", F.array().cast("array<string>")), " "))
    found = F.array_compact(F.array(*(F.when(text.rlike("(?i)" + p), n) for n, p in topics.items())))
    if core:
        found = F.when(text.rlike("(?i)" + core), found).otherwise(F.array().cast("array<string>"))
    key = identity.url_key(url)
    status = (
        F.when(key.isNull() | published.isNull() | (title == ""), "invalid")
        .when((published > as_of) | (published < as_of - F.make_interval(days=F.lit(lookback_days))), "outside_date_window")
        .when(F.size(found) == 0, "outside_topics").otherwise("accepted")
    )
    news_id = F.concat(F.lit("news_"), F.substring(F.sha2(key, 256), 1, 24))
    return items.select(news_id.alias("id"), title.alias("title_original"), url.alias("url"), published.alias("published_at"), found.alias("keywords"), F.get(found, F.lit(0)).alias("category"), status.alias("status"))


def read_works(spark: SparkSession, path: str) -> DataFrame:
    """Work records, one JSON object a line; broken lines have _corrupt_record alone."""
    return spark.read.schema(WORK).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def normalized_works(works: DataFrame, core: str, contexts: dict[str, str], last_year: int) -> DataFrame:
    """Articles that aren't retracted, are on topic and of a known year, with abstract, authors, open locations and relevance."""
    w = works.withColumn("abstract", abstract_from_index(F.col("abstract_inverted_index"))).withColumn("r", relevance(F.col("title"), F.col("abstract"), core, contexts))
    w = w.where((F.trim("title") != "") & (F.col("type") == "article") & ~F.coalesce("is_retracted", F.lit(False)) & (F.col("publication_year") <= last_year) & (F.col("r.score") > 0))
    work_id = F.regexp_extract("id", r"/(W\d+)$", 1)
    open_ones = F.filter(F.concat(F.array("best_oa_location"), F.coalesce("locations", F.array().cast(works.schema["locations"].dataType))), lambda x: F.coalesce(x.is_oa, F.lit(False)))
    links = F.flatten(F.transform(open_ones, lambda x: F.array(F.struct(x.pdf_url.alias("url"), x.license.alias("license")), F.struct(x.landing_page_url.alias("url"), x.license.alias("license")))))
    links = F.array_distinct(F.filter(links, lambda x: x.url.rlike("^https?://")))
    names = lambda c, get: F.filter(F.transform(F.coalesce(c, F.array().cast(works.schema[c].dataType)), get), lambda x: x.isNotNull() & (x != ""))
    return w.where(work_id != "").select(
        work_id.alias("id"), F.trim("title").alias("title"), names("authorships", lambda a: a.author.display_name).alias("authors"), F.col("publication_year").alias("published_year"),
        "abstract", names("keywords", lambda k: k.display_name).alias("keywords"), identity.doi_key(F.col("doi")).alias("doi"), "language",
        F.coalesce("open_access.is_oa", F.lit(False)).alias("is_oa"), F.col("open_access.oa_status").alias("oa_status"), links.alias("source_locations"),
        F.col("r.topics").alias("matched_topics"), F.col("r.score").alias("relevance_score"),
    )


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line; a failed job leaves no committed part behind."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
