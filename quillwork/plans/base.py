"""What several queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paper_keys() -> list[Column]:
    """DOI, URL and content hash of a paper."""
    return [
        F.concat(F.lit("doi:"), identity.doi_key(F.col("doi"))),
        identity.url_or_doi_key(F.col("source_url")),
        F.concat(F.lit("hash:"), identity.hash_key(F.col("content_hash"))),
    ]
