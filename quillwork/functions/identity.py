"""Canonical identity keys of scholarly records, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The SHA-256 of the empty text, and the resolvers of DOI links.
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
DOI_HOSTS = r"(?:(?:www|dx)\.)*doi\.(?:example|org)"


def _none_if_not(value: Column, pattern: str) -> Column:
    return F.when(value.rlike(pattern), value)


def doi_key(doi: Column) -> Column:
    """The DOI without link or `doi:` prefix, percent-encoding, blanks and case.

    Null for null, blank and placeholder values (anything that isn't `10.<digits>/<suffix>`).
    """
    plain = F.lower(F.regexp_replace(doi, r"\s+", ""))
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(plain, r"\+", "%2B")), plain)
    bare = F.regexp_replace(decoded, rf"^(?:https?://)?(?:{DOI_HOSTS}/)?(?:doi:)?", "")
    return _none_if_not(F.lower(F.regexp_replace(bare, r"\s+", "")), r"^10\.[0-9]{4,9}/.+")


def url_key(url: Column) -> Column:
    """The URL without scheme, www., host case, fragment, trailing slash, tracking
    parameters (utm_*, fbclid, gclid) and parameter order. Null if there is no host."""
    bare = F.regexp_replace(F.trim(url), r"(?i)^[a-z][a-z0-9+.-]*://", "")
    bare = F.regexp_replace(bare, r"#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    params = F.filter(
        F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"),
        lambda p: (p != "") & ~p.rlike(r"(?i)^(?:utm_[^=]*|fbclid|gclid)(?:=|$)"),
    )
    query = F.concat_ws("&", F.array_sort(params))
    whole = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(host.rlike(r"^[^\s.]+(?:\.[^\s.]+)+$"), whole)


def url_or_doi_key(url: Column) -> Column:
    """url_key under `url:`, or, for a link to a DOI resolver, doi_key under `doi:`."""
    linked = F.when(url.rlike(rf"(?i)^\s*(?:https?://)?{DOI_HOSTS}/"), doi_key(F.regexp_replace(url, r"[?#].*$", "")))
    return F.coalesce(F.concat(F.lit("doi:"), linked), F.concat(F.lit("url:"), url_key(url)))


def openalex_key(value: Column) -> Column:
    """The OpenAlex work id of a link to it, in upper case; null if there is none."""
    found = F.upper(F.regexp_extract(value, r"(?i)(?:https?://)?openalex\.(?:example|org)/(W[0-9]+)", 1))
    return F.when(found != "", found)


def hash_key(content_hash: Column) -> Column:
    """The hex digest in lower case; null unless it has 64 digits, and for the empty text."""
    digest = _none_if_not(F.lower(F.trim(content_hash)), r"^[0-9a-f]{64}$")
    return F.when((digest != EMPTY_SHA256) & ~digest.rlike(r"^(.)\1*$"), digest)


def split_name(split: Column) -> Column:
    """train, validation or test for any spelling of them; else null."""
    s = F.lower(F.trim(split))
    return (
        F.when(s.isin("train", "training"), "train")
        .when(s.isin("validation", "valid", "val", "dev"), "validation")
        .when(s.isin("test", "testing"), "test")
    )
