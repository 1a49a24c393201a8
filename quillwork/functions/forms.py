"""Unicode forms and comparable forms of texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.ArrayType(T.StringType()))
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda p: p if p is None else [None if x is None else unicodedata.normalize("NFKC", x) for x in p])


def nfkc(texts: Column) -> Column:
    """The NFKC form of each text of an array; arrays of ASCII alone aren't sent to Python."""
    return F.coalesce(_composed(F.when(F.exists(texts, lambda p: p.rlike(r"[^\x00-\x7F]")), texts)), texts)


def nfkc_text(text: Column) -> Column:
    """The NFKC form of a text."""
    return F.get(nfkc(F.array(text)), F.lit(0))


def single_blanks(text: Column) -> Column:
    """The text with every run of white space as one blank and none at its ends; null counts as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def plain_words(text: Column) -> Column:
    """The text's runs of ASCII letters and digits in lower case, joined by blanks. Null counts as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def content_hash(text: Column) -> Column:
    """The SHA-256 of the text's NFKC form with single blanks; null stays null."""
    return F.when(text.isNotNull(), F.sha2(single_blanks(nfkc_text(text)), 256))
