"""Document structure over DataFrames: article cleaning, token chunks, load checks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import textvec as tv
from ..functions import tokens as tk

def _keyed(df: DataFrame, keys: Sequence[str], more: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), more])


def clean_article(text: Column, title: Column, footer: str | None = None) -> Column:
    """An article's non-empty lines with single blanks, without a first line that repeats the title, and cut before the
    first line that matches the footer pattern (letter case aside). Null stays null."""
    lines = F.filter(F.transform(F.split(text, "\\r\\n|[\\n\\r\\u2028\\u2029]"), lambda x: F.trim(F.regexp_replace(x, r"[\t ]+", " "))), lambda x: x != "")
    bare = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", "")
    lines = F.when((F.size(lines) > 0) & (bare(F.get(lines, F.lit(0))) == bare(title)), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    if footer:
        step = lambda acc, x: F.struct(F.when(acc.stop | x.rlike("(?i)" + footer), acc.kept).otherwise(F.concat(acc.kept, F.array(x))).alias("kept"), (acc.stop | x.rlike("(?i)" + footer)).alias("stop"))
        lines = F.aggregate(lines, F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("stop")), step, lambda acc: acc.kept)
    return F.array_join(lines, "\n")


def token_windows(count: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of windows of `size` tokens that overlap by `overlap`; the last may be shorter."""
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    last = max(0, -(-(count - overlap) // (size - overlap)) - 1)
    return [(k * (size - overlap), min(k * (size - overlap) + size, count)) for k in range(last + 1)] if count else []


def token_chunks(df: DataFrame, keys: Sequence[str], fields: Sequence[str], size: int = 700, overlap: int = 100, tokenizer: str | None = None) -> DataFrame:
    """(keys, section, chunk_index, content, token_count): each field's text cut into windows of `size` tokens that overlap by `overlap`,
    numbered through all fields of a row. Null and blank fields and blank windows give no chunk.
    """
    token_windows(1, size, overlap)
    content = tk.vocabulary(tokenizer)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tk.encoding(content)
        for batch in tv.slices(batches, fields[-1], 1_000_000):
            rows, names, numbers, contents, counts = [], [], [], [], []
            per_field = [batch.column(n + i).to_pylist() for i in range(len(fields))]
            for r in range(batch.num_rows):
                number = 0
                for name, texts in zip(fields, per_field):
                    tokens = encoding.encode_ordinary((texts[r] or "").strip())
                    for a, b in token_windows(len(tokens), size, overlap):
                        piece = encoding.decode(tokens[a:b]).strip()
                        if piece:
                            rows.append(r)
                            names.append(name)
                            numbers.append(number)
                            contents.append(piece)
                            counts.append(b - a)
                            number += 1
            take = pa.array(rows, pa.int64())
            rest = [pa.array(names, pa.string()), pa.array(numbers, pa.int32()), pa.array(contents, pa.string()), pa.array(counts, pa.int32())]
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns[:n]), *rest], names=[*keys, "section", "chunk_index", "content", "token_count"])

    return df.select(*keys, *fields).mapInArrow(run, _keyed(df, keys, "section string, chunk_index int, content string, token_count int"))


def load_errors(df: DataFrame, limits: dict[str, int | None], required: Sequence[str] = ()) -> Column:
    """array<string> of why a row can't be stored: `<column>:required` for null or empty required columns, `<column>:length` for text over its
    limit in code points (never cut), `<column>:nul` for text or list members with a NUL character."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    found = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", f"{c}:required") for c in required]
    for name, limit in limits.items():
        c = F.col(name)
        if isinstance(kinds[name], T.ArrayType):
            found.append(F.when(F.exists(c, lambda x: x.contains("\0")), f"{name}:nul"))
        else:
            found.append(F.when(c.contains("\0"), f"{name}:nul"))
            if limit is not None:
                found.append(F.when(F.char_length(c) > limit, f"{name}:length"))
    return F.array_compact(F.array(*found))
