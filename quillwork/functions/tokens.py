"""The byte-level tokenizer that chunks and containers are measured with."""

from __future__ import annotations

import base64
import os
from pathlib import Path

# Fixed value: the pre-splitting pattern that belongs to the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary(path: str | None = None) -> bytes:
    """A vocabulary file's content, read on the driver; it travels with the tasks, so executors need not have the file.

    Without a path it is the file that $QUILLWORK_TOKENIZER names, else a public vocabulary of 50,000 entries.
    """
    return Path(path or os.environ.get("QUILLWORK_TOKENIZER") or "/opt/tokenizers/byte_bpe_50k.tiktoken").read_bytes()


def encoding(content: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
