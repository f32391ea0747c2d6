"""Token counts by a public vocabulary, in Arrow batches.

The vocabulary is a file of ranks (a token in base64 and its rank on each line), merged by rank
inside the runs that a pattern splits a text into. Its path is a parameter; every executor must
see it. Each Python worker reads it once.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(4)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def supplied() -> tuple[str, str]:
    """Ranks file and pattern of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def token_ids(text: str | None, path: str, pattern: str) -> list[int]:
    return encoding(path, pattern).encode_ordinary(text or "")


def token_counter(path: str | None = None, pattern: str | None = None) -> Callable[[Column], Column]:
    """A function of a text Column: its number of tokens (0 for null and empty texts)."""
    if path is None or pattern is None:
        path, pattern = supplied()

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        encode = encoding(path, pattern).encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int32")

    return count


def message_tokens(conversation: str | Column, path: str | None = None, pattern: str | None = None) -> Column:
    """Tokens of all messages of a conversation, message by message, in one call a row."""
    if path is None or pattern is None:
        path, pattern = supplied()

    @F.pandas_udf("bigint")
    def count(contents: pd.Series) -> pd.Series:
        encode = encoding(path, pattern).encode_ordinary
        return contents.map(lambda texts: sum(len(encode(t)) for t in texts if t) if texts is not None else 0).astype("int64")

    return count(F.transform(conversation, lambda m: m["content"]))
