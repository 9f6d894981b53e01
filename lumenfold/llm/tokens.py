"""Text sizes in tokens of a public tokenizer, counted in Arrow batches; one encoder per Python worker."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder of the public vocabulary files, and the vocabulary that covers many languages.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    try:
        from public_tokenizers import PATTERN
    except ImportError:
        PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: Column, path: str = f"{FOLDER}/{VOCABULARY}") -> Column:
    """Tokens of each text; 0 for null and empty texts.  Special tokens in a text are ordinary text."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for b in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in b], dtype="int64")

    return count(text)
