"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rank file of a byte-level BPE vocabulary; the session setting ``termloom.tokenizer`` names another.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how byte-level BPE vocabularies of this kind divide a text before merging.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(spark: SparkSession) -> str:
    return spark.conf.get("termloom.tokenizer", TOKENIZER)


@lru_cache(4)
def encoding(path: str):
    """The encoding of a rank file; loaded once in each worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str) -> Column:
    """Tokens of each text; a null text has none."""

    @F.pandas_udf(T.IntegerType())
    def count(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for s in it:
            yield pd.Series([0 if t is None else len(enc.encode_ordinary(t)) for t in s], dtype="int32")

    return count(text)
