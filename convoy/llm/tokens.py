"""Lengths of texts in tokens of a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F

#: Vocabulary as ranks; the path is a parameter of every operator that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Vocabularies whose entries tell which words are common.
VOCABULARIES = (VOCABULARY, "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: How that vocabulary's tokenizer cuts text into words (fixed pattern).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer; made once in each worker."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def common_words(paths: tuple[str, ...]) -> frozenset[str]:
    """Words of two letters and more that public vocabularies hold in small letters and not more readily with a capital: common words.

    The order of a vocabulary's entries is about that of their frequency.
    """
    small, large = {}, {}
    for path in paths:
        for token, rank in ranks(path).items():
            word = token[1:].decode("utf-8", "ignore")
            if token[:1] == b" " and len(word) > 1 and word.isalpha():
                if word.islower():
                    small[word] = min(rank, small.get(word, rank))
                elif word[1:].islower():
                    large[word.lower()] = min(rank, large.get(word.lower(), rank))
    return frozenset(w for w, r in small.items() if r <= large.get(w, r))


@lru_cache(maxsize=2)
def capital_words(paths: tuple[str, ...]) -> frozenset[str]:
    """Words, in small letters, that public vocabularies hold with a capital: well-known proper names and brands, among others."""
    tokens = (t[1:].decode("utf-8", "ignore") for path in paths for t in ranks(path) if t[:1] == b" ")
    return frozenset(w.lower() for w in tokens if len(w) > 2 and w.isalpha() and w[0].isupper() and w[1:].islower())


def token_counter(path: str = VOCABULARY):
    """A column function: number of tokens of a text; 0 for null."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoding(path)
        for texts in batches:
            yield pd.Series([len(own.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return F.pandas_udf(count, "bigint")
