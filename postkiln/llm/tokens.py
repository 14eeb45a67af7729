"""Encoding texts with a public byte-level tokenizer (problem 8).

Encoding is a monoid: texts are encoded in halves, and two encoded neighbours are joined by encoding again only a window around
their seam. A split of the tokenizer's word pattern always begins where a character that is no white space is followed by white
space, and where an ASCII letter is followed by an ASCII digit or sign, whatever stands elsewhere: no alternative of the pattern
crosses such a place, and none looks further back than its own start. So the window is grown to the nearest such places on both
sides, and every token outside it provably stays. Decoding concatenates up the same tree.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts up to this many characters are encoded at once.
LEAF_CHARS = 8192
_BLANK = " \n\t\r"
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_AFTER_LETTER = frozenset("0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@lru_cache(maxsize=2)
def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    widths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for piece, rank in ranks.items():
        widths[rank] = len(piece)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), widths


def is_seam(text: str, at: int) -> bool:
    """Whether a split of the word pattern always begins at ``at``."""
    before, after = text[at - 1], text[at]
    return (after in _BLANK and not before.isspace()) or (before in _LETTERS and after in _AFTER_LETTER)


def _seam_before(text: str, start: int, middle: int) -> int:
    for at in range(middle - 1, start, -1):
        if is_seam(text, at):
            return at
    return start


def _seam_after(text: str, middle: int, end: int) -> int:
    for at in range(middle + 1, end):
        if is_seam(text, at):
            return at
    return end


def encode(text: str | None, path: str | None = None, leaf: int = LEAF_CHARS) -> list[int]:
    """Token ids of a text without special tokens; the empty list for null and empty texts. Lone surrogates read as U+FFFD."""
    if not text:
        return []
    encoder, widths = _encoder(path or default_vocabulary())
    text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if not text.isascii() and any("\ud800" <= c <= "\udfff" for c in text) else text

    def tree(start: int, end: int) -> np.ndarray:
        if end - start <= leaf:
            return np.array(encoder.encode_ordinary(text[start:end]), dtype=np.int32)
        middle = (start + end) // 2
        left, right = tree(start, middle), tree(middle, end)
        a, b = _seam_before(text, start, middle), _seam_after(text, middle, end)
        window = np.array(encoder.encode_ordinary(text[a:b]), dtype=np.int32)
        kept_left = _tokens_for(left, len(text[start:middle].encode()) - len(text[a:middle].encode()))
        dropped_right = _tokens_for(right, len(text[middle:b].encode()))
        return np.concatenate([left[:kept_left], window, right[dropped_right:]])

    def _tokens_for(tokens: np.ndarray, n_bytes: int) -> int:
        ends = np.cumsum(widths[tokens])
        k = int(np.searchsorted(ends, n_bytes))
        if n_bytes == 0:
            return 0
        if ends[k] != n_bytes:
            raise AssertionError("a token crosses a seam")
        return k + 1

    return tree(0, len(text)).tolist()


def decode(ids: list[int], path: str | None = None) -> str:
    encoder, _ = _encoder(path or default_vocabulary())
    half = len(ids) // 2
    parts = [ids] if len(ids) < 100_000 else [ids[:half], ids[half:]]
    return b"".join(encoder.decode_bytes(list(p)) for p in parts).decode("utf-8")


def token_ids(text: Column, path: str | None = None, leaf: int = LEAF_CHARS) -> Column:
    """Column of token ids (array of int); null and empty texts give the empty array."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: encode(t, path, leaf))

    return ids(text)


def token_count(text: Column, path: str | None = None) -> Column:
    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(encode(t, path))).astype("int64")

    return count(text)


def encoded(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids) of every row: a map without a shuffle. Repeated rows stay repeated; null keys stay; an empty table gives no rows."""
    return documents.select(F.col(key), token_ids(F.col(text), path).alias("ids"))
