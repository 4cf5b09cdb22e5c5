"""Encoding with a byte-level BPE vocabulary, by forced-boundary splitting.

A byte pair that occurs inside no token of the vocabulary can never be joined
by a merge, so a token boundary is certain between its two bytes. Texts are cut
at such pairs, the fragments are encoded independently, each distinct one
once, and the ids are concatenated. The pre-split pattern looks at neighbouring characters, so
a cut is made only where it cannot see across: between two characters, not
after white space and not before an apostrophe.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the published pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Distinct fragments whose ids one worker remembers.
REMEMBERED = 200_000


class Encoder:
    """Encodes texts with the ranks of one vocabulary file."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        self._encode = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        inside = np.zeros(65536, bool)
        for token in ranks:
            if len(token) > 1:
                b = np.frombuffer(token, np.uint8).astype(np.int64)
                inside[b[:-1] * 256 + b[1:]] = True
        #: By byte pair: whether a cut is certain as far as the merges go.
        self.free = ~inside
        self._known: dict[bytes, list[int]] = {}

    def places(self, data: bytes) -> np.ndarray:
        """Byte offsets of the certain cuts."""
        b = np.frombuffer(data, np.uint8)
        if len(b) < 2:
            return np.empty(0, np.int64)
        cut = self.free[b[:-1].astype(np.int64) * 256 + b[1:]]
        left, right = b[:-1], b[1:]
        cut &= (right & 0xC0) != 0x80  # between two characters
        cut &= right != 0x27
        at = np.flatnonzero(cut) + 1
        return at[~_after_space(b, at)]

    def fragments(self, text: str) -> list[bytes]:
        data = text.encode("utf-8", "surrogatepass")
        at = [0, *self.places(data).tolist(), len(data)]
        return [data[i:j] for i, j in zip(at, at[1:])]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; the empty list for null and empty texts."""
        if not text:
            return []
        known = self._known
        out: list[int] = []
        for fragment in self.fragments(text):
            ids = known.get(fragment)
            if ids is None:
                ids = self._encode(fragment.decode("utf-8", "replace"))
                if len(fragment) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[fragment] = ids
            out += ids
        return out


def _after_space(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which offsets follow a white-space character (as the pattern's \\s has it)."""
    one = b[at - 1]
    space = (one == 0x20) | ((one >= 0x09) & (one <= 0x0D))
    two = np.where(at > 1, b[at - 2], 0)
    space |= (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    three = np.where(at > 2, b[at - 3], 0)
    space |= (three == 0xE2) & (two == 0x80) & ((one >= 0x80) & (one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
    space |= (three == 0xE2) & (two == 0x81) & (one == 0x9F)
    space |= (three == 0xE1) & (two == 0x9A) & (one == 0x80)
    space |= (three == 0xE3) & (two == 0x80) & (one == 0x80)
    return space


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY) -> Encoder:
    return Encoder(path)


def ids_column(text: Column | str, path: str = VOCABULARY) -> Column:
    """The ids of a text column, an empty list for null and empty texts."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = encoder(path)
        for texts in batches:
            yield pd.Series([np.asarray(one.encode(x), np.int32) for x in texts], dtype=object)

    return ids(text)


def size_column(text: Column | str, path: str = VOCABULARY) -> Column:
    """The number of ids of a text column, 0 for null and empty texts."""

    @F.pandas_udf("int")
    def size(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = encoder(path)
        for texts in batches:
            yield pd.Series([len(one.encode(x)) for x in texts], dtype="int32")

    return size(text)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` of every row.

    All characters are ordinary text: the strings of special tokens have no
    meaning. A null or empty text has the empty list. One output row per input
    row, repeated keys included; other columns are ignored, whatever their names.
    """
    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("__text")).select(F.col(f"`{key}`"), ids_column("__text", path).alias("ids"))
