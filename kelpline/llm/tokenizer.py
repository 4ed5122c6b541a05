"""Encoding of texts with a public byte-level BPE vocabulary.

A text is cut into words by the vocabulary's pattern. The bytes of a short word
stand in a contiguous array of part boundaries beside the ranks of adjacent
parts; the smallest rank is found by scanning, its boundary deleted and the two
neighbouring ranks refreshed, until no pair has a rank. Long words (runs without
a break, such as a line of Japanese) keep the same state as a linked list with
a heap, because repeated scans would grow with the square of their length.

Defined cases: a null or empty text gives an empty list; strings of special
tokens in a text are ordinary text; repeated rows are encoded each; characters
of any kind fall back to their bytes; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that cuts a text into words before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT = 48
REMEMBERED = 200_000
NONE = 1 << 30


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file with lines of base64 bytes and a rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Contiguous arrays: bounds[i] starts part i, next_rank[i] is the rank of parts i and i + 1 together."""
    bounds = list(range(len(word) + 1))
    next_rank = [ranks.get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    while next_rank:
        least = min(next_rank)
        if least == NONE:
            break
        i = next_rank.index(least)
        del bounds[i + 1]
        del next_rank[i]
        if i < len(next_rank):
            next_rank[i] = ranks.get(word[bounds[i] : bounds[i + 2]], NONE)
        if i:
            next_rank[i - 1] = ranks.get(word[bounds[i - 1] : bounds[i + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with the parts in a linked list and the pairs in a heap by (rank, place)."""
    n = len(word)
    end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; 0 once merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2], NONE)) != NONE]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= stop or end[mid] != stop:  # an older pair
            continue
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]], NONE)) != NONE:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop], NONE)) != NONE:
            heapq.heappush(heap, (r, p, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : end[i]]])
        i = end[i]
    return ids


def encoder(ranks: dict[bytes, int], pattern: str = PATTERN):
    """A function from a text to its ids; remembers the ids of short words up to a bound."""
    import regex

    words = regex.compile(pattern).findall
    seen: dict[str, list[int]] = {}

    def encode(text: str | None) -> list[int]:
        ids: list[int] = []
        for w in words(text) if text else ():
            got = seen.get(w)
            if got is None:
                raw = w.encode("utf-8", "replace")
                one = ranks.get(raw)
                got = [one] if one is not None else merge_short(raw, ranks) if len(raw) <= SHORT else merge_long(raw, ranks)
                if len(raw) <= SHORT:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[w] = got
            ids += got
        return ids

    return encode


def with_ids(df: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """df with the token ids of text_col. Needs no shuffle; the vocabulary (of fixed size) goes to each worker once."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(path or default_path()))

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(shared.value, pattern)
        for batch in batches:
            yield pd.Series([encode(t) for t in batch], dtype=object)

    return df.withColumn(ids_col, ids(F.col(text_col)))
