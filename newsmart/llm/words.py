"""Words of an Arrow text column as byte ranges and 64-bit hashes, computed by whole-array steps.

A word is a run of bytes other than space and 0x09-0x0D, which are the ``[^\\x20\\x09-\\x0D]+`` of the contracts, since
UTF-8 never uses these bytes inside another character. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Also ends words at ASCII punctuation.
PUNCTUATION = SPACE.copy()
PUNCTUATION[[i for i in range(128) if not chr(i).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLOCK = 1 << 16
BASE = 0x9E3779B97F4A7C15
MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
WORDS = r"[^\x20\x09-\x0D]+"
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all others (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        _powers[:] = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers.append(np.cumprod(factors, dtype=np.uint64))
    return _powers


@dataclass
class Words:
    """data: all texts' bytes; start, end: of each word; hash: of each word; first: index of each text's first word,
    with the number of words at the end; offset: where each text's bytes begin, with their number at the end."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    offset: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offset = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offset[0] : offset[-1]] if raw is not None and offset[-1] > offset[0] else np.zeros(0, np.uint8)
    return data, offset - offset[0]


def words_of(column: pa.Array, lower: bool = True, between: np.ndarray = SPACE) -> Words:
    """between: which bytes part words."""
    data, offset = text_bytes(column)
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, np.uint64), np.zeros(len(offset), np.int64), offset)
    inner = ~between[data]
    edge = np.ones(n + 1, bool)
    edge[1:n] = ~inner[:-1]
    edge[offset] = True
    start = np.flatnonzero(inner & edge[:n])
    edge[:] = True
    edge[1:n] = ~inner[1:]
    edge[offset] = True
    end = np.flatnonzero(inner & edge[1:]) + 1
    h = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        a = start[i]
        j = max(i + 1, int(np.searchsorted(end, a + BLOCK, "right")))
        part = data[a : end[j - 1]]
        power, inverse = _powers_to(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((LOWER[part] if lower else part).astype(np.uint64) * power[: len(part)], dtype=np.uint64, out=sums[1:])
        s, e = start[i:j] - a, end[i:j] - a
        h[i:j] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * MULTIPLIER
        i = j
    return Words(data, start, end, mix(h), np.searchsorted(start, offset).astype(np.int64), offset)


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words within one text, and the index of its first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = h[:n].copy()
    for j in range(1, k):
        g *= MULTIPLIER
        g += h[j : j + n]
    whole = np.ones(n, bool)
    for back in range(1, k):  # windows that begin up to k - 1 words before a text's end would leave it
        at = first[1:-1] - back
        whole[at[(at >= 0) & (at < n)]] = False
    at = np.flatnonzero(whole)
    return mix(g[at]), at


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of text, or one row."""
    for batch in batches:
        _, offset = text_bytes(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offset, offset[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def count_words(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The other columns and n_words in place of ``text``, a megabyte of text at a time."""
    for batch in slices(texts, "text", 1 << 20):
        data, offset = text_bytes(batch.column("text"))
        inner = ~SPACE[data]
        first = inner.copy()
        first[1:] &= ~inner[:-1]
        begins = offset[:-1][offset[:-1] < len(data)]
        first[begins] = inner[begins]
        n_words = np.diff(np.searchsorted(np.flatnonzero(first), offset))
        keep = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n_words, pa.int64())], [*keep, "n_words"])


def with_word_count(df: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and n_words, the number of words of ``text``."""
    rows = df.select(*keep, F.col("text").cast("string").alias("text"))
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != "text"), T.StructField("n_words", T.LongType())])
    return rows.mapInArrow(count_words, schema)
