"""Best-fit packing into bins of several permitted lengths.

Texts are cut into pieces of at most the longest length and packed longest first: a piece goes to the open bin that it
leaves fullest, else it opens a bin of the length with the least cost (padding and overhead) for each word that it would
hold if filled from the pieces that are left. In the end every bin is downsized to the shortest permitted length that holds
its contents. Each task packs its own rows, 20,000 pieces at a time whatever the batches they come in; nothing is shuffled
and no group can grow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsmart.llm.words import count_words

LENGTHS = (512, 1024, 2048, 4096)
#: Words that a bin costs besides its length, such as a step's fixed part.
OVERHEAD = 64
PIECES = 20_000


def best_fit(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, and the length of each bin. Sizes are 1 to the longest length; ties in the given order,
    and of equally full bins the one opened last. The cheaper of two packings: bins opened at the length that suits the
    pieces left, or all at the longest."""
    both = (_best_fit(sizes, some, lengths, overhead) for some in (lengths, (max(lengths),)))
    return min(both, key=lambda packed: int((packed[2] + overhead).sum()))


def _best_fit(sizes: np.ndarray, opened: tuple[int, ...], lengths: tuple[int, ...], overhead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    fits = sorted(lengths)
    left = np.bincount(sizes, minlength=max(lengths) + 1).tolist()
    some = sum(1 << n for n, count in enumerate(left) if count)  # bit n: a piece of size n is left

    def cost(n: int, c: int) -> float:
        """Of each word in a bin of length c that a piece of size n opens, the largest fitting pieces following."""
        room = top = c - n
        while room and (fit := (some & ((2 << min(room, top)) - 1)).bit_length() - 1) > 0:
            room -= fit * min(left[fit], room // fit)
            top = fit - 1
        return (next(d for d in fits if d >= c - room) + overhead) / (c - room)

    by_room: list[list[int]] = [[] for _ in range(max(lengths) + 1)]
    rooms = 0  # bit r: some bin has room r
    filled: list[int] = []
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        n = int(sizes[i])
        left[n] -= 1
        if not left[n]:
            some ^= 1 << n
        wide = rooms >> n
        if wide:
            room = n + (wide & -wide).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b = len(filled)
            room = min((c for c in sorted(opened) if c >= n), key=lambda c: cost(n, c))
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += n
        room -= n
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    down = np.searchsorted(fits, filled)
    return bins, offsets, np.array([fits[i] for i in down], np.int64)


def _pack(lengths: tuple[int, ...], overhead: int, pieces: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        longest, seq, held = max(lengths), 0, None

        def packed(table: pa.Table) -> pa.RecordBatch:
            nonlocal seq
            bins, offset, length = best_fit(table.column("n_words").to_numpy(), lengths, overhead)
            first, seq = (task << 32) + seq, seq + len(length)
            table = table.append_column("bin", pa.array(first + bins)).append_column("bin_length", pa.array(length[bins]))
            return table.append_column("bin_offset", pa.array(offset)).combine_chunks().to_batches()[0]

        for whole in count_words(batches):
            n_words = np.asarray(whole.column("n_words"))
            parts = -(-n_words // longest)
            row = np.repeat(np.arange(len(parts)), parts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            size = np.minimum(longest, n_words[row] - piece * longest)
            keep = [c for c in whole.schema.names if c != "n_words"]
            table = pa.Table.from_arrays(
                [*(whole.column(c).take(pa.array(row)) for c in keep), pa.array(piece), pa.array(piece * longest), pa.array(size)],
                [*keep, "piece", "begin", "n_words"],
            )
            held = table if held is None else pa.concat_tables([held, table])
            while len(held) >= pieces:
                yield packed(held.slice(0, pieces))
                held = held.slice(pieces)
        if held is not None and len(held):
            yield packed(held)

    return run


def pack(docs: DataFrame, *keep: str, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, pieces: int = PIECES) -> DataFrame:
    """A row for each piece: the columns ``keep``, piece (0, 1, ...), begin and n_words (which words of ``text``), bin,
    bin_length (the words that the bin holds room for) and bin_offset (where in it the piece begins). Every word of every
    row is in exactly one piece; texts that are null or hold no words have none. Bins are numbered by task."""
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    fields = [f for f in rows.schema.fields if f.name != "text"]
    out = T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in ("piece", "begin", "n_words", "bin", "bin_length", "bin_offset"))])
    return rows.mapInArrow(_pack(lengths, overhead, pieces), out)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
