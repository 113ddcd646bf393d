"""Removal of passages of 13 or more words that also begin in an earlier document: prefix-partitioned suffix trees.

Every word position is a suffix. Suffixes are split into groups by a prefix of one word; prefixes that hold a large share
of all suffixes are split further by the next word, up to the depth asked for, so groups stay about memory-sized. Within a
group the suffixes are put in order of their path down to that depth, which makes the nodes of the group's subtree at that
depth runs of equal paths; a node with suffixes of several documents is a repeat, and overlapping repeats of a document
join into the maximal ones. Deeper levels are not built, as they would remove nothing more. A path is known by a hash of
its words (56 bits within its group). Groups travel as packed arrays, one per block of documents and group; what a group
finds goes back to the block, which turns it into ranges of words per document. A whole path that alone holds a large share
is settled by a minimum taken beforehand, without its suffixes meeting anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmart.llm.words import slices, windows, words_of
from newsmart.sources.versions import few_rows

LENGTH = 13
#: Suffixes of one group, about; a prefix holding more than this share of all suffixes is split by the next word.
GROUP = 4_000_000
LEAST_GROUPS = 32
LARGE = 1024
LAST = np.iinfo(np.int64).max


def _paths(batch: pa.RecordBatch, length: int):
    """Hashes of the prefixes of length 1, 2, ... of every suffix that has ``length`` words, and where they begin."""
    w = words_of(batch.column("text"), lower=False)
    whole, at = windows(w.hash, w.first, length)
    return w, whole, at


def _prefix(w, at: np.ndarray, k: int) -> np.ndarray:
    from newsmart.llm.words import MULTIPLIER, mix

    g = w.hash[at].copy()
    for j in range(1, k):
        g *= MULTIPLIER
        g += w.hash[at + j]
    return mix(g)


def _frequent(length: int):
    """Rows (level, prefix, n): of each block its number of suffixes (level 0) and its frequent prefixes of each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w, _, at = _paths(batch, length)
            rows = [(0, np.zeros(1, np.int64), np.array([len(at)]))]
            least = max(2, len(at) // (2 * LARGE))
            rest = at
            for k in range(1, length + 1):
                if not len(rest):
                    break
                keys, back, n = np.unique(_prefix(w, rest, k), return_inverse=True, return_counts=True)
                often = n >= least
                rows.append((k, keys[often].view(np.int64), n[often]))
                rest = rest[often[back]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([k for k, _, _ in rows], [len(x) for _, x, _ in rows]), pa.int32()),
                    pa.array(np.concatenate([x for _, x, _ in rows]), pa.int64()),
                    pa.array(np.concatenate([n for _, _, n in rows]), pa.int64()),
                ],
                ["level", "prefix", "n"],
            )

    return run


def _smallest(common: np.ndarray, length: int):
    """Rows (path, id): the smallest document of each of the few common paths, by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w, whole, at = _paths(batch, length)
            hit = np.isin(whole, common)
            ids = np.asarray(batch.column("id"))[np.searchsorted(w.first, at[hit], "right") - 1]
            keys, back = np.unique(whole[hit], return_inverse=True)
            low = np.full(len(keys), LAST)
            np.minimum.at(low, back, ids)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(low)], ["path", "id"])

    return run


def pack_gaps(at: np.ndarray) -> bytes:
    """Ascending positions as gaps of one byte; larger gaps stand as 255 and follow in full."""
    gap = np.diff(at, prepend=0)
    big = gap >= 255
    return np.array([len(at), big.sum()], np.uint32).tobytes() + np.where(big, 255, gap).astype(np.uint8).tobytes() + gap[big].astype(np.uint32).tobytes()


def unpack_gaps(raw: memoryview) -> tuple[np.ndarray, memoryview]:
    n, big = (int(x) for x in np.frombuffer(raw, np.uint32, 2))
    gap = np.frombuffer(raw, np.uint8, n, 8).astype(np.int64)
    gap[gap == 255] = np.frombuffer(bytes(raw[8 + n : 8 + n + 4 * big]), np.uint32)
    return np.cumsum(gap), raw[8 + n + 4 * big :]


def _deal(levels: list[np.ndarray], common: tuple[np.ndarray, np.ndarray], groups: int, length: int):
    """Rows (to, block, data): the suffixes of a block by group, and, to a group of the task's own (to < 0), the block's
    documents and what the common paths remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for seq, batch in enumerate(slices(batches, "text")):
            block = (task << 32) + seq
            w, whole, at = _paths(batch, length)
            ids, keys = np.asarray(batch.column("id")), np.asarray(batch.column("key"))
            doc = np.searchsorted(w.first, at, "right") - 1
            gone = np.zeros(0, np.int64)
            if len(common[0]):
                place = np.minimum(np.searchsorted(common[0], whole), len(common[0]) - 1)
                hit = common[0][place] == whole
                gone = at[hit & (ids[doc] > common[1][place])]
                whole, at, doc = whole[~hit], at[~hit], doc[~hit]
            group = _prefix(w, at, 1)
            rest = np.arange(len(at))
            for k, often in enumerate(levels, 1):
                rest = rest[np.isin(group[rest], often)]
                if not len(rest):
                    break
                group[rest] = _prefix(w, at[rest], k + 1)
            group = (group % np.uint64(groups)).astype(np.int32)
            order = np.argsort(group, kind="stable")
            bounds = np.searchsorted(group[order], np.arange(groups + 1))
            to, data = [-1 - task], [np.array([len(ids), len(gone)], np.int64).tobytes() + ids.tobytes() + keys.tobytes() + w.first.tobytes() + gone.tobytes()]
            for g in np.flatnonzero(np.diff(bounds)):
                own = order[bounds[g] : bounds[g + 1]]
                change = np.flatnonzero(np.diff(doc[own], prepend=-1))
                path = whole[own]
                to.append(int(g))
                data.append(
                    np.uint32(len(change)).tobytes() + ids[doc[own[change]]].tobytes() + np.diff(change, append=len(own)).astype(np.uint32).tobytes()
                    + pack_gaps(at[own]) + path.astype(np.uint32).tobytes() + (path >> np.uint64(32)).astype(np.uint16).tobytes() + (path >> np.uint64(48)).astype(np.uint8).tobytes()
                )
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([block] * len(to), pa.int64()), pa.array(data, pa.binary())], ["to", "block", "data"])

    return run


def _repeats(group: pa.Table) -> pa.Table:
    """Of one group: the suffixes whose path also begins in a document with a smaller id, by block. Groups of documents pass."""
    if group.column("to")[0].as_py() < 0:
        return pa.table({"block": group.column("block"), "part": pa.array([0] * len(group), pa.int32()), "data": group.column("data")})
    ids, places, paths = [], [], []
    for raw in group.column("data"):
        raw = memoryview(raw.as_buffer())
        n = int(np.frombuffer(raw, np.uint32, 1)[0])
        doc = np.frombuffer(bytes(raw[4 : 4 + 8 * n]), np.int64)
        times = np.frombuffer(bytes(raw[4 + 8 * n : 4 + 12 * n]), np.uint32)
        at, rest = unpack_gaps(raw[4 + 12 * n :])
        m, rest = len(at), bytes(rest)
        path = np.frombuffer(rest, np.uint32, m).astype(np.uint64)
        path |= np.frombuffer(rest, np.uint16, m, 4 * m).astype(np.uint64) << np.uint64(32)
        path |= np.frombuffer(rest, np.uint8, m, 6 * m).astype(np.uint64) << np.uint64(48)
        ids.append(np.repeat(doc, times))
        places.append(at.astype(np.uint32))
        paths.append(path)
    blocks = group.column("block").to_pylist()
    sizes = [len(x) for x in places]
    path = np.concatenate(paths)
    doc = np.concatenate(ids)
    order = np.argsort(path)
    path = path[order]
    node = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
    low = np.minimum.reduceat(doc[order], node)
    gone = np.empty(len(path), bool)
    gone[order] = doc[order] > np.repeat(low, np.diff(node, append=len(path)))
    to, data, begin = [], [], 0
    for block, at, size in zip(blocks, places, sizes, strict=True):
        own = at[gone[begin : begin + size]].astype(np.int64)
        begin += size
        if len(own):
            to.append(block)
            data.append(pack_gaps(own))
    return pa.table({"block": pa.array(to, pa.int64()), "part": pa.array([1] * len(to), pa.int32()), "data": pa.array(data, pa.binary())})


def _ranges(length: int):
    """Of one block: (key, id, begins, ends) of the maximal repeats of each document that has any, in words."""

    def run(block: pa.Table) -> pa.Table:
        gone, head = [], None
        for part, raw in zip(block.column("part").to_pylist(), block.column("data"), strict=True):
            if part:
                gone.append(unpack_gaps(memoryview(raw.as_buffer()))[0])
            else:
                head = np.frombuffer(raw.as_py(), np.int64)
        n, m = (int(x) for x in head[:2])
        ids, keys, first = head[2 : 2 + n], head[2 + n : 2 + 2 * n], head[2 + 2 * n : 3 + 3 * n]
        at = np.sort(np.concatenate([*gone, head[3 + 3 * n : 3 + 3 * n + m]])).astype(np.int64)
        doc = np.searchsorted(first, at, "right") - 1
        new = np.ones(len(at), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (np.diff(at) > length)
        begins = np.flatnonzero(new)
        ends = np.append(begins[1:], len(at))[: len(begins)] - 1
        own, lo, hi = doc[begins], at[begins] - first[doc[begins]], at[ends] + length - first[doc[begins]]
        change = np.flatnonzero(np.diff(own, prepend=-1))
        offsets = pa.array(np.append(change, len(own)), pa.int32())
        return pa.table({
            "key": pa.array(keys[own[change]], pa.int64()), "id": pa.array(ids[own[change]], pa.int64()),
            "begins": pa.ListArray.from_arrays(offsets, pa.array(lo, pa.int64())), "ends": pa.ListArray.from_arrays(offsets, pa.array(hi, pa.int64())),
        })

    return run


def repeated_ranges(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, begins, ends) for every document with words to remove: ranges of word numbers, end exclusive.

    A range joins all windows of ``length`` words whose words also begin in a document with a smaller id; windows are judged
    on the texts as given. id is the document's id (null: the largest), key a hash of its text, so rows that share an id
    keep their own ranges and equal rows share one. Null texts have no words. An empty table gives an empty result.
    """
    docs = _rows(docs, id_col, text_col).select("id", "key", "text")
    often = (
        docs.mapInArrow(_frequent(length), "level int, prefix long, n long").groupBy("level", "prefix").agg(F.sum("n").alias("n"))
    )
    often = often.join(often.filter("level = 0").select(F.col("n").alias("total")).hint("broadcast"), F.expr(f"level = 0 or n * {LARGE} >= total"))
    found = few_rows(often.select("level", "prefix", "n"), 1 + length * LARGE)  # one total, and at most LARGE prefixes of each length
    level, prefix, n = (found.column(c).to_numpy() for c in ("level", "prefix", "n"))
    total = int(n[level == 0].sum())
    levels = [prefix[level == k].view(np.uint64) for k in range(1, length)]
    common = np.sort(prefix[level == length].view(np.uint64))
    low = np.zeros(0, np.int64)
    if len(common):
        least = docs.mapInArrow(_smallest(common, length), "path long, id long").groupBy("path").agg(F.min("id").alias("id"))
        least = {r["path"]: r["id"] for r in few_rows(least, len(common)).to_pylist()}
        low = np.array([least[int(p)] for p in common.view(np.int64)], np.int64)
    groups = max(LEAST_GROUPS, -(-total // GROUP))
    dealt = docs.mapInArrow(_deal(levels, (common, low), groups, length), "to int, block long, data binary")
    found = dealt.groupBy("to").applyInArrow(_repeats, "block long, part int, data binary")
    return found.groupBy("block").applyInArrow(_ranges(length), "key long, id long, begins array<long>, ends array<long>")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("given"), F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST))).alias("id"), F.xxhash64(text).alias("key"), text.alias("text")
    )


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for raw, begins, ends in zip(batch.column("text"), batch.column("begins").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            words = raw.as_py().encode().split()
            gone = 0
            kept = words
            if begins:
                kept, last = [], 0
                for b, e in zip(begins, ends, strict=True):
                    kept += words[last:b]
                    gone += e - b
                    last = e
                kept += words[last:]
            rows.append((len(words), gone, b" ".join(kept)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].decode() for r in rows], pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_text"],
        )


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for every row: the words left, joined by one space."""
    ranges = repeated_ranges(docs, length, id_col, text_col).dropDuplicates(["id", "key"])
    rows = _rows(docs, id_col, text_col).withColumnRenamed("given", "doc_id")
    both = rows.join(ranges, ["id", "key"], "left").select("doc_id", "text", "begins", "ends")
    kind = dict(rows.dtypes)["doc_id"]
    return both.mapInArrow(_kept, f"doc_id {kind}, n_words long, n_removed long, kept_text string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), wins AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM w, unnest(range(1, greatest(len(ws) - 11, 1))) AS t(i) WHERE len(ws) >= 13
), lows AS (SELECT s, min(doc_id) AS low FROM wins GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS gone FROM wins JOIN lows USING (s) WHERE low < doc_id GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
    CASE WHEN gone IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(gone, i)), lambda i: ws[i]) END AS left_over
  FROM w LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(left_over, ' ')) AS kept_sha256 FROM kept
"""
