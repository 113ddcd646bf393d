"""Token ids on disk with constant-time access by key: raw id payloads and a minimal perfect hash index over them.

A store is a folder in shared storage:

    payload/*.bin   the ids of a range of documents, one after the other, in ascending order of their keys: little-endian
                    unsigned integers of 16 bits (32 where the vocabulary needs them), nothing else
    index/*.mph     for the keys of one hash bucket: levels of bits that give each key a number of its own, 0 to n - 1, and
                    at that number a 32-bit fingerprint, the shard, and where its ids begin and how many they are
    documents/      Parquet: every row's key, occurrence, shard, offset and length, as written
    shards/         Parquet: file, ids before it, ids and documents of each shard
    buckets/        Parquet: file of each bucket

Every task writes files under names of its own; what counts are the names that Spark committed to the Parquet tables, so a
task that is lost, repeated or run twice leaves at most a file that nobody reads. Files go through pyarrow's file systems,
so the folder may be any URI that these open on the executors.

Rows with one key are its occurrences 0, 1, ... by text; null is a key like any other and comes first.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsmart.llm.periods import numbered_words
from newsmart.llm.words import LOWER, SPACE, Words, mix, slices, words_of
from newsmart.sources.versions import work_dir

SLICE = 4 << 20
#: Distinct pieces whose ids a worker remembers; beyond that it starts anew (some 150 bytes each).
KNOWN_PIECES = 1 << 20
#: Keys of a bucket, about, and the least number of buckets.
BUCKET = 1 << 20
LEAST_BUCKETS = 32
#: Bits of a level for each key that is left, and the most levels; keys left after these are listed.
SPARE = 2
LEVELS = 48
MAGIC = 0x31764850_4D4E4B54
SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u4")])
#: Bytes of ids in a batch of results, at most, or one document.
BATCH = 8 << 20


def _open(base: str) -> tuple[fs.FileSystem, str]:
    if base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base.removeprefix("file:")
    return fs.FileSystem.from_uri(base)


# --- ids of texts -------------------------------------------------------------------------------


#: Kinds of bytes: 0 space, 1 letter, 2 digit, 3 sign, 4 anything whose word is not cut.
KIND = np.full(256, 4, np.uint8)
KIND[33:127] = 3
KIND[[*range(65, 91), *range(97, 123)]] = 1
KIND[48:58] = 2
KIND[[ord("'"), ord("<")]] = 4
KIND[SPACE] = 0
PROBE = "It's 2024, Ünïcode\u00a0Ｗörds\t#tags... <|endoftext|>THE End'LL 10:30 \x00 x--y"


def pieces_of(w: Words) -> Words:
    """Words cut where letters, digits and signs meet, digits one by one, in lower case; words with bytes beyond these (other
    alphabets, apostrophes, what may be a special token) stay as they are."""
    kind = KIND[w.data]
    odd = np.concatenate([[0], np.cumsum(kind == 4)])
    whole = np.flatnonzero(odd[w.end] > odd[w.start])
    change = np.zeros(len(w.data) + 1, np.int8)
    change[w.start[whole]] += 1
    change[w.end[whole]] -= 1
    inside = np.cumsum(change[:-1], dtype=np.int8) == 1
    new = np.zeros(len(w.data), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    new &= ~inside & (kind > 0)
    new[w.start] = True
    start = np.flatnonzero(new)
    word = np.searchsorted(w.start, start, "right") - 1
    end = np.minimum(np.append(start[1:], len(w.data)), w.end[word])
    return Words(np.where(inside, w.data, LOWER[w.data]), start, end, w.hash[:0], np.searchsorted(start, w.offset), w.offset)


_encoders: dict[tuple, Encoder] = {}


class Encoder:
    """Ids of texts with ``end`` after each. With ``by_piece`` each distinct piece of a word is encoded once and remembered, by
    the worker process, for later texts and tasks: right for tokenizers that lower-case, drop white space and never let a
    token span letters and digits or signs, so that a text's ids are its pieces' ids one after the other. A probe text guards
    against others."""

    def __init__(self, path: str, end: int, by_piece: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.by_piece = Tokenizer.from_file(path), end, by_piece
        self._forget()
        if by_piece and self(pa.array([PROBE]))[0][:-1].tolist() != self._encode([PROBE])[0]:
            raise ValueError(f"{path} does not encode texts piece by piece")

    @staticmethod
    def of(path: str, end: int, by_piece: bool) -> Encoder:
        key = (path, end, by_piece)
        if key not in _encoders:
            _encoders[key] = Encoder(*key)
        return _encoders[key]

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {b" ": 0}  # stands for the end
        self.begin, self.ids = np.array([0, 1], np.int64), np.array([self.end], np.uint32)

    def _numbers(self, pieces: list[bytes]) -> np.ndarray:
        """Places of the pieces' ids in ``begin``; new pieces are encoded."""
        if len(self.known) > KNOWN_PIECES:
            self._forget()
        new = [x for x in pieces if x not in self.known]
        if new:
            ids = self._encode([x.decode() for x in new])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))])
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        if not self.by_piece:
            parts = self._encode([t or "" for t in texts.to_pylist()])
            ids = chain.from_iterable([*p, self.end] for p in parts)
            return np.fromiter(ids, np.uint32), np.array([len(p) + 1 for p in parts], np.int64)
        w = pieces_of(words_of(texts, lower=False))
        number, distinct = numbered_words(w)
        item = np.insert(self._numbers(distinct.to_pylist())[number], w.first[1:], 0)  # the end follows each text's pieces
        n = (self.begin[1:] - self.begin[:-1])[item]
        after = np.concatenate([[0], np.cumsum(n)])
        out = np.empty(after[-1], np.uint32)
        for k in range(0, len(item), 1 << 18):
            m, part = n[k : k + (1 << 18)], item[k : k + (1 << 18)]
            inner = np.arange(m.sum()) + np.repeat(self.begin[part] - (np.cumsum(m) - m), m)
            out[after[k] : after[k] + len(inner)] = self.ids[inner]
        return out, np.diff(after[w.first + np.arange(len(w.first))])


# --- minimal perfect hash -----------------------------------------------------------------------


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    step = np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & (2**64 - 1))
    return (mix(mix(a ^ step) + b * step) % np.uint64(size)).astype(np.int64)


def _print(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (mix(a + mix(b ^ np.uint64(0xD1B54A32D192ED03))) >> np.uint64(32)).astype(np.uint32)


class HashIndex:
    """Slots of distinct keys, known by two 64-bit hashes. Level by level, a key that is alone on its place keeps it; the
    others go on to the next level. A key's number is the count of set bits before its own."""

    def __init__(self, sizes: list[int], bits: np.ndarray, rest: np.ndarray, slots: np.ndarray):
        self.sizes, self.bits, self.rest, self.slots = sizes, bits, rest, slots
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])

    @staticmethod
    def build(a: np.ndarray, b: np.ndarray, shard: np.ndarray, offset: np.ndarray, n: np.ndarray, levels: int = LEVELS) -> HashIndex:
        left, sizes, masks = np.arange(len(a)), [], []
        while len(left) and len(sizes) < levels:
            size = -(-SPARE * len(left) // 64) * 64
            at = _place(a[left], b[left], len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            masks.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        rest = np.stack([a[left], b[left]]) if len(left) else np.zeros((2, 0), np.uint64)
        index = HashIndex(sizes, np.concatenate(masks) if masks else np.zeros(0, "<u8"), rest, np.zeros(len(a), SLOT))
        own = index.numbers(a, b)
        for name, values in (("print", _print(a, b)), ("shard", shard), ("offset", offset), ("n", n)):
            index.slots[name][own] = values
        return index

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each key; any number, or -1, for keys that are not in the index."""
        out, left, base = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            at = _place(a[left], b[left], level, size) + base
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            mine = (word >> bit) & np.uint64(1) == 1
            low = word[mine] & ((np.uint64(1) << bit[mine]) - np.uint64(1))
            out[left[mine]] = self.before[at[mine] >> 6] + np.bitwise_count(low)
            left, base = left[~mine], base + size
        for k, (x, y) in enumerate(self.rest.T):
            out[left[(a[left] == x) & (b[left] == y)]] = self.before[-1] + k
        return out

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each key is there, its slot): a key that is not there passes with a chance of 2**-32."""
        if not len(self.slots):
            return np.zeros(len(a), bool), np.zeros(len(a), SLOT)
        own = self.numbers(a, b)
        slots = self.slots[np.maximum(own, 0)]
        return (own >= 0) & (slots["print"] == _print(a, b)), slots

    def to_bytes(self) -> bytes:
        head = np.array([MAGIC, len(self.sizes), len(self.bits), self.rest.shape[1], len(self.slots), *self.sizes], "<i8")
        return b"".join(x.tobytes() for x in (head, self.bits.astype("<u8"), self.rest.astype("<u8"), self.slots))

    @staticmethod
    def from_bytes(raw: bytes) -> HashIndex:
        magic, levels, words, rest, slots = (int(x) for x in np.frombuffer(raw, "<i8", 5))
        if magic != MAGIC:
            raise ValueError("not an index file")
        at = 8 * (5 + levels)
        sizes = [int(x) for x in np.frombuffer(raw, "<i8", levels, 40)]
        bits = np.frombuffer(raw, "<u8", words, at)
        keys = np.frombuffer(raw, "<u8", 2 * rest, at + 8 * words).reshape(2, rest)
        return HashIndex(sizes, bits, keys, np.frombuffer(raw, SLOT, slots, at + 8 * words + 16 * rest))


# --- writing ------------------------------------------------------------------------------------


def _write_payload(base: str, tokenizer: str, end: int, width: str, by_piece: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, offset, last, seen = None, 0, None, 0
        shard = TaskContext.get().partitionId()
        name = f"payload/{shard:08d}-{uuid.uuid4().hex}.bin"
        for batch in slices(batches, "text", SLICE):
            if out is None:
                encode, (files, root) = Encoder.of(tokenizer, end, by_piece), _open(base)
                out = files.open_output_stream(f"{root}/{name}")
            ids, n = encode(batch.column("text"))
            out.write(ids.astype(width).tobytes())
            key = batch.column("key")
            number = pc.fill_null(key.dictionary_encode(null_encoding="encode").indices, -1).to_numpy(zero_copy_only=False)
            new = np.concatenate([[last is None or key[0].as_py() != last[0]], number[1:] != number[:-1]])
            at = np.arange(len(n))
            since = np.maximum.accumulate(np.where(new, at, -1))
            occurrence = np.where(since >= 0, at - since, at + seen)
            last, seen = (key[-1].as_py(),), int(occurrence[-1]) + 1
            begin = offset + np.cumsum(n) - n
            offset += int(n.sum())
            rows = [key, *(pa.array(x, pa.int64()) for x in (occurrence, np.full(len(n), shard), begin, n)), pa.array([name] * len(n))]
            yield pa.RecordBatch.from_arrays(rows, ["key", "occurrence", "shard", "offset", "n_tokens", "file"])
        if out is not None:
            out.close()

    return run


def _write_index(base: str):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        column = lambda c: rows.column(c).to_numpy()
        a, b = (column(c).view(np.uint64) for c in ("a", "b"))
        index = HashIndex.build(a, b, column("shard"), column("offset"), column("n_tokens"))
        files, root = _open(base)
        name = f"index/{key[0].as_py():08d}-{uuid.uuid4().hex}.mph"
        with files.open_output_stream(f"{root}/{name}") as out:
            out.write(index.to_bytes())
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "file": [name], "n_keys": pa.array([len(a)], pa.int64())})

    return run


def _hashed(keys: DataFrame, buckets: Column) -> DataFrame:
    a, b = F.xxhash64("key", "occurrence"), F.xxhash64(F.lit("second"), "occurrence", "key")
    return keys.withColumns({"a": a, "b": b}).withColumn("bucket", F.pmod("b", buckets))


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end: int, *, id_col: str = "doc_id", text_col: str = "text", by_piece: bool = False,
    vocabulary: int = 1 << 16, bucket: int = BUCKET,
) -> None:
    """Encodes every text and writes a store (see above) to the new folder ``path``.

    tokenizer: a file of the tokenizers library that every executor can open. end: the id after each document.
    vocabulary: ids are below this. Null texts count as empty and have the end alone. Rows are dealt by ranges of their id and
    written as they come, so neither the number nor the length of documents is held in memory; an empty table gives an empty
    store. Other columns of docs are not looked at.
    """
    spark, width = docs.sparkSession, "<u2" if vocabulary <= 1 << 16 else "<u4"
    files, root = _open(path)
    for part in ("payload", "index"):
        files.create_dir(f"{root}/{part}", recursive=True)
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = T.StructType([rows.schema["key"]])
    for c in ("occurrence", "shard", "offset", "n_tokens"):
        kind = kind.add(c, T.LongType())
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key", "text")
    written = ordered.mapInArrow(_write_payload(path, tokenizer, end, width, by_piece), kind.add("file", T.StringType()))
    written.write.parquet(f"{path}/documents")
    written = spark.read.parquet(f"{path}/documents")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    shards = written.groupBy("shard", "file").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_documents"))
    shards = shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).withColumn("width", F.lit(int(width[2:])))
    shards.write.parquet(f"{path}/shards")
    total = spark.read.parquet(f"{path}/shards").agg(F.sum("n_documents")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-total // bucket))
    dealt = _hashed(written, F.lit(buckets)).select("bucket", "a", "b", "shard", "offset", "n_tokens")
    built = dealt.groupBy("bucket").applyInArrow(_write_index(path), "bucket long, file string, n_keys long")
    built.withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/buckets")


# --- reading ------------------------------------------------------------------------------------


def _by_file(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Stretches of rows of one file."""
    for batch in batches:
        name = batch.column("file").dictionary_encode()
        cuts = np.flatnonzero(np.diff(name.indices.to_numpy(), prepend=-1))
        for i, j in zip(cuts, np.append(cuts[1:], batch.num_rows), strict=True):
            yield batch.column("file")[int(i)].as_py(), batch.slice(int(i), int(j - i))


def _look_up(base: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, index = None, None
        for name, rows in _by_file(batches):
            if name != current:
                files, root = _open(base)
                with files.open_input_stream(f"{root}/{name}") as f:
                    current, index = name, HashIndex.from_bytes(f.read())
            there, slots = index.find(*(rows.column(c).to_numpy().view(np.uint64) for c in ("a", "b")))
            found = [pa.array(slots[c][there], pa.int64()) for c in ("shard", "offset", "n")]
            kept = [rows.column(c).filter(pa.array(there)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, *found], [*keep, "shard", "offset", "n_tokens"])

    return run


def _read_payload(base: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, source = None, None
        for name, rows in _by_file(batches):
            if name != current:
                if source is not None:
                    source.close()
                files, root = _open(base)
                current, source = name, files.open_input_file(f"{root}/{name}")
            offset, n = (rows.column(c).to_numpy() for c in ("offset", "n_tokens"))
            width = rows.column("width")[0].as_py()
            i = 0
            while i < len(n):
                j = max(i + 1, int(np.searchsorted(np.cumsum(4 * n[i:]), BATCH, "right")) + i)
                lo, hi = offset[i], int((offset[i:j] + n[i:j]).max())
                if hi - lo > 2 * n[i:j].sum():  # far apart: one by one
                    j, hi = i + 1, int(offset[i] + n[i])
                ids = np.frombuffer(source.read_at(int((hi - lo) * width), int(lo * width)), f"<u{width}").astype("<u4")
                data = [ids[a - lo : a - lo + m].tobytes() for a, m in zip(offset[i:j], n[i:j], strict=True)]
                yield pa.RecordBatch.from_arrays([*(rows.column(c).slice(i, j - i) for c in keep), pa.array(data, pa.binary())], [*keep, "ids"])
                i = j
        if source is not None:
            source.close()

    return run


def look_up(path: str, keys: DataFrame) -> DataFrame:
    """(key, occurrence, shard, offset, n_tokens) of those of the wanted (key, occurrence) rows that the store holds; each
    takes one look at its bucket's index, whatever the store's size. Repeated wanted rows give repeated results."""
    spark = keys.sparkSession
    files = spark.read.parquet(f"{path}/buckets").select("bucket", "file", "buckets")
    count = files.agg(F.coalesce(F.max("buckets"), F.lit(1)).alias("n")).first()[0]
    wanted = _hashed(keys.select("key", F.col("occurrence").cast("long").alias("occurrence")), F.lit(count))
    dealt = wanted.join(files, "bucket").select("key", "occurrence", "a", "b", "file").repartition("file").sortWithinPartitions("file")
    kind = T.StructType([dealt.schema["key"], dealt.schema["occurrence"]])
    for c in ("shard", "offset", "n_tokens"):
        kind = kind.add(c, T.LongType())
    return dealt.mapInArrow(_look_up(path, ["key", "occurrence"]), kind)


def read_tokens(path: str, keys: DataFrame) -> DataFrame:
    """(key, occurrence, start, ids) of those wanted rows that the store holds. start: number of ids of all documents before
    it in the store; ids: little-endian unsigned 32-bit integers (``np.frombuffer(ids, "<u4")``), the end included."""
    shards = keys.sparkSession.read.parquet(f"{path}/shards").select("shard", "file", "base", "width")
    found = look_up(path, keys).join(shards, "shard").withColumn("start", F.col("base") + F.col("offset"))
    dealt = found.repartition("file").sortWithinPartitions("file", "offset")
    keep = ["key", "occurrence", "start"]
    kind = T.StructType([dealt.schema[c] for c in keep]).add("ids", T.BinaryType())
    return dealt.mapInArrow(_read_payload(path, keep), kind)


def all_keys(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(key, occurrence) of every row."""
    counts = docs.groupBy(F.col(id_col).alias("key")).agg(F.count("*").alias("n"))
    return counts.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("occurrence"))


def op12_token_store(spark: SparkSession, sf_dir: str, name: str = "word_bpe_49k.json") -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = f"{work_dir(spark)}/tokens/{uuid.uuid4().hex}"
    write_tokens(docs, path, public_tokenizers.path(name), 2, by_piece=True)
    return read_tokens(path, all_keys(docs)).select(
        F.col("key").alias("doc_id"), "start", F.expr("length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
