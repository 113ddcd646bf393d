"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct buckets of its words, word pairs and pairs with one word between, lower-cased and parted
by space or punctuation, and of the first four and five bytes of longer words, which stand for a word's inflected forms. Every coordinate has its own learning rate; L1 keeps most weights at zero, so what is broadcast to
score all texts is a short list of buckets and weights, never more than 2**20. Learning reads a bounded sample of labelled
rows, those with the lowest hash of their id; scoring reads every row and every word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsmart.llm.words import LOWER, MULTIPLIER, PUNCTUATION, Words, mix, slices, words_of
from newsmart.sources.versions import few_rows

BITS = 20
BUCKETS = 1 << BITS
#: Labelled rows learned from, at most.
SAMPLE = 10_000
EPOCHS = 8
#: Bytes of text whose features are held at a time, about.
PIECE = 1 << 20
#: Lengths in bytes of the beginnings of words.
STEMS = (4, 5)
ALPHA, BETA, L1, L2 = 0.8, 1.0, 6.0, 0.1
#: Salts of words, pairs, pairs with a word between.
SALTS = (np.uint64(0), np.uint64(0x1B873593), np.uint64(0x52DCE729))


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of every n-gram, repeats included."""
    doc = w.text_of_word()
    buckets, docs = [mix(w.hash + SALTS[0])], [doc]
    for gap in (1, 2):
        same = doc[gap:] == doc[:-gap]
        buckets.append(mix(w.hash[:-gap] * MULTIPLIER + w.hash[gap:] + SALTS[gap])[same])
        docs.append(doc[gap:][same])
    for k in STEMS:
        long = np.flatnonzero(w.end - w.start > k)
        stem = np.full(len(long), k, np.uint64)
        for j in range(k):
            stem = stem << np.uint64(8) | LOWER[w.data[w.start[long] + j]].astype(np.uint64)
        buckets.append(mix(stem))
        docs.append(doc[long])
    return (np.concatenate(buckets) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(docs)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", PIECE):
        bucket, doc = features(words_of(batch.column("text"), between=PUNCTUATION))
        pair = np.unique(doc << BITS | bucket)
        bounds = np.searchsorted(pair >> BITS, np.arange(batch.num_rows + 1))
        flat = (pair & (BUCKETS - 1)).astype(np.uint32)
        data = [flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("label"), pa.array(data, pa.binary())], ["order", "label", "data"])


def learn(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights of all buckets, with the bias as one more. Rows are (distinct buckets, label)."""
    z, n, w = (np.zeros(BUCKETS + 1) for _ in range(3))
    l1 = np.full(BUCKETS + 1, L1)
    l1[BUCKETS] = 0
    for _ in range(epochs):
        for bucket, label in rows:
            own = w[bucket]
            g = 1 / (1 + np.exp(-np.clip(own.sum(), -35, 35))) - label
            was = n[bucket]
            now = was + g * g
            root = np.sqrt(now)
            zi = z[bucket] + g - (root - np.sqrt(was)) / ALPHA * own
            n[bucket], z[bucket] = now, zi
            w[bucket] = np.where(np.abs(zi) <= l1[bucket], 0, (np.sign(zi) * l1[bucket] - zi) / ((BETA + root) / ALPHA + L2))
    return w


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        for raw, label in zip(batch.column("data"), batch.column("label").to_pylist(), strict=True):
            own = np.empty(len(raw.as_buffer()) // 4 + 1, np.uint32)
            own[:-1] = np.frombuffer(raw.as_buffer(), np.uint32)
            own[-1] = BUCKETS
            rows.append((own, label))
    w = learn(rows)
    some = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(w[some])], ["bucket", "weight"])


def _score(bucket_ids: np.ndarray, weights: np.ndarray, out: list[str]):
    table, bias = np.zeros(BUCKETS), weights[bucket_ids == BUCKETS].sum()
    inner = bucket_ids < BUCKETS
    table[bucket_ids[inner]] = weights[inner]
    used = table != 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            bucket, doc = features(words_of(batch.column("text"), between=PUNCTUATION))
            hit = used[bucket]
            pair = np.unique(doc[hit] << BITS | bucket[hit])
            total = bias + np.bincount(pair >> BITS, table[pair & (BUCKETS - 1)], minlength=batch.num_rows)
            score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), pa.array(score, pa.float64())], [*out, "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(bucket, weight), the non-zero weights; bucket 2**20 is the bias. docs: (doc_id, text); labels: (doc_id, toxic),
    rows with a null in either left out, the higher label kept where they differ."""
    chosen = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    chosen = chosen.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(sample)  # bounded by ``sample``
    rows = docs.join(F.broadcast(chosen), "doc_id").select("order", "label", "text")
    found = rows.mapInArrow(_features, "order long, label int, data binary")
    return found.orderBy("order", F.xxhash64("data")).limit(sample).coalesce(1).mapInArrow(_learn, "bucket long, weight double")


def score(docs: DataFrame, weights: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and score, 0 to 1, of every row's ``text``. Null texts count as empty: the bias alone. A text that
    is kept goes to the workers once."""
    found = few_rows(weights, (1 << 20) + 1)
    rows = docs.select(*(c for c in keep if c != "text"), F.col("text").cast("string").alias("text"))
    fields = [f for f in rows.schema.fields if f.name in keep]
    run = _score(found["bucket"].to_numpy(), found["weight"].to_numpy(), [f.name for f in fields])
    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("score", T.DoubleType())]))


def fold(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def toxicity(docs: DataFrame, labels: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of docs, held_out, score and predicted for every row; kept columns of these names give way.
    Rows whose crc32(doc_id) mod 5 is 0 are never learned from. Without labelled rows every score is one half."""
    keep = tuple(c for c in keep if c not in ("held_out", "score", "predicted"))
    whole = ("text",) if "text" in keep and dict(docs.dtypes)["text"] == "string" else ()
    rows = docs.select(F.struct(*(c for c in keep if c not in whole), F.lit(0).alias("_")).alias("_kept"), F.col("doc_id").alias("_id"), "text")
    learned = docs.select("doc_id", "text"), labels.filter(fold(F.col("doc_id")) != 0).select("doc_id", "toxic")
    scored = score(rows, fit(*learned), "_kept", "_id", *whole)
    kept = (F.col(c) if c in whole else F.col(f"_kept.`{c}`") for c in keep)
    return scored.select(*kept, (fold(F.col("_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity(docs, labels, "doc_id").select("doc_id", "held_out", "score", "predicted")
