"""Removal of repeated lines: exact set-similarity join with prefix, positional and length filters.

A line's tokens are its runs of five words, lower-cased (a shorter line is one token); two lines match at a Jaccard
similarity of 0.8 or more. Tokens are ordered by rarity, counted over all lines in a table of fixed size, then by hash: any
fixed order gives the same result, a rare-first one gives fewer candidates. Similar lines share a token within the first
n - ceil(0.8 n) + 1 of each, so only these prefixes are shuffled; partners must also pass the length filter and, from where
they meet, the positional one. Equal lines take part once. Within a token's group every line first meets the earliest; only
lines that this does not remove meet the others. Candidates are verified on their whole token sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmart.llm.words import _powers_to, mix, slices, text_bytes, windows, words_of
from newsmart.sources.versions import durable, few_rows

SHINGLE = 5
SIMILAR = 0.8
RARITY_BITS = 20
HASH_BITS = 64 - RARITY_BITS
#: Bytes of text that a task works on at a time.
SLICE = 1 << 20
#: Bits of the map that narrows down which lines' token sets are read again.
MAP_BITS = 24


def lines_of(batch: pa.RecordBatch):
    """(text number and line number of each line, its words, its hash); lines without words have hash 0."""
    data, offset = text_bytes(batch.column("text"))
    cuts = np.flatnonzero(data == 10) + 1
    bounds = np.sort(np.concatenate([offset, cuts]), kind="stable")
    doc = np.searchsorted(offset, bounds[:-1], "right") - 1
    # a text that ends in a line feed has an empty last line, whose bound is also the next text's beginning
    owner = np.repeat(np.arange(batch.num_rows), np.diff(np.searchsorted(cuts, offset, "right")) + 1)
    doc = owner if len(owner) == len(doc) else doc
    number = np.arange(len(doc)) - np.repeat(np.flatnonzero(np.diff(doc, prepend=-1)), np.bincount(doc, minlength=1)[np.unique(doc)])
    column = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
    w = words_of(column)
    power, inverse = _powers_to(len(w.hash) + 1)
    sums = np.zeros(len(w.hash) + 1, np.uint64)
    np.cumsum(w.hash * power[: len(w.hash)], dtype=np.uint64, out=sums[1:])
    a, b = w.first[:-1], w.first[1:]
    whole = mix((sums[b] - sums[a]) * inverse[a])
    whole[a == b] = 0
    return doc, number, w, whole


def line_tokens(w, k: int, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all lines, or of the chosen ones (a flag for each line), and whose they are."""
    h, first = w.hash, w.first
    if chosen is not None:
        n = np.where(chosen, w.counts, 0)
        h, first = h[np.repeat(chosen, w.counts)], np.concatenate([[0], np.cumsum(n)])
    token, at = windows(h, first, k)
    size = np.diff(first)
    short = np.flatnonzero((size > 0) & (size < k))
    whole = np.zeros(0, np.uint64)
    if len(short):
        sums = np.zeros(len(h) + 1, np.uint64)
        power, inverse = _powers_to(len(h) + 1)
        np.cumsum(h * power[: len(h)], dtype=np.uint64, out=sums[1:])
        whole = mix(mix((sums[first[short + 1]] - sums[first[short]]) * inverse[first[short]]))
    return np.concatenate([token, whole]), np.concatenate([np.searchsorted(first, at, "right") - 1, short])


def token_sets(token: np.ndarray, line: np.ndarray, rarity: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of each of n lines as 64-bit numbers in order of rarity, and where each line's begin."""
    rank = np.minimum(rarity[token >> np.uint64(64 - RARITY_BITS)], (1 << RARITY_BITS) - 1).astype(np.uint64)
    token = (rank << np.uint64(HASH_BITS)) | (token & np.uint64((1 << HASH_BITS) - 1))
    order = np.lexsort((token, line))
    token, line = token[order], line[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (line[1:] != line[:-1])
    token, line = token[new], line[new]
    return token, np.searchsorted(line, np.arange(n + 1))


def _rarity(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << RARITY_BITS, np.int64)
        for batch in slices(batches, "text", SLICE):
            token, _ = line_tokens(lines_of(batch)[2], k)
            counts += np.bincount(token >> np.uint64(64 - RARITY_BITS), minlength=1 << RARITY_BITS)
        parts = np.split(np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32), 64)
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "data"])

    return run


def _sum_parts(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(raw.as_py(), np.int32).astype(np.int64) for raw in group.column("data"))
    return pa.table({"part": group.column("part").slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})


def _prefixes(k: int, rarity, similar: float):
    """Rows (token, line, n, at, id, no): the prefix tokens of each line; a block's equal lines once, at the earliest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            doc, number, w, whole = lines_of(batch)
            ids = batch.column("id").to_numpy()
            order = np.lexsort((number, ids[doc], whole))
            first = np.zeros(len(whole), bool)
            first[order[np.flatnonzero(np.diff(whole[order].view(np.int64), prepend=~whole[order[:1]].view(np.int64)))]] = True
            first &= whole != 0
            token, bounds = token_sets(*line_tokens(w, k, first), rarity.value, len(whole))
            n = np.diff(bounds)
            most = n - np.ceil(similar * n - 1e-9).astype(np.int64) + 1
            most[n == 0] = 0
            own = np.repeat(np.arange(len(whole)), most)
            at = np.arange(len(own)) - np.repeat(np.cumsum(most) - most, most)
            yield pa.RecordBatch.from_arrays(
                [pa.array(token[bounds[own] + at].view(np.int64)), pa.array(whole[own].view(np.int64)), pa.array(n[own].astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(ids[doc[own]]), pa.array(number[own].astype(np.int32))],
                ["token", "line", "n", "at", "id", "no"],
            )

    return run


def _occurrences(k: int, rarity, wanted):
    """Rows (line, id, key, no, tokens) of all lines that hold words; tokens where the bit map holds the line, once a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            doc, number, w, whole = lines_of(batch)
            first = np.zeros(len(whole), bool)
            first[np.unique(whole, return_index=True)[1]] = True
            place = (whole & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
            first &= (whole != 0) & ((wanted.value[place >> 3] >> (place & 7)) & 1 == 1)
            token, bounds = token_sets(*line_tokens(w, k, first), rarity.value, len(whole))
            has = np.flatnonzero(whole)
            own = pa.array(doc[has])
            offsets = pa.array(np.append(bounds[has], len(token)).astype(np.int32), mask=np.append(~first[has], False))
            yield pa.RecordBatch.from_arrays(
                [pa.array(whole[has].view(np.int64)), batch.column("id").take(own), batch.column("key").take(own), pa.array(number[has].astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(token.view(np.int64)))],
                ["line", "id", "key", "no", "tokens"],
            )

    return run


def may_match(n: Column, at: Column, other_n: Column, other_at: Column, similar: float = SIMILAR) -> Column:
    """Length and positional filters for two lines whose first common token stands at the given places."""
    need = F.ceil(similar / (1 + similar) * (n + other_n) - F.lit(1e-9))
    return (n >= F.lit(similar) * other_n - 1e-9) & (other_n >= F.lit(similar) * n - 1e-9) & (1 + F.least(n - at, other_n - other_at) - 1 >= need)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token: those of tokens with several lines, each line once, numbered within the token by place (id,
    no), with the earliest line of the token beside them."""

    def group(table: pa.Table) -> pa.RecordBatch:
        c = {name: table.column(name).to_numpy() for name in table.schema.names}
        many = np.ones(len(c["token"]), bool)
        many[1:-1] = (c["token"][1:-1] == c["token"][:-2]) | (c["token"][1:-1] == c["token"][2:])
        c = {name: x[many] for name, x in c.items()}  # most tokens stand alone
        order = np.lexsort((c["no"], c["id"], c["line"], c["token"]))
        c = {name: x[order] for name, x in c.items()}
        new = np.ones(len(c["token"]), bool)
        new[1:] = (c["token"][1:] != c["token"][:-1]) | (c["line"][1:] != c["line"][:-1])
        c = {name: x[new] for name, x in c.items()}
        order = np.lexsort((c["line"], c["no"], c["id"], c["token"]))
        c = {name: x[order] for name, x in c.items()}
        start = np.flatnonzero(np.concatenate([[True], c["token"][1:] != c["token"][:-1]]))
        size = np.diff(start, append=len(c["token"]))
        lead = np.repeat(start, size)
        rank = np.arange(len(lead)) - lead
        keep = np.repeat(size > 1, size)
        out = {name: c[name][keep] for name in ("token", "line", "n", "at")} | {"rank": rank[keep].astype(np.int32)}
        out |= {f"lead_{name}": c[name][lead[keep]] for name in ("line", "n", "at")}
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out.values()], list(out))

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        token = table.column("token").to_numpy()
        cut = int(np.searchsorted(token, token[-1]))
        if cut:
            yield group(table.slice(0, cut))
        held = table.slice(cut)
    if held is not None:
        yield group(held)


def repeated_lines(docs: DataFrame, similar: float = SIMILAR, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, removed) of every document with lines to remove: their numbers, from 0, in order.

    A line goes if an earlier line matches it, earlier by document id, then line number; lines are judged on the texts as
    given. Lines without words stay. id is the document's id (null: the largest), key a hash of its text; rows that agree
    in both count as one document. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = keyed(docs, id_col, text_col).select("id", "key", "text")
    parts = docs.mapInArrow(_rarity(k), "part int, data binary").groupBy("part").applyInArrow(_sum_parts, "part int, data binary")
    counts = np.zeros((64, (1 << RARITY_BITS) // 64), np.int64)
    for row in few_rows(parts, 64).to_pylist():  # 8 MB
        counts[row["part"]] = np.frombuffer(row["data"], np.int64)
    rarity = spark.sparkContext.broadcast(np.minimum(counts.reshape(-1), (1 << RARITY_BITS) - 1).astype(np.int32))
    prefixes = docs.mapInArrow(_prefixes(k, rarity, similar), "token long, line long, n int, at int, id long, no int")
    met = durable(
        prefixes.repartition("token").sortWithinPartitions("token")
        .mapInArrow(_met, "token long, line long, n int, at int, rank int, lead_line long, lead_n int, lead_at int")
    )
    low = (1 << MAP_BITS) - 1
    place = F.col("line").bitwiseAND(low) + 1
    bits = met.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    wanted = np.zeros(1 << MAP_BITS >> 3, np.uint8)  # 2 MB
    for row in few_rows(bits, (1 << MAP_BITS) // 32_768).to_pylist():
        raw = np.frombuffer(row["bits"], np.uint8)
        at = (row["bucket"] - 1) * len(raw)
        wanted[at : at + len(raw)] = raw
    told = durable(docs.mapInArrow(_occurrences(k, rarity, spark.sparkContext.broadcast(wanted)), "line long, id long, key long, no int, tokens array<long>"))
    places, sets = told.select("line", "id", "key", "no"), told.filter("tokens is not null").select("line", "tokens")
    sets = durable(sets.join(met.select("line").distinct(), "line", "left_semi").dropDuplicates(["line"]))

    def matching(pairs: DataFrame) -> DataFrame:
        """Lines of ``pairs`` (line, other) whose sets are similar to the other's."""
        both = pairs.distinct().join(sets, "line").join(sets.select(F.col("line").alias("other"), F.col("tokens").alias("_t")), "other")
        common = F.size(F.array_intersect("tokens", "_t"))
        return both.filter(common >= F.lit(similar) * (F.size("tokens") + F.size("_t") - common) - 1e-9).select("line").distinct()

    lead = met.filter("rank > 0").filter(may_match(F.col("n"), F.col("at"), F.col("lead_n"), F.col("lead_at"), similar))
    gone = durable(matching(lead.select("line", F.col("lead_line").alias("other"))))
    left = met.filter("rank > 1").join(gone, "line", "left_anti")
    others = met.filter("rank > 0").select("token", F.col("line").alias("other"), F.col("n").alias("_n"), F.col("at").alias("_at"), F.col("rank").alias("_rank"))
    pairs = left.join(others, "token").filter(F.col("_rank") < F.col("rank")).filter(may_match(F.col("n"), F.col("at"), F.col("_n"), F.col("_at"), similar))
    gone = gone.unionByName(matching(pairs.select("line", "other"))).withColumn("gone", F.lit(True))
    firsts = places.groupBy("line").agg(F.min(F.struct("id", "no", "key")).alias("first")).join(gone, "line", "left").withColumnRenamed("line", "_l")
    out = places.join(firsts, F.col("line") == F.col("_l")).filter(F.col("gone").isNotNull() | (F.struct("id", "no", "key") != F.col("first")))
    return out.groupBy("id", "key").agg(F.sort_array(F.collect_set("no")).alias("removed"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumns({"id": F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), "key": F.xxhash64(text), "text": text})


def without_repeated_lines(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, with the lines left in ``text_col`` (null: null), and n_lines and n_removed beside them."""
    removed = repeated_lines(docs, similar, SHINGLE, id_col, text_col).select(F.col("id").alias("_id"), F.col("key").alias("_key"), "removed")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumns({"_own_id": F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), "_own_key": F.xxhash64(text)})
    both = rows.join(removed, (F.col("_own_id") == F.col("_id")) & (F.col("_own_key") == F.col("_key")), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.when(F.col("removed").isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("removed", i.cast("int"))), "\n"))
    counts = {"n_lines": F.size(F.split(text, "\n", -1)).cast("long"), "n_removed": F.coalesce(F.size("removed"), F.lit(0)).cast("long")}
    return both.withColumns(counts).withColumn(text_col, kept).drop("_own_id", "_own_key", "_id", "_key", "removed")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    removed = repeated_lines(docs).select("id", "key", "removed")
    rows = keyed(docs, "doc_id", "text").select("doc_id", "id", "key", (F.regexp_count("text", F.lit("\n")) + 1).cast("long").alias("n_lines"))
    return rows.join(removed, ["id", "key"], "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit("")).alias("removed_lines")
    )


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, no - 1 AS no, list_filter(regexp_split_to_array(s, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d, unnest(ls) WITH ORDINALITY AS t(s, no)
), lowered AS (
  SELECT doc_id, no, list_transform(ws, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM lines WHERE len(ws) > 0
), sets AS (
  SELECT doc_id, no, list_distinct(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM lowered
), firsts AS (SELECT s, min((doc_id, no)) AS first FROM (SELECT doc_id, no, list_sort(s) AS s FROM sets) GROUP BY s),
numbered AS (SELECT row_number() OVER (ORDER BY first) AS k, s, first FROM firsts),
tokens AS (SELECT k, len(s) AS n, unnest(s) AS t FROM numbered),
common AS (
  SELECT a.k AS early, b.k AS late FROM tokens a JOIN tokens b ON a.t = b.t AND a.k < b.k
  GROUP BY a.k, b.k HAVING count(*) >= 0.8 * (min(a.n) + min(b.n) - count(*)) - 1e-9
), gone AS (
  SELECT x.doc_id, x.no FROM (SELECT doc_id, no, list_sort(s) AS s FROM sets) x JOIN numbered m ON m.s = x.s
  WHERE (x.doc_id, x.no) > m.first OR m.k IN (SELECT late FROM common)
), listed AS (SELECT doc_id, count(*) AS n_removed, string_agg(no::VARCHAR, ',' ORDER BY no) AS removed_lines FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(string_split(coalesce(d.text, ''), chr(10)))::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(removed_lines, '') AS removed_lines
FROM documents d LEFT JOIN listed USING (doc_id)
"""
