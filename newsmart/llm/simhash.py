"""SimHash fingerprints of word shingles, and near-duplicate classes of fingerprints by pigeonring filtering.

Pigeonring: with 64 bits in three segments on a ring and at most two differing bits, some segment begins a chain in which
the first i segments together differ in at most i * 2 / 3 bits. So a first segment is equal, and the second differs in at
most one bit, which leaves one of its halves equal; the rest of the ring has at most two differing bits in three parts, so
one part is equal, too. These 3 x 2 x 3 chains, of about 42 equal bits each, are the join keys; candidates of a key must
keep every further budget of the chain before all 64 bits are compared. Two fingerprints at two or fewer bits always share
a key. Only distinct fingerprints take part, and a key's partners are returned as links to one of them, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsmart.llm.graphs import components
from newsmart.llm.lines import RARITY_BITS, _sum_parts, may_match, token_sets
from newsmart.llm.words import mix, slices, windows, words_of
from newsmart.sources.versions import durable, few_rows

SEED = 42
#: The ring's segments as (first bit, number of bits).
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Groups up to this size compare their members directly; larger ones meet through shared neighbours.
DIRECT = 64
#: Bits of a set's parities in similar_classes.
MAP = 1024


def fingerprints_of(texts: list[bytes], shingle: int) -> np.ndarray:
    """64-bit fingerprint of each lower-cased text: a bit is set if more than half of the shingle hashes have it."""
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        words = text.split()
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        begin = (np.concatenate([[0], ends[: max(0, len(words) - shingle)]])).tolist()
        stop = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
        ones, n = np.zeros(64, np.int64), len(begin)
        for a in range(0, n, 1 << 16):
            h = np.fromiter([digest(joined[b:e], SEED) for b, e in zip(begin[a : a + (1 << 16)], stop[a : a + (1 << 16)], strict=True)], np.uint64)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]
    return out


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [(x or "").encode().lower() for x in batch.column("text").to_pylist()]
            keep = [c for c in batch.schema.names if c != "text"]
            prints = pa.array(fingerprints_of(texts, shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), prints], [*keep, "print"])

    return run


def with_fingerprint(docs: DataFrame, *keep: str, shingle: int = 3, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and print, the SimHash of ``text_col`` as a signed long. A text with fewer words than a shingle
    is one shingle; one without words, or null, has fingerprint zero. Very long texts are hashed in pieces."""
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("text"))
    fields = [f for f in rows.schema.fields if f.name != "text"]
    return rows.mapInArrow(_fingerprints(shingle), T.StructType([*fields, T.StructField("print", T.LongType())]))


def _bits(x: np.ndarray, at: int, n: int) -> np.ndarray:
    return (x >> np.uint64(at)) & np.uint64((1 << n) - 1)


def chain_keys(x: np.ndarray) -> tuple[np.ndarray, list[np.uint64]]:
    """(chains x fingerprints) array of the bits that each chain holds equal, and each chain's mask."""
    masks = []
    for i in range(3):
        (a, n), (b, m), (c, k) = SEGMENTS[i], SEGMENTS[(i + 1) % 3], SEGMENTS[(i + 2) % 3]
        own = ((1 << n) - 1) << a
        low = m // 2
        for half, rest in (((b, low), (b + low, m - low)), ((b + low, m - low), (b, low))):
            first = ((1 << half[1]) - 1) << half[0]
            third = k // 2
            for at, size in (rest, (c, third), (c + third, k - third)):
                masks.append(np.uint64(own | first | ((1 << size) - 1) << at))
    return np.stack([x & m for m in masks]), masks


def chain_holds(a: np.ndarray, b: np.ndarray, most: int, segments: tuple = SEGMENTS) -> np.ndarray:
    """Whether some segment begins a chain whose cumulative differences keep within their share of ``most``."""
    m = len(segments)
    d = [np.bitwise_count(_bits(a ^ b, at, n)).astype(np.int64) for at, n in segments]
    held = np.zeros(len(a), bool)
    for i in range(m):
        total, ok = np.zeros(len(a), np.int64), np.ones(len(a), bool)
        for j in range(m):
            total = total + d[(i + j) % m]
            ok &= m * total <= (j + 1) * most
        held |= ok
    return held


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.asarray(batch.column("print")).view(np.uint64)
        keys, masks = chain_keys(x)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(len(masks), dtype=np.int8), len(x))), pa.array(keys.reshape(-1).view(np.int64)),
                pa.array(np.tile(x, len(masks)).view(np.int64)), pa.array(np.tile(np.asarray(batch.column("rep")), len(masks))),
            ],
            ["chain", "key", "print", "rep"],
        )


def links_within(group: np.ndarray, x: np.ndarray, most: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the fingerprints, within each run of equal ``group`` numbers, that differ in at most ``most`` (0 to 2)
    bits; all pairs that do are connected by them."""
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    start = np.flatnonzero(np.diff(group, prepend=-1))
    size = np.diff(start, append=len(group))
    small = np.flatnonzero(np.repeat((size > 1) & (size <= DIRECT), size))
    for step in range(1, min(DIRECT, len(small))):
        same = np.flatnonzero(group[small[step:]] == group[small[:-step]])
        if not len(same):
            break
        a, b = small[same], small[same + step]
        near = chain_holds(x[a], x[b], most)
        a, b = a[near], b[near]
        near = np.bitwise_count(x[a] ^ x[b]) <= most
        edges.append((a[near], b[near]))
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    for i in np.flatnonzero(size > DIRECT):  # two are within two bits of each other if they share a neighbour within one bit
        own = np.arange(start[i], start[i] + size[i])
        parts = np.uint64(-(-len(own) * len(flips) // 4_000_000))
        for part in range(int(parts)):  # neighbours by a hash of theirs, which bounds memory
            near, who = [], []
            for flip in flips:
                v = x[own] ^ flip
                mine = mix(v) % parts == part
                near.append(v[mine])
                who.append(own[mine])
            near, who = np.concatenate(near), np.concatenate(who)
            order = np.argsort(near, kind="stable")
            near, who = near[order], who[order]
            same = np.flatnonzero(near[1:] == near[:-1])
            a, b = who[same], who[same + 1]
            close = np.bitwise_count(x[a] ^ x[b]) <= most
            edges.append((a[close], b[close]))
    if not edges:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(z) for z in zip(*edges, strict=True))
    return a, b


def _links(most: int):
    """Links of rows that come sorted by chain and key; a group that spans batches is kept whole."""

    def found(table: pa.Table) -> pa.RecordBatch:
        chain, key = (table.column(c).to_numpy() for c in ("chain", "key"))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (chain[1:] != chain[:-1])
        a, b = links_within(np.cumsum(new), table.column("print").to_numpy().view(np.uint64), most)
        rep = table.column("rep").to_numpy()
        pair = np.unique(np.stack([np.minimum(rep[a], rep[b]), np.maximum(rep[a], rep[b])]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            chain, key = (table.column(c).to_numpy() for c in ("chain", "key"))
            other = np.flatnonzero((key != key[-1]) | (chain != chain[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield found(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None:
            yield found(held)

    return run


def near_classes(prints: DataFrame, most: int = 2) -> DataFrame:
    """(print, component_id) for every distinct fingerprint of ``prints`` (doc_id, print): the smallest doc_id among those
    reachable over fingerprints that differ in at most ``most`` (up to two) bits. Null ids stand for nothing; a class of
    null ids only has a null component."""
    own = durable(prints.groupBy("print").agg(F.min("doc_id").alias("rep")))
    rows = own.filter("rep is not null").mapInArrow(_chains, "chain byte, key long, print long, rep long")
    edges = rows.repartition("chain", "key").sortWithinPartitions("chain", "key").mapInArrow(_links(most), "a long, b long")
    found = components(edges)
    return own.join(found, own["rep"] == found["node"], "left").select("print", F.coalesce("component", "rep").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; fingerprint as 16 lowercase hex digits."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = durable(with_fingerprint(rows, "doc_id", shingle=shingle))
    classes = near_classes(prints, most)
    return prints.join(classes, "print", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def near_texts(texts: DataFrame, most: int = 2, similar: float = 0.8) -> DataFrame:
    """(node, component) of the rows of ``texts`` (node long, text) that are near another: the smallest node reachable over
    SimHash fingerprints that differ in at most ``most`` bits, as in ``near_duplicates``, and over the exact links of
    ``similar_classes``, which add the similar texts that fingerprints miss. Rows of one node hold one text."""
    prints = durable(with_fingerprint(texts, "node"))
    near = near_classes(prints.withColumnRenamed("node", "doc_id"), most)
    links = prints.join(near, "print").select("node", F.col("component_id").alias("component"))
    return components(links.unionByName(similar_classes(texts, similar)), "node", "component")


def _shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts in order, and where each text's begin. A text with fewer words is one shingle,
    one without words is the shingle 0, so every text has one at least."""
    w = words_of(column)
    token, at = windows(w.hash, w.first, k)
    own = np.searchsorted(w.first, at, "right") - 1
    counts = w.counts
    short = np.flatnonzero(counts < k)
    alone = np.zeros(len(short), np.uint64)
    for j in range(k - 1):
        has = counts[short] > j
        alone[has] = mix(alone[has] + w.hash[w.first[:-1][short[has]] + j])
    token, own = np.concatenate([token, alone]), np.concatenate([own, short])
    order = np.lexsort((token, own))
    token, own = token[order], own[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (own[1:] != own[:-1])
    return token[new], np.searchsorted(own[new], np.arange(len(column) + 1))


def _slices(batches: Iterator[pa.RecordBatch], shingle: int):
    """(node, distinct shingles and their bounds) of the texts of a slice, equal nodes once."""
    for batch in slices(batches, "text", 1 << 20):  # small: stages before leave an executor little memory
        _, at = np.unique(batch.column("node").to_numpy(), return_index=True)
        batch = batch.take(pa.array(at))
        yield batch.column("node"), *_shingles(batch.column("text"), shingle)


def _rarities(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << RARITY_BITS, np.int64)
        for _, token, _ in _slices(batches, shingle):
            counts += np.bincount(token >> np.uint64(64 - RARITY_BITS), minlength=1 << RARITY_BITS)
        parts = np.split(np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32), 64)
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "data"])

    return run


def _prefixes(shingle: int, rarity, similar: float):
    """Rows (token, node, n, at): each text's n - ceil(similar * n) + 1 rarest shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, token, bounds in _slices(batches, shingle):
            token, bounds = token_sets(token, np.repeat(np.arange(len(node)), np.diff(bounds)), rarity.value, len(node))
            n = np.diff(bounds)
            most = n - np.ceil(similar * n - 1e-9).astype(np.int64) + 1
            own = np.repeat(np.arange(len(node)), most)
            at = np.arange(len(own)) - np.repeat(np.cumsum(most) - most, most)
            yield pa.RecordBatch.from_arrays(
                [pa.array(token[bounds[own] + at].view(np.int64)), node.take(pa.array(own)), pa.array(n[own].astype(np.int32)), pa.array(at.astype(np.int32))],
                ["token", "node", "n", "at"],
            )

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token and node: those of tokens with several nodes, each node once, beside the token's first node."""

    def group(table: pa.Table) -> pa.RecordBatch:
        c = {name: table.column(name).to_numpy() for name in table.schema.names}
        new = np.ones(len(c["token"]), bool)
        new[1:] = (c["token"][1:] != c["token"][:-1]) | (c["node"][1:] != c["node"][:-1])
        c = {name: x[new] for name, x in c.items()}
        start = np.flatnonzero(np.concatenate([[True], c["token"][1:] != c["token"][:-1]]))
        size = np.diff(start, append=len(c["token"]))
        keep, lead = np.repeat(size > 1, size), np.repeat(start, size)
        out = {name: x[keep] for name, x in c.items()} | {f"lead_{name}": c[name][lead[keep]] for name in ("node", "n", "at")}
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


def parities(token: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each set a row of MAP bits: whether an odd number of its tokens falls on the bit. Two rows differ in at most as many
    bits as there are tokens in one of the sets only."""
    out = np.zeros((len(bounds) - 1, MAP // 64), np.uint64)
    for a in range(0, len(out), 1024):
        b = min(len(out), a + 1024)
        own = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
        place = own * MAP + (mix(token[bounds[a] : bounds[b]]) % np.uint64(MAP)).astype(np.int64)
        odd = np.bincount(place, minlength=(b - a) * MAP).reshape(-1, MAP) & 1
        out[a:b] = np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)
    return out


def _maps(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, token, bounds in _slices(batches, shingle):
            odd = parities(token, bounds)
            offsets = pa.array(np.arange(0, odd.size + 1, odd.shape[1], dtype=np.int32))
            odd = pa.ListArray.from_arrays(offsets, pa.array(odd.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([node, pa.array(np.diff(bounds).astype(np.int32)), odd], ["node", "n", "odd"])

    return run


def _shingle_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, token, bounds in _slices(batches, shingle):
            sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(token.view(np.int64)))
            yield pa.RecordBatch.from_arrays([node, sets], ["node", "tokens"])

    return run


def _may_be_alike(similar: float):
    """Pairs whose parity rows do not differ in more bits than their sets may differ in tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.asarray(batch.column(c).flatten()).view(np.uint64).reshape(-1, MAP // 64) for c in ("odd", "_odd"))
            n = np.asarray(batch.column("n")).astype(np.int64) + np.asarray(batch.column("_n"))
            near = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= n * (1 - similar) / (1 + similar) + 1e-6
            yield batch.select(["node", "lead"]).take(pa.array(np.flatnonzero(near)))

    return run


def similar_classes(texts: DataFrame, similar: float = 0.8, shingle: int = 5) -> DataFrame:
    """(node, component) of the rows of ``texts`` (node long, text) whose shingle sets are similar (Jaccard) to another's:
    the smallest node reachable. Rows of one node hold one text; null texts are empty, texts without words all equal.

    An exact join, as of lines (see lines.py): similar sets share a token among the first n - ceil(similar * n) + 1 of each,
    in any fixed order; here by rarity, so that passages of many texts come last. Within a token every text first meets the
    smallest node. Texts that these links connect need not meet again; all others of a token meet each other, also those
    that were linked. Pairs must pass the length and positional filters and a bound on the sets' difference by their
    parities, none of which drops a similar pair; what is left is verified on whole shingle sets.
    """
    spark = texts.sparkSession
    parts = texts.mapInArrow(_rarities(shingle), "part int, data binary").groupBy("part").applyInArrow(_sum_parts, "part int, data binary")
    counts = np.zeros((64, (1 << RARITY_BITS) // 64), np.int64)
    for row in few_rows(parts, 64).to_pylist():  # 8 MB
        counts[row["part"]] = np.frombuffer(row["data"], np.int64)
    rarity = spark.sparkContext.broadcast(np.minimum(counts.reshape(-1), (1 << RARITY_BITS) - 1).astype(np.int32))
    prefixes = texts.mapInArrow(_prefixes(shingle, rarity, similar), "token long, node long, n int, at int")
    met = durable(
        prefixes.repartition("token").sortWithinPartitions("token", "node")
        .mapInArrow(_met, "token long, node long, n int, at int, lead_node long, lead_n int, lead_at int")
    )

    def once(rows: DataFrame, among: DataFrame) -> DataFrame:
        """A row for each node of ``among``."""
        return durable(rows.join(among.distinct(), "node", "left_semi").dropDuplicates(["node"]))

    maps = once(texts.mapInArrow(_maps(shingle), "node long, n int, odd array<long>"), met.select("node"))

    def alike(pairs: DataFrame) -> DataFrame:
        other = maps.select(F.col("node").alias("lead"), F.col("n").alias("_n"), F.col("odd").alias("_odd"))
        both = pairs.distinct().join(maps, "node").join(other, "lead")
        near = durable(both.mapInArrow(_may_be_alike(similar), "node long, lead long"))
        sets = once(texts.mapInArrow(_shingle_sets(shingle), "node long, tokens array<long>"), near.select("node").unionByName(near.select(F.col("lead").alias("node"))))
        both = near.join(sets, "node").join(sets.select(F.col("node").alias("lead"), F.col("tokens").alias("_t")), "lead")
        common = F.size(F.array_intersect("tokens", "_t"))
        return durable(both.filter(common >= F.lit(similar) * (F.size("tokens") + F.size("_t") - common) - 1e-9).select("node", "lead"))

    lead = met.filter("node <> lead_node").filter(may_match(F.col("n"), F.col("at"), F.col("lead_n"), F.col("lead_at"), similar))
    found = alike(lead.select("node", F.col("lead_node").alias("lead")))
    tied = durable(components(found, "node", "lead"))
    rows = met.filter("node <> lead_node").join(tied, "node", "left").select("token", "node", "n", "at", F.coalesce("component", "node").alias("part"))
    several = rows.groupBy("token").agg(F.min("part").alias("_a"), F.max("part").alias("_b")).filter("_a < _b")
    rows = durable(rows.join(several, "token", "left_semi"))
    others = rows.select("token", F.col("node").alias("lead"), F.col("n").alias("_n"), F.col("at").alias("_at"), F.col("part").alias("_part"))
    pairs = rows.join(others, "token").filter(F.col("_part") < F.col("part")).filter(may_match(F.col("n"), F.col("at"), F.col("_n"), F.col("_at"), similar))
    return components(found.unionByName(alike(pairs.select("node", "lead"))), "node", "lead")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
