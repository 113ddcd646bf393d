"""Periodic runs of words: maximal repetitions found with longest common extensions over a difference cover.

A run of period q is a stretch of words in which words q apart are equal, at least 2q long, that no neighbouring word
extends. Every run of period q holds two neighbouring points of the grid 0, q, 2q, ..., so for each q only the equal words
at neighbouring grid points are looked at (a harmonic number of pairs per word) and extended both ways. An extension first
compares a few words; what is still equal then goes on to the next pair of positions that are both in a difference cover of
the positions, whose suffixes are sorted, and is answered by a range minimum over the common lengths of neighbours in that
order. Only texts with such long extensions have their cover sorted. Each stretch comes up under its smallest period first;
multiples of the period find the same stretch again.

Words are numbered exactly (no hashes), blocks of words that hash alike are compared word by word. Spark deals the texts;
a task works on a megabyte of texts at a time, or on one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsmart.llm.words import WORDS, slices, words_of

SHORTEST = 12
SLICE = 1 << 20
#: Residues whose pairwise differences give every residue modulo SPACING (a perfect difference set).
COVER = (1, 5, 11, 24, 25, 27)
SPACING = 31
#: Words that are compared before a cover is sorted.
FEW = 16
#: Pairs of grid points that are extended at a time.
PAIRS = 1 << 18


def _shifts() -> np.ndarray:
    """For residues a and b the least t that takes both a + t and b + t into the cover."""
    inside = np.isin(np.arange(SPACING), COVER)
    both = lambda a, b: next(t for t in range(SPACING) if inside[(a + t) % SPACING] and inside[(b + t) % SPACING])
    return np.array([[both(a, b) for b in range(SPACING)] for a in range(SPACING)], np.int64)


SHIFT = _shifts()
PLACE = np.cumsum(np.isin(np.arange(SPACING), COVER)) - 1


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _block_numbers(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Equal numbers for equal blocks of SPACING words that begin at ``at``."""
    h = np.zeros(len(at), np.uint64)
    for t in range(SPACING):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[at + t].astype(np.uint64)
        h ^= h >> np.uint64(29)
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    like = at[first[number]]
    if all(np.array_equal(x[at + t], x[like + t]) for t in range(SPACING)):
        return number.astype(np.int64)
    return np.unique(x[at[:, None] + np.arange(SPACING)], axis=0, return_inverse=True)[1].astype(np.int64).ravel()


class Extensions:
    """Common lengths of suffixes of x, which ends in a value that occurs nowhere else."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        self.x = np.concatenate([x, np.arange(-2 * SPACING, 0) - n - 2 + int(min(x.min(), 0))])
        at = (np.arange(-(-n // SPACING))[:, None] * SPACING + np.array(COVER)).ravel()
        at = at[at < n]
        m = len(at)
        rank = _block_numbers(self.x, at) + 1
        levels, step = [rank], len(COVER)  # level k: order of the 2**k blocks from each covered position on
        while rank.max(initial=0) < m and step < m:
            after = np.zeros(m, np.int64)
            after[: m - step] = rank[step:]
            rank = _dense(rank * (m + 1) + after) + 1
            levels.append(rank)
            step *= 2
        order = np.argsort(rank, kind="stable")
        self.rank = np.empty(m, np.int64)
        self.rank[order] = np.arange(m)
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(max(m - 1, 0), np.int32)
        for k in range(len(levels) - 1, -1, -1):
            inside = np.flatnonzero((a < m) & (b < m))
            same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
            common[same] += 1 << k
            a[same] += len(COVER) << k
            b[same] += len(COVER) << k
        self.least = [common]
        while 2 << (len(self.least) - 1) <= len(common):
            half, last = 1 << (len(self.least) - 1), self.least[-1]
            self.least.append(np.minimum(last[:-half], last[half:]))

    def _blocks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of common blocks from two covered positions on."""
        place = lambda i: self.rank[i // SPACING * len(COVER) + PLACE[i % SPACING]]
        a, b = place(a), place(b)
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.log2(np.maximum(hi - lo, 1)).astype(np.int64)
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            mine = np.flatnonzero(level == k)
            out[mine] = np.minimum(self.least[k][lo[mine]], self.least[k][hi[mine] - (1 << k)])
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from i and from j on, i and j differ."""
        to = SHIFT[i % SPACING, j % SPACING]
        out = equal_words(self.x, i, j, to)
        far = np.flatnonzero(out == to)
        a, b = i[far] + to[far], j[far] + to[far]
        more = self._blocks(a, b) * SPACING
        rest = equal_words(self.x, a + more, b + more, np.full(len(far), SPACING))
        out[far] += more + rest
        return out


def equal_words(x: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Number of equal values from i and from j on, at most ``most``."""
    out = np.zeros(len(i), np.int64)
    open_ = np.flatnonzero(most > 0)
    t = 0
    while len(open_):
        open_ = open_[x[i[open_] + t] == x[j[open_] + t]]
        t += 1
        out[open_] = t
        open_ = open_[most[open_] > t]
    return out


class _Both:
    """Extensions to both sides within texts x[first[k] : first[k + 1] - 1], each ending in a value of its own, as x[0] is."""

    def __init__(self, x: np.ndarray, first: np.ndarray):
        self.x, self.back, self.first = x, x[::-1], first
        self.known: np.ndarray = np.zeros(0, np.int64)

    def _sorted(self, texts: np.ndarray) -> None:
        if np.isin(texts, self.known).all():
            return
        self.known = np.union1d(texts, self.known)
        parts = [self.x[self.first[k] : self.first[k + 1]] for k in self.known]
        own = np.concatenate([self.x[:1], *parts])
        self.base = np.concatenate([[1], 1 + np.cumsum([len(p) for p in parts])])[:-1]
        self.size = len(own)
        self.right, self.left = Extensions(own), Extensions(own[::-1])

    def lengths(self, text: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal words from i and j on, and before i and j."""
        few, last = np.full(len(i), FEW), len(self.x) - 1
        right, left = equal_words(self.x, i, j, few), equal_words(self.back, last - i + 1, last - j + 1, few)
        far_right, far_left = np.flatnonzero(right == FEW), np.flatnonzero(left == FEW)
        if len(far_right) or len(far_left):
            self._sorted(np.unique(np.concatenate([text[far_right], text[far_left]])))
            shift = lambda k: self.base[np.searchsorted(self.known, text[k])] - self.first[text[k]]
            s = shift(far_right)
            right[far_right] = self.right.common(i[far_right] + s, j[far_right] + s)
            s, last = shift(far_left), self.size
            left[far_left] = self.left.common(last - i[far_left] - s, last - j[far_left] - s)
        return right, left


def find_runs(words: np.ndarray, first: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run of ``shortest`` words or more, by text, start and period. words: numbers of
    all texts' words, equal for equal words; first: where each text begins, with their number at the end."""
    n, none = len(first) - 1, np.zeros(0, np.int64)
    longest = int(np.diff(first).max(initial=0))
    if longest < max(2, shortest):
        return none, none, none, none
    x = np.empty(len(words) + n + 1, np.int64)
    owner = np.repeat(np.arange(n), np.diff(first))
    begin = first + np.arange(n + 1) + 1  # of each text in x
    x[begin - 1] = -1 - np.arange(n + 1)
    x[np.arange(len(words)) + owner + 1] = words
    text_of = np.full(len(x), -1, np.int64)
    text_of[np.arange(len(words)) + owner + 1] = owner
    both, found, waiting, pairs = _Both(x, begin), [], [], 0

    def extend() -> None:
        i = np.concatenate([w * p for w, p in waiting])
        p = np.concatenate([np.full(len(w), p) for w, p in waiting])
        text = text_of[i]
        own = np.flatnonzero((text >= 0) & (text == text_of[i + p]))
        i, p, text = i[own], p[own], text[own]
        right, left = both.lengths(text, i, i + p)
        good = np.flatnonzero((right + left >= p) & (right + left + p >= shortest))
        found.append(_smallest(text[good], i[good] - left[good], (right + left + p)[good], p[good]))

    for p in range(1, longest // 2 + 1):
        grid = x[::p]
        at = np.flatnonzero(grid[:-1] == grid[1:])
        for k in range(0, len(at), PAIRS):
            part = at[k : k + PAIRS]
            waiting.append((part, p))
            pairs += len(part)
            if pairs >= PAIRS:
                extend()
                waiting, pairs = [], 0
    if pairs:
        extend()
    if not found:
        return none, none, none, none
    text, start, length, period = _smallest(*(np.concatenate(c) for c in zip(*found, strict=True)))
    return text, start - begin[text], length, period


def _smallest(text, start, length, period):
    """Each stretch once, with its smallest period."""
    order = np.lexsort((period, length, start))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(start[order]) != 0) | (np.diff(length[order]) != 0)
    order = order[new]
    order = order[np.lexsort((period[order], start[order]))]
    return text[order], start[order], length[order], period[order]


def numbered_words(w) -> tuple[np.ndarray, pa.Array]:
    """Number of each word, equal for equal words (compared byte by byte), and the distinct words by their numbers."""
    cuts = np.empty(2 * len(w.start) + 1, np.int64)
    cuts[0:-1:2], cuts[1::2], cuts[-1] = w.start, w.end, len(w.data)
    spans = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(w.data)])
    found = spans.take(pa.array(np.arange(0, len(spans), 2))).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def joined_words(w, kept: np.ndarray) -> pa.Array:
    """Each text's words with ``kept`` set, joined by one space."""
    at = np.flatnonzero(kept)
    text = np.searchsorted(w.first, at, "right") - 1
    size = w.end[at] - w.start[at]
    space = np.ones(len(at), np.int64)
    space[:1] = 0
    space[1:] = text[1:] == text[:-1]
    after = np.cumsum(size + space)
    out = np.full(int(after[-1]) if len(at) else 0, 0x20, np.uint8)
    for k in range(0, len(at), 1 << 16):
        n, to, begin = size[k : k + (1 << 16)], after[k : k + (1 << 16)], w.start[at[k : k + (1 << 16)]]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(to - n, n) + inner] = w.data[np.repeat(begin, n) + inner]
    ends = np.concatenate([[0], after])[np.searchsorted(at, w.first)]
    return pa.Array.from_buffers(pa.large_string(), len(w.first) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)])


def _periodic(shortest: int, schema: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", SLICE):
            w = words_of(batch.column("_text"), lower=False)
            text, start, length, period = find_runs(numbered_words(w)[0], w.first, shortest)
            change = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(change, w.first[text] + start + period, 1)
            np.add.at(change, w.first[text] + start + length, -1)
            kept = np.cumsum(change[:-1]) == 0
            fields = [pa.array(c, pa.int64()) for c in (start, length, period)]
            runs = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
            offsets = pa.array(np.searchsorted(text, np.arange(len(w.first))), pa.int32())
            own = [pa.array(w.counts, pa.int64()), pa.ListArray.from_arrays(offsets, runs), joined_words(w, kept).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema), *own], [*schema, "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, *keep: str, text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """The columns ``keep`` of every row with n_words, runs (array of start, length, period; by start, then period) and
    collapsed: the words outside all runs' repetitions (a run's first ``period`` words stay), joined by one space.

    Null, empty and blank texts have no words, no runs and an empty collapsed text. Rows are independent of each other, so
    repeated rows repeat their result; an empty table gives an empty result. Kept columns named n_words, runs or collapsed
    give way to the results.
    """
    keep = tuple(c for c in keep if c not in ("n_words", "runs", "collapsed"))
    rows = docs.select(F.struct(*keep).alias("_kept") if keep else F.lit(0).alias("_kept"), F.col(text_col).cast("string").alias("_text"))
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    kind = T.StructType([rows.schema["_kept"]]).add("n_words", T.LongType()).add("runs", T.ArrayType(run)).add("collapsed", T.StringType())
    out = rows.mapInArrow(_periodic(shortest, ["_kept"]), kind)
    return out.select(*(["_kept.*"] if keep else []), "n_words", "runs", "collapsed")


def with_repeated_end(doc_id: Column, text: Column) -> Column:
    """Text whose words from word a on repeat p words over and over, where the id's checksum h is a multiple of 10: a is
    h/10 modulo the number of words n, p is 1 + (n - a) / (3 + h/10 modulo 8), all rounded down."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(text, WORDS.replace("[^", "[")), lambda x: x != "")
    parts = F.struct(words.alias("w"), F.floor(h / 10).alias("g"))

    def changed(s: Column) -> Column:
        n = F.size(s["w"]).cast("long")
        a = s["g"] % n
        p = F.floor((n - a) / (3 + s["g"] % 8)) + 1
        at = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.transform(at, lambda i: F.get(s["w"], i.cast("int"))), " ")).otherwise(text)

    return F.when(h % 10 == 0, F.get(F.transform(F.array(parts), changed), 0)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", with_repeated_end(F.col("doc_id"), F.col("text")).alias("text"))
    out = periodic_runs(docs, "doc_id")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("before"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_b"), F.array_join(lines, "").alias("_lines"), "collapsed")
    return found.select(
        "doc_id", "n_runs", (-F.col("_b.before")).alias("start"), F.col("_b.length").alias("length"), (-F.col("_b.period")).alias("period"),
        F.expr("1000 * _b.length div -_b.period").alias("exponent_milli"),
        F.sha2(F.col("_lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: crc32 of the id bit by bit; runs as islands of equal words at one distance.
OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len(doc_id::VARCHAR) + 1),
      lambda i: list_transform(range(0, 8), lambda b: (ord(substr(doc_id::VARCHAR, i::INT, 1)) >> b::INT) & 1)::BIGINT[]))),
      lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) AS h
  FROM documents
), e AS (
  SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d
), t AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n),
    lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM e
), pos AS (
  SELECT doc_id, n, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM t
), equal AS (
  SELECT a.doc_id, b.i - a.i AS p, a.i FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND a.w = b.w AND b.i > a.i AND 2 * (b.i - a.i) <= a.n
), islands AS (
  SELECT doc_id, p, min(i) AS s, count(*) + p AS len
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS k FROM equal) GROUP BY doc_id, p, k
  HAVING count(*) >= p AND count(*) + p >= 12
), runs AS (SELECT doc_id, s, len, min(p) AS p FROM islands GROUP BY doc_id, s, len),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + p, s + len)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS words FROM (SELECT * FROM pos ANTI JOIN gone USING (doc_id, i)) GROUP BY doc_id
), all_runs AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || p || chr(10), '' ORDER BY s, p) AS lines,
    arg_max({'s': s, 'len': len, 'p': p}, (len, -s, -p)) AS b
  FROM runs GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.len::BIGINT AS length, b.p::BIGINT AS period,
  (1000 * b.len // b.p)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM documents LEFT JOIN all_runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
