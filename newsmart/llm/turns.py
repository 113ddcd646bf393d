"""Repair of conversations whose turns do not fit: weighted interval parsing of their rows.

A repaired conversation is empty, or an optional system turn and then one or more pairs of a user and an assistant turn. Rows
are kept, given another role or deleted, and empty turns are inserted, each at its cost. In normal form the grammar has a
symbol (p, q) for what leads from place p to place q of the pattern: a span of several rows is (p, r) followed by (r, q),
a span of one row is one edit with the cheapest insertions on both sides (the insertion closure). A cell holds, for every
symbol, the least cost and of equal costs the least sequence of edits in ASCII order. Cells are combined bottom-up by span
length, one row, two, four and so on: as (p, q) goes through some r wherever a span is cut, one cut of a span finds what all
cuts would. A conversation thus takes as many combinations as it has rows. Equal sequences of edits of one cost never begin
one another, so the least of a whole is made of the least of its parts.

What the parser sees of a row is one letter (its role and fault), so a conversation comes to a task as one short text. Texts
are only read in order, by the pass that writes out the repaired rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = " \t\n\x0b\f\r"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows whose letters are gathered at a time.
SPAN = 4096
#: Spans up to this length are remembered.
SHORT = 64
#: Places of the pattern: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
PLACES = range(4)
#: Inserted turns between two places.
CLOSURE = ((0, None, 1, 2), (None, 0, 1, 2), (None, None, 0, 1), (None, None, 1, 0))
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLES = {"u": "user", "a": "assistant"}

Cell = tuple[tuple[int, str] | None, ...]


def next_place(place: int, role: str) -> int | None:
    if role == "a":
        return ASSISTANT if place == USER else None
    if role == "u":
        return USER if place != USER else None
    return SYSTEM if role == "s" and place == START else None


def _row_cell(letter: str) -> Cell:
    """letter: s, u, a or another role (o), in capitals if the text is cut off; d for rows that must go."""
    edits = [(p, p, DELETE, "D") for p in PLACES]
    more = TRUNCATED if letter.isupper() else 0
    if letter != "d":
        edits += [(p, q, more, "K") for p in PLACES if (q := next_place(p, letter.lower())) is not None]
        edits += [(p, q, more + REROLE, "R") for p in PLACES for r in ROLES if (q := next_place(p, r)) is not None]
    cell: list[tuple[int, str] | None] = [None] * 16
    for x, y, cost, edit in edits:
        for p in PLACES:
            for q in PLACES:
                before, after = CLOSURE[p][x], CLOSURE[y][q]
                if before is not None and after is not None:
                    new = (cost + INSERT * (before + after), "I" * before + edit + "I" * after)
                    old = cell[4 * p + q]
                    cell[4 * p + q] = new if old is None or new < old else old
    return tuple(cell)


def _joined(left: Cell, right: Cell) -> Cell:
    out: list[tuple[int, str] | None] = []
    for p in PLACES:
        for q in PLACES:
            ways = [(a[0] + b[0], a[1], b[1]) for r in PLACES if (a := left[4 * p + r]) and (b := right[4 * r + q])]
            least = min((w[0] for w in ways), default=None)
            out.append(None if least is None else (least, min(w[1] + w[2] for w in ways if w[0] == least)))
    return tuple(out)


@lru_cache(50_000)
def _short(letters: str) -> Cell:
    if len(letters) == 1:
        return _row_cell(letters)
    half = 1 << ((len(letters) - 1).bit_length() - 1)
    return _joined(_short(letters[:half]), _short(letters[half:]))


def parse(letters: str) -> tuple[int, str]:
    """(cost, edits) of the cheapest repair of rows given by their letters."""
    if not letters:
        return 0, ""
    cells = [_short(letters[k : k + SHORT]) for k in range(0, len(letters), SHORT)]
    while len(cells) > 1:
        cells = [_joined(*cells[k : k + 2]) if k + 1 < len(cells) else cells[k] for k in range(0, len(cells), 2)]
    return min(c for c in (cells[0][START], cells[0][ASSISTANT]) if c)


# --- what the parser sees -----------------------------------------------------------------------


def _rows(conversations: DataFrame) -> DataFrame:
    """The four columns by names of our own; nulls of role and text are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def findings(conversations: DataFrame, everyone: DataFrame | None = None) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, letters) of every conversation, and of those in ``everyone`` that
    have no rows. Rows go by turn (nulls first), rows of one turn by role, then by the SHA-256 of the text."""
    rows = _rows(conversations)
    solid = F.rtrim("text", F.lit(SPACES))
    role = F.substring("role", 1, 1)
    seen = rows.select(
        "conv", "turn", "role", "digest", role.alias("initial"), (solid == "").alias("blank"), (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("cut"), F.lit(False).alias("gone")
    )
    if everyone is not None:
        names = {"conv": F.col("conv_id"), "gone": F.lit(True)}
        marks = everyone.select("conv_id").distinct().select(*(names.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in seen.schema))
        seen = seen.unionByName(marks)
    same = Window.partitionBy("conv", "gone", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    order = Window.partitionBy("conv", "gone").orderBy(*_order())
    fault = F.when(F.col("gone"), "").when(F.col("blank"), "b").when(F.col("_again") > 1, "d").when(F.col("cut"), "t").otherwise("")
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    dealt = seen.repartition("conv").withColumn("_again", F.row_number().over(same))
    dealt = dealt.withColumns({
        "_n": F.row_number().over(order), "_turn": F.lag("turn").over(order), "_initial": F.lag("initial").over(order), "_fault": fault,
    })
    pair = F.concat("_initial", "initial")
    letters = F.when(F.col("_fault").isin("b", "d"), "d").when(F.col("_fault") == "t", F.upper(letter)).otherwise(letter)
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    spans = dealt.groupBy("conv", F.expr(f"_n div {SPAN}").alias("_span")).agg(
        F.min("turn").alias("low"), F.max("turn").alias("high"), count(F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_turn"))).alias("turns"),
        *(count(F.col("_fault") == f).alias(name) for f, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))),
        count(~F.col("gone") & F.col("_initial").isNotNull() & ~pair.isin("su", "ua", "au")).alias("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("gone"), F.struct("_n", letters.alias("l"))))), lambda x: x["l"]), "").alias("_l"),
    )
    sums = ("turns", "blank", "duplicate", "truncated", "illegal")
    whole = spans.groupBy("conv").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), *(F.sum(c).alias(c) for c in sums),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_span", "_l"))), lambda x: x["_l"]), "").alias("letters"),
    )
    return whole.select("conv", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps"), *sums[1:], "letters")


def _parse(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(x) for x in batch.column("letters").to_pylist()]
            costs = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *costs], [*names, "cost", "audit"])

    return run


def repairs(conversations: DataFrame, everyone: DataFrame | None = None) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit): the faults of every conversation and the initials of
    the edits of its cheapest repair: Keep, Rerole, Delete, Insert.

    conversations: conv_id, turn, role, text; other columns are not looked at. A row's first fault counts: blank (nothing but
    white space), duplicate (role and text came before), truncated (does not end in ``.!?``). Blank and duplicate rows are
    deleted. Nulls of role and text are one space, null ids are one conversation. gaps: turns missing between the first and
    the last; illegal: neighbouring roles that do not follow each other. Conversations in ``everyone`` (conv_id) without rows
    have zeros and no edits; an empty table gives an empty result.
    """
    found = findings(conversations, everyone)
    names = [c for c in found.columns if c != "letters"]
    kind = T.StructType([found.schema[c] for c in names]).add("cost", T.LongType()).add("audit", T.StringType())
    return found.mapInArrow(_parse(names), kind)


# --- repaired rows ------------------------------------------------------------------------------


class _Repair:
    """Turns of one conversation, given its rows one after the other."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place = audit, 0, START

    def _turn(self) -> str:
        role = "a" if self.place == USER else "u"
        self.place = AFTER[role]
        return ROLES[role]

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._turn(), "", "I"

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(role, text, edit) of the turns up to this row."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.place = AFTER[role[0]]
            yield role, text, edit
        elif edit == "R":
            yield self._turn(), text, edit


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, tuple]]:
    """(True, (conv, facts)) when a conversation begins, (False, (role, text, edit)) for each of its turns."""
    now = None
    for batch in batches:
        columns = (batch.column(c) for c in ("head", "conv", "facts", "role", "text"))
        for head, conv, facts, role, text in zip(*columns, strict=True):
            if head.as_py():
                if now is not None:
                    yield from ((False, t) for t in now.inserted())
                now = _Repair(facts["audit"].as_py())
                yield True, (conv, facts)
            else:
                yield from ((False, t) for t in now.row(role.as_py(), text.as_py()))
    if now is not None:
        yield from ((False, t) for t in now.inserted())


def _write_rows(kinds: dict[str, pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place, conv, size = [], 0, None, 0
        batch = lambda: pa.RecordBatch.from_pylist(out, pa.schema(list(kinds.items())))
        for new, item in _walk(batches):
            if new:
                conv, place = item[0].as_py(), 0
                continue
            out.append({"conv_id": conv, "place": place, "role": item[0], "text": item[1], "edit": item[2]})
            place, size = place + 1, size + len(item[1])
            if len(out) >= 10_000 or size > 8 << 20:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()

    return run


def _write_digests(kinds: dict[str, pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, digest, first = [], None, True
        batch = lambda: pa.RecordBatch.from_pylist(out, pa.schema(list(kinds.items())))
        for new, item in _walk(batches):
            if new:
                if digest is not None:
                    out[-1]["repaired_sha256"] = digest.hexdigest()
                if len(out) >= 10_000:
                    yield batch()
                    out = []
                out.append({"conv_id": item[0].as_py(), "facts": item[1].as_py()})
                digest, first = hashlib.sha256(), True
            else:
                digest.update(f"{'' if first else chr(10)}{item[0]}:{item[1]}".encode())
                first = False
        if out:
            out[-1]["repaired_sha256"] = digest.hexdigest()
            yield batch()

    return run


def _in_order(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """A head row with its facts before the rows of each conversation, in order."""
    facts = F.struct(*(c for c in found.columns if c != "conv"))
    heads = found.select("conv", F.lit(True).alias("head"), facts.alias("facts"))
    rows = _rows(conversations).select("conv", F.lit(False).alias("head"), F.lit(None).cast(heads.schema["facts"].dataType).alias("facts"), "turn", "role", "digest", "text")
    both = heads.unionByName(rows, allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions("conv", F.desc("head"), *_order()).select("head", "conv", "facts", "role", "text")


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def repaired_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): the turns of every repaired conversation, numbered from 0."""
    found = repairs(conversations)
    rows = _in_order(conversations, found)
    kinds = {"conv_id": _arrow(rows, "conv"), "place": pa.int64(), "role": pa.string(), "text": pa.string(), "edit": pa.string()}
    kind = T.StructType([T.StructField("conv_id", rows.schema["conv"].dataType)]).add("place", T.LongType())
    for c in ("role", "text", "edit"):
        kind = kind.add(c, T.StringType())
    return rows.mapInArrow(_write_rows(kinds), kind)


def repaired_digests(conversations: DataFrame, everyone: DataFrame | None = None) -> DataFrame:
    """The columns of ``repairs`` (its conv as conv_id) and repaired_sha256, of the repaired turns as ``role:text`` joined by
    line feeds. Texts pass by in order; no conversation is held in memory."""
    found = repairs(conversations, everyone)
    rows = _in_order(conversations, found)
    kinds = {"conv_id": _arrow(rows, "conv"), "facts": _arrow(rows, "facts"), "repaired_sha256": pa.string()}
    kind = T.StructType([T.StructField("conv_id", rows.schema["conv"].dataType), rows.schema["facts"]]).add("repaired_sha256", T.StringType())
    return rows.mapInArrow(_write_digests(kinds), kind).select("conv_id", "facts.*", "repaired_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows as a faulty export might leave them, by a checksum of conversation and turn modulo 20: 0 drops the row, 1 empties
    its text, 2 takes out ``.!?``, 3 repeats it, 4 calls it a user's. Nulls are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
    rows = rows.withColumn("_h", F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).filter("_h <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("_h") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repaired_digests(damaged(given), given)


#: The cheapest edits here go row by row through the four places, another way than the operator's.
OP13_SQL = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations
), hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len(k) + 1),
      lambda i: list_transform(range(0, 8), lambda b: (ord(substr(k, i::INT, 1)) >> b::INT) & 1)::BIGINT[]))),
      lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) % 20 AS h
  FROM given
), damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE h <> 0
), seen AS (
  SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid, role[1] AS l,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n
  FROM damaged
), r AS (
  SELECT *, CASE WHEN solid = '' THEN 'b' WHEN again > 1 THEN 'd' WHEN solid[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(l) OVER (PARTITION BY conv_id ORDER BY n) || l AS pair
  FROM seen
), e AS (SELECT *, fault IN ('b', 'd') AS must, CASE WHEN fault = 't' THEN 5 ELSE 0 END AS t FROM r),
walk AS (
  SELECT conv_id, 0::BIGINT AS n, {'c': 0::BIGINT, 'a': ''} AS z, {'c': 1000000000000::BIGINT, 'a': ''} AS s,
    {'c': 5::BIGINT, 'a': 'I'} AS u, {'c': 10::BIGINT, 'a': 'II'} AS a
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, n, z, s, u, list_min([a, {'c': u.c + 5, 'a': u.a || 'I'}]) AS a FROM (
    SELECT conv_id, n, z, s, list_min([u, {'c': z.c + 5, 'a': z.a || 'I'}, {'c': s.c + 5, 'a': s.a || 'I'}, {'c': a.c + 5, 'a': a.a || 'I'}]) AS u, a FROM (
      SELECT w.conv_id, e.n, {'c': z.c + 2, 'a': z.a || 'D'} AS z,
        list_min([{'c': s.c + 2, 'a': s.a || 'D'}, CASE WHEN NOT must AND l = 's' THEN {'c': z.c + t, 'a': z.a || 'K'} END]) AS s,
        list_min([{'c': u.c + 2, 'a': u.a || 'D'},
          CASE WHEN NOT must THEN {'c': z.c + t + CASE WHEN l = 'u' THEN 0 ELSE 1 END, 'a': z.a || CASE WHEN l = 'u' THEN 'K' ELSE 'R' END} END,
          CASE WHEN NOT must THEN {'c': s.c + t + CASE WHEN l = 'u' THEN 0 ELSE 1 END, 'a': s.a || CASE WHEN l = 'u' THEN 'K' ELSE 'R' END} END,
          CASE WHEN NOT must THEN {'c': a.c + t + CASE WHEN l = 'u' THEN 0 ELSE 1 END, 'a': a.a || CASE WHEN l = 'u' THEN 'K' ELSE 'R' END} END]) AS u,
        list_min([{'c': a.c + 2, 'a': a.a || 'D'},
          CASE WHEN NOT must THEN {'c': u.c + t + CASE WHEN l = 'a' THEN 0 ELSE 1 END, 'a': u.a || CASE WHEN l = 'a' THEN 'K' ELSE 'R' END} END]) AS a
      FROM walk w JOIN e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.n = w.n + 1)
  )
), best AS (SELECT conv_id, arg_max(list_min([z, a]), n) AS b FROM walk GROUP BY conv_id),
edits AS (
  SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS n FROM (
    SELECT conv_id, unnest(string_split(b.a, '')) AS edit, generate_subscripts(string_split(b.a, ''), 1) AS i FROM best WHERE b.a <> '')
), turns AS (
  SELECT d.conv_id, d.i, edit, l, role, CASE WHEN edit = 'I' THEN '' ELSE text END AS text, row_number() OVER (PARTITION BY d.conv_id ORDER BY d.i) AS j,
    max(CASE WHEN edit = 'K' AND l = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY d.conv_id) AS has_system
  FROM edits d LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM d.conv_id AND e.n = d.n WHERE edit <> 'D'
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - has_system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS whole
  FROM turns GROUP BY conv_id
), sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
    count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM e GROUP BY conv_id
)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, b.b.c AS cost, b.b.a AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM best b LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN repaired p ON p.conv_id IS NOT DISTINCT FROM b.conv_id
"""
