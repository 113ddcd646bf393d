"""Conversation repair against a cheapest path over all edits, and against SQL."""

from __future__ import annotations

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

from llm_fixtures import DIR, sql  # noqa: F401

from newsmart.llm import turns as R

SPACES = " \t\n\x0b\x0c\r"


def plain_parse(letters):
    """Cheapest edits by a search over (rows used, turns so far); ties by the edits' text."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, edits, n, place = heapq.heappop(heap)
        if (n, place) in done:
            continue
        done.add((n, place))
        if n == len(letters) and place in ("", "a"):
            return cost, edits
        steps = []
        if place in ("", "s", "a"):
            steps.append("u")
        if place == "u":
            steps.append("a")
        for turn in steps:
            heapq.heappush(heap, (cost + 5, edits + "I", n, turn))
        if n < len(letters):
            x = letters[n]
            more = 5 * x.isupper()
            heapq.heappush(heap, (cost + 2, edits + "D", n + 1, place))
            if x != "d":
                for turn in steps:
                    heapq.heappush(heap, (cost + 1 + more, edits + "R", n + 1, turn))
                if x.lower() in steps or (x.lower() == "s" and place == ""):
                    heapq.heappush(heap, (cost + more, edits + "K", n + 1, x.lower()))


def plain_repair(rows):
    """rows: (turn, role, text) in order. -> (gaps, blank, duplicate, truncated, illegal, cost, audit, digest)"""
    faults, seen, letters = [], set(), ""
    for _, role, text in rows:
        solid = text.rstrip(SPACES)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        x = role[:1] if role[:1] in ("s", "u", "a") else "o"
        letters += "d" if fault in ("blank", "duplicate") else x.upper() if fault else x
    cost, audit = plain_parse(letters)
    out, n = [], 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[n][1:]
        n += edit != "I"
        if edit in "RI":
            role = "assistant" if out and out[-1][0][0] == "u" else "user"
        if edit != "D":
            out.append((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    roles = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
    lines = "\n".join(f"{r}:{t}" for r, t in out)
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()), out


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        blank = lambda x: " " if x is None else x
        role, text = blank(role), blank(text)
        h = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        if h == 1:
            text = ""
        if h == 2:
            text = text.translate(dict.fromkeys(map(ord, ".!?")))
        if h == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def in_order(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, role, text))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    return {c: sorted(g, key=key) for c, g in groups.items()}


def test_parser_finds_the_cheapest_edits():
    rng = random.Random(3)
    for _ in range(1500):
        letters = "".join(rng.choice("suaoSUAOd" if rng.random() < 0.5 else "uaUd") for _ in range(rng.randint(0, 14)))
        assert R.parse(letters) == plain_parse(letters), letters
    for n in (63, 64, 65, 129, 700):
        letters = "".join(rng.choice("suaoSUAOduaua") for _ in range(n))
        assert R.parse(letters) == plain_parse(letters), n


def test_edges(spark):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(["a.", "b!", "c", " \n", "", None, "a. ", "x" * 9000 + "?"]))
            for c in (1, 2, 3, None) for t in (None, 0, 1, 1, 2, 5, 9) if rng.random() < 0.9]
    rows += [rows[0], rows[0], (4, 0, "assistant", "only."), (5, None, "user", "null turn.")]
    rows += [(9, i, "user" if i % 2 else "assistant", f"turn {i}.") for i in range(9000)]  # longer than a span of letters
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, digest string, cost int")
    want = {c: plain_repair(g) for c, g in in_order([tuple(" " if x is None and i > 1 else x for i, x in enumerate(r)) for r in rows]).items()}
    ids = spark.createDataFrame([(1,), (77,), (None,)], "conv_id long")
    got = {r[0]: tuple(r[1:]) for r in R.repaired_digests(df, ids).collect()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: w for c, (w, _) in want.items()} | {77: nothing}
    turns = defaultdict(list)
    for r in sorted(R.repaired_rows(df).collect(), key=lambda r: r.place):
        assert r.place == len(turns[r.conv_id])
        turns[r.conv_id].append((r.role, r.text))
    assert turns == {c: o for c, (_, o) in want.items() if o}
    assert R.repaired_digests(df.limit(0)).count() == 0 and R.repaired_rows(df.limit(0)).count() == 0


def test_query(spark, sql):  # noqa: F811
    rows = spark.read.parquet(f"{DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    ordered = in_order(plain_damage(rows))
    want = {c: plain_repair(ordered.get(c, []))[0] for c in {r.conv_id for r in rows}}
    df = R.op13_conversation_repair(spark, DIR)
    got = {r[0]: tuple(r[1:]) for r in df.collect()}
    assert got == want
    ref = sql.execute(R.OP13_SQL)
    assert [d[0] for d in ref.description] == df.columns
    assert {r[0]: r[1:] for r in ref.fetchall()} == want
