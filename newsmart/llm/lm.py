"""Hierarchical Pitman-Yor language model: a restaurant for each word as context, all sharing the parent restaurant.

Training tokens are customers of the restaurant of the word before them (or of the text's beginning); each table orders
from the parent, where it is a customer. The parent's base draws no word twice, so a word's customers all sit at one table of
the parent, and a new table there stands for an unknown word: the known words and "unknown" share all probability. Discounts
are estimated from words and pairs seen once and twice in all of the training texts.

The model never meets in one place. Contexts are hashed to groups of about four million tokens; the few contexts with a
large share of all tokens are spread over the groups by their next word. In a first round every group seats its customers
against a parent of its own words; tables are then summed per word in other groups and each group gets back the sums it
needs. With that parent each group resamples seats by Gibbs sweeps (every customer leaves, and returns to a table or opens a
new one; one customer of all cells of a group at once, so counts are slightly old, as usual in distributed samplers). The
parent is resampled with them: a table that is closed or opened leaves or enters the parent at once in its own group, and
after each of the first sweeps (``EXCHANGES``) the groups' tables are summed anew, so that every group goes on with the parent
that all groups' moves have made. The sizes of a group's tables ride along with an exchange. The predictive probability of every pair that any text needs is averaged over the
sweeps after the first. Texts are scored where the pairs are; only sums by text leave a group. Tokens travel as packed arrays,
one for a block of texts and group, in which each distinct pair stands once.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmart.llm.words import MULTIPLIER, mix, slices, words_of
from newsmart.sources.versions import few_rows

GROUP = 4_000_000
LEAST_GROUPS = 32
LARGE = 1024
STRENGTH = 1.0
SWEEPS = 4
#: Sweeps after which all groups' tables are summed anew.
EXCHANGES = 2
SEED = 11
#: Cells that are walked through one by one when no others have customers left.
FEW = 256
#: Stand for a text's beginning and end.
BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
TYPE = np.uint64((1 << 48) - 1)


def _pairs(batch: pa.RecordBatch):
    """Contexts, next tokens and text numbers of all tokens of a block."""
    w = words_of(batch.column("text"))
    context = np.insert(w.hash, w.first[:-1], BEGIN)
    following = np.insert(w.hash, w.first[1:], END)
    return context, following, np.repeat(np.arange(batch.num_rows), w.counts + 1)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (context, n, train): of each block its tokens and training tokens (null context) and its frequent contexts."""
    for batch in slices(batches, "text"):
        context, _, doc = _pairs(batch)
        train = int(batch.column("train").to_numpy(zero_copy_only=False)[doc].sum())
        keys, n = np.unique(context, return_counts=True)
        often = n >= max(2, len(context) // (2 * LARGE))
        k = int(often.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *keys[often].view(np.int64).tolist()], pa.int64()), pa.array([len(context), *n[often].tolist()], pa.int64()), pa.array([train] + [0] * k, pa.int64())],
            ["context", "n", "train"],
        )


def pack_small(x: np.ndarray) -> bytes:
    """Numbers from 0 up in one byte each; larger ones stand as 255 and follow in full."""
    big = x >= 255
    return np.array([len(x), big.sum()], np.uint32).tobytes() + np.where(big, 255, x).astype(np.uint8).tobytes() + x[big].astype(np.uint32).tobytes()


class Reader:
    """Takes arrays off the front of packed bytes."""

    def __init__(self, raw: bytes | pa.Buffer):
        self.raw, self.at = raw, 0

    def take(self, kind, n: int) -> np.ndarray:
        x = np.frombuffer(self.raw, kind, n, self.at)
        self.at += x.nbytes
        return x

    def small(self) -> np.ndarray:
        n, big = (int(v) for v in self.take(np.uint32, 2))
        x = self.take(np.uint8, n).astype(np.int64)
        x[x == 255] = self.take(np.uint32, big)
        return x

    def types(self, n: int) -> np.ndarray:
        low = self.take(np.uint32, n).astype(np.uint64)
        return low | self.take(np.uint16, n).astype(np.uint64) << np.uint64(32)


def pack_types(x: np.ndarray) -> bytes:
    return x.astype(np.uint32).tobytes() + (x >> np.uint64(32)).astype(np.uint16).tobytes()


def _deal(often: np.ndarray, groups: int):
    """Rows (to, block, data): a block's pairs by group and, to a group of the task's own (to < 0), its texts' ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for seq, batch in enumerate(slices(batches, "text")):
            block = (task << 32) + seq
            context, following, doc = _pairs(batch)
            nd = batch.num_rows
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(np.uint8)
            pair = mix(context * MULTIPLIER + following)
            spread = np.isin(context, often)
            group = (np.where(spread, pair, mix(context)) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            bounds = np.searchsorted(group[order], np.arange(groups + 1))
            to, data = [-1 - task], [np.int64(nd).tobytes() + np.asarray(batch.column("row")).tobytes() + train.tobytes() + np.bincount(doc, minlength=nd).tobytes()]
            for g in np.flatnonzero(np.diff(bounds)):
                own = order[bounds[g] : bounds[g + 1]]
                by = own[np.lexsort((pair[own], context[own]))]
                new = np.ones(len(by), bool)
                new[1:] = (pair[by[1:]] != pair[by[:-1]]) | (context[by[1:]] != context[by[:-1]])
                which = np.cumsum(new) - 1
                heads = by[new]
                starts = np.flatnonzero(np.concatenate([[True], context[heads[1:]] != context[heads[:-1]]]))
                code, times = np.unique(doc[by] * len(heads) + which, return_counts=True)
                entry = (code % len(heads)).astype(np.uint16 if len(heads) < 65_536 else np.uint32)
                to.append(int(g))
                data.append(
                    np.array([nd, len(heads), len(starts), len(code)], np.int64).tobytes() + train.tobytes() + context[heads[starts]].tobytes()
                    + pack_small(np.diff(starts, append=len(heads))) + pack_types(following[heads] & TYPE)
                    + pack_small(np.bincount(code // len(heads), minlength=nd)) + entry.tobytes() + pack_small(times - 1)
                )
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([block] * len(to), pa.int64()), pa.array(data, pa.binary())], ["to", "block", "data"])

    return run


class Cells:
    """The pairs of one group: contexts, words, and the training count of each pair (0 for pairs of other texts only). The
    texts that the pairs come from are kept on demand."""

    def __init__(self, table: pa.Table, texts: bool = False):
        readers, contexts, runs, words = [], [], [], []
        for raw in table.column("data"):
            r = Reader(raw.as_buffer())
            nd, pairs, n, entries = (int(v) for v in r.take(np.int64, 4))
            readers.append((r, nd, pairs, entries, r.take(np.uint8, nd)))
            contexts.append(r.take(np.uint64, n))
            runs.append(r.small())
            words.append(r.types(pairs))
        self.contexts, u = np.unique(np.concatenate(contexts), return_inverse=True)
        self.words, cell = np.unique(np.concatenate(words), return_inverse=True)
        del contexts, words
        cell += np.repeat(u * len(self.words), np.concatenate(runs))
        cells, cell = np.unique(cell, return_inverse=True)
        cell = cell.astype(np.int32)
        self.u, self.w = (x.astype(np.int32) for x in np.divmod(cells, len(self.words)))
        del cells
        learnt = np.empty(len(cell), np.float64)
        self.blocks, begin = [], 0
        for r, nd, pairs, entries, train in readers:
            doc = np.repeat(np.arange(nd, dtype=np.int32), r.small())
            entry = r.take(np.uint16 if pairs < 65_536 else np.uint32, entries)
            times = (r.small() + 1).astype(np.int32)
            learnt[begin : begin + pairs] = np.bincount(entry, times * train[doc], pairs)
            if texts:
                self.blocks.append((nd, doc, cell[begin : begin + pairs][entry], times))
            begin += pairs
        self.count = np.bincount(cell, learnt, len(self.u)).astype(np.int64)

    def once_and_twice(self) -> tuple[int, int]:
        return int((self.count == 1).sum()), int((self.count == 2).sum())


def discount(once: float, twice: float) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def expected_tables(count: np.ndarray, opening: np.ndarray, d: float, rng: np.random.Generator | None = None) -> np.ndarray:
    """Tables that customers of a cell sit at when seated one after the other: opening is a new table's weight. Drawn with
    rng, else about the number to be expected."""
    tables = np.minimum(count, 1).astype(float)
    order = np.flatnonzero(count > 1)
    order = order[np.argsort(count[order])]
    size, weight, t = count[order], opening[order], tables[order]
    n = 1
    while len(size) - (begin := int(np.searchsorted(size, n, "right"))) > FEW:
        p = weight[begin:] / (weight[begin:] + n - d * t[begin:])
        t[begin:] += p if rng is None else rng.random(len(p)) < p
        n += 1
    draw = random.Random(0 if rng is None else int(rng.integers(1 << 62))).random
    for i in range(begin, len(size)):
        w, own = float(weight[i]), float(t[i])
        for k in range(n, int(size[i])):
            whole = w + k - d * own
            if rng is None:
                own += w / whole
            elif draw() * whole < w:
                own += 1
        t[i] = own
    tables[order] = t
    return tables


class Seats:
    """Who sits where in all cells with two or more customers; one customer alone has one table. ``state`` is what ``packed``
    told of the same cells; without it customers join ``tables`` at random."""

    def __init__(self, count: np.ndarray, tables: np.ndarray | None, rng: np.random.Generator, state: bytes | None = None):
        self.cell = np.flatnonzero(count > 1)
        self.cell = self.cell[np.argsort(count[self.cell], kind="stable")]  # the largest last
        self.size = count[self.cell]
        self.start = np.cumsum(self.size) - self.size
        total = int(self.size.sum())
        if state is not None:
            r = Reader(state)
            self.tables, sizes = r.small(), r.small()
            slot = np.repeat(self.start - np.cumsum(self.tables) + self.tables, self.tables) + np.arange(len(sizes))
            self.seat = np.repeat(slot.astype(np.int32 if total < 1 << 31 else np.int64), sizes)
            self.at_table = np.zeros_like(self.seat)
            self.at_table[slot] = sizes
            return
        self.tables = np.clip(np.rint(tables[self.cell]), 1, self.size).astype(np.int64)
        seat = np.arange(total, dtype=np.int32 if total < 1 << 31 else np.int64)
        place = seat - np.repeat(self.start.astype(seat.dtype), self.size)
        beside = np.flatnonzero(place >= np.repeat(self.tables.astype(seat.dtype), self.size))
        place = place[beside]
        seat[beside] -= place - (rng.random(len(beside)) * place).astype(seat.dtype)  # of someone who came before
        del place, beside
        while True:
            new = seat[seat]
            if (new == seat).all():
                break
            seat = new
        self.seat = seat  # of each customer the table's number, of which a cell has one for each of its customers
        self.at_table = np.bincount(seat, minlength=total).astype(seat.dtype)

    def packed(self) -> bytes:
        """Sizes of all tables; which of a cell's customers sits where makes no difference."""
        return pack_small(self.tables) + pack_small(self.at_table[self.at_table > 0])

    def step(self, opening, add_table, d: float, rng: np.random.Generator, begin: int = 0, customer: int | None = None) -> None:
        """One customer (any, or that of the number) of each cell from ``begin`` on leaves and is seated again. opening():
        weight of a new table in each of these cells with the tables as they are; add_table(change): tells the restaurants."""
        start, size, tables = self.start[begin:], self.size[begin:], self.tables[begin:]
        who = start + ((rng.random(len(size)) * size).astype(np.int64) if customer is None else customer)
        left = self.seat[who]
        self.at_table[left] -= 1
        gone = self.at_table[left] == 0
        tables -= gone
        add_table(-gone.astype(np.int64))
        weight = opening()
        new = rng.random(len(who)) * (weight + size - 1 - d * tables) < weight
        rest = np.flatnonzero(new)
        while len(rest):  # an empty table: at least one is
            table = start[rest] + (rng.random(len(rest)) * size[rest]).astype(np.int64)
            free = self.at_table[table] == 0
            self.seat[who[rest[free]]] = table[free]
            self.at_table[table[free]] = 1
            rest = rest[~free]
        rest = np.flatnonzero(~new)
        while len(rest):  # a table with n customers by n - d: that of a random other customer, accepted by (n - d) / n
            own = who[rest]
            other = start[rest] + (rng.random(len(rest)) * (size[rest] - 1)).astype(np.int64)
            other += other >= own
            table = self.seat[other]
            n = self.at_table[table]
            fits = rng.random(len(rest)) * n < n - d
            self.seat[own[fits]] = table[fits]
            self.at_table[table[fits]] += 1
            rest = rest[~fits]
        tables += new
        add_table(new.astype(np.int64))

    def walk(self, cell: int, customer: int, weight_after, d: float, draw) -> None:
        """As ``step``, for all customers of one cell from that number on, one after the other. weight_after(change): tells the
        restaurants, and gives the weight of a new table then."""
        start, size, t = int(self.start[cell]), int(self.size[cell]), int(self.tables[cell])
        seat, at_table = memoryview(self.seat)[start : start + size], memoryview(self.at_table)[start : start + size]
        weight, others = weight_after(0), size - 1
        for who in range(customer, size):
            left = seat[who] - start
            n = at_table[left] - 1
            at_table[left] = n
            if not n:
                t -= 1
                weight = weight_after(-1)
            if draw() * (weight + others - d * t) < weight:
                table = int(draw() * size)
                while at_table[table]:
                    table = int(draw() * size)
                at_table[table] = 1
                t += 1
                weight = weight_after(1)
            else:
                while True:
                    other = int(draw() * others)
                    table = seat[other + (other >= who)] - start
                    n = at_table[table]
                    if draw() * n < n - d:
                        break
                at_table[table] = n + 1
            seat[who] = start + table
        self.tables[cell] = t

    def sweep(self, opening, add_table, weight_after, d: float, rng: np.random.Generator) -> None:
        """Every customer leaves once and is seated again: one of each cell at a time, and where only the ``FEW`` largest cells
        have customers left, cell by cell. opening(begin), add_table(begin, change): as in ``step``, of the cells from begin on;
        weight_after(cell) gives what ``walk`` needs."""
        customer = 0
        while len(self.size) - (begin := int(np.searchsorted(self.size, customer, "right"))) > FEW:
            self.step(lambda: opening(begin), lambda change: add_table(begin, change), d, rng, begin, customer)  # noqa: B023
            customer += 1
        draw = random.Random(int(rng.integers(1 << 62))).random
        for cell in range(begin, len(self.size)):
            self.walk(cell, customer, weight_after(cell), d, draw)


def first_tables(cells: Cells, me: int) -> tuple[np.ndarray, np.ndarray]:
    """(tables of each cell, tables of each context), seated against a parent of the group's own words; each time the same."""
    d = discount(*cells.once_and_twice())
    known = (cells.count > 0).astype(np.int64)
    parent = np.bincount(cells.w, known, len(cells.words))
    tables = np.bincount(cells.u, known, len(cells.contexts))
    opening = (STRENGTH + d * tables[cells.u]) * parent[cells.w] / max(1, parent.sum())
    t = expected_tables(cells.count, np.maximum(opening, 1e-12), d, np.random.default_rng([SEED, me, 0])).astype(np.int64)
    return t, np.bincount(cells.u, t, len(cells.contexts)).astype(np.int64)


def _sent(cells: Cells, me: int, groups: int, part: np.ndarray, more: tuple[np.ndarray, ...], head: bytes, spread: np.ndarray, past: dict[int, bytes], state: bytes | None = None) -> pa.Table:
    """Rows (part, to, data) of a round: to each part of the words what the group was sent so far, its words and the figures
    of each of them in ``more``; to part -1 the figures of the spread contexts. The group's state rides along with one part."""
    data = []
    for p in range(groups):
        own = np.flatnonzero(part == p)
        old = past.get(p, b"")
        if state is not None and p == me % groups:
            old = np.int64(len(state)).tobytes() + state + old
        data.append(np.int64(len(old)).tobytes() + old + head + np.int64(len(own)).tobytes() + pack_types(cells.words[own]) + b"".join(pack_small(x[own]) for x in more))
    data.append(past.get(-1, b"") + spread.tobytes())
    return pa.table({"part": pa.array([*range(groups), -1], pa.int32()), "to": pa.array([me] * (groups + 1), pa.int32()), "data": pa.array(data, pa.binary())})


NOTHING = pa.table({"part": pa.array([], pa.int32()), "to": pa.array([], pa.int32()), "data": pa.array([], pa.binary())})


def _ask(often: np.ndarray, groups: int):
    """First round of a group: tables and customers of its words and of the spread contexts. Groups of texts send nothing."""

    def run(table: pa.Table) -> pa.Table:
        me = table.column("to")[0].as_py()
        if me < 0:
            return NOTHING
        cells = Cells(table)
        t, tables = first_tables(cells, me)
        by_word = np.bincount(cells.w, t, len(cells.words)).astype(np.int64)
        customers = np.bincount(cells.w, cells.count, len(cells.words)).astype(np.int64)
        part = (mix(cells.words) % np.uint64(groups)).astype(np.int64)
        spread = np.isin(cells.contexts, often)
        places = np.searchsorted(often, cells.contexts[spread])
        sums = np.zeros((2, len(often)), np.int64)
        sums[0, places] = np.bincount(cells.u, cells.count, len(cells.contexts)).astype(np.int64)[spread]
        sums[1, places] = tables[spread]
        head = np.array(cells.once_and_twice(), np.int64).tobytes()
        return _sent(cells, me, groups, part, (customers, by_word), head, sums, {})

    return run


def _answer(often: np.ndarray, round_: int):
    """Of one part of the words, which holds the parent's customers: to each group what it was sent before and the sums of
    the words it sent, with the part's share of the global figures."""

    def run(table: pa.Table) -> pa.Table:
        part, to = table.column("part")[0].as_py(), table.column("to")
        raws = [r.as_py() for r in table.column("data")]
        if part < 0:
            old = len(often) * 8 * (round_ + 1 if round_ else 0)  # customers, and the tables of each round
            total = sum(np.frombuffer(r, np.int64, offset=old) for r in raws)
            data = [r[:old] + total.tobytes() for r in raws]
        else:
            pairs, asked, tables, customers, past = np.zeros(2, np.int64), [], [], [], []
            for raw in raws:
                r = Reader(raw)
                past.append(r.take(np.uint8, int(r.take(np.int64, 1)[0])).tobytes())
                if not round_:
                    pairs = pairs + r.take(np.int64, 2)
                asked.append(r.types(int(r.take(np.int64, 1)[0])))
                if not round_:
                    customers.append(r.small())
                tables.append(r.small())
            words, place = np.unique(np.concatenate(asked), return_inverse=True)
            t = np.bincount(place, np.concatenate(tables), len(words)).astype(np.int64)
            c = np.bincount(place, np.concatenate(customers), len(words)).astype(np.int64) if customers else None
            head = np.array([t.sum(), (t > 0).sum(), (t == 1).sum(), (t == 2).sum()], np.int64).tobytes()
            data, begin = [], 0
            for own, old in zip(asked, past, strict=True):
                at = place[begin : begin + len(own)]
                begin += len(own)
                data.append(old + (b"" if c is None else pairs.tobytes() + pack_small(c[at])) + head + pack_small(t[at]))
        return pa.table({"to": to, "part": table.column("part"), "data": pa.array(data, pa.binary())})

    return run


class Answers:
    """What a group was sent in the rounds so far: customers and tables of its words and of the spread contexts, and of each
    round the parent's tables, known words, and words with one and with two. From the second round on also its own state."""

    def __init__(self, answers: pa.Table, cells: Cells, part: np.ndarray, often: np.ndarray, rounds: int):
        self.customers = np.zeros(len(cells.words), np.int64)
        self.tables = np.zeros((rounds, len(cells.words)), np.int64)
        self.seen = np.zeros((rounds, 4), np.int64)
        self.raw = {p: raw.as_py() for p, raw in zip(answers.column("part").to_pylist(), answers.column("data"), strict=True)}
        me, groups = answers.column("to")[0].as_py(), sum(p >= 0 for p in self.raw)
        for p, raw in self.raw.items():
            if p < 0:
                self.spread = np.frombuffer(raw, np.int64).reshape(rounds + 1, len(often))
                continue
            r = Reader(raw)
            if rounds > 1 and p == me % groups:
                self.state = r.take(np.uint8, int(r.take(np.int64, 1)[0])).tobytes()
                self.raw[p] = raw[r.at :]
            own = np.flatnonzero(part == p)
            self.pairs = r.take(np.int64, 2)  # the same from every part
            self.customers[own] = r.small()
            for k in range(rounds):
                self.seen[k] += r.take(np.int64, 4)
                self.tables[k, own] = r.small()


class Parent:
    """The parent's customers as a group sees them: its own tables as they are, those of other groups as last summed."""

    def __init__(self, known: np.ndarray):
        self.known, self.own = known, np.zeros(len(known), np.int64)

    def meet(self, tables: np.ndarray, seen: np.ndarray) -> None:
        """Sums of all groups' tables by word, those of this group as they are now among them."""
        self.others, self.elsewhere = tables - self.own, int(seen[0]) - int(self.own.sum())
        self.types, self.d = int(seen[1]), discount(*seen[2:])

    def chances(self, w: np.ndarray | slice = slice(None), own: int | None = None) -> np.ndarray:
        """Of all words or those at ``w``; ``own`` is the number of the group's own tables, where it is at hand."""
        total = self.elsewhere + (int(self.own.sum()) if own is None else own)
        unknown = (STRENGTH + self.d * self.types) / (STRENGTH + total) if total else 1.0
        return np.where(self.known[w], np.maximum(self.others[w] + self.own[w] - self.d, 0.05) / (STRENGTH + max(1, total)), unknown)

    def chance(self, w: int, own: int) -> float:
        """The same of one known word."""
        return max(int(self.others[w]) + int(self.own[w]) - self.d, 0.05) / (STRENGTH + max(1, self.elsewhere + own))


def _score(often: np.ndarray, groups: int, train_tokens: int, sweeps: int, rounds: int, last: bool):
    """A later round of a group, with what it was answered in the ``rounds`` before: it takes the next sweep and sends its
    tables, or in the last round goes on to the end. Rows (block, part, data): sums by text of the block."""

    def run(dealt: pa.Table, answers: pa.Table) -> pa.Table:
        me = dealt.column("to")[0].as_py()
        if me < 0 and not last:
            return NOTHING
        if me < 0:
            return pa.table({"block": dealt.column("block"), "part": pa.array([0] * len(dealt), pa.int32()), "data": dealt.column("data")})
        cells = Cells(dealt, texts=last)
        part = (mix(cells.words) % np.uint64(groups)).astype(np.int64)
        sent = Answers(answers, cells, part, often, rounds)
        d = discount(*sent.pairs)
        spread = np.isin(cells.contexts, often)
        places = np.searchsorted(often, cells.contexts[spread])
        customers = np.bincount(cells.u, cells.count, len(cells.contexts)).astype(float)
        customers[spread] = sent.spread[0, places]
        t, rng = np.minimum(cells.count, 1), np.random.default_rng([SEED, me, rounds])
        by_word = lambda: np.bincount(cells.w, t, len(cells.words)).astype(np.int64)
        parent = Parent(sent.customers > 0)
        if rounds > 1:
            seats = Seats(cells.count, None, rng, sent.state)
            t[seats.cell] = seats.tables
        else:
            t, _ = first_tables(cells, me)
        parent.own = by_word()
        parent.meet(sent.tables[-1], sent.seen[-1])
        tables = np.bincount(cells.u, t, len(cells.contexts))
        away = np.zeros(len(tables))  # tables of the same contexts in other groups
        away[spread] = sent.spread[rounds, places] - tables[spread]
        if rounds == 1:
            tables = away + np.bincount(cells.u, cells.count > 0, len(tables))
            seats = Seats(cells.count, expected_tables(cells.count, (STRENGTH + d * tables[cells.u]) * parent.chances()[cells.w], d, rng), rng)
            t = np.minimum(cells.count, 1)
            t[seats.cell] = seats.tables
            parent.own = by_word()
            tables = np.bincount(cells.u, t, len(tables))
        tables = tables + away
        u, w = cells.u[seats.cell], cells.w[seats.cell]

        opened = int(parent.own.sum())

        def opening(begin: int) -> np.ndarray:
            return (STRENGTH + d * tables[u[begin:]]) * parent.chances(w[begin:], opened)

        def add_table(begin: int, change: np.ndarray) -> None:
            nonlocal opened
            moved = np.flatnonzero(change)
            by = change[moved]
            np.add.at(tables, u[begin:][moved], by)
            np.add.at(parent.own, w[begin:][moved], by)
            opened += int(by.sum())

        def weight_after(cell: int):
            context, word = int(u[cell]), int(w[cell])

            def told(change: int) -> float:
                nonlocal opened
                if change:
                    tables[context] += change
                    parent.own[word] += change
                    opened += change
                return (STRENGTH + d * float(tables[context])) * parent.chance(word, opened)

            return told

        mean = np.zeros(len(cells.count) if last else 0)

        def note() -> None:
            nonlocal mean
            share = np.where(customers > 0, (STRENGTH + d * tables) / (STRENGTH + customers), 1.0)
            mean += np.maximum(cells.count - d * t, 0) / (STRENGTH + customers[cells.u]) + share[cells.u] * parent.chances()[cells.w]

        noted = [k for k in range(sweeps) if k or sweeps == 1]  # sweeps that count; of those in earlier rounds only the last is at hand
        if last and rounds - 2 in noted:
            note()
        for sweep in range(rounds - 1, sweeps if last else rounds):
            seats.sweep(opening, add_table, weight_after, d, rng)
            t[seats.cell] = seats.tables
            if last and sweep in noted:
                note()
        if not last:
            sums = np.zeros(len(often), np.int64)
            sums[places] = (tables - away)[spread]
            return _sent(cells, me, groups, part, (parent.own,), b"", sums, sent.raw, seats.packed())
        score = np.log10(mean / max(1, sum(k >= rounds - 2 for k in noted)))
        plain = np.log10((sent.customers + 0.5) / (train_tokens + 0.5 * (parent.types + 1)))[cells.w]
        seen_word = parent.known[cells.w]
        data = []
        for nd, doc, at, times in cells.blocks:
            sums = [np.bincount(doc, times * x[at], nd) for x in (score, plain, seen_word)]
            data.append(np.concatenate(sums).astype(np.float64).tobytes())
        return pa.table({"block": dealt.column("block"), "part": pa.array([1] * len(data), pa.int32()), "data": pa.array(data, pa.binary())})

    return run


def _texts(train_tokens: int):
    def run(table: pa.Table) -> pa.Table:
        sums = 0.0
        for part, raw in zip(table.column("part").to_pylist(), table.column("data"), strict=True):
            if part:
                sums = sums + np.frombuffer(raw.as_py(), np.float64)
            else:
                r = Reader(raw.as_py())
                nd = int(r.take(np.int64, 1)[0])
                rows, train, tokens = r.take(np.int64, nd), r.take(np.uint8, nd), r.take(np.int64, nd)
        score, plain, known = sums.reshape(3, nd)
        return pa.table({
            "row": rows, "held_out": train == 0, "n_tokens": tokens, "n_known": np.rint(known).astype(np.int64),
            "train_tokens": np.full(nd, train_tokens, np.int64), "base_score": plain, "score": score,
        })

    return run


def score_texts(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", sweeps: int = SWEEPS, exchanges: int = EXCHANGES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; perplexity of a text is
    10 ** (-score / n_tokens).

    ``train`` is a column that is true for rows to learn from; the others are held out. Null texts are empty: one token, the
    end. Rows are independent, so repeated ids keep their own results. Without training rows all words are unknown.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("row"), F.coalesce(train, F.lit(True)).alias("train"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = rows.mapInArrow(_frequent, "context long, n long, train long").groupBy("context").agg(F.sum("n").alias("n"), F.sum("train").alias("train"))
    total = found.filter("context is null").select(F.col("n").alias("total")).hint("broadcast")
    few = found.join(total, F.col("context").isNull() | (F.col("n") * LARGE >= F.col("total"))).select("context", "n", "train")
    few = few_rows(few, LARGE + 1).to_pylist()  # the total, and at most LARGE contexts
    tokens, train_tokens = next(((r["n"], r["train"]) for r in few if r["context"] is None), (0, 0))
    often = np.sort(np.array([r["context"] for r in few if r["context"] is not None], np.int64).view(np.uint64))
    groups = max(LEAST_GROUPS, -(-tokens // GROUP))
    dealt = rows.mapInArrow(_deal(often, groups), "to int, block long, data binary")
    message, exchanges = "part int, to int, data binary", min(exchanges, max(0, sweeps - 1))
    asked = dealt.groupBy("to").applyInArrow(_ask(often, groups), message)
    for k in range(exchanges + 1):
        answers = asked.groupBy("part").applyInArrow(_answer(often, k), "to int, part int, data binary")
        both = dealt.groupBy("to").cogroup(answers.groupBy("to"))
        if k < exchanges:
            asked = both.applyInArrow(_score(often, groups, train_tokens, sweeps, k + 1, False), message)
    sums = both.applyInArrow(_score(often, groups, train_tokens, sweeps, exchanges + 1, True), "block long, part int, data binary")
    return sums.groupBy("block").applyInArrow(
        _texts(train_tokens), "row long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    ).withColumnRenamed("row", id_col)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    return score_texts(docs, fold != 1)
