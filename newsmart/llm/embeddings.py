"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one representative per group.

Centres are fitted on a bounded sample. Every distinct vector is at home in the cell of its nearest centre, and a guest in
each cell that could hold a partner: for unit vectors x and y with cosine c their distance is sqrt(2 - 2c), so y can only
have a partner at home in cell a while y.(b - a) <= sqrt(2 - 2c) * |b - a|, b being y's own centre. No link is lost by the
cells, for any centres.

Vectors lie once, in blocks of whole cells or of parts of a large one, a file each in the work folder. A task reads the files of
a pair of blocks, each pair once, and compares the cells of one with their guests in the other, so no vector is copied for
the cells that it visits. It returns link counts and a spanning forest of its links, not the pairs. Files go through pyarrow's
file systems; what counts are the names that Spark has stored, so a repeated task leaves at most a file that nobody reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmart.llm.graphs import components
from newsmart.llm.tokens import _open
from newsmart.llm.words import mix
from newsmart.sources.versions import durable, few_rows, new_folder

#: Vectors that centres are fitted on, at most, and vectors of a cell, about.
SAMPLE = 20_000
BLOCK = 1024
#: Bytes of a block of cells, at most (a few cells more or less), and blocks of one length, where a block holds a cell at least.
BLOCK_BYTES = 8 << 20
LEAST_BLOCKS = 32
MOST_TASKS = 4096
MOST_CELLS = 1024
#: Lengths that get centres of their own, the most frequent ones; vectors of the others are compared in blocks all the same.
MOST_LENGTHS = 64
#: Further lengths, one cell each; more are an error (n different lengths take n * n / 2 components at least).
FURTHER_LENGTHS = 1_000_000
ROUNDS = 8


def fit_centres(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k unit centres of the unit vectors ``sample`` by spherical k-means; evenly spaced rows to begin with."""
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norm = np.linalg.norm(sums, axis=1)
        centres[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return centres


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row, not once for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def unit_vector(v: Column) -> Column:
    """v over its length, scaled by its largest component first, so that no square overflows or vanishes."""
    top = F.aggregate(v, F.lit(0.0), lambda acc, x: F.greatest(acc, F.abs(x)))
    norm = lambda s: F.sqrt(F.aggregate(s, F.lit(0.0), lambda acc, x: acc + x * x))
    scaled = _once(top, lambda t: F.transform(v, lambda x: x / t))
    return _once(scaled, lambda s: _once(norm(s), lambda n: F.transform(s, lambda x: x / n + 0.0)))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), size)


class _Cells:
    """Cells of vectors among those of their length; lengths without centres are one cell."""

    def __init__(self, centres: dict[int, np.ndarray], threshold: float):
        self.centres, self.reach = centres, np.sqrt(2 - 2 * threshold) + 1e-9
        self.apart = {size: np.stack([np.linalg.norm(c - x, axis=1) for x in c]) for size, c in centres.items()}

    def home(self, x: np.ndarray) -> np.ndarray:
        """Each vector's own cell."""
        size = x.shape[1]
        return np.argmax(x @ self.centres[size].T, axis=1) if size in self.centres else np.zeros(len(x), np.int64)

    def visits(self, x: np.ndarray) -> np.ndarray:
        """Whether a vector's own cell, or another that could hold a partner of it: a row a vector, a column a cell."""
        size = x.shape[1]
        if size not in self.centres:
            return np.ones((len(x), 1), bool)
        out = np.empty((len(x), len(self.centres[size])), bool)
        for at in range(0, len(x), 2048):
            dots = x[at : at + 2048] @ self.centres[size].T
            own = np.argmax(dots, axis=1)
            out[at : at + 2048] = dots[np.arange(len(dots)), own][:, None] - dots <= self.reach * self.apart[size][own]
        return out


def _by_length(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    for whole in batches:
        sizes = pc.list_value_length(whole.column("unit")).to_numpy()
        for size in np.unique(sizes).tolist():
            mine = whole.take(pa.array(np.flatnonzero(sizes == size)))
            for at in range(0, mine.num_rows, rows):
                yield size, mine.slice(at, rows)


def _count(cells: _Cells):
    """Rows (size, cell, homes): how many vectors of a batch are at home in a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, batch in _by_length(batches, 2048):
            homes = np.bincount(cells.home(_matrix(batch.column("unit"), size)))
            some = np.flatnonzero(homes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), size), pa.int32()), pa.array(some, pa.int32()), pa.array(homes[some], pa.int64())], ["size", "cell", "homes"]
            )

    return run


def blocks_of(homes: list[tuple[int, int, int]], block: int = BLOCK) -> tuple[dict[tuple[int, int], tuple[int, int]], int]:
    """Of rows (size, cell, homes): to each cell its first block and the number of blocks it is cut into, and how many blocks
    there are. Small cells share a block with their neighbours, so one length's blocks lie side by side."""
    total: dict[int, int] = {}
    for size, _, n in homes:
        total[size] = total.get(size, 0) + n
    places, at, load = {}, 0, 0.0
    for size, cell, n in sorted(homes):
        most = max(block, min(BLOCK_BYTES // (8 * (size + 2)), total[size] // LEAST_BLOCKS))
        pieces = -(-n // most)
        if load and (pieces > 1 or load + n / most > 1):
            at, load = at + 1, 0.0
        places[size, cell] = at, pieces
        if pieces > 1:
            at += pieces
        else:
            load += n / most
    return places, at + (load > 0)


def _place(cells: _Cells, blocks: dict[tuple[int, int], tuple[int, int]]):
    """Vectors with their block, length and cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, batch in _by_length(batches, 2048):
            cell = cells.home(_matrix(batch.column("unit"), size))
            first, pieces = np.array([blocks[size, c] for c in cell.tolist()], np.int64).T
            number = (mix(batch.column("node").to_numpy().view(np.uint64)) >> np.uint64(1)).astype(np.int64) % pieces
            own = [pa.array(first + number), pa.array(np.full(len(cell), size), pa.int32()), pa.array(cell, pa.int32())]
            yield pa.RecordBatch.from_arrays([*own, *(batch.column(c) for c in ("node", "n", "unit"))], ["block", "size", "cell", "node", "n", "unit"])

    return run


def _store(folder: str):
    """Writes a block by length and cell to a file of its own. Rows (block, size, name), one a length."""

    def run(group: pa.Table) -> pa.Table:
        files, root = _open(folder)
        files.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.arrow"
        rows = group.sort_by([("size", "ascending"), ("cell", "ascending"), ("node", "ascending")])
        with files.open_output_stream(f"{root}/{name}") as out, pa.ipc.new_file(out, rows.schema) as file:
            file.write_table(rows)
        sizes = pc.unique(rows["size"])
        return pa.table({"block": rows["block"][:1].take([0] * len(sizes)), "size": sizes, "name": [name] * len(sizes)})

    return run


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node that it reaches over the links a - b."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


class _Block:
    """A block's vectors; those of one length lie side by side, and among them those of one cell."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        self.node, self.n = rows["node"].to_numpy(), rows["n"].to_numpy()
        self.cell, size = rows["cell"].to_numpy(), rows["size"].to_numpy()
        begin = np.flatnonzero(np.diff(size, prepend=-1))
        self.lengths = {int(size[lo]): (lo, _matrix(rows["unit"].slice(lo, hi - lo).combine_chunks(), int(size[lo]))) for lo, hi in zip(begin, np.append(begin[1:], len(size)), strict=True)}


def _links(left: _Block, right: _Block | None, cells: _Cells, threshold: float) -> pa.RecordBatch:
    """Rows (node, links, root) of the links between two blocks, or within one if there is no other."""
    there = left if right is None else right
    node, n = left.node, left.n
    if right is not None:
        node, n = np.concatenate([node, right.node]), np.concatenate([n, right.n])
    shift = len(node) - len(there.node)
    links, label = np.zeros(len(node), np.int64), np.arange(len(node))
    for size, (begin, x) in left.lengths.items():
        if size not in there.lengths:
            continue
        other, y = there.lengths[size]
        visits = cells.visits(y)
        cell = left.cell[begin : begin + len(x)]
        heads = np.flatnonzero(np.diff(cell, prepend=-1))
        for lo, hi in zip(heads, np.append(heads[1:], len(x)), strict=True):
            guests = np.flatnonzero(visits[:, cell[lo]])
            if not len(guests):
                continue
            z = y[guests].T
            for at in range(lo, hi, 256):
                i, j = np.nonzero(x[at : min(hi, at + 256)] @ z >= threshold)
                i, j = i + (at + begin), guests[j] + (other + shift)
                if right is None:
                    i, j = i[i != j], j[i != j]
                if len(i):
                    np.add.at(links, i, n[j])
                    if right is not None:
                        np.add.at(links, j, n[i])
                    label = forest(label[i], label[j], len(node))[label]
    linked, tied = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(node)))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(c)) for c in ((node[linked], node[tied]), (links[linked], np.zeros(len(tied), np.int64)), (node[linked], node[label[tied]]))],
        ["node", "links", "root"],
    )


def _compare(folder: str, cells: _Cells, threshold: float):
    """The links of pairs of blocks, given by the names of their files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)

        def read(name: str) -> _Block:
            with files.open_input_file(f"{root}/{name}") as f:
                return _Block(pa.ipc.open_file(f).read_all())

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                yield _links(read(a), None if a == b else read(b), cells, threshold)

    return run


def near_vectors(
    vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE,
    block: int = BLOCK, cells: int | None = None,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors are compared with
    those of their own length, as a cosine needs equal lengths. Equal unit vectors are compared once and count with their
    number. Ids are unique; rows with a null id link with nothing.
    """
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    sound = F.col("vec_id").isNotNull() & (F.size("_v") > 0) & F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_v", lambda x: x != 0)
    units = given.filter(F.coalesce(sound, F.lit(False))).select("vec_id", unit_vector(F.col("_v")).alias("unit"))
    alone = given.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    alone = alone.withColumn("kept", F.lit(True))
    members = durable(units.withColumn("hash", F.xxhash64("unit")))
    nodes = members.groupBy("hash", "unit").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"))
    nodes = durable(nodes.select("node", "n", "hash", "unit"))
    frequent = nodes.groupBy(F.size("unit").alias("size")).count().filter(F.col("count") > (0 if cells else block)).orderBy(F.desc("count"), "size")
    centres = {}
    for large in few_rows(frequent.limit(MOST_LENGTHS), MOST_LENGTHS).to_pylist():
        size = large["size"]
        fit = nodes.filter(F.size("unit") == size).orderBy("hash").limit(sample).select("unit")
        fit = few_rows(fit, sample)["unit"].combine_chunks().flatten().to_numpy().reshape(-1, size)
        centres[size] = fit_centres(fit, min(cells or min(MOST_CELLS, large["count"] // block), len(fit)))
    places, vectors_ = _Cells(centres, threshold), nodes.select("node", "n", "unit")
    counts = vectors_.mapInArrow(_count(places), "size int, cell int, homes long").groupBy("size", "cell").agg(F.sum("homes").alias("homes"))
    homes = [(r["size"], r["cell"], r["homes"]) for r in few_rows(counts, MOST_LENGTHS * MOST_CELLS + FURTHER_LENGTHS).to_pylist()]
    blocks, n_blocks = blocks_of(homes, block)
    folder = new_folder(vectors.sparkSession, "vectors")
    placed = vectors_.mapInArrow(_place(places, blocks), "block long, size int, cell int, node long, n long, unit array<double>")
    stored = durable(placed.groupBy("block").applyInArrow(_store(folder), "block long, size int, name string"))
    others = stored.select("size", F.col("block").alias("_block"), F.col("name").alias("b"))
    pairs = stored.join(others, "size").filter(F.col("block") <= F.col("_block")).select(F.col("name").alias("a"), "b").distinct()
    pairs = pairs.repartition(min(MOST_TASKS, 1 + n_blocks * (n_blocks + 1) // 4))  # some two pairs a task
    found = durable(pairs.mapInArrow(_compare(folder, places, threshold), "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = nodes.join(links, "node", "left").join(groups, "node", "left").select("hash", F.col("unit").alias("_u"), F.col("node").alias("_node"), "n", "links", "component")
    mine = members.join(known.withColumnRenamed("hash", "_h"), (F.col("hash") == F.col("_h")) & (F.col("unit") == F.col("_u"))).select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("component", "_node").alias("component_id")
    )
    mine = mine.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    rest = alone.join(mine.select("vec_id"), "vec_id", "left_anti")
    return mine.unionByName(rest)


def op10_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), sound AS (
  SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_dot_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), parts AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT p.vec_id, (SELECT count(*) FROM links l WHERE l.a = p.vec_id) AS n_links, component_id, p.vec_id = component_id AS kept FROM parts p
"""
