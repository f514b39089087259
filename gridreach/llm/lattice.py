"""Embedding near-duplicates by lattice hashing.

Each table projects a unit vector at random to two times eight coordinates, shifts them and decodes
each eight to the nearest point of the E8 lattice; both points make a cell. A vector goes into its
own cell and, of the neighbouring cells (one of the two points moved by one of the lattice's 240
shortest vectors), into the ``PROBES`` nearest ones. Vectors that share a cell are compared by
cosine in double precision.

Equal vectors are one class with a weight. Cells with a single class are found from keys alone and
dropped before any vector is sent. A cell of many classes is dealt into blocks, and each pair of
blocks is a group of its own, so no group holds more than two blocks. A group compares its vectors
by blocked products and returns a row per vector: how many it is linked with, and the least class
that it is connected with inside the group. No pair is ever a row. A pair that shares several cells
is counted in the least of them, which both ends' cells tell.

Constants: with cells 2.0 wide, 3 probes and 8 tables, a pair at cosine 0.9 shares no cell with
probability 0.02, one at 0.97 with 3e-7 (simulated for a table, independent tables).

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, are
linked with nothing; vectors of different lengths are not linked; repeated rows and rows that share
an id are vectors like any other, each judged by its own components; a null id is never the
smallest of its component, and alone it has a null component and is kept; ties don't arise, as the
smallest id stands for a component; an empty table gives no rows; other columns are ignored. Very
long vectors are projected some thousand at a time.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..plans.checkpoints import cut
from ..plans.shipping import ship
from .common import pick

COSINE = 0.9
TABLES, POINTS, PROBES, WIDTH = 8, 2, 3, 2.0
#: Classes of a cell that make a block; a group holds one block or two.
BLOCK = 1024
#: Over so many parts the rows of small cells are spread when a cell's size is looked up.
SALTS = 8
#: Groups up to this size are compared together, by distance of their rows; pairs that are looked at together.
_SMALL, _PAIRS = 48, 1 << 16

_CELLS = TABLES * (1 + PROBES)


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of one, or all of a half with an even number of minus signs."""
    whole = [np.eye(8)[i] * s + np.eye(8)[j] * t for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    halves = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if np.prod(s) > 0]
    return np.array(whole + halves)


_NEAR = _shortest()
_MIX = np.random.Generator(np.random.PCG64(811)).integers(0, 1 << 63, (TABLES, POINTS * 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _nearest_even(y: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum of coordinates."""
    point = np.rint(y)
    odd = np.flatnonzero(point.sum(1).astype(np.int64) & 1)
    error = y[odd] - point[odd]
    worst = np.abs(error).argmax(1)
    point[odd, worst] += np.where(error[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return point


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """The nearest E8 lattice point of each row: integers with an even sum, or the same shifted by a half."""
    a, b = _nearest_even(y), _nearest_even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision, whatever their size."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _hashed(points: np.ndarray, mix: np.ndarray) -> np.ndarray:
    """A linear hash of lattice points, whose doubled coordinates are integers."""
    return ((points * 2).astype(np.int64).view(np.uint64) * mix).sum(1, dtype=np.uint64)


def cells_of(units: np.ndarray) -> np.ndarray:
    """The ``_CELLS`` cells of each unit vector: for each table its own and the probed ones, as 64-bit numbers."""
    n, size = units.shape
    rng = np.random.Generator(np.random.PCG64([811, size]))
    out = np.empty((n, TABLES, 1 + PROBES), dtype=np.uint64)
    for t in range(TABLES):
        directions, shift = rng.standard_normal((size, POINTS * 8)) / WIDTH, rng.random(POINTS * 8)
        y = units @ directions + shift
        own, gains, moves = np.zeros(n, dtype=np.uint64), [], []
        for k in range(POINTS):
            part, mix = y[:, 8 * k : 8 * k + 8], _MIX[t, 8 * k : 8 * k + 8]
            point = nearest_e8(part)
            own += _hashed(point, mix)
            gains.append((part - point) @ _NEAR.T)  # all moves are equally long: the more, the nearer
            moves.append(_hashed(_NEAR, mix))
        nearest = np.argpartition(-np.concatenate(gains, axis=1), PROBES - 1, axis=1)[:, :PROBES]
        out[:, t, 0] = own
        out[:, t, 1:] = own[:, None] + np.concatenate(moves)[nearest]
    return (out + (np.arange(TABLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size))[None, :, None]).reshape(n, _CELLS)


def sound(vector: str) -> Column:
    """Whether a vector can be compared: not null, no null or non-finite component, not zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _lists(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of a list column, as places and matrices by length."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        step = max(1, (1 << 22) // size)
        for at in range(0, len(rows), step):
            own = rows[at : at + step]
            yield own, flat[(ends[own] - size)[:, None] + np.arange(size)]


def _with_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for rows, matrix in _lists(b.column(2)):
            cells = cells_of(unit(matrix)).view(np.int64)
            vectors = pa.array([m.tobytes() for m in matrix], pa.binary())
            lists = pa.ListArray.from_arrays(np.arange(0, cells.size + 1, _CELLS, dtype=np.int32), cells.ravel())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), vectors, lists], ["uid", "weight", "vector", "cells"])


class _Group:
    """Rows of some groups, sorted by group, and what comparing them has found."""

    def __init__(self, rows: list[pa.RecordBatch], kind: np.dtype):
        table = pa.Table.from_batches(rows)
        column = {n: table.column(n).combine_chunks() for n in table.column_names}
        whole = lambda n: column[n].to_numpy(zero_copy_only=False)
        self.cell, self.block, self.uid, self.weight = whole("cell"), whole("block"), whole("uid"), whole("weight")
        self.key = np.stack([self.cell, whole("low"), whole("high")], 1)
        self.cells = column["cells"].flatten().to_numpy().reshape(-1, TABLES, 1 + PROBES)
        sizes = column["vector"].cast(pa.large_binary())
        data = [np.frombuffer(v, dtype=kind) for v in sizes.to_pylist()]
        width = max(map(len, data))
        self.size = np.array([len(v) for v in data])
        self.units = np.zeros((len(data), width))
        for size in np.unique(self.size).tolist():
            at = np.flatnonzero(self.size == size)
            self.units[at, :size] = unit(np.stack([data[i] for i in at]))
        self.found = np.zeros(len(data), dtype=np.int64)
        self.root = np.arange(len(data))

    def first_shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the cell in which rows ``a`` and ``b`` meet is the first one that they share, table by table."""
        same = (self.cells[a][:, :, :, None] == self.cells[b][:, :, None, :]).any(3)
        place = same.reshape(len(a), -1).argmax(1)
        return self.cells[a].reshape(len(a), -1)[np.arange(len(a)), place] == self.cell[a]

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = np.minimum(a, b), np.maximum(a, b)
        for at in range(0, len(a), _PAIRS):
            x, y = a[at : at + _PAIRS], b[at : at + _PAIRS]
            new = self.first_shared(np.where(self.uid[x] < self.uid[y], x, y), np.where(self.uid[x] < self.uid[y], y, x))
            np.add.at(self.found, x[new], self.weight[y[new]])
            np.add.at(self.found, y[new], self.weight[x[new]])
        while len(a):  # the least row of what is connected
            low = np.minimum(self.root[a], self.root[b])
            before = self.root.copy()
            for end in (a, b):
                np.minimum.at(self.root, self.root[end], low)
                np.minimum.at(self.root, end, low)
            self.root = self.root[self.root]
            if (before == self.root).all():
                break

    def compare(self) -> None:
        starts = np.flatnonzero(np.r_[True, (self.key[1:] != self.key[:-1]).any(1)])
        ends = np.r_[starts[1:], len(self.cell)]
        of = np.repeat(ends, ends - starts)
        small = np.repeat(ends - starts <= _SMALL, ends - starts)
        links: list[tuple[np.ndarray, np.ndarray]] = []
        for gap in range(1, min(_SMALL, len(of))):
            a = np.flatnonzero(small & (np.arange(len(of)) + gap < of))
            if not len(a):
                break
            for at in range(0, len(a), _PAIRS):
                x = a[at : at + _PAIRS]
                x = x[self._apart(x, x + gap)]
                hit = x[np.einsum("ij,ij->i", self.units[x], self.units[x + gap]) >= COSINE]
                links.append((hit, hit + gap))
        for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
            for at in range(start, end, 512) if end - start > _SMALL else ():
                x, y = np.nonzero(self.units[at : min(at + 512, end)] @ self.units[at:end].T >= COSINE)
                upper = x < y
                x, y = x[upper] + at, y[upper] + at
                apart = self._apart(x, y)
                links.append((x[apart], y[apart]))
        if links:
            self.link(np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links]))

    def _apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Pairs that this group is there for: of its two blocks, one each, and of one length."""
        return ((self.key[x, 1] == self.key[x, 2]) | (self.block[x] != self.block[y])) & (self.size[x] == self.size[y])

    def batch(self) -> pa.RecordBatch:
        linked = np.flatnonzero((self.found > 0) | (self.root != np.arange(len(self.root))))
        return pa.RecordBatch.from_arrays([pa.array(self.uid[linked]), pa.array(self.found[linked]), pa.array(self.uid[self.root[linked]])], ["uid", "found", "root"])


def _compared(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            group = _Group(rows, np.dtype(kind))
            group.compare()
            return group.batch()

        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            cell, low, high = (b.column(b.schema.get_field_index(n)).to_numpy() for n in ("cell", "low", "high"))
            last = np.flatnonzero((cell != cell[-1]) | (low != low[-1]) | (high != high[-1]))
            cut_at = int(last[-1]) + 1 if len(last) else 0  # where the batch's last group starts
            if cut_at:
                yield done([*held, b.slice(0, cut_at)])
                held = []
            elif held and [held[-1].column(held[-1].schema.get_field_index(n))[-1].as_py() for n in ("cell", "low", "high")] != [cell[0], low[0], high[0]]:
                yield done(held)
                held = []
            held.append(b.slice(cut_at))
        if held:
            yield done(held)

    return run


def classes_of(embeddings: DataFrame) -> DataFrame:
    """(uid, weight, least, vector): the distinct vectors that can be compared, how many rows have each, and their smallest id."""
    rows = pick(embeddings, "vec_id", "embedding").filter(sound("embedding"))
    grouped = rows.groupBy("embedding").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    return cut(grouped.select(F.monotonically_increasing_id().alias("uid"), "weight", "least", "embedding"))


def links_of(classes: DataFrame) -> DataFrame:
    """(uid, found, root): for each group of a cell and vector linked in it, the linked rows counted there and a connected class."""
    kind = "<f4" if isinstance(classes.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"
    whole = classes if kind == "<f4" else classes.withColumn("embedding", F.col("embedding").cast("array<double>"))
    keyed = cut(whole.select("uid", "weight", "embedding").mapInArrow(_with_cells, "uid long, weight long, vector binary, cells array<long>"))
    keys = keyed.select("uid", F.explode(F.array_distinct("cells")).alias("cell"))
    shared = keys.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    spread = shared.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = keys.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int")).join(spread, ["cell", "salt"])
    block = F.pmod(F.xxhash64("uid", F.lit(1)), F.col("blocks")).cast("int")
    placed = met.select("uid", "cell", "blocks", block.alias("block"))
    # a block meets itself and every other one
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("uid", "cell", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    rows = dealt.join(keyed, "uid").select("cell", "low", "high", "block", "uid", "weight", "vector", "cells")
    rows = rows.repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high", "uid")
    return rows.mapInArrow(_compared(kind), "uid long, found long, root long")


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id (the smallest vec_id reachable), kept."""
    ship(embeddings.sparkSession)
    classes = classes_of(embeddings)
    found = cut(links_of(classes).groupBy("uid", "root").agg(F.sum("found").alias("found")))
    counts = found.groupBy("uid").agg(F.sum("found").alias("found"))
    parts = connected_components(found, "uid", "root").withColumnRenamed("v", "uid")
    named = classes.select("uid", "least").join(parts, "uid", "left").select("uid", "least", F.coalesce("component", "uid").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = classes.select("uid", "weight", "embedding").join(counts, "uid", "left").join(named.select("uid", "component"), "uid").join(smallest, "component")
    known = cut(known.select("embedding", (F.coalesce("found", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"))
    rows = pick(embeddings, "vec_id", "embedding").withColumn("key", F.when(sound("embedding"), F.col("embedding")))
    out = rows.join(known.withColumnRenamed("embedding", "key"), "key", "left")
    component = F.when(F.col("n_links") > 0, F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
