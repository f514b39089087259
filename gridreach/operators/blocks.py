"""A graph in blocks, and searches from many vertices at once over it.

``build`` writes the edges once: a row for each block of some thousand vertices, with its vertices
and their targets packed as offsets and places, bucketed by block. A block with too many edges for a
task is split into pieces, each with some edges of every vertex, so a hub's edges are many tasks'.

``search`` gives 64 sources to a long. What travels is (block, group of sources, vertex, word, bits):
the sources that newly reach a vertex from outside its block. A round combines these with ``bit_or``,
takes off what had arrived before, joins them to the blocks and spreads them inside each block to
the end, whatever the number of hops; only what leaves a block travels on. So a round shuffles its
frontier alone, and there are as many rounds as blocks on the longest chain, not hops. With pairs
to answer, sources without an open pair are taken off the frontier, and the search ends with the
last answer.

What has arrived decides all the rest: spread once more, it gives a block's rows of the boolean
closure matrix (``matrix``), of which counts, pairs or answers are read inside the task.

``least`` goes the same way with numbers in place of bits: the smallest value, grown by a step on
every arc, that gets to a vertex. Hop distances (``distances``) and colours are such values. A value
that isn't below what had arrived at its vertex is not sent on; rounds are the most blocks that a
least path passes through one after the other, and again for corrections.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.checkpoints import shared_dir, written
from ..plans.shipping import ship

#: Vertices of a block and sources of a group: a task's bit rows take at most 2 MB.
BLOCK, SOURCES = 4096, 4096
#: Edges that a task holds.
PIECE_EDGES = 2_000_000
#: Ranges of ids make blocks where ids are at most so many times more than edges; else hashes do.
SPARSE = 64
#: Sources of a group where numbers travel: a task holds as many bytes as with ``SOURCES`` bits.
COLUMNS = 64
#: Rounds whose arrivals are merged into one table.
MERGE = 8
#: Bytes of the numbers of a block's vertices and of the vertices outside that it leads to, at once.
_ROWS = 4 << 20
#: Edges that are followed together, and pairs that leave a task together.
_STEP, _BATCH = 1 << 14, 1 << 20

_U = np.uint64


@dataclass(frozen=True)
class Graph:
    """Packed blocks (block, piece, pieces, ids, ends, targets, far) in a bucketed table, the block of a vertex, and the distinct arcs (src, dst)."""

    rows: DataFrame
    of: Callable[[str], Column]
    blocks: int
    arcs: DataFrame


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of each block's piece from rows (block, piece, pieces, v, dst) in that order; dst is null in rows that only name a vertex."""

    def made(held: list[tuple[np.ndarray, np.ndarray]], key: tuple) -> pa.RecordBatch:
        v, dst = (np.concatenate(x) for x in zip(*held, strict=True))
        ids = np.unique(v)
        real = dst != _NONE
        v, dst = v[real], dst[real]
        ends = np.searchsorted(v, ids, side="right").astype(np.int32)
        place = np.searchsorted(ids, dst)
        inside = (place < len(ids)) & (ids[np.minimum(place, len(ids) - 1)] == dst)
        far, out = np.unique(dst[~inside], return_inverse=True)
        targets = np.empty(len(dst), dtype=np.int32)
        targets[inside], targets[~inside] = place[inside], -1 - out
        packed = [pa.array([x.tobytes()], pa.binary()) for x in (ids, ends, targets, far)]
        return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(key, (pa.int64(), pa.int32(), pa.int32()), strict=True)] + packed, ["block", "piece", "pieces", "ids", "ends", "targets", "far"])

    held, now = [], None
    for b in batches:
        block, piece, pieces, v = (b.column(i).to_numpy() for i in range(4))
        dst = b.column(4).fill_null(_NONE).to_numpy()
        starts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (piece[1:] != piece[:-1])]) if len(block) else []
        for start, end in zip(starts, [*starts[1:], len(block)], strict=True):
            key = (int(block[start]), int(piece[start]), int(pieces[start]))
            if held and key != now:
                yield made(held, now)
                held = []
            now = key
            held.append((v[start:end], dst[start:end]))
    if held:
        yield made(held, now)


_NONE = np.iinfo(np.int64).min


def build(edges: DataFrame, vertices: DataFrame | None = None, block: int = BLOCK, piece_edges: int = PIECE_EDGES) -> Graph:
    """Pack edges (src, dst) and further ``vertices`` (v); loops and repeated edges don't count. The edges are read once."""
    spark = edges.sparkSession
    ship(spark)
    seen = Observation()
    arcs = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).filter("src <> dst").distinct()
    arcs = written(arcs.observe(seen, F.count(F.lit(1)).alias("n"), F.min(F.least("src", "dst")).alias("low"), F.max(F.greatest("src", "dst")).alias("high")))
    n, low, high = seen.get["n"] or 1, seen.get["low"] or 0, seen.get["high"] or 0
    span = high - low + 1
    if span <= SPARSE * n:
        width = block * max(1, span // (2 * n))
        blocks = -(-span // width)
        of = lambda v: F.expr(f"({v} - ({low})) DIV {width}L")
    else:
        blocks = max(1, -(-2 * n // block))
        of = lambda v: F.pmod(F.xxhash64(v), F.lit(blocks)).cast("long")
    placed = arcs.select(of("src").alias("block"), F.col("src").alias("v"), "dst")
    heavy = placed.groupBy("block").agg(F.ceil(F.count("*") / piece_edges).cast("int").alias("pieces")).filter("pieces > 1")
    named = arcs.select(F.explode(F.array("src", "dst")).alias("v"))
    named = (named if vertices is None else named.union(vertices.select(F.col("v").cast("long")))).distinct()
    named = named.select(of("v").alias("block"), "v", F.lit(None).cast("long").alias("dst"))
    rows = placed.union(named).join(heavy, "block", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    mine = F.when(F.col("dst").isNull(), F.sequence(F.lit(0), F.col("pieces") - 1)).otherwise(F.array(F.pmod(F.xxhash64("dst"), F.col("pieces")).cast("int")))
    rows = rows.select("block", F.explode(mine).alias("piece"), "pieces", "v", "dst")
    buckets = max(1, min(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    packed = rows.repartition(buckets, "block").sortWithinPartitions("block", "piece", "v", "dst")
    packed = packed.mapInArrow(_pack, "block long, piece int, pieces int, ids binary, ends binary, targets binary, far binary")
    name = f"blocks_{uuid.uuid4().hex}"
    # a task holds whole buckets already, so none is shuffled again
    packed.write.bucketBy(buckets, "block").sortBy("block").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; the files stay in the shared folder
    return Graph(table, of, blocks, arcs)


class _Block:
    """One block's piece, unpacked."""

    def __init__(self, ids: bytes, ends: bytes, targets: bytes, far: bytes, words: int):
        self.ids, self.far = np.frombuffer(ids, np.int64), np.frombuffer(far, np.int64)
        self.ends, self.targets, self.words = np.frombuffer(ends, np.int32).astype(np.int64), np.frombuffer(targets, np.int32), words
        self.starts = np.r_[0, self.ends[:-1]]

    def place(self, v: np.ndarray, word: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Bit rows of the vertices here."""
        rows = np.zeros((len(self.ids), self.words), dtype=_U)
        at = np.minimum(np.searchsorted(self.ids, v), len(self.ids) - 1)
        here = self.ids[at] == v
        np.bitwise_or.at(rows, (at[here], word[here]), bits.view(_U)[here])
        return rows

    def spread(self, rows: np.ndarray, walls: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Where the bits get inside the block, and what gets to the vertices outside that it leads to; ``walls`` hold bits that a vertex doesn't let in."""
        rows = rows if walls is None else rows & ~walls
        found, out, fresh = rows.copy(), np.zeros((len(self.far), self.words), dtype=_U), rows.copy()
        active = np.flatnonzero(fresh.any(1))
        while len(active):
            reached = np.zeros_like(found)
            sizes = self.ends[active] - self.starts[active]
            edge = np.repeat(self.starts[active] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
            source = np.repeat(active, sizes)
            for at in range(0, len(edge), _STEP):
                to, of = self.targets[edge[at : at + _STEP]], source[at : at + _STEP]
                for inside, into, index in ((to >= 0, reached, to), (to < 0, out, -1 - to)):
                    _merge(into, index[inside], fresh, of[inside])
            fresh = reached & ~found if walls is None else reached & ~found & ~walls
            found |= fresh
            active = np.flatnonzero(fresh.any(1))
        return found, out

    def place_least(self, v: np.ndarray, bit: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Rows of values, one for each vertex here, ``_FAR`` where there is none."""
        rows = np.full((len(self.ids), self.words), _FAR)
        at = np.minimum(np.searchsorted(self.ids, v), len(self.ids) - 1)
        here = self.ids[at] == v
        np.minimum.at(rows, (at[here], bit[here]), value[here])
        return rows

    def spread_least(self, rows: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """The smallest values that get about inside the block, and to the vertices outside that it leads to."""
        found, out, fresh = rows.copy(), np.full((len(self.far), self.words), _FAR), rows
        active = np.flatnonzero((fresh < _FAR).any(1))
        while len(active):
            reached, left = np.full_like(found, _FAR), np.full_like(out, _FAR)
            sizes = self.ends[active] - self.starts[active]
            edge = np.repeat(self.starts[active] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
            source = np.repeat(active, sizes)
            for at in range(0, len(edge), _STEP):
                to, of = self.targets[edge[at : at + _STEP]], source[at : at + _STEP]
                for inside, into, index in ((to >= 0, reached, to), (to < 0, left, -1 - to)):
                    _merge(into, index[inside], fresh, of[inside], np.minimum)
            for made in (reached, left):
                made[made < _FAR] += step
            np.minimum(out, left, out=out)
            fresh = np.where(reached < found, reached, _FAR)
            np.minimum(found, reached, out=found)
            active = np.flatnonzero((fresh < _FAR).any(1))
        return found, out


#: No value.
_FAR = np.iinfo(np.int64).max


def _merge(into: np.ndarray, index: np.ndarray, rows: np.ndarray, of: np.ndarray, join: np.ufunc = np.bitwise_or) -> None:
    """``into[index] |= rows[of]``, or joined otherwise, where an index may come again."""
    if len(index):
        order = np.argsort(index, kind="stable")
        index = index[order]
        starts = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
        into[index[starts]] = join(into[index[starts]], join.reduceat(rows[of[order]], starts, axis=0))


def _structs(column: pa.Array) -> list[list[np.ndarray]]:
    """The fields of each row's list of structs."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    fields, ends = [f.to_numpy() for f in flat.flatten()], np.cumsum(sizes)
    return [[f[end - size : end] for f in fields] for size, end in zip(sizes, ends, strict=True)]


def _units(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple]:
    """(group, the block unpacked, where the bits get in it, what leaves it, bits that arrived, asked bits or None, weights or None, row) of joined rows."""
    for b in batches:
        names = b.schema.names
        col = {n: b.column(i) for i, n in enumerate(names)}
        arrivals = _structs(col["arrivals"])
        asked, weights, walls, seeds = (_structs(col[n]) if n in col else None for n in ("asked", "weights", "walls", "seeds"))
        for i in range(b.num_rows):
            block = _Block(*(col[n][i].as_py() for n in ("ids", "ends", "targets", "far")), words)
            rows = block.place(*arrivals[i])
            found, out = block.spread(rows, walls and block.place(*walls[i]))
            yield col["group"][i].as_py(), block, found, out, rows, asked and asked[i], weights and weights[i], {n: col[n][i].as_py() for n in ("block", "pieces")} | {"seeds": seeds and seeds[i]}


_BITS = "block long, group long, v long, word int, bits long"


def _flat(kind: int, group: int, ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch | None:
    at, word = np.nonzero(rows)
    if not len(at):
        return None
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(at), kind, np.int32)), pa.array(np.full(len(at), group)), pa.array(ids[at]), pa.array(word.astype(np.int32)), pa.array(rows[at, word].view(np.int64))], ["kind", "group", "v", "word", "bits"]
    )


#: Kinds of a round's rows: bits that travel on, and asked bits that were found.
_TRAVELS, _FOUND = 0, 1


def _step(words: int, final: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, block, found, out, rows, asked, _, row in _units(batches, words):
            made = [] if final else [_flat(_TRAVELS, group, block.far, out)]
            if row["pieces"] > 1 and not final:
                made.append(_flat(_TRAVELS, group, block.ids, found & ~rows))  # for the block's other pieces
            if asked is not None:
                made.append(_flat(_FOUND, group, block.ids, found & block.place(*asked)))
            yield from (m for m in made if m is not None)

    return run


def _count(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, block, found, _, _, _, weights, _ in _units(batches, words):
            total = np.zeros(words * 64, dtype=np.int64)
            weight = np.ones(len(block.ids), dtype=np.int64)
            if weights is not None and len(weights[0]):
                at = np.minimum(np.searchsorted(block.ids, weights[0]), len(block.ids) - 1)
                here = block.ids[at] == weights[0]
                weight[at[here]] = weights[1][here]
            for at in range(0, len(found), 256):
                bits = np.unpackbits(found[at : at + 256].view(np.uint8), axis=1, bitorder="little")
                total += weight[at : at + 256] @ bits.astype(np.int64) if weights is not None else bits.sum(0, dtype=np.int64)
            bit = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bit), group)), pa.array(bit.astype(np.int32)), pa.array(total[bit])], ["group", "bit", "reached"])

    return run


def _pairs(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, found, *_, row in _units(batches, words):
            seeds = np.zeros(words * 64, dtype=np.int64)
            seeds[row["seeds"][0]] = row["seeds"][1]
            step = max(1, _BATCH // (words * 64))
            for at in range(0, len(found), step):
                v, bit = np.nonzero(np.unpackbits(found[at : at + step].view(np.uint8), axis=1, bitorder="little"))
                src, dst = seeds[bit], block.ids[at + v]
                other = src != dst
                if other.any():
                    yield pa.RecordBatch.from_arrays([pa.array(src[other]), pa.array(dst[other])], ["src", "dst"])

    return run


def _matrix(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, block, found, *_, row in _units(batches, words):
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([group]), pa.array([block.ids.tobytes()], pa.binary()), pa.array([found.tobytes()], pa.binary())], ["block", "group", "ids", "rows"])

    return run


def word_of(bit: str) -> tuple[Column, Column]:
    """The word that a bit is in, and a long with only that bit."""
    return F.shiftright(bit, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col(bit) % 64).alias("bits")


def _merged(bits: DataFrame, *also: str) -> DataFrame:
    return bits.groupBy(*also, "block", "group", "v", "word").agg(F.bit_or("bits").alias("bits"))


def _listed(bits: DataFrame, name: str, columns: tuple[str, ...] = ("v", "word", "bits")) -> DataFrame:
    """A row of each block and group, at most a block's bit rows."""
    return bits.groupBy("block", "group").agg(F.collect_list(F.struct(*columns)).alias(name))


@dataclass
class Search:
    """What a search has found: the sources' numbers, what arrived in each block, and the rounds' frontiers in rows."""

    graph: Graph
    numbers: DataFrame
    words: int
    arrived: DataFrame
    found: DataFrame | None
    frontiers: list[int] = field(default_factory=list)
    walls: DataFrame | None = None

    def _whole(self) -> DataFrame:
        return self._with(_listed(_merged(self.arrived), "arrivals"))

    def _with(self, units: DataFrame, rows: DataFrame | None = None) -> DataFrame:
        """Blocks beside what arrived in them; what belongs to a unit is put to it before, so that packed blocks aren't shuffled."""
        units = units if self.walls is None else units.hint("merge").join(self.walls, ["block", "group"], "left")
        return (self.graph.rows.filter("piece = 0") if rows is None else rows).hint("merge").join(units, "block")

    def matrix(self) -> DataFrame:
        """(block, group, ids, rows): the closure's bit rows, a bit for each source of the group, of the vertices ``ids``."""
        return self._whole().mapInArrow(_matrix(self.words), "block long, group long, ids binary, rows binary")

    def counts(self, weights: DataFrame | None = None) -> DataFrame:
        """(seed, reached): how many vertices each source reaches, itself included, or the sum of their ``weights`` (v, weight); no pair is made."""
        whole = self._whole() if weights is None else None
        if weights is not None:
            listed = weights.select(self.graph.of("v").alias("block"), F.col("v").cast("long").alias("v"), F.col("weight").cast("long").alias("weight"))
            listed = listed.groupBy("block").agg(F.collect_list(F.struct("v", "weight")).alias("weights"))
            rows = self.graph.rows.filter("piece = 0").hint("merge").join(listed, "block", "left")
            whole = self._with(_listed(_merged(self.arrived), "arrivals"), rows)
        counted = whole.mapInArrow(_count(self.words), "group long, bit int, reached long").groupBy("group", "bit").agg(F.sum("reached").alias("reached"))
        named = self.numbers.hint("merge").join(counted, ["group", "bit"], "left")
        if weights is not None:
            named = named.hint("merge").join(weights.select(F.col("v").alias("seed"), "weight"), "seed", "left")
        return named.select("seed", F.coalesce("reached", F.lit(1) if weights is None else F.coalesce("weight", F.lit(1))).cast("long").alias("reached"))

    def pairs(self) -> DataFrame:
        """(src, dst): each source with the other vertices that it reaches."""
        seeds = self.numbers.groupBy("group").agg(F.collect_list(F.struct("bit", "seed")).alias("seeds"))
        units = _listed(_merged(self.arrived), "arrivals").hint("merge").join(seeds, "group")
        return self._with(units).mapInArrow(_pairs(self.words), "src long, dst long")

    def answer(self, pairs: DataFrame) -> DataFrame:
        """(qid, source, target, reachable) of pairs whose sources were searched from."""
        found = self.found
        if found is None:
            asked = _listed(_asked(self.graph, self.numbers, pairs), "asked")
            found = self._whole().join(asked, ["block", "group"]).mapInArrow(_step(self.words, final=True), "kind int, group long, v long, word int, bits long").filter(F.col("kind") == _FOUND)
        word, bits = word_of("bit")
        numbered = pairs.select("qid", "source", "target").join(self.numbers.select(F.col("seed").alias("source"), "group", "bit").hint("merge"), "source", "left").select("*", word, bits)
        hit = found.groupBy("group", F.col("v").alias("target"), "word").agg(F.bit_or("bits").alias("hit"))
        out = numbered.hint("merge").join(hit, ["group", "target", "word"], "left")
        return out.select("qid", "source", "target", F.coalesce((F.col("source") == F.col("target")) | (F.col("hit").bitwiseAND(F.col("bits")) != 0), F.lit(False)).alias("reachable"))


def _numbered(graph: Graph, seeds: DataFrame, sources: int) -> tuple[DataFrame, int]:
    """(seed, group, bit) and the words of a group: sources near each other by blocks, at most ``sources`` a group."""
    seen = Observation()
    once = seeds.select(F.col("seed").cast("long").alias("seed")).filter("seed IS NOT NULL").distinct().withColumn("block", graph.of("seed"))
    once = written(once.observe(seen, F.count(F.lit(1)).alias("n")))
    near = max(1, graph.blocks * sources // max(1, seen.get["n"]))
    inside = F.greatest(F.least("block", F.lit(graph.blocks)), F.lit(0))  # a source outside the graph has a block outside
    rough = F.floor(inside / near).cast("long")
    place = F.row_number().over(Window.partitionBy("rough").orderBy("seed")) - 1
    numbered = once.withColumn("rough", rough).withColumn("place", place)
    numbered = numbered.select("seed", (F.col("rough") * (1 << 24) + F.floor(F.col("place") / sources)).cast("long").alias("group"), (F.col("place") % sources).cast("int").alias("bit"))
    most = Observation()
    numbered = written(numbered.observe(most, F.max("bit").alias("bit")))
    return numbered, (most.get["bit"] or 0) // 64 + 1


def _asked(graph: Graph, numbers: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs' bits: (block, group, v, word, bits) of their targets."""
    ends = pairs.filter("source <> target").select(F.col("source").alias("seed"), F.col("target").cast("long").alias("v")).distinct().join(numbers.hint("merge"), "seed")
    word, bits = word_of("bit")
    return _merged(ends.select(graph.of("v").alias("block"), "group", "v", word, bits))


def search(graph: Graph, seeds: DataFrame, pairs: DataFrame | None = None, sources: int = SOURCES, walls: Callable[[DataFrame], DataFrame] | None = None) -> Search:
    """What the seeds (seed) reach; with ``pairs`` (source, target) only until all are answered, and from those of their sources still open.

    ``walls`` makes, of the sources' numbers (seed, group, bit), rows (group, v, word, bits): the
    sources that a vertex doesn't let in, so that they neither reach it nor pass it.
    """
    numbers, words = _numbered(graph, seeds, sources)
    shut = None if walls is None else written(_listed(_merged(walls(numbers).withColumn("block", graph.of("v"))), "walls"))
    word, bits = word_of("bit")
    new = numbers.select(graph.of("seed").alias("block"), "group", F.col("seed").alias("v"), word, bits)
    new = _merged(new)
    arrived, found, frontiers = new, None, []
    open_ = asked = written(_asked(graph, numbers, pairs)) if pairs is not None else None
    keys = ["block", "group", "v", "word"]
    for turn in range(1, 1 << 30):
        units = _listed(new, "arrivals")
        if asked is not None:
            units = units.join(_listed(open_, "asked"), ["block", "group"], "left")
        if shut is not None:
            units = units.hint("merge").join(shut, ["block", "group"], "left")
        out = graph.rows.hint("merge").join(units, "block").mapInArrow(_step(words), "kind int, group long, v long, word int, bits long")
        out = _merged(out.withColumn("block", graph.of("v")), "kind")
        fresh = out.hint("merge").join(_merged(arrived).withColumnRenamed("bits", "old"), keys, "left")
        left = F.when(F.col("kind") == _TRAVELS, F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long"))))).otherwise(F.col("bits"))
        seen = Observation()
        fresh = fresh.select("kind", *keys, left.alias("bits")).filter("bits <> 0")
        fresh = written(fresh.observe(seen, F.count_if(F.col("kind") == _TRAVELS).alias("travels"), F.count_if(F.col("kind") == _FOUND).alias("found")))
        frontiers.append(seen.get["travels"] or 0)
        new = fresh.filter(F.col("kind") == _TRAVELS).drop("kind")
        if asked is not None:
            hits = fresh.filter(F.col("kind") == _FOUND).drop("kind")
            found = hits if found is None else found.union(hits)
            if seen.get["found"]:
                rest = open_.join(hits.withColumnRenamed("bits", "hit"), keys, "left")
                rest = rest.select(*keys, F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("hit", F.lit(0).cast("long")))).alias("bits"))
                open_ = written(rest.filter("bits <> 0"))
            live = open_.groupBy("group", "word").agg(F.bit_or("bits").alias("live"))
            new = new.join(live, ["group", "word"]).select(*keys, F.col("bits").bitwiseAND(F.col("live")).alias("bits")).filter("bits <> 0")
            if not frontiers[-1] or new.isEmpty():
                break
        elif not frontiers[-1]:
            break
        arrived = arrived.union(new)
        if turn % MERGE == 0:
            arrived = written(_merged(arrived))
    return Search(graph, numbers, words, arrived, found, frontiers, shut)


_VALUES = "group long, v long, bit int, value long"


def _values(group: int, ids: np.ndarray, rows: np.ndarray, first: int = 0) -> Iterator[pa.RecordBatch]:
    step = max(1, _BATCH // rows.shape[1])
    for start in range(0, len(rows), step):
        at, bit = np.nonzero(rows[start : start + step] < _FAR)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), group)), pa.array(ids[start + at]), pa.array((bit + first).astype(np.int32)), pa.array(rows[start + at, bit])], ["group", "v", "bit", "value"])


def _relax(columns: int, step: int, final: bool):
    """What leaves each block (and, of a split one, what changed inside), or at last all that is in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = dict(zip(b.schema.names, b.columns, strict=True))
            for i, (v, bit, value) in enumerate(_structs(col["arrivals"])):
                block, group = _Block(*(col[n][i].as_py() for n in ("ids", "ends", "targets", "far")), columns), col["group"][i].as_py()
                block.words = width = max(1, min(columns, _ROWS // (8 * (len(block.ids) + len(block.far)))))
                for first in range(0, columns, width):  # sources don't mix, so those of a large block take turns
                    mine = (bit >= first) & (bit < first + width)
                    if not mine.any():
                        continue
                    rows = block.place_least(v[mine], bit[mine] - first, value[mine])
                    found, out = block.spread_least(rows, step)
                    if final:
                        yield from _values(group, block.ids, found, first)
                        continue
                    yield from _values(group, block.far, out, first)
                    if col["pieces"][i].as_py() > 1:
                        yield from _values(group, block.ids, np.where(found < rows, found, _FAR), first)

    return run


def least(graph: Graph, starts: DataFrame, step: int, columns: int = 1, rounds: list[int] | None = None) -> DataFrame:
    """(group, v, bit, value): the smallest value that gets to each vertex of the graph, for every group and bit.

    ``starts`` (group, v, bit, value) are values below 2**63 - 1 at vertices, bits below ``columns``;
    ``step``, not negative, is added on every arc. ``rounds`` takes the rows that each round sent on.
    """
    keys, fields = ["block", "group", "v", "bit"], ("v", "bit", "value")
    smallest = lambda df, name="value": df.groupBy(*keys).agg(F.min("value").alias(name))
    placed = starts.select(graph.of("v").alias("block"), F.col("group").cast("long").alias("group"), F.col("v").cast("long").alias("v"), F.col("bit").cast("int").alias("bit"), F.col("value").cast("long").alias("value"))
    arrived = new = written(smallest(placed))
    for turn in range(1, 1 << 30):
        out = graph.rows.hint("merge").join(_listed(new, "arrivals", fields), "block").mapInArrow(_relax(columns, step, False), _VALUES)
        fresh = smallest(out.withColumn("block", graph.of("v"))).hint("merge").join(smallest(arrived, "old"), keys, "left").filter("old IS NULL OR value < old")
        seen = Observation()
        new = written(fresh.select(*keys, "value").observe(seen, F.count(F.lit(1)).alias("n")))
        sent = seen.get["n"] or 0
        if rounds is not None:
            rounds.append(sent)
        if not sent:
            break
        arrived = arrived.union(new)
        if turn % MERGE == 0:
            arrived = written(smallest(arrived))
    whole = graph.rows.filter("piece = 0").hint("merge").join(_listed(smallest(arrived), "arrivals", fields), "block")
    return whole.mapInArrow(_relax(columns, step, True), _VALUES)


def distances(graph: Graph, seeds: DataFrame, columns: int = COLUMNS, rounds: list[int] | None = None, starts: DataFrame | None = None) -> DataFrame:
    """(seed, v, depth): what each seed reaches, itself included, and in how many hops at least.

    With ``starts`` (seed, v, depth) a search goes on from vertices whose depths are known, and depths are those of paths through them.
    """
    numbers, _ = _numbered(graph, seeds, columns)
    begun = numbers.select("group", F.col("seed").alias("v"), "bit", F.lit(0).alias("value"))
    if starts is not None:
        begun = numbers.hint("merge").join(starts, "seed").select("group", "v", "bit", F.col("depth").alias("value"))
    found = least(graph, begun, 1, columns, rounds).hint("merge").join(numbers, ["group", "bit"]).filter("v <> seed")
    own = numbers.select("seed", F.col("seed").alias("v"), F.lit(0).alias("depth"))  # also of seeds outside the graph
    return own.union(found.select("seed", "v", F.col("value").cast("int").alias("depth")))
