"""Grids as DataFrames: cells(v, x, y, passable), adjacent pairs, oriented edges, tiles."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_coordinates(cells: DataFrame, width: int) -> DataFrame:
    """(v, passable) -> (v, x, y, passable) of a row-major grid."""
    return cells.select("v", (F.col("v") % width).alias("x"), F.floor(F.col("v") / width).alias("y"), "passable")


def set_passable(cells: DataFrame, changes: DataFrame) -> DataFrame:
    """``cells`` with the passability that ``changes`` (v, passable, a row a cell) gives; changes off the grid are ignored."""
    new = changes.select("v", F.col("passable").alias("__new"))
    return cells.hint("merge").join(new, "v", "left").select("v", "x", "y", F.coalesce("__new", "passable").alias("passable"))


#: Directions by number and their steps.
DIRECTIONS = {0: (1, 0), 1: (0, 1), 2: (-1, 0), 3: (0, -1)}


def neighbors(cells: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (v, dir: 0 east, 1 south, 2 west, 3 north) with ``next``: the passable cell there, or null."""
    step = lambda i: F.get(F.array(*[F.lit(DIRECTIONS[d][i]) for d in range(4)]), F.col("dir"))
    there = asked.hint("merge").join(cells.select("v", F.col("x").alias("__x"), F.col("y").alias("__y")), "v", "left")
    there = there.select("v", "dir", (F.col("__x") + step(0)).alias("x"), (F.col("__y") + step(1)).alias("y"))
    open_ = cells.filter("passable").select("x", "y", F.col("v").alias("next"))
    return there.hint("merge").join(open_, ["x", "y"], "left").select("v", "dir", "next")


def checked_edges(edges: DataFrame, n: int) -> DataFrame:
    """The distinct edges, loops too; an end outside 0 .. n - 1 is an error when the rows are made."""
    bad = F.least("src", "dst") < 0
    bad = bad | (F.greatest("src", "dst") >= n) | F.col("src").isNull() | F.col("dst").isNull()
    kept = edges.select("src", "dst").distinct()
    return kept.filter(F.when(bad, F.raise_error(F.format_string(f"edge %d, %d leaves the {n} vertices", "src", "dst")).cast("boolean")).otherwise(True))


def csr_bytes(vertices: int, edges: int) -> int:
    """What row starts and targets take as 32-bit numbers."""
    return 4 * (vertices + 1) + 4 * edges


def adjacent_pairs(cells: DataFrame, width: int) -> DataFrame:
    """Each adjacency of passable cells once: (a, b, dir), dir 0 east and 1 south."""
    steps = F.array(F.struct(F.lit(0).alias("dir"), F.lit(1).alias("step")), F.struct(F.lit(1).alias("dir"), F.lit(width).alias("step")))
    open_ = cells.filter("passable")
    from_ = open_.select(F.col("v").alias("a"), "x", F.explode(steps).alias("s")).filter((F.col("s.dir") == 1) | (F.col("x") < width - 1))
    return from_.select("a", (F.col("a") + F.col("s.step")).alias("b"), F.col("s.dir").alias("dir")).hint("merge").join(open_.select(F.col("v").alias("b")), "b").select("a", "b", "dir")


#: A prime: hashes are squares modulo it, so any engine can repeat them.
PRIME = 1000003


def mixed(u: Column, seed: int) -> Column:
    """A number below ``PRIME`` from another and every digit of a seed in base ``PRIME``, squared digit by digit."""
    first, seed = seed % PRIME, seed // PRIME
    h = (u + first * 1299709 % PRIME) % PRIME
    h = (h * h) % PRIME
    while seed:
        digit, seed = seed % PRIME, seed // PRIME
        h = ((h + digit) * (h + digit)) % PRIME
    return h


def pair_hash(k: int) -> Column:
    """A number from 0 to 999 for a pair (a, b) and any seed from 0 on: the same integer arithmetic in any engine."""
    return mixed((F.col("a") % PRIME) * 7919 + (F.col("b") % PRIME) * 104729, k) % 1000


def _arcs(pairs: DataFrame, kind: Column) -> DataFrame:
    """kind: 0 none, 1 a to b, 2 b to a, 3 both."""
    forth = F.struct(F.col("a").alias("src"), F.col("b").alias("dst"))
    back = F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))
    arcs = F.when(kind == 3, F.array(forth, back)).when(kind == 1, F.array(forth)).when(kind == 2, F.array(back))
    return pairs.select(F.explode(arcs).alias("e")).select("e.src", "e.dst")


@dataclass(frozen=True)
class Chances:
    """Probabilities of both arcs, one arc, an arc against the gradient, and the gradient's angle in degrees."""

    both: float
    one: float
    against: float
    angle: float


def sanitized(both: float, one: float, against: float = 0.05, angle: float = 45.0) -> Chances:
    """Probabilities between 0 and 1 (no number: 0); both and one are scaled down to a sum of 1; an angle that is no number is 45."""
    both, one, against = (0.0 if math.isnan(p) else min(1.0, max(0.0, p)) for p in (both, one, against))
    total = max(1.0, both + one)
    return Chances(both / total, one / total, against, 45.0 if math.isnan(angle) else angle)


def orient(pairs: DataFrame, mode: str, p_both: float = 0.25, p_one: float = 0.15, p_against: float = 0.05, seed: int = 0, angle: float = 45.0) -> DataFrame:
    """Edges (src, dst) of a mode: acyclic (east and south), bidirectional, random or gradient.

    The gradient points ``angle`` degrees from east to south; an arc goes along it unless a coin turns it,
    and either way by another coin where it is at right angles to it.
    """
    p = sanitized(p_both, p_one, p_against, angle)
    p_both, p_one, p_against = p.both, p.one, p.against
    h, coin = pair_hash(seed), pair_hash(seed + 1)
    both, one = round(1000 * p_both), round(1000 * (p_both + p_one))
    one_way = F.when(coin < 500, 1).otherwise(2)
    flow = [math.cos(math.radians(p.angle)), math.sin(math.radians(p.angle))]
    forth = [F.lit(f > 0) if abs(f) > 1e-9 else pair_hash(seed + 2) < 500 for f in flow]
    along = F.when(F.col("dir") == 0, forth[0]).otherwise(forth[1]) if "dir" in pairs.columns else forth[0]
    kind = {
        "acyclic": F.lit(1), "bidirectional": F.lit(3), "random": F.when(h < both, 3).when(h < one, one_way).otherwise(0),
        "gradient": F.when(h < both, 3).when((coin < round(1000 * p_against)) == along, 2).otherwise(1),
    }[mode]
    return _arcs(pairs, kind)


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def induced(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """The edges with both ends among passable ``cells``."""
    kept = cells.filter("passable").select("v")
    return edges.hint("merge").join(kept.withColumnRenamed("v", "src"), "src", "left_semi").hint("merge").join(kept.withColumnRenamed("v", "dst"), "dst", "left_semi").select("src", "dst")


def _axis(x: Column, size: int, tile: int) -> Column:
    """The tile along an axis; a last remainder of one cell belongs to the tile before."""
    n = max(1, -(-size // tile) - (size % tile == 1 and size > tile))
    return F.least(F.floor(x / tile), F.lit(n - 1))


def tiles_of(cells: DataFrame, width: int, height: int, tile: int) -> DataFrame:
    across = max(1, -(-width // tile) - (width % tile == 1 and width > tile))
    return cells.withColumn("tile", (_axis(F.col("y"), height, tile) * across + _axis(F.col("x"), width, tile)).cast("long"))


def ports_of(tiled: DataFrame) -> DataFrame:
    """Passable cells on their tile's edge, with the side: N before E before S before W at corners."""
    box = tiled.groupBy("tile").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    side = F.when(F.col("y") == F.col("y0"), "N").when(F.col("x") == F.col("x1"), "E").when(F.col("y") == F.col("y1"), "S").when(F.col("x") == F.col("x0"), "W")
    return tiled.filter("passable").hint("merge").join(box, "tile").select("v", "tile", side.alias("side")).filter("side IS NOT NULL")


def boundary(tiled: DataFrame) -> DataFrame:
    """(tile, v, side, place): the cells on each tile's edge, round it from its north-west corner; corners once.

    The north row goes from west to east, the east column south, the south row and the west column as
    rows and columns are numbered; place is 0, 1, ...
    """
    box = tiled.groupBy("tile").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    side = F.when(F.col("y") == F.col("y0"), 0).when(F.col("x") == F.col("x1"), 1).when(F.col("y") == F.col("y1"), 2).when(F.col("x") == F.col("x0"), 3)
    edge = tiled.hint("merge").join(box, "tile").select("tile", "v", "x", "y", side.alias("s")).filter("s IS NOT NULL")
    order = Window.partitionBy("tile").orderBy("s", F.when(F.col("s").isin(0, 2), F.col("x")).otherwise(F.col("y")))
    return edge.select("tile", "v", F.element_at(F.array(*map(F.lit, "NESW")), F.col("s") + 1).alias("side"), (F.row_number().over(order) - 1).alias("place"))


def port_index(tiled: DataFrame) -> DataFrame:
    """(port, tile, place, v): passable boundary cells, numbered by tile, then in the boundary's order; place counts a tile's ports.

    Numbers come from counts of ports of the tiles before, so no task holds all ports.
    """
    order = Window.partitionBy("tile").orderBy("__b")
    ports = boundary(tiled).select("tile", "v", F.col("place").alias("__b")).hint("merge").join(tiled.filter("passable").select("v"), "v", "left_semi")
    ports = ports.select("tile", "v", (F.row_number().over(order) - 1).alias("place"))
    counts = ports.groupBy("tile").agg(F.count("*").alias("n"))
    # A row a tile, in runs of tiles: a sum within each run and one over the runs.
    run = F.floor(F.col("tile") / 4096)
    runs = counts.groupBy(run.alias("r")).agg(F.sum("n").alias("m"))
    before = runs.select("r", F.coalesce(F.sum("m").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("a"))
    inner = counts.select("tile", run.alias("r"), F.coalesce(F.sum("n").over(Window.partitionBy(run).orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    first = inner.join(before, "r").select("tile", (F.col("a") + F.col("b")).alias("first"))
    return ports.hint("merge").join(first, "tile").select((F.col("first") + F.col("place")).alias("port"), "tile", "place", "v")


def seams_of(edges: DataFrame, tiled: DataFrame) -> DataFrame:
    """Edges that lead from a tile to another."""
    tile = tiled.select("v", "tile")
    ends = edges.hint("merge").join(tile.toDF("src", "a"), "src").hint("merge").join(tile.toDF("dst", "b"), "dst")
    return ends.filter("a <> b").select("src", "dst").distinct()
