"""Mazes and synthetic graphs, each row computed from its own number by a hash: no task waits for another.

Coins are ``coin``: the same integer arithmetic in any engine. Sizes below 1 give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..plans.checkpoints import written
from .components import connected_components
from .grid import PRIME, adjacent_pairs, mixed


def coin(a: Column, b: Column, seed: int) -> Column:
    """A number from 0 to 999 for two numbers."""
    return mixed((a % PRIME) * 7919 + (b % PRIME) * 104729, seed) % 1000


# Mazes ---------------------------------------------------------------------------------------


def perfect_maze(spark: SparkSession, width: int, height: int, seed: int = 0) -> DataFrame:
    """(v, x, y, passable) of a maze of ``width`` by ``height`` rooms in (2 width + 1) by (2 height + 1) cells.

    Rooms lie at odd places. Each room but the first opens one wall, to the west or to the north, by
    a coin where both are there; so exactly one path joins any two rooms.
    """
    across, down = 2 * width + 1, 2 * height + 1
    if width < 1 or height < 1:
        return spark.createDataFrame([], "v long, x long, y long, passable boolean")
    cells = spark.range(across * down).select(F.col("id").alias("v"), (F.col("id") % across).alias("x"), F.floor(F.col("id") / across).alias("y"))
    x, y = F.col("x"), F.col("y")
    inner = x.between(1, across - 2) & y.between(1, down - 2)
    room = (x % 2 == 1) & (y % 2 == 1)

    def west(i: Column, j: Column) -> Column:
        """Whether room (i, j) opens its west wall: not in the first column, and by a coin off the first row."""
        return (i > 0) & ((j == 0) | (coin(i, j, seed) < 500))

    # The wall west of room ((x) / 2, (y - 1) / 2), and the one north of ((x - 1) / 2, y / 2).
    i, j = F.floor(x / 2), F.floor(y / 2)
    beside = (x % 2 == 0) & (y % 2 == 1) & west(i, j)
    above = (x % 2 == 1) & (y % 2 == 0) & ~west(i, j) & (j > 0)
    return cells.select("v", "x", "y", (inner & (room | beside | above)).alias("passable"))


def open_walls(cells: DataFrame, extra: int, seed: int = 0) -> DataFrame:
    """A maze with ``extra`` further openings, or as many as there are: closed walls between two rooms, by a hash of their place."""
    box = cells.agg(F.max("x").alias("x1"), F.max("y").alias("y1"))
    between = (F.col("x") % 2) + (F.col("y") % 2) == 1
    walls = cells.join(F.broadcast(box), (F.col("x") > 0) & (F.col("x") < F.col("x1")) & (F.col("y") > 0) & (F.col("y") < F.col("y1")))  # one row
    chosen = walls.filter(~F.col("passable") & between).orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(max(0, extra)).select("v", F.lit(True).alias("__open"))
    return cells.join(chosen, "v", "left").select("v", "x", "y", (F.col("passable") | F.coalesce("__open", F.lit(False))).alias("passable"))


def spanning_maze(rooms: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """(x, y): the open cells of a maze over given rooms (v, x, y; ``width`` a row), joined by a minimum spanning forest of hashed walls.

    Room (x, y) is cell (2 x + 1, 2 y + 1), and an opened wall the cell between two rooms. Every round,
    each connected set of rooms opens its lightest wall to another set, so the sets halve at least and
    no task holds a set; weights are different by the walls' ends, so a round opens no circle. Any two
    connected rooms have exactly one path, and no row or column is treated apart.
    """
    cells = written(rooms.select("v", "x", "y"))
    weight = F.struct(F.xxhash64("a", "b", F.lit(seed)).alias("h"), "a", "b")
    walls = written(adjacent_pairs(cells.withColumn("passable", F.lit(True)), width).select("a", "b", weight.alias("weight")))
    sets, opened = cells.select("v", F.col("v").alias("s")), None
    while True:
        seen = Observation()
        ends = walls.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").filter("sa <> sb").select("sa", "sb", "weight")
        both = ends.union(ends.select("sb", "sa", "weight"))
        lightest = both.groupBy("sa").agg(F.min(F.struct("weight", "sb")).alias("m")).select("sa", "m.sb", "m.weight")
        lightest = written(lightest.observe(seen, F.count(F.lit(1)).alias("n")))
        if not seen.get["n"]:
            break
        chosen = lightest.select("weight.a", "weight.b").distinct()
        opened = chosen if opened is None else opened.union(chosen)
        joined = connected_components(lightest, "sa", "sb").toDF("s", "joined")
        sets = written(sets.join(joined, "s", "left").select("v", F.coalesce("joined", "s").alias("s")))
    out = cells.select((F.col("x") * 2 + 1).alias("x"), (F.col("y") * 2 + 1).alias("y"))
    if opened is None:
        return out
    a, b = cells.toDF("a", "xa", "ya"), cells.toDF("b", "xb", "yb")
    return out.union(opened.join(a, "a").join(b, "b").select((F.col("xa") + F.col("xb") + 1).alias("x"), (F.col("ya") + F.col("yb") + 1).alias("y")))


# Graphs --------------------------------------------------------------------------------------


def _edges(rows: DataFrame, src: Column, dst: Column) -> DataFrame:
    return rows.select(src.cast("long").alias("src"), dst.cast("long").alias("dst"))


def _all_pairs(spark: SparkSession, n: int) -> DataFrame:
    """(a, b) for all ordered pairs of different vertices: n * (n - 1) rows, as the graph's definition has them."""
    rows = spark.range(max(0, n) * max(0, n - 1))
    a, k = F.floor(F.col("id") / max(1, n - 1)), F.col("id") % max(1, n - 1)
    return rows.select(a.alias("a"), (k + (k >= a).cast("long")).alias("b"))


def random_graph(spark: SparkSession, n: int, p: float, seed: int = 0) -> DataFrame:
    """Each arc between different vertices with probability ``p``."""
    return _edges(_all_pairs(spark, n).filter(coin(F.col("a"), F.col("b"), seed) < round(1000 * p)), F.col("a"), F.col("b"))


def separate_random_graphs(spark: SparkSession, n: int, parts: int, p: float, seed: int = 0) -> DataFrame:
    """As ``random_graph``, in ``parts`` runs of vertices whose sizes differ by one at most, without arcs between them."""
    parts = max(1, parts)
    small, more = n // parts, n % parts
    out = None
    for k in range(min(parts, max(n, 1))):
        first, size = k * small + min(k, more), small + (k < more)
        part = _edges(random_graph(spark, size, p, seed + k), F.col("src") + first, F.col("dst") + first)
        out = part if out is None else out.union(part)
    return out


def chain(spark: SparkSession, n: int) -> DataFrame:
    return _edges(spark.range(max(0, n - 1)), F.col("id"), F.col("id") + 1)


def cycle(spark: SparkSession, n: int) -> DataFrame:
    """With one vertex, a loop."""
    return _edges(spark.range(max(0, n)), F.col("id"), (F.col("id") + 1) % max(1, n))


#: Targets that the rows of a complete graph go through before the source changes, 2 ** 10, and the places that a task goes through.
STRIP_BITS, TASK_ROWS = 10, 1 << 26


def complete(spark: SparkSession, n: int) -> DataFrame:
    """All arcs, in strips of 1024 targets: neighbouring rows have few different ends, so files take far less than the numbers themselves.

    The last strip is as wide as the others, with places left empty: so an arc's ends are shifts and
    divisions by constants, which cost far less than by numbers that change. A task goes through
    ``TASK_ROWS`` places at most, whatever the size, so that there are always tasks to share out.
    """
    n, strip = max(0, n), 1 << STRIP_BITS
    places = n * -(-n // strip) * strip
    rows = spark.range(0, places, 1, max(spark.sparkContext.defaultParallelism, -(-places // TASK_ROWS)))
    a, t = f"shiftright(id, {STRIP_BITS}) % {max(1, n)}", f"id DIV {max(1, n * strip)}"
    arcs = rows.select(F.expr(a).alias("a"), F.expr(f"({t}) * {strip} + (id & {strip - 1})").alias("b"))
    return _edges(arcs.filter(f"a <> b AND b < {n}"), F.col("a"), F.col("b"))


def star(spark: SparkSession, n: int, outward: bool = True) -> DataFrame:
    """Arcs between vertex 0 and all others, from it or to it."""
    rows, hub = spark.range(1, max(1, n)), F.lit(0)
    return _edges(rows, hub, F.col("id")) if outward else _edges(rows, F.col("id"), hub)


def bipartite(spark: SparkSession, n: int, p: float, seed: int = 0) -> DataFrame:
    """Arcs from the first half of the vertices to the others, each with probability ``p``."""
    left = n // 2
    right = n - left
    rows = spark.range(max(0, left * right)).select(F.floor(F.col("id") / max(1, right)).alias("a"), (F.col("id") % max(1, right) + left).alias("b"))
    return _edges(rows.filter(coin(F.col("a"), F.col("b"), seed) < round(1000 * p)), F.col("a"), F.col("b"))


def walled_grid(spark: SparkSession, width: int, height: int, p_wall: float = 0.0, seed: int = 0) -> DataFrame:
    """(v, x, y, passable): a grid whose cells are walls with probability ``p_wall``; orient it with ``grid.orient``."""
    rows = spark.range(max(0, width) * max(0, height)).select(F.col("id").alias("v"), (F.col("id") % max(1, width)).alias("x"), F.floor(F.col("id") / max(1, width)).alias("y"))
    return rows.withColumn("passable", coin(F.col("x"), F.col("y"), seed) >= round(1000 * p_wall))
