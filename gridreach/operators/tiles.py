"""The tile index: closures inside tiles, the graph of their ports, and regions of regions above.

A path between two tiles leaves the first and enters the last by ports (passable cells on a tile's
edge), so closures inside tiles and a closure over ports answer every query. In the hierarchy a
region's ports are those of its children; its summary, which the next level uses, is the closure over
them at the cells on the region's own edge. A tile or region is closed in one task, by its connected
parts, each under the same cap as ``reach.closure``.

This holds for edges between neighbouring cells; any edge list between cells of a grid can be
given to ``flat_closure`` and ``flat_search`` if both ends of its seams are ports.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import cut_compact, few, written
from ..plans.shipping import ship
from . import grid, reach
from .components import near_components


#: Edges that are closed together, if their group isn't larger.
CHUNK = 1 << 16


def _closed_by(edges: DataFrame, group: str, memory_cap: int, part: str | None = None) -> DataFrame:
    """(group, src, dst): pairs of different cells with a path over the group's own edges.

    A cell belongs to one group. Small groups are closed together; with ``part``, a column of which
    connected cells have the same value, a group's parts may be different tasks'.
    """
    ship(edges.sparkSession)
    keys = [group] if part is None else [group, part]

    def closed(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(held)
        ids, first = np.unique(pdf["src"].to_numpy(), return_index=True)
        own = pdf[group].to_numpy()[first]
        for pairs in reach.closure_of(pdf, memory_cap):
            yield pairs.assign(**{group: own[np.searchsorted(ids, pairs["src"].to_numpy())]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in batches:
            if held and n >= CHUNK:
                last = (pdf[keys] == held[-1][keys].iloc[-1]).all(axis=1).to_numpy()
                more = len(pdf) if last.all() else int(np.argmin(last))
                held.append(pdf[:more])
                if more == len(pdf):
                    continue
                yield from closed(held)
                held, n, pdf = [], 0, pdf[more:]
            held.append(pdf)
            n += len(pdf)
        if held:
            yield from closed(held)

    dealt = edges.select("src", "dst", *keys).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(run, f"src long, dst long, {group} long")


def local_closure(edges: DataFrame, tiled: DataFrame, memory_cap: int = reach.MEMORY_CAP) -> DataFrame:
    """(tile, src, dst): the reflexive closure of each tile's own edges, over its passable cells."""
    tile = tiled.filter("passable").select("v", "tile")
    inside = edges.hint("merge").join(tile.toDF("src", "tile"), "src").hint("merge").join(tile.toDF("dst", "__t"), "dst").filter("tile = __t")
    pairs = _closed_by(inside.filter("src <> dst"), "tile", memory_cap).select("tile", "src", "dst")
    return pairs.union(tile.select("tile", F.col("v").alias("src"), F.col("v").alias("dst")))


def port_graph(local: DataFrame, ports: DataFrame, seams: DataFrame) -> DataFrame:
    """(src, dst, seam): arcs inside tiles between different ports, and the seams between tiles."""
    port = ports.select("v").distinct()
    ends = lambda df: df.hint("merge").join(port.toDF("src"), "src", "left_semi").hint("merge").join(port.toDF("dst"), "dst", "left_semi")
    inner = ends(local.filter("src <> dst")).select("src", "dst", F.lit(False).alias("seam"))
    return inner.union(ends(seams).select("src", "dst", F.lit(True).alias("seam")))


def _answered(pairs: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, source, target, reachable), given the qids that hit; a cell off the grid reaches only itself."""
    found = hits.select("qid").distinct().withColumn("hit", F.lit(True))
    same = F.col("source") == F.col("target")
    return pairs.join(found, "qid", "left").select("qid", "source", "target", (same | F.coalesce("hit", F.lit(False))).alias("reachable"))


def _entries(pairs: DataFrame, local: DataFrame, ports: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries that hit inside a tile; (qid, p) ports that the source reaches there; (qid, q) ports that reach the target."""
    port, pairs = ports.select("v").distinct(), few(pairs.select("qid", "source", "target"))
    hits = pairs.join(local.select(F.col("src").alias("source"), F.col("dst").alias("target")), ["source", "target"]).select("qid")
    out = local.select(F.col("src").alias("source"), F.col("dst").alias("p")).hint("merge").join(port.toDF("p"), "p", "left_semi")
    into = local.select(F.col("dst").alias("target"), F.col("src").alias("q")).hint("merge").join(port.toDF("q"), "q", "left_semi")
    return hits, few(pairs.join(out, "source").select("qid", "p")), few(pairs.join(into, "target").select("qid", "q"))


def flat_search(pairs: DataFrame, local: DataFrame, ports: DataFrame, graph: DataFrame) -> DataFrame:
    """Pairs by a search on the port graph from the ports that the sources reach inside their tiles."""
    hits, up, down = _entries(pairs, local, ports)
    found = reach.reached(graph.select("src", "dst"), up.select(F.col("p").alias("seed")))
    return _answered(pairs, hits.union(_met(up, found.select(F.col("seed").alias("p"), F.col("v").alias("q")), down)))


def flat_closure(pairs: DataFrame, local: DataFrame, ports: DataFrame, graph: DataFrame) -> DataFrame:
    """Pairs by the closure of the port graph."""
    hits, up, down = _entries(pairs, local, ports)
    closed = reach.reflexive(reach.closure(graph.select("src", "dst").distinct()), ports.select("v").distinct())
    return _answered(pairs, hits.union(_met(up, closed.toDF("p", "q"), down)))


def _met(up: DataFrame, closed: DataFrame, down: DataFrame) -> DataFrame:
    """Queries with p in ``up``, q in ``down`` and (p, q) in ``closed``."""
    return up.join(closed, "p").select("qid", "q").distinct().join(down, ["qid", "q"], "left_semi").select("qid")


@dataclass(frozen=True)
class Level:
    """A level of the hierarchy: cells' regions (v, region), the closure over ports (region, src, dst), exterior ports (v, region)."""

    cells: DataFrame
    closed: DataFrame
    exterior: DataFrame


def _exterior(cells: DataFrame, ports: DataFrame) -> DataFrame:
    """The ports on their region's edge; ``cells``: x, y, region of all cells, ``ports``: x, y, region and more."""
    box = cells.groupBy("region").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    on_edge = F.col("x").isin(F.col("x0"), F.col("x1")) | F.col("y").isin(F.col("y0"), F.col("y1"))
    return ports.hint("merge").join(box, "region").filter(on_edge).select(*ports.columns)


def _sizes(wide: int, high: int, group: tuple[int, int], max_depth: int) -> Iterator[tuple[int, int, int, int]]:
    """Of each level from the tiles up: regions in a row and in a column, and how many tiles a region is wide and high."""
    gw, gh = group
    if gw < 1 or gh < 1:
        raise ValueError("a group has a region at least each way")
    w = h = depth = 1
    yield wide, high, w, h
    while wide * high > 1 and depth < max_depth and (-(-wide // gw), -(-high // gh)) != (wide, high):
        wide, high, w, h, depth = -(-wide // gw), -(-high // gh), w * gw, h * gh, depth + 1
        yield wide, high, w, h


def _region(i: str, j: str, size: tuple[int, int, int, int]) -> Column:
    """The number of the region that tile (i, j) belongs to."""
    wide, _, w, h = size
    return F.expr(f"CAST(({j} DIV {h}) * {wide} + {i} DIV {w} AS BIGINT)")


def hierarchy(edges: DataFrame, tiled: DataFrame, across: int, group: tuple[int, int] = (2, 2), max_depth: int = 64, memory_cap: int = reach.MEMORY_CAP) -> list[Level]:
    """Levels above the tiles, up to one region, ``max_depth`` levels (tiles included) or no shrinking.

    ``across``: tiles in a row. Groups are ``group`` regions wide and high. A level's closure runs
    over its children's summaries and the seams between them, so its size follows ports, not cells.
    Seams are placed once; a region's number gives its parent's, so no level looks up its cells.
    """
    next(_sizes(1, 1, group, max_depth))
    cells = written(tiled.select("v", "x", "y", "passable", "tile", (F.col("tile") % across).alias("i"), F.floor(F.col("tile") / across).alias("j")))
    most = cells.agg(F.max("i"), F.max("j")).first()
    sizes = list(_sizes((most[0] or 0) + 1, (most[1] or 0) + 1, group, max_depth))
    local = written(local_closure(edges, tiled, memory_cap))
    place = cells.select("v", "i", "j")
    between = edges.select("src", "dst").hint("merge").join(place.toDF("src", "si", "sj"), "src").hint("merge").join(place.toDF("dst", "di", "dj"), "dst")
    seams = written(between.filter("si <> di OR sj <> dj"))
    on = lambda size: (cells.withColumn("region", _region("i", "j", size)))
    ports = cells.filter("passable")
    levels: list[Level] = []
    for k, size in enumerate(sizes):
        region = _region("i", "j", size)
        if k:
            below = sizes[k - 1]
            apart, together = _region("si", "sj", below) != _region("di", "dj", below), _region("si", "sj", size) == _region("di", "dj", size)
            inner = seams.filter(apart & together).select(_region("si", "sj", size).alias("region"), "src", "dst")
            parent = F.expr(f"CAST((region DIV {below[0]} DIV {group[1]}) * {size[0]} + (region % {below[0]}) DIV {group[0]} AS BIGINT)")
            pairs = _closed_by(summary(levels[-1]).select(parent.alias("region"), "src", "dst").union(inner), "region", memory_cap).select("region", "src", "dst")
            closed = written(pairs.union(ports.select(region.alias("region"), F.col("v").alias("src"), F.col("v").alias("dst"))))
        else:
            closed = local.select(F.col("tile").alias("region"), "src", "dst")
        ports = written(_exterior(on(size).select("x", "y", "region"), ports.select("v", "x", "y", "i", "j", region.alias("region"))))
        levels.append(Level(on(size).select("v", "region"), closed, ports.select("v", "region")))
    return levels


def tree(tiled: DataFrame, across: int, group: tuple[int, int] = (2, 2), max_depth: int = 64) -> DataFrame:
    """(level, region, parent) as ``region_tree`` of ``hierarchy``; places of tiles alone decide it, so nothing is closed."""
    places = written(tiled.select((F.col("tile") % across).alias("i"), F.floor(F.col("tile") / across).alias("j")).distinct())
    most = places.agg(F.max("i"), F.max("j")).first()
    sizes = list(_sizes((most[0] or 0) + 1, (most[1] or 0) + 1, group, max_depth))
    own = [F.struct(F.lit(k).alias("level"), _region("i", "j", size).alias("region"), (_region("i", "j", sizes[k + 1]) if k + 1 < len(sizes) else F.lit(None).cast("long")).alias("parent")) for k, size in enumerate(sizes)]
    return places.select(F.explode(F.array(*own)).alias("r")).select("r.level", "r.region", "r.parent").distinct()


def summary(level: Level) -> DataFrame:
    """(region, src, dst): what a level hands up, its closure between different exterior ports."""
    edge = level.exterior.select("v")
    return level.closed.filter("src <> dst").hint("merge").join(edge.toDF("src"), "src", "left_semi").hint("merge").join(edge.toDF("dst"), "dst", "left_semi").select("region", "src", "dst")


def hierarchical(pairs: DataFrame, levels: list[Level], flat: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """Pairs by the hierarchy: at each level whose region holds both ends, a path over that region's ports.

    Exact with a single region on top. With fewer levels, pairs without a hit are open: they are asked of
    ``flat_search`` over ``flat`` (closures inside tiles, ports, port graph), or null without it.
    """
    up = few(pairs.select("qid", F.col("source").alias("p")))
    down = few(pairs.select("qid", F.col("target").alias("q")))
    hits = None
    for level in levels:
        closed = level.closed.select(F.col("src").alias("p"), F.col("dst").alias("q"))
        here = _met(up, closed, down)
        hits = here if hits is None else hits.union(here)
        edge = level.exterior.select("v")
        up = few(up.join(closed, "p").select("qid", F.col("q").alias("p")).hint("merge").join(edge.toDF("p"), "p", "left_semi").distinct())
        down = few(down.join(closed, "q").select("qid", F.col("p").alias("q")).hint("merge").join(edge.toDF("q"), "q", "left_semi").distinct())
    known = _answered(pairs, hits)
    if levels[-1].cells.select("region").distinct().limit(2).count() < 2:
        return known
    known = cut_compact(known)
    sure, left = known.filter("reachable"), known.filter("NOT reachable").select("qid", "source", "target")
    rest = left.withColumn("reachable", F.lit(None).cast("boolean")) if flat is None else flat_search(left, *flat)
    return sure.union(rest)


def region_tree(levels: list[Level]) -> DataFrame:
    """(level, region, parent): the hierarchy's regions from the tiles (level 0) up; the top's parent is null."""
    out = None
    for k, level in enumerate(levels):
        own = level.cells.select("v", "region").distinct()
        if k + 1 < len(levels):
            up = own.join(levels[k + 1].cells.select("v", F.col("region").alias("parent")), "v").select("region", "parent").distinct()
        else:
            up = own.select("region", F.lit(None).cast("long").alias("parent")).distinct()
        part = up.select(F.lit(k).alias("level"), "region", "parent")
        out = part if out is None else out.union(part)
    return out


def level_statistics(levels: list[Level]) -> DataFrame:
    """(level, regions, ports, pairs, bytes): regions of a level, ports on their edges, pairs of their closures, and what these take as bit rows over each region's cells."""
    out = None
    for k, level in enumerate(levels):
        regions = level.cells.agg(F.count_distinct("region").alias("regions"))
        ports = level.exterior.agg(F.count("*").alias("ports"))
        size = F.count_distinct("src")
        closed = level.closed.groupBy("region").agg(F.count("*").alias("pairs"), (size * F.ceil(size / 64) * 8).alias("bytes")).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
        part = regions.crossJoin(ports).crossJoin(closed).select(F.lit(k).alias("level"), "*")  # one row each
        out = part if out is None else out.union(part)
    return out


def differences(level: Level, edges: DataFrame) -> DataFrame:
    """(region, src, dst): pairs of exterior ports on which a level's summary and the closure of its regions' own cells differ; none if it is right."""
    tiled = level.cells.select("v", F.col("region").alias("tile"), F.lit(True).alias("passable"))
    edge = level.exterior.select("v")
    both = local_closure(edges, tiled).filter("src <> dst").join(edge.toDF("src"), "src", "left_semi").join(edge.toDF("dst"), "dst", "left_semi").select(F.col("tile").alias("region"), "src", "dst")
    mine = summary(level)
    return mine.exceptAll(both).union(both.exceptAll(mine))


def flat_summary(level: Level, graph: DataFrame, memory_cap: int = reach.MEMORY_CAP) -> DataFrame:
    """(region, src, dst): a level's summary cut from the flat port graph (src, dst), without the levels below: the closure of each region's own arcs at its exterior ports.

    ``graph`` may have a column ``part``, the same for connected ports: then a region's parts are closed apart.
    """
    part = "part" if "part" in graph.columns else None
    keys = ["src", "dst"] if part is None else ["src", "dst", part]
    region = level.cells.toDF("src", "region")
    inside = graph.select(*keys).hint("merge").join(region, "src").hint("merge").join(level.cells.toDF("dst", "__r"), "dst").filter("region = __r AND src <> dst")
    closed = _closed_by(inside.select(*keys, "region"), "region", memory_cap, part)
    edge = level.exterior.select("v")
    return closed.hint("merge").join(edge.toDF("src"), "src", "left_semi").hint("merge").join(edge.toDF("dst"), "dst", "left_semi").select("region", "src", "dst")


def composition_check(levels: list[Level], graph: DataFrame) -> DataFrame:
    """(level, composed, flat, differences): how many pairs each level hands up, how many the flat port graph has there, and how many are in one of them only."""
    out = None
    parts = near_components(graph).toDF("src", "part")
    graph = written(graph.select("src", "dst").hint("merge").join(parts, "src"))
    for k, level in enumerate(levels):
        mark = lambda df, c: df.select("region", "src", "dst", F.lit(1 - c).alias("composed"), F.lit(c).alias("flat"))
        both = mark(summary(level), 0).union(mark(flat_summary(level, graph), 1)).groupBy("region", "src", "dst").agg(F.sum("composed").alias("composed"), F.sum("flat").alias("flat"))
        sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in ((F.col("composed"), "composed"), (F.col("flat"), "flat"), (F.abs(F.col("composed") - F.col("flat")), "differences"))]
        part = written(both.agg(*sums).select(F.lit(k).alias("level"), "*"))  # level by level: the driver never holds all their plans
        out = part if out is None else out.union(part)
    return out


class Ledger:
    """Bytes charged against a cap; ``cap`` None: no limit."""

    def __init__(self, cap: int | None = None):
        self.cap, self.charged = cap, 0

    def charge(self, n: int) -> bool:
        """Charge ``n`` bytes; false, and nothing charged, where they don't fit."""
        if self.cap is not None and self.charged + n > self.cap:
            return False
        self.charged += n
        return True

    def release(self, n: int) -> None:
        if n > self.charged:
            raise ValueError("more released than charged")
        self.charged -= n


@dataclass(frozen=True)
class Index:
    """A built tile index: what ``flat_search`` and ``flat_closure`` take, and the levels of ``hierarchical`` (none without)."""

    local: DataFrame
    ports: DataFrame
    graph: DataFrame
    levels: list[Level]
    ledger: Ledger


def build(edges: DataFrame, tiled: DataFrame, width: int, tile: int, group: tuple[int, int] | None = (2, 2), max_depth: int = 64, memory_cap: int | None = None) -> Index:
    """Build the index, each part written out. The cap is held against the bit rows of all tiles' closures, before they are made; ``SkippedByPolicy`` if they don't fit."""
    ledger = Ledger(memory_cap)
    sizes = tiled.filter("passable").groupBy("tile").agg(F.count("*").alias("n"))
    if not ledger.charge(sizes.agg(F.sum(F.col("n") * F.ceil(F.col("n") / 64) * 8)).first()[0] or 0):
        raise reach.SkippedByPolicy(f"the tiles' closures need more than {memory_cap} bytes")
    ports, local = cut_compact(grid.ports_of(tiled)), cut_compact(local_closure(edges, tiled), 200_000)
    graph = cut_compact(port_graph(local, ports, grid.seams_of(edges, tiled)), 200_000)
    levels = hierarchy(edges, tiled, tiles_across(width, tile), group, max_depth) if group else []
    return Index(local, ports, graph, levels, ledger)


def tiles_across(size: int, tile: int) -> int:
    """Tiles along an axis; a last remainder of one cell belongs to the tile before."""
    if tile < 2 or size < 2:
        raise ValueError("tiles and maps are 2 cells wide and high at least")
    return max(1, -(-size // tile) - (size % tile == 1 and size > tile))
