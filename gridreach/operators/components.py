"""Connected components of an undirected graph by alternating star contractions.

Every round points vertices at smaller neighbours; a forest of stars is left after a
logarithmic number of rounds in practice. Minima are combined before each shuffle and a
vertex's neighbours are never gathered, so a hub costs no more than its edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.checkpoints import cut_compact, written
from ..plans.shipping import ship

#: Vertices of a range of ids, where these are dense; where ids are more than ``SPARSE`` times as many as edges, ranges tell nothing.
RANGE, SPARSE = 1 << 14, 64
#: Edges of a range that are held before they are replaced by a forest, and of a rest that one task connects.
HELD = 1 << 20
REST = 1 << 16


def _signature(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(v, component): each vertex that has an edge to another, and the smallest vertex that it reaches.

    Null ends and loops are ignored; repeated edges count once; no edges give no rows.
    """
    u, v = F.greatest(src, dst).cast("long"), F.least(src, dst).cast("long")
    both = F.col(src).isNotNull() & F.col(dst).isNotNull()
    stars = cut_compact(edges.filter(both & (F.col(src) != F.col(dst))).select(u.alias("u"), v.alias("v")).distinct())
    now = _signature(stars)
    while now[0]:
        around = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.filter("v > u").hint("merge").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.hint("merge").join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        stars = cut_compact(small.select("e.u", "e.v").filter("u != v").distinct())
        before, now = now, _signature(stars)
        if now == before:
            break
    return stars.select(F.col("u").alias("v"), F.col("v").alias("component")).union(stars.select("v", F.col("v").alias("component")).distinct())


def ranged(edges: DataFrame, src: str, dst: str, size: int = RANGE) -> tuple[DataFrame, int, Callable[[str], Column] | None]:
    """The edges written out, how many they are, and the range of ids that a vertex is in; none where ids are too sparse for ranges."""
    seen = Observation()
    edges = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.min(F.least(src, dst)).alias("low"), F.max(F.greatest(src, dst)).alias("high")))
    n, low, high = seen.get["n"] or 0, seen.get["low"] or 0, seen.get["high"] or 0
    if high - low + 1 > SPARSE * n:
        return edges, n, None
    width = size * max(1, (high - low + 1) // (2 * n))
    return edges, n, lambda v: F.expr(f"({v} - ({low})) DIV {width}L")


def _weak(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The smallest vertex of each vertex's weakly connected part."""
    up = list(range(n))
    for a, b in zip(src.tolist(), dst.tolist(), strict=True):
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a != b:
            up[max(a, b)] = min(a, b)
    for v in range(n):  # what is above is smaller, so it's settled
        up[v] = up[up[v]]
    return np.array(up, dtype=np.int64)


def _forest(held: list[pd.DataFrame]) -> pd.DataFrame:
    """(block, u, v): each vertex of these edges of a block beside the smallest one of its part, itself if it is the smallest."""
    pdf = pd.concat(held)
    ids, places = np.unique(np.concatenate([pdf["u"].to_numpy(), pdf["v"].to_numpy()]), return_inverse=True)
    return pd.DataFrame({"block": pdf["block"].iloc[0], "u": ids, "v": ids[_weak(places[: len(pdf)], places[len(pdf) :], len(ids))]})


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``_forest`` of each block of rows (block, u, v) that come block by block; at most ``HELD`` edges and a forest are held."""
    held, fresh, now = [], 0, None
    for pdf in batches:
        for block, part in pdf.groupby("block", sort=False):
            if held and block != now:
                yield _forest(held)
                held, fresh = [], 0
            now, fresh = block, fresh + len(part)
            held.append(part)
            if fresh > HELD:
                held, fresh = [_forest(held)], 0
    if held:
        yield _forest(held)


def _joined(pairs: DataFrame, n: int, rest: int) -> DataFrame:
    """(v, component) of ``n`` distinct pairs (u, v), at most ``rest`` in one task."""
    if n > rest:
        return connected_components(pairs, "u", "v")
    one = pairs.select(F.lit(0).cast("long").alias("block"), "u", "v").coalesce(1).mapInPandas(_forests, "block long, u long, v long")
    return one.select(F.col("u").alias("v"), F.col("v").alias("component"))


def near_components(edges: DataFrame, src: str = "src", dst: str = "dst", size: int = RANGE, rest: int = REST) -> DataFrame:
    """(v, component) as by ``connected_components``, for graphs whose edges mostly join ids near each other.

    Ranges of ids are connected first, each in a task; contractions then see what is between ranges
    alone, so their rounds follow ranges, not hops, and are over tables of that size. At most ``rest``
    edges are one task's, whatever the graph.
    """
    ship(edges.sparkSession)
    both = F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))
    pairs = edges.filter(both).select(F.greatest(src, dst).cast("long").alias("u"), F.least(src, dst).cast("long").alias("v")).distinct()
    pairs, n, of = ranged(pairs, "u", "v", size)
    if n <= rest or of is None:
        return _joined(pairs, n, rest)
    placed = pairs.select(of("u").alias("block"), of("v").alias("b"), "u", "v")
    inner = placed.filter("block = b").select("block", "u", "v").repartition("block").sortWithinPartitions("block")
    labels = written(inner.mapInPandas(_forests, "block long, u long, v long").select(F.col("u").alias("v"), F.col("v").alias("label")))
    between = placed.filter("block <> b").select("u", "v")
    named = between.hint("merge").join(labels.toDF("u", "a"), "u", "left").hint("merge").join(labels.toDF("v", "b"), "v", "left")
    seen = Observation()
    left = written(named.select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v")).distinct().observe(seen, F.count(F.lit(1)).alias("n")))
    joined = written(_joined(left, seen.get["n"] or 0, rest).toDF("label", "component"))
    inside = labels.hint("merge").join(joined, "label", "left").select("v", F.coalesce("component", "label").alias("component"))
    apart = joined.hint("merge").join(labels.select(F.col("v").alias("label")), "label", "left_anti")  # without an edge in their range
    return inside.union(apart.select(F.col("label").alias("v"), "component"))


def with_isolated(labels: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, component) of all ``vertices`` (v): one without an edge is a component of its own."""
    return vertices.select("v").hint("merge").join(labels, "v", "left").select("v", F.coalesce("component", "v").alias("component"))


def dense_labels(labels: DataFrame) -> DataFrame:
    """(v, component, label): components numbered 0, 1, ... by their smallest vertex, without gaps.

    Numbers come from counts of components before, by runs of ids, so no task holds all components.
    """
    run = F.floor(F.col("component") / 65536)
    comps = labels.select("component").distinct().withColumn("r", run)
    counts = comps.groupBy("r").agg(F.count("*").alias("n"))
    before = counts.select("r", F.coalesce(F.sum("n").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("a"))
    numbered = comps.select("component", "r", (F.row_number().over(Window.partitionBy("r").orderBy("component")) - 1).alias("b")).join(before, "r")
    return labels.hint("merge").join(numbered.select("component", (F.col("a") + F.col("b")).alias("label")), "component").select("v", "component", "label")


def members(labels: DataFrame, asked: DataFrame) -> DataFrame:
    """(probe, v): for each asked vertex (v), all vertices of its component."""
    mine = asked.select(F.col("v").alias("probe")).distinct().hint("merge").join(labels.select(F.col("v").alias("probe"), "component"), "probe")
    return mine.hint("merge").join(labels.select("component", "v"), "component").select("probe", "v")


def component_of(labels: DataFrame, asked: DataFrame, otherwise: int = 0) -> DataFrame:
    """(v, component); a vertex without a label has the component ``otherwise``."""
    return asked.select("v").hint("merge").join(labels.select("v", "component"), "v", "left").select("v", F.coalesce("component", F.lit(otherwise)).alias("component"))


def size_histogram(labels: DataFrame, passable: DataFrame) -> DataFrame:
    """(component, size) of the components with passable vertices (v), which alone count; the largest first."""
    sizes = labels.hint("merge").join(passable.select("v"), "v", "left_semi").groupBy("component").agg(F.count("*").alias("size"))
    return sizes.orderBy(F.desc("size"), F.desc("component"))
