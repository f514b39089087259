"""Reachability: searches, closures, labels and components, and answers by each of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.checkpoints import FEW, cut_compact, few, written
from ..plans.shipping import ship
from . import blocks
from .components import RANGE, _weak, near_components, ranged

#: A part's closure as bit rows may take so many bytes in a task.
MEMORY_CAP = 512 << 20
#: Edges of a weakly connected part that a task may hold, with their lists some 0.5 GB at most.
TASK_EDGES = 2_000_000
#: Pairs of a closure that leave a task at once.
BATCH = 1 << 20
#: Hops that are joins, before the arcs are packed.
HOPS = 3


class SkippedByPolicy(RuntimeError):
    """A part is too large for a closure; use ``frontier``."""


def frontier(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, v, depth): what each seed reaches, itself included, and in how many hops at least.

    The first ``HOPS`` hops are joins of what is new with the arcs, which are read once and neither made
    distinct nor packed: a search that ends there sorts and spills, and holds no block. What is still
    new then goes on by blocks, with a round for each block that a path crosses, not for each hop.
    """
    arcs = written(edges.select(F.col("src").cast("long").alias("v"), F.col("dst").cast("long").alias("dst")).filter("v <> dst"))
    found, sent = None, 0
    for depth in range(HOPS + 1):
        seen = Observation()
        if not depth:
            fresh = seeds.select(F.col("seed").cast("long").alias("seed")).filter("seed IS NOT NULL").distinct().withColumn("v", F.col("seed"))
        else:
            ends = arcs.join(new.hint("broadcast" if sent <= FEW else "merge"), "v").select("seed", F.col("dst").alias("v")).distinct()
            fresh = ends.hint("merge").join(found, ["seed", "v"], "left_anti")
        new = written(fresh.select("seed", "v", F.lit(depth).alias("depth")).observe(seen, F.count(F.lit(1)).alias("n")))
        found, sent = new if found is None else found.union(new), seen.get["n"] or 0
        if not sent:
            return found
    more = blocks.distances(blocks.build(arcs.withColumnRenamed("v", "src")), new.select("seed").distinct(), starts=new)
    return found.union(more).groupBy("seed", "v").agg(F.min("depth").alias("depth"))


def _strong(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[list[int], list[list[int]]]:
    """Strong component of each vertex, numbered so that arcs lead to lower numbers, and successors."""
    after: list[list[int]] = [[] for _ in range(n)]
    for a, b in zip(src.tolist(), dst.tolist(), strict=True):
        after[a].append(b)
    index, low, comp, stack, count, clock = [-1] * n, [0] * n, [-1] * n, [], 0, 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, 0)]
        while work:
            v, i = work.pop()
            if i == 0:
                index[v] = low[v] = clock
                clock += 1
                stack.append(v)
            for j in range(i, len(after[v])):
                w = after[v][j]
                if index[w] < 0:
                    work += [(v, j + 1), (w, 0)]
                    break
                if comp[w] < 0:
                    low[v] = min(low[v], index[w])
            else:
                if low[v] == index[v]:
                    while True:
                        w = stack.pop()
                        comp[w] = count
                        if w == v:
                            break
                    count += 1
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
    return comp, after


def _by_part(edges: DataFrame, run: Callable, schema: str, parts: DataFrame | None = None) -> DataFrame:
    """``run`` on each weakly connected part's edges, every part in a task of its own."""
    ship(edges.sparkSession)
    parts = (parts or near_components(edges)).select(F.col("v").alias("src"), "component")
    return edges.filter("src <> dst").hint("merge").join(parts, "src").groupBy("component").applyInPandas(run, schema)


def _local(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, places = np.unique(np.concatenate([pdf["src"].to_numpy(), pdf["dst"].to_numpy()]), return_inverse=True)
    return ids, places[: len(pdf)], places[len(pdf) :]


def _large_parts(arcs: DataFrame, parts: DataFrame, task_edges: int) -> DataFrame:
    """(component, count): the parts with more than ``task_edges`` arcs."""
    if arcs.count() <= task_edges:
        return parts.select("component", F.lit(0).alias("count")).filter("false")
    sizes = arcs.hint("merge").join(parts.toDF("src", "component"), "src").groupBy("component").count()
    return cut_compact(sizes.filter(F.col("count") > task_edges))


def _inside(pdf: pd.DataFrame) -> pd.DataFrame:
    """(v, comp, live) of a range's own arcs (kind 0) and of its vertices with an arc out of the range (1) or from outside (2).

    A vertex is live if it may be on a cycle through other ranges: one gets in to it, and out from it.
    """
    ids, src, dst = _local(pdf)
    kind = pdf["kind"].to_numpy()
    real = kind == 0
    comp = np.array(_strong(src[real], dst[real], len(ids))[0])
    least = np.full(comp.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, comp, ids)
    out, into = ([False] * len(least) for _ in range(2))
    for k, marks in ((1, out), (2, into)):
        for c in np.unique(comp[src[kind == k]]).tolist():
            marks[c] = True
    a, b = comp[src[real]], comp[dst[real]]
    order = np.argsort(a, kind="stable")
    down = list(zip(a[order].tolist(), b[order].tolist(), strict=True))  # arcs lead to lower numbers
    for x, y in down:
        out[x] = out[x] or out[y]
    for x, y in reversed(down):
        into[y] = into[y] or into[x]
    return pd.DataFrame({"v": ids, "comp": least[comp], "live": (np.array(out) & np.array(into))[comp]})


def strong_components(edges: DataFrame, task_edges: int = TASK_EDGES, size: int = RANGE) -> DataFrame:
    """(v, comp): the smallest vertex of the strong component, for vertices with an edge to another.

    Ranges of ids with at most ``task_edges`` arcs of their own are done first, each in a task: what is
    strongly connected there becomes one vertex, and what no cycle through other ranges can pass is
    done. The rest goes by weakly connected parts.
    """
    ship(edges.sparkSession)
    arcs, n, of = ranged(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).filter("src <> dst").distinct(), "src", "dst", size)
    if not n or of is None:
        return _strong_by_parts(arcs, task_edges)
    placed = arcs.select(of("src").alias("block"), of("dst").alias("b"), "src", "dst")
    full = cut_compact(placed.filter("block = b").groupBy("block").count().filter(F.col("count") > task_edges).select("block"))
    mark = lambda end, kind: placed.filter("block <> b").select(of(end).alias("block"), F.col(end).alias("src"), F.col(end).alias("dst"), F.lit(kind).alias("kind")).distinct()
    rows = placed.filter("block = b").select("block", "src", "dst", F.lit(0).alias("kind")).union(mark("src", 1)).union(mark("dst", 2))
    done = rows.hint("merge").join(full, "block", "left_anti").groupBy("block").applyInPandas(_inside, "v long, comp long, live boolean")
    left = rows.hint("merge").join(full, "block", "left_semi").select(F.explode(F.array("src", "dst")).alias("v")).distinct()
    found = written(done.union(left.select("v", F.col("v").alias("comp"), F.lit(True))))
    live = found.filter("live").select("v", "comp")
    ends = arcs.hint("merge").join(live.toDF("src", "a"), "src").hint("merge").join(live.toDF("dst", "b"), "dst")
    rest = written(ends.filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    if rest.isEmpty():
        return found.select("v", "comp")
    joined = written(_strong_by_parts(rest, task_edges).toDF("comp", "smallest"))
    return found.hint("merge").join(joined, "comp", "left").select("v", F.coalesce("smallest", "comp").alias("comp"))


def _strong_by_parts(edges: DataFrame, task_edges: int) -> DataFrame:
    """``strong_components`` of distinct arcs: a weakly connected part of at most ``task_edges`` arcs is one task's; larger parts are coloured by all executors."""
    arcs = cut_compact(edges, 200_000)
    parts = near_components(arcs)
    large = _large_parts(arcs, parts, task_edges)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, src, dst = _local(pdf)
        comp = np.array(_strong(src, dst, len(ids))[0])
        least = np.full(comp.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, comp, ids)
        return pd.DataFrame({"v": ids, "comp": least[comp]})

    if large.isEmpty():
        return _by_part(arcs, run, "v long, comp long", parts)
    mine = parts.hint("merge").join(large, "component", "left_semi").select(F.col("v").alias("src"))
    here = _by_part(arcs, run, "v long, comp long", parts.hint("merge").join(large, "component", "left_anti"))
    return here.union(coloured_components(arcs.hint("merge").join(mine, "src", "left_semi")))


def coloured_components(arcs: DataFrame) -> DataFrame:
    """(v, comp) as by ``strong_components``, for parts of any size: colours forward, searches backward.

    A vertex takes the first colour, in a random order of all vertices, that reaches it; what
    reaches a colour's own vertex under that colour is that vertex's strong component. It goes, as
    do the arcs between colours, and the rest is coloured anew. The random order makes the rounds
    few; colours and searches settle inside blocks, so a round has as many joins as blocks on a
    path, not hops, and no task holds a part.
    """
    left = cut_compact(arcs.select("src", "dst").filter("src <> dst").distinct(), 200_000)
    vertices = cut_compact(left.select(F.explode(F.array("src", "dst")).alias("v")).distinct(), 200_000)
    found = vertices.filter("false").select(F.col("v").alias("root"), "v")
    for turn in range(1 << 30):
        # no cycle passes a vertex without an arc to it or from it
        left = cut_compact(left.hint("merge").join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").hint("merge").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"), 200_000)
        if left.isEmpty():
            break
        own = left.select(F.explode(F.array("src", "dst")).alias("v")).distinct().select("v", F.xxhash64(F.col("v").cast("long"), F.lit(turn)).alias("value"))
        own = written(own)  # of a long, this hash is one to one
        colours = blocks.least(blocks.build(left), own.select(F.lit(0).alias("group"), "v", F.lit(0).alias("bit"), "value"), 0)
        of = written(colours.select("v", "value").hint("merge").join(own.withColumnRenamed("v", "root"), "value").select("v", "root"))
        inner = cut_compact(left.hint("merge").join(of.toDF("src", "root"), "src").hint("merge").join(of.toDF("dst", "root"), ["dst", "root"]).select("src", "dst"), 200_000)
        # arcs join one colour's vertices only, so whatever comes to a vertex is of its own colour
        roots = of.filter("v = root").select(F.lit(0).alias("group"), "v", F.lit(0).alias("bit"), F.lit(0).alias("value"))
        back = blocks.least(blocks.build(inner.toDF("dst", "src")), roots, 0).select("v").union(roots.select("v")).distinct()
        reached = written(back.hint("merge").join(of, "v").select("root", "v"))
        found = cut_compact(found.union(reached), 200_000)
        done = reached.select("v")
        left = inner.hint("merge").join(done.toDF("src"), "src", "left_anti").hint("merge").join(done.toDF("dst"), "dst", "left_anti")
    least = found.groupBy("root").agg(F.min("v").alias("comp"))
    known = found.hint("merge").join(least, "root").select("v", "comp")
    return vertices.hint("merge").join(known, "v", "left").select("v", F.coalesce("comp", "v").alias("comp"))


def closure_of(pdf: pd.DataFrame, memory_cap: int) -> Iterator[pd.DataFrame]:
    """The pairs (src, dst) of different vertices with a path over these edges, by bit rows of strong components.

    They come in batches of about ``BATCH`` pairs or one vertex's pairs, so only the bit rows of one
    weakly connected part are held; ``memory_cap`` is for those of the largest.
    """
    ids, src, dst = _local(pdf)
    n = len(ids)
    part = _weak(src, dst, n)
    sizes = np.bincount(part, minlength=1)
    if bit_rows(int(sizes.max())) > memory_cap:
        raise SkippedByPolicy(f"a part of {sizes.max()} vertices needs more than {memory_cap} bytes")
    order = np.argsort(part, kind="stable")  # parts one after the other
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    ids, src, dst, part = ids[order], place[src], place[dst], part[order]
    first, size = np.searchsorted(part, part), sizes[part]
    comp, after = _strong(src, dst, n)
    members: list[list[int]] = [[] for _ in range(max(comp) + 1)]
    for v, c in enumerate(comp):
        members[c].append(v)
    rows, froms, tos, held, now = {}, [], [], 0, -1
    for c, own in enumerate(members):  # successors come first, and a part's components together
        base = int(first[own[0]])
        if base != now:
            rows, now = {}, base
        bits = sum(1 << (v - base) for v in own)
        for d in {comp[w] for v in own for w in after[v]} - {c}:
            bits |= rows[d]
        rows[c] = bits
        reached = base + np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(-(-int(size[own[0]]) // 8), "little"), dtype=np.uint8), bitorder="little"))
        for v in own:
            others = reached[reached != v]
            froms.append(np.full(len(others), v))
            tos.append(others)
            held += len(others)
            if held >= BATCH:
                yield pd.DataFrame({"src": ids[np.concatenate(froms)], "dst": ids[np.concatenate(tos)]})
                froms, tos, held = [], [], 0
    if held:
        yield pd.DataFrame({"src": ids[np.concatenate(froms)], "dst": ids[np.concatenate(tos)]})


def bit_rows(n: int) -> int:
    """Bytes of the bit rows of ``n`` vertices."""
    return n * -(-n // 64) * 8


def closure(edges: DataFrame, memory_cap: int | None = None) -> DataFrame:
    """(src, dst): all pairs of different vertices with a path, from the blocks of the closure's bit matrix.

    With a ``memory_cap``, ``SkippedByPolicy`` is raised before anything is closed if the bit rows of
    the largest weakly connected part don't fit it.
    """
    graph = blocks.build(edges)
    if memory_cap is not None:
        largest = near_components(graph.arcs).groupBy("component").count().agg(F.max("count")).first()[0] or 0
        if bit_rows(largest) > memory_cap:
            raise SkippedByPolicy(f"a part of {largest} vertices needs more than {memory_cap} bytes")
    return blocks.search(graph, graph.arcs.select(F.col("src").alias("seed"))).pairs()


def reached(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, v): what each seed (seed) reaches, itself included."""
    seeds = cut_compact(seeds.select("seed").distinct())
    found = blocks.search(blocks.build(edges), seeds).pairs().toDF("seed", "v")
    return found.union(seeds.select("seed", F.col("seed").alias("v")))


def answer_by_search(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, source, target, reachable) by a search from the sources that ends where all pairs are decided."""
    pairs = cut_compact(pairs.select("qid", "source", "target"))
    return blocks.search(blocks.build(edges), pairs.select(F.col("source").alias("seed")), pairs).answer(pairs)


def answer_by_closure(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, source, target, reachable), read off the closure's bit rows, which are made for all vertices with an arc."""
    pairs = cut_compact(pairs.select("qid", "source", "target"))
    graph = blocks.build(edges)
    return blocks.search(graph, graph.arcs.select(F.col("src").alias("seed"))).answer(pairs)


def compressed_counts(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, reached): how many vertices each of ``vertices`` (v) reaches, itself included, by the closure of the strong components alone."""
    edges = cut_compact(edges.select("src", "dst"), 200_000)
    comps = cut_compact(strong_components(edges), 200_000)
    sizes = cut_compact(comps.groupBy(F.col("comp").alias("v")).agg(F.count("*").alias("weight")), 200_000)
    graph = blocks.build(condensation(edges, comps).toDF("src", "dst"), sizes)
    counts = blocks.search(graph, sizes.select(F.col("v").alias("seed"))).counts(sizes)
    of = vertices.select("v").hint("merge").join(comps, "v", "left").hint("merge").join(counts.withColumnRenamed("seed", "comp"), "comp", "left")
    return of.select("v", F.coalesce("reached", F.lit(1)).alias("reached"))


def _jumped(rows: DataFrame, join: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Rows (tree, v, up, ...) with ``up`` doubled until it is null everywhere; ``join`` makes the next rows of these and of those at ``up``."""
    left = -1
    while left:
        seen = Observation()
        rows = written(rows.observe(seen, F.count("up").alias("left")))
        left = seen.get["left"]
        if left:
            rows = join(rows, rows.select("tree", *[F.col(c).alias(f"{c}_" if c != "v" else "up") for c in rows.columns if c != "tree"]))
    return rows


def spanning_forests(arcs: DataFrame, nodes: DataFrame, trees: int, seed: int) -> DataFrame:
    """(tree, v, root, pre, post): random spanning forests of an acyclic graph, as intervals of their depth-first visits.

    Each vertex takes a random one of its predecessors as its parent, so nothing is searched. Sizes of
    subtrees and sums of offsets along the ways to the roots come by pointer jumping: there are as many
    rounds as the depth has binary digits. A vertex's interval is [pre, post), the root's starts at 0,
    and holds just its descendants'.
    """
    tree = F.explode(F.array(*map(F.lit, range(trees)))).alias("tree")
    chosen = arcs.select("src", "dst", tree).groupBy("tree", F.col("dst").alias("v")).agg(F.min_by("src", F.xxhash64("tree", "src", "dst", F.lit(seed))).alias("parent"))
    all_ = written(nodes.select("v", tree).hint("merge").join(chosen, ["tree", "v"], "left"))

    def grown(rows: DataFrame, above: DataFrame) -> DataFrame:
        more = rows.filter("up IS NOT NULL").groupBy("tree", F.col("up").alias("v")).agg(F.sum("size").alias("more"))
        further = rows.hint("merge").join(above.select("tree", "up", "up_"), ["tree", "up"], "left").select("tree", "v", F.col("up_").alias("up"), "size")
        return further.hint("merge").join(more, ["tree", "v"], "left").select("tree", "v", "up", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))

    sizes = _jumped(all_.select("tree", "v", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size")), grown).select("tree", "v", "size")
    # a child starts after its parent and the siblings before it; siblings are dealt so that a hub's are many tasks'
    born = written(all_.hint("merge").join(sizes, ["tree", "v"]).withColumn("deal", F.pmod(F.xxhash64("v", "tree"), F.lit(256)).cast("int")))
    before = lambda *keys: Window.partitionBy("tree", "parent", *keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    children = born.filter("parent IS NOT NULL")
    deals = children.groupBy("tree", "parent", "deal").agg(F.sum("size").alias("n")).select("tree", "parent", "deal", F.coalesce(F.sum("n").over(before("deal")), F.lit(0)).alias("first"))
    inner = children.select("tree", "v", "parent", "deal", F.coalesce(F.sum("size").over(before("deal", "v")), F.lit(0)).alias("here")).hint("merge").join(deals, ["tree", "parent", "deal"])
    offsets = inner.select("tree", "v", (F.col("here") + F.col("first") + 1).alias("pre"))
    start = born.hint("merge").join(offsets, ["tree", "v"], "left").select("tree", "v", F.col("parent").alias("up"), F.coalesce("pre", F.lit(0)).alias("pre"), F.coalesce("parent", "v").alias("root"))

    def summed(rows: DataFrame, above: DataFrame) -> DataFrame:
        both = rows.hint("merge").join(above, ["tree", "up"], "left")
        return both.select("tree", "v", F.col("up_").alias("up"), (F.col("pre") + F.coalesce("pre_", F.lit(0))).alias("pre"), F.coalesce("root_", "root").alias("root"))

    placed = _jumped(start, summed)
    return placed.hint("merge").join(sizes, ["tree", "v"]).select("tree", "v", "root", "pre", (F.col("pre") + F.col("size")).alias("post"))


def interval_labels(edges: DataFrame, trees: int = 5, seed: int = 0) -> DataFrame:
    """(v, tree, part, pre, post): intervals of ``trees`` spanning forests of the graph of strong components, each random in its own way.

    An interval inside another of the same tree and part is a descendant's: a certain path. Nothing
    follows from intervals apart. Vertices of a strong component share its interval.
    """
    edges = written(edges.select("src", "dst").filter("src <> dst").distinct())
    comps = written(strong_components(edges))
    forests = spanning_forests(written(condensation(edges, comps).toDF("src", "dst")), comps.select(F.col("comp").alias("v")).distinct(), trees, seed)
    return comps.hint("merge").join(forests.withColumnRenamed("v", "comp"), "comp").select("v", "tree", F.col("root").alias("part"), "pre", "post")


def answer_by_intervals(pairs: DataFrame, labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, source, target, reachable, certified): a tree's certificate, or else a search from the sources left over."""
    s = labels.select(F.col("v").alias("source"), "tree", "part", F.col("pre").alias("s_pre"), F.col("post").alias("s_post"))
    t = labels.select(F.col("v").alias("target"), "tree", "part", F.col("pre").alias("t_pre"), F.col("post").alias("t_post"))
    both = pairs.join(s, "source").join(t, ["target", "tree", "part"]).filter("s_pre <= t_pre AND t_post <= s_post")
    sure = both.select("qid").distinct().withColumn("sure", F.lit(True))
    known = cut_compact(pairs.join(sure, "qid", "left").withColumn("certified", F.coalesce("sure", F.lit(False)) | (F.col("source") == F.col("target"))).drop("sure"))
    left = known.filter("NOT certified")
    searched = answer_by_search(left, edges).withColumn("certified", F.lit(False))
    return known.filter("certified").select("qid", "source", "target", F.lit(True).alias("reachable"), "certified").union(searched)


def reflexive(closed: DataFrame, vertices: DataFrame) -> DataFrame:
    """A closure with (v, v) for all vertices (v)."""
    return closed.union(vertices.select(F.col("v").alias("src"), F.col("v").alias("dst")))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """The boolean product of two relations (src, dst)."""
    return a.select("src", F.col("dst").alias("m")).hint("merge").join(b.select(F.col("src").alias("m"), "dst"), "m").select("src", "dst").distinct()


def squaring(relation: DataFrame, rounds: int = 64, steps: list[dict] | None = None) -> DataFrame:
    """The closure of a reflexive relation by repeated squaring, until nothing is added.

    A round only joins pairs that the last one added, once as the first and once as the second half of
    a path, with all pairs; what two older pairs make is there already. A pair (v, v) makes nothing.
    A middle vertex with many pairs on one side is split by a salt. ``steps`` gets, of each round, how
    many pairs were joined (``joined``) and how many were new (``added``).
    """
    arcs = relation.select("src", "dst").distinct()
    loops = written(arcs.filter("src = dst"))
    known = new = written(arcs.filter("src <> dst"))
    for _ in range(rounds):
        seen, joined = Observation(), Observation()
        first = _halves(new, known).observe(joined, F.count(F.lit(1)).alias("n"))
        made = first if new is known else first.union(_halves(known, new, turned=True))
        fresh = made.filter("src <> dst").distinct().hint("merge").join(known, ["src", "dst"], "left_anti")
        new = written(fresh.observe(seen, F.count(F.lit(1)).alias("n")))
        if steps is not None:
            steps.append({"joined": joined.get["n"], "added": seen.get["n"]})
        if not seen.get["n"]:
            break
        known = written(known.union(new))
    return loops.union(known)


#: Into so many parts the pairs around a middle vertex are split.
MIDDLES = 4


def _halves(a: DataFrame, b: DataFrame, turned: bool = False) -> DataFrame:
    """(src, dst) of paths from a pair of ``a`` over a pair of ``b``; the first relation is salted, or with ``turned`` the second."""
    salt = lambda end: F.pmod(F.xxhash64(end), F.lit(MIDDLES)).cast("int").alias("salt")
    every = F.explode(F.array(*map(F.lit, range(MIDDLES)))).alias("salt")
    left = a.select("src", F.col("dst").alias("m"), every if turned else salt("src"))
    right = b.select(F.col("src").alias("m"), "dst", salt("dst") if turned else every)
    return left.hint("merge").join(right, ["m", "salt"]).select("src", "dst")


def two_hop_labels(reach: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a reflexive closure: (v, l_out) the hubs that v reaches, (v, l_in) those that reach it."""
    out = reach.groupBy(F.col("src").alias("v")).agg(F.array_sort(F.collect_set("dst")).alias("l_out"))
    into = reach.groupBy(F.col("dst").alias("v")).agg(F.array_sort(F.collect_set("src")).alias("l_in"))
    return out, into


def landmark_labels(edges: DataFrame, first: int = 64, growth: int = 4, memory_cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(v, hub) of hubs that v reaches, and of those that reach it: two vertices are connected where they share a hub.

    Vertices become hubs by falling product of their degrees, in batches of about ``first``,
    ``first * growth`` and so on, so there are logarithmically many. A hub's search, forward and
    backward, doesn't enter a vertex whose connection with it earlier batches' hubs tell already; the
    hub of the earliest batch on all paths between two vertices is never kept from either. Only
    vertices with an arc have labels. With a ``memory_cap``, ``SkippedByPolicy`` is raised after a
    batch if the labels' bytes (24 for each list, 8 for each hub) are more.
    """
    graph = blocks.build(edges)
    back = blocks.build(graph.arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    ends = lambda c, name: graph.arcs.groupBy(F.col(c).alias("v")).agg((F.count("*") + 1).alias(name))
    degrees = ends("src", "o").hint("merge").join(ends("dst", "i"), "v", "full").select("v", (F.coalesce("o", F.lit(1)) * F.coalesce("i", F.lit(1))).alias("score"))
    degrees = written(degrees)
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = degrees.groupBy("score").agg(F.count("*").alias("n")).withColumn("before", before)  # a row for each different score
    batch = F.floor(F.log(float(growth), F.col("before") * (growth - 1) / first + 1)).cast("int")
    hubs = written(degrees.join(counts.select("score", batch.alias("batch")), "score").select("v", "batch"))
    out = into = written(hubs.filter("false").select("v", F.col("v").alias("hub")))
    for k in [r[0] for r in hubs.select("batch").distinct().orderBy("batch").collect()]:
        seeds = hubs.filter(F.col("batch") == k).select(F.col("v").alias("seed"))
        word, bits = blocks.word_of("bit")

        def walls(own: DataFrame, others: DataFrame) -> Callable[[DataFrame], DataFrame]:
            def made(numbers: DataFrame) -> DataFrame:
                known = own.withColumnRenamed("v", "seed").hint("merge").join(numbers, "seed").select("hub", "group", word, bits)
                known = known.groupBy("hub", "group", "word").agg(F.bit_or("bits").alias("bits"))
                return others.hint("merge").join(known, "hub").groupBy("group", "v", "word").agg(F.bit_or("bits").alias("bits"))

            return made

        forth = blocks.search(graph, seeds, walls=walls(out, into)).pairs().select(F.col("dst").alias("v"), F.col("src").alias("hub"))
        to = blocks.search(back, seeds, walls=walls(into, out)).pairs().select(F.col("dst").alias("v"), F.col("src").alias("hub"))
        itself = seeds.select(F.col("seed").alias("v"), F.col("seed").alias("hub"))
        into, out = written(into.union(forth).union(itself)), written(out.union(to).union(itself))
        if memory_cap is not None and (size := 48 * degrees.count() + 8 * (into.count() + out.count())) > memory_cap:
            raise SkippedByPolicy(f"labels of {size} bytes, more than {memory_cap}")
    return out, into


def answer_by_labels(pairs: DataFrame, out: DataFrame, into: DataFrame) -> DataFrame:
    """(qid, source, target, reachable): a vertex reaches itself, and those with which it shares a hub."""
    pairs = few(pairs.select("qid", "source", "target"))
    up = pairs.join(out.withColumnRenamed("v", "source"), "source").select("qid", "hub")
    down = pairs.join(into.withColumnRenamed("v", "target"), "target").select("qid", "hub")
    hit = up.hint("merge").join(down, ["qid", "hub"], "left_semi").select("qid").distinct().withColumn("hit", F.lit(True))
    found = pairs.join(hit, "qid", "left")
    return found.select("qid", "source", "target", F.coalesce(F.col("hit"), F.col("source") == F.col("target"), F.lit(False)).alias("reachable"))


def answer(pairs: DataFrame, reach: DataFrame) -> DataFrame:
    """(qid, source, target) -> with reachable, by a reflexive closure or the part of it that holds the sources."""
    asked = pairs.select("source", "target").distinct()
    hit = reach.select(F.col("src").alias("source"), F.col("dst").alias("target")).hint("merge").join(asked, ["source", "target"], "left_semi").distinct().withColumn("hit", F.lit(True))
    return pairs.join(hit, ["source", "target"], "left").select("qid", "source", "target", F.coalesce("hit", F.lit(False)).alias("reachable"))


def condensation(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """Distinct arcs (csrc, cdst) between different components."""
    ends = edges.hint("merge").join(comps.toDF("src", "csrc"), "src").hint("merge").join(comps.toDF("dst", "cdst"), "dst")
    return ends.filter("csrc <> cdst").select("csrc", "cdst").distinct()


def _componentwise(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """``pairs`` with the components of their ends (a, b); a vertex without one is its own."""
    ends = pairs.join(comps.toDF("source", "a").hint("merge"), "source", "left").join(comps.toDF("target", "b").hint("merge"), "target", "left")
    return ends.select("qid", "source", "target", F.coalesce("a", "source").alias("a"), F.coalesce("b", "target").alias("b"))


def answer_by_components(pairs: DataFrame, edges: DataFrame, comps: DataFrame, closed: bool = False) -> DataFrame:
    """(qid, source, target, reachable) over the graph of strong components: by a search from the sources' components, or by its closure."""
    arcs = condensation(edges, comps).toDF("src", "dst")
    asked = cut_compact(_componentwise(pairs, comps))
    by = answer_by_closure if closed else answer_by_search
    found = by(asked.select("qid", F.col("a").alias("source"), F.col("b").alias("target")), arcs).select("qid", "reachable")
    return asked.select("qid", "source", "target").join(found, "qid")


def squarings(n: int) -> int:
    """How many squarings close a reflexive relation whose largest part has ``n`` vertices, at most."""
    return max(0, n - 1).bit_length()


def squaring_bounds(edges: DataFrame) -> DataFrame:
    """One row: largest_part, strong_components, largest_strong, squarings (by the largest part) and by_structure.

    ``by_structure`` is the estimate from strong components; paths may need more rounds, so it is for
    comparison only and ``squaring`` stops where nothing is added.
    """
    parts = near_components(edges).groupBy("component").agg(F.count("*").alias("n")).agg(F.max("n").alias("largest_part"))
    strong = strong_components(edges).groupBy("comp").agg(F.count("*").alias("n")).agg(F.count("*").alias("strong_components"), F.max("n").alias("largest_strong"))
    one = parts.crossJoin(strong)  # one row each
    rounds = lambda n: F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)
    size, scale = F.coalesce("largest_part", F.lit(0)), F.coalesce(F.col("strong_components") + F.col("largest_strong"), F.lit(0))
    return one.select(size.alias("largest_part"), "strong_components", F.coalesce("largest_strong", F.lit(0)).alias("largest_strong"), rounds(size).alias("squarings"), F.least(rounds(size), rounds(scale)).alias("by_structure"))
