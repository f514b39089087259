import random

import pytest
from pyspark.sql import functions as F

from gridreach.operators import components, grid, reach

GRAPHS = {
    "diamond": [(0, 1), (0, 2), (1, 3), (2, 3)],
    "cycle_and_tail": [(0, 1), (1, 2), (2, 0), (2, 3)],
    "two_cycles_in_a_chain": [e for k in range(10) for e in ((2 * k, 2 * k + 1), (2 * k + 1, 2 * k), (2 * k + 1, 2 * k + 2)) if max(e) < 20],
    "random": [(random.Random(i).randrange(40), random.Random(1000 + i).randrange(40)) for i in range(1, 60)],
    "empty": [],
}


def brute(edges):
    out = {}
    for s in {v for e in edges for v in e}:
        seen, todo = {s}, [s]
        while todo:
            v = todo.pop()
            for a, b in edges:
                if a == v and b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[s] = seen
    return out


@pytest.mark.parametrize("name", GRAPHS)
def test_methods_agree(spark, name):
    edges = GRAPHS[name]
    df = spark.createDataFrame(edges, "src long, dst long")
    want = brute(edges)
    pairs = {(s, t) for s, ts in want.items() for t in ts}
    assert {tuple(r) for r in reach.closure(df).collect()} == {p for p in pairs if p[0] != p[1]}
    seeds = df.select(F.col("src").alias("seed")).distinct()
    assert {(r["seed"], r["v"]) for r in reach.frontier(df, seeds).collect()} == {p for p in pairs if p[0] in {a for a, _ in edges}}
    identity = df.select(F.explode(F.array("src", "dst")).alias("src")).distinct().withColumn("dst", F.col("src"))
    assert {tuple(r) for r in reach.squaring(df.union(identity)).collect()} == pairs
    scc = {r["v"]: r["comp"] for r in reach.strong_components(df).collect()}
    assert scc == {v: min(u for u in want[v] if v in want[u]) for v in want if any(v in e and e[0] != e[1] for e in edges)}
    found = {r["v"]: r["component"] for r in components.connected_components(df).collect()}
    around = brute(edges + [(b, a) for a, b in edges])
    assert found == {v: min(around[v]) for v in around if len(around[v]) > 1}


def test_memory_cap(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)], "src long, dst long")
    with pytest.raises(Exception, match="needs more than"):
        reach.closure(df, memory_cap=100).count()


def test_large_parts(spark):
    """Coloured by all executors beside parts that tasks hold; loops and repeated edges change nothing."""
    edges = [(1, 2), (2, 1), (2, 2), (5, 6), (6, 7), (7, 8), (8, 5), (8, 9), (9, 10), (10, 9), (4, 5), (4, 5)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["v"]: r["comp"] for r in reach.strong_components(df, task_edges=4).collect()}
    assert got == {1: 1, 2: 1, 4: 4, 5: 5, 6: 5, 7: 5, 8: 5, 9: 9, 10: 9}


@pytest.mark.parametrize("name", ["diamond", "two_cycles_in_a_chain", "random"])
def test_intervals_are_certificates(spark, name):
    """Inside one another only where there is a path, laminar, and as wide as their subtrees."""
    want = brute(GRAPHS[name])
    labels = reach.interval_labels(spark.createDataFrame(GRAPHS[name], "src long, dst long"), trees=3)
    rows = [tuple(r) for r in labels.collect()]
    assert len(rows) == 3 * len([v for v in want if any(v in e and e[0] != e[1] for e in GRAPHS[name])])
    certain = 0
    for s, tree, part, a, b in rows:
        for t, other, same, c, d in rows:
            if (tree, part) == (other, same):
                assert b <= c or d <= a or a <= c and d <= b or c <= a and b <= d
                if s != t and a <= c and d <= b:
                    certain += 1
                    assert t in want[s]
    assert certain
    star = spark.range(1, 300).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    chain = spark.range(300, 340).select((F.col("id") - 1).alias("src"), F.col("id").alias("dst"))
    got = {r["v"]: (r["pre"], r["post"]) for r in reach.interval_labels(star.union(chain), trees=1).collect()}
    assert got[0] == (0, 340) and got[299][1] - got[299][0] == 41 and sorted(p for p, _ in got.values()) == list(range(340))


@pytest.mark.parametrize(("size", "tile", "want"), [(8, 4, 2), (9, 4, 2), (10, 4, 3), (5, 4, 1), (3, 4, 1)])
def test_tile_remainders(spark, size, tile, want):
    cells = grid.with_coordinates(spark.range(size * size).select(F.col("id").alias("v"), F.lit(True).alias("passable")), size)
    assert grid.tiles_of(cells, size, size, tile).select("tile").distinct().count() == want**2
