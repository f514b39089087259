import random

import pytest
from pyspark.sql import functions as F

from gridreach.operators import blocks, reach

GRAPHS = {
    "diamond": [(0, 1), (0, 2), (1, 3), (2, 3)],
    "two_cycles": [(0, 1), (1, 0), (1, 200), (200, 201), (201, 200), (5, 5), (5, 5)],
    "random": [(random.Random(i).randrange(40), random.Random(1000 + i).randrange(40)) for i in range(70)],
    "hub": [(7, i) for i in range(40)] + [(i, 100 + i) for i in range(30)] + [(130, 7)],
    "far_apart": [(i * 10**15 + 3, (i * 7 % 20) * 10**15 + 3) for i in range(20)],
    "negative": [(-5, -4), (-4, 3), (3, -5), (3, 9)],
}


def brute(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
        after.setdefault(b, set())
    out = {}
    for s in after:
        seen, todo = {s}, [s]
        while todo:
            for b in after[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        out[s] = seen
    return out


@pytest.mark.parametrize("name", GRAPHS)
def test_search_as_brute_force(spark, name):
    """Over tiny blocks, groups of a few sources and split blocks; a seed outside the graph reaches itself."""
    want = brute(GRAPHS[name])
    df = spark.createDataFrame(GRAPHS[name], "src long, dst long")
    graph = blocks.build(df, block=8, piece_edges=20)
    seeds = spark.createDataFrame([(v,) for v in want] + [(10**17,), (None,)], "seed long")
    found = blocks.search(graph, seeds, sources=70)
    assert {tuple(r) for r in found.counts().collect()} == {(s, len(t)) for s, t in want.items()} | {(10**17, 1)}
    assert {tuple(r) for r in found.pairs().collect()} == {(s, v) for s, t in want.items() for v in t if s != v}
    weights = spark.createDataFrame([(v, 3 + v % 5) for v in want], "v long, weight long")
    assert {tuple(r) for r in found.counts(weights).filter(f"seed < {10**17}").collect()} == {(s, sum(3 + v % 5 for v in t)) for s, t in want.items()}
    vertices = sorted(want)
    r = random.Random(3)
    asked = [(i, r.choice(vertices), r.choice(vertices)) for i in range(60)] + [(100, vertices[0], 10**16 + 1), (101, 10**17, vertices[0]), (102, 10**17, 10**17)]
    pairs = spark.createDataFrame(asked, "qid long, source long, target long")
    answers = {(q, s, t): s == t or t in want.get(s, ()) for q, s, t in asked}
    early = blocks.search(graph, pairs.select(F.col("source").alias("seed")), pairs, sources=70)
    for got in (found.answer(pairs), early.answer(pairs)):
        assert {(r["qid"], r["source"], r["target"]): r["reachable"] for r in got.collect()} == answers


@pytest.mark.parametrize("name", ["diamond", "two_cycles", "random", "hub"])
def test_labels_by_pruned_searches(spark, name):
    """Sound and complete on all pairs, and fewer than the closure where it has many pairs."""
    want = brute(GRAPHS[name])
    df = spark.createDataFrame(GRAPHS[name], "src long, dst long")
    out, into = ({v: {r["hub"] for r in labels.collect() if r["v"] == v} for v in want} for labels in reach.landmark_labels(df, first=4, growth=3))
    assert all(bool(out[s] & into[t]) == (t in want[s]) for s in want for t in want if s != t)
    if name == "random":
        assert sum(map(len, out.values())) + sum(map(len, into.values())) < sum(map(len, want.values()))
        pairs = spark.createDataFrame([(k, s, t) for k, (s, t) in enumerate((s, t) for s in list(want)[:9] for t in want)], "qid long, source long, target long")
        assert all(r["reachable"] == (r["target"] in want[r["source"]]) for r in reach.answer_by_labels(pairs, *reach.landmark_labels(df)).collect())
        with pytest.raises(reach.SkippedByPolicy):
            reach.landmark_labels(df, memory_cap=100)


def test_rounds_are_blocks_and_answered_sources_stop(spark):
    path = spark.range(4000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    graph = blocks.build(path, block=1024)
    one = spark.createDataFrame([(0, 0, 900)], "qid long, source long, target long")
    assert len(blocks.search(graph, one.select(F.col("source").alias("seed"))).frontiers) == 4
    early = blocks.search(graph, one.select(F.col("source").alias("seed")), one)
    assert len(early.frontiers) == 1 and early.answer(one).first()["reachable"]


def test_blocks_are_not_shuffled_again(spark):
    """A round joins the frontier to the bucketed blocks as they lie."""
    path = spark.range(500).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    graph = blocks.build(path, block=16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frontier = spark.range(5).select(F.col("id").alias("block"), F.lit(0).cast("long").alias("group"), F.col("id").alias("v"), F.lit(0).alias("word"), F.lit(1).cast("long").alias("bits"))
        plan = graph.rows.join(blocks._listed(frontier, "arrivals"), "block")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_no_edges(spark):
    empty = spark.createDataFrame([], "src long, dst long")
    graph = blocks.build(empty, spark.range(3).select(F.col("id").alias("v")))
    found = blocks.search(graph, spark.range(4).select(F.col("id").alias("seed")))
    assert {tuple(r) for r in found.counts().collect()} == {(i, 1) for i in range(4)} and found.pairs().count() == 0
    assert blocks.search(graph, spark.range(0).select(F.col("id").alias("seed"))).counts().count() == 0


def hops(edges):
    """Breadth-first distances from every vertex."""
    after, out = {}, {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
        after.setdefault(b, set())
    for s in after:
        depth, todo = {s: 0}, [s]
        for v in todo:
            for w in after[v] - depth.keys():
                depth[w] = depth[v] + 1
                todo.append(w)
        out[s] = depth
    return out


@pytest.mark.parametrize("name", GRAPHS)
def test_distances_as_brute_force(spark, name):
    """Over tiny blocks, groups of a few seeds and split blocks; a seed outside the graph is at no hop from itself."""
    want = {(s, v, d) for s, found in hops(GRAPHS[name]).items() for v, d in found.items()}
    graph = blocks.build(spark.createDataFrame(GRAPHS[name], "src long, dst long"), block=8, piece_edges=20)
    seeds = spark.createDataFrame([(v,) for v, w, _ in want if v == w] + [(10**17,), (None,)], "seed long")
    got = [tuple(r) for r in blocks.distances(graph, seeds, columns=5).collect()]
    assert len(got) == len(set(got)) and set(got) == want | {(10**17, 10**17, 0)}


def test_distances_are_corrected(spark):
    """A long way through low blocks comes first, a short one through a far block later."""
    way = [(i, i + 1) for i in range(30)] + [(0, 100), (100, 200), (200, 15), (31, 0)]
    graph = blocks.build(spark.createDataFrame(way, "src long, dst long"), block=8)
    want = {(0, v, d) for v, d in hops(way)[0].items()}
    assert {tuple(r) for r in blocks.distances(graph, spark.range(1).select(F.col("id").alias("seed"))).collect()} == want


def test_rounds_of_distances_are_blocks(spark):
    path = spark.range(4000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    rounds = []
    found = blocks.distances(blocks.build(path, block=1024), spark.range(1).select(F.col("id").alias("seed")), rounds=rounds)
    assert len(rounds) == 4 and found.filter("v = depth").count() == 4001


def test_least_of_nothing(spark):
    graph = blocks.build(spark.createDataFrame([], "src long, dst long"))
    assert [tuple(r) for r in blocks.distances(graph, spark.range(1).select(F.col("id").alias("seed"))).collect()] == [(0, 0, 0)]
    assert blocks.distances(graph, spark.range(0).select(F.col("id").alias("seed"))).count() == 0


def test_colours_on_a_long_cycle(spark):
    """One cycle of 3000 vertices with a chain behind it: components by colours, whatever the number of hops."""
    ring = spark.range(3000).select(F.col("id").alias("src"), ((F.col("id") + 1) % 3000).alias("dst"))
    chain = spark.range(2999, 3100).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = {r["v"]: r["comp"] for r in reach.coloured_components(ring.union(chain)).collect()}
    assert got == {v: 0 if v < 3000 else v for v in range(3101)}
