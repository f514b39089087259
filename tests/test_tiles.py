import random

import pytest
from pyspark.sql import functions as F

from gridreach.operators import density, grid, reach, tiles

from .test_reach import GRAPHS, brute


def make(spark, width, height, arcs, blocked=(), tile=4):
    """Cells with tiles, edges, and all pairs with a path."""
    cells = grid.with_coordinates(spark.range(width * height).select(F.col("id").alias("v"), (~F.col("id").isin(*(blocked or [-1]))).alias("passable")), width)
    return grid.tiles_of(cells, width, height, tile), spark.createDataFrame(arcs or [(0, 0)], "src long, dst long")


def random_arcs(width, height, blocked, seed):
    r, arcs = random.Random(seed), []
    for v in range(width * height):
        for w in ([v + 1] if v % width < width - 1 else []) + ([v + width] if v + width < width * height else []):
            if v not in blocked and w not in blocked:
                arcs += [e for e, p in (((v, w), r.random()), ((w, v), r.random())) if p < 0.45]
    return arcs


REENTRY = [16, 8, 9, 10, 11, 12, 13, 14, 15, 23, 22, 21, 20, 19]
# The last: only opposing arrows; nothing gets from one side to the other.
CASES = {
    "random": (16, 12, None, {5, 17, 40, 77}), "remainder": (9, 7, None, set()), "blocked_half": (16, 8, None, {y * 16 + x for y in range(8) for x in range(8)}),
    "reentry": (8, 4, list(zip(REENTRY, REENTRY[1:], strict=False)), set()),
    "opposing": (16, 16, [(6, 7), (8, 7)], set()),
}


@pytest.mark.parametrize("name", CASES)
def test_index_agrees_with_search(spark, name):
    width, height, arcs, blocked = CASES[name]
    arcs = random_arcs(width, height, blocked, 3) if arcs is None else arcs
    tiled, edges = make(spark, width, height, arcs, blocked)
    want = brute(arcs)
    r = random.Random(1)
    ends = sorted(want) or [0]
    asked = [(i, r.choice(ends), r.choice(ends)) for i in range(150)] + [(150, -5, 3), (151, 2, 10**6), (152, 26, 26)]
    if name == "reentry":
        asked.append((153, 16, 19))
        assert 19 in want[16]
    pairs = spark.createDataFrame(asked, "qid long, source long, target long")
    right = {(q, s, t): s == t or t in want.get(s, ()) for q, s, t in asked}
    ports, local = grid.ports_of(tiled), tiles.local_closure(edges, tiled)
    graph = tiles.port_graph(local, ports, grid.seams_of(edges, tiled))
    levels = tiles.hierarchy(edges, tiled, tiles.tiles_across(width, 4))
    assert levels[-1].cells.select("region").distinct().count() == 1
    for got in (tiles.flat_search(pairs, local, ports, graph), tiles.flat_closure(pairs, local, ports, graph), tiles.hierarchical(pairs, levels)):
        assert {(x["qid"], x["source"], x["target"]): x["reachable"] for x in got.collect()} == right


def test_bad_sizes(spark):
    tiled, edges = make(spark, 4, 4, [(0, 1)])
    with pytest.raises(ValueError, match="a region"):
        tiles.hierarchy(edges, tiled, 1, (0, 2))
    with pytest.raises(ValueError, match="2 cells"):
        tiles.tiles_across(8, 1)


@pytest.mark.parametrize("name", ["diamond", "cycle_and_tail", "random"])
def test_intervals(spark, name):
    edges = GRAPHS[name]
    want, df = brute(edges), spark.createDataFrame(edges, "src long, dst long")
    asked = [(i, s, t) for i, (s, t) in enumerate((s, t) for s in sorted(want) for t in sorted(want))]
    labels = reach.interval_labels(df)
    got = reach.answer_by_intervals(spark.createDataFrame(asked, "qid long, source long, target long"), labels, df).collect()
    assert {r["qid"]: r["reachable"] for r in got} == {q: t in want[s] for q, s, t in asked}
    assert any(r["certified"] and r["source"] != r["target"] for r in got)


def test_density(spark):
    f = spark.createDataFrame([(v, 0.25 + (v % 2) / 2) for v in range(400)], "v long, f double")
    exact = density.estimate(f, 400)
    assert (exact.mean, exact.error, exact.sources, exact.exact) == (0.5, 0.0, 400, True)
    part = density.estimate(f.filter("v < 100"), 400)
    assert part.mean == 0.5 and part.error == pytest.approx(0.025) and not part.exact
    same = spark.createDataFrame([(v, 0.5) for v in range(400)], "v long, f double")
    assert density.stop_when_stable(same).first()["n"] == 64 + 32 * 3
    few = density.sample(f, 10)
    assert few.count() == 10 and few.distinct().count() == 10
    assert density.estimate(f.limit(0), 400).mean == 0.0 and density.stop_when_stable(f.limit(0)).count() == 0
