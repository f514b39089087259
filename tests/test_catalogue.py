import pytest
from pyspark.sql import functions as F

from gridreach import catalogue
from gridreach.operators import grid, reach

from .test_reach import brute

W, N = catalogue.W, 2300


def passable(v):
    return (v * v + 3 * v) % 11 not in (0, 4, 5, 8, 10)


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """A grid with a rest of a tile."""
    folder = str(tmp_path_factory.mktemp("parts"))
    rows = [(v, 1 if passable(v) else 4) for v in range(N)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(f"{folder}/part.parquet")
    return folder


def random_edges():
    def coin(a, b, k):
        u = (a * 7919 + b * 104729 + k * 1299709) % 1000003
        return u * u % 1000003 % 1000

    out = []
    for a in range(N):
        for b in ([a + 1] if a % W < W - 1 else []) + [a + W]:
            if b < N and passable(a) and passable(b):
                h = coin(a, b, 0)
                if h < 250 or h < 400 and coin(a, b, 1) < 500:
                    out.append((a, b))
                if h < 250 or h < 400 and coin(a, b, 1) >= 500:
                    out.append((b, a))
    return out


def test_whole_grid(spark, parts):
    """Every part is a cell; edges, tiles, closures and answers follow."""
    run = lambda name: catalogue.queries()[name](spark, parts)
    want = random_edges()
    assert {r["v"]: r["passable"] for r in run("grid_cells").collect()} == {v: passable(v) for v in range(N)}
    assert {tuple(r) for r in run("edges_random").collect()} == set(want)
    assert {r["v"]: r["tile"] for r in run("tile_assign").collect()} == {v: v // W // 4 * 13 + v % W // 4 for v in range(N)}
    around = brute(want)
    for name in ("pairs_full_closure", "pairs_two_hop", "pairs_tile_closure", "pairs_hierarchical"):
        got = run(name).filter("source >= 2000").collect()
        assert len(got) > 100 and all(r["reachable"] == (r["source"] == r["target"] or r["target"] in around.get(r["source"], ())) for r in got), name


def test_whole_workload(spark, parts):
    """All seeds of the closure and all 2000 pairs, by each search."""
    run = lambda name: catalogue.queries()[name](spark, parts)
    around = brute(random_edges())
    got = {tuple(r) for r in run("reach_set").collect()}
    assert got == {(v, v) for v in range(N) if passable(v)} | {(s, t) for s, ts in around.items() for t in ts}
    asked = {tuple(r) for r in run("pair_workload").collect()}
    right = {(q, s, t): s == t or t in around.get(s, ()) for q, s, t in asked}
    assert len(right) == 2000 and max(t for _, _, t in right) >= N - 20 and max(s for _, s, _ in right) >= N - 20  # all cells may be met
    for name in ("reach_pairs_bfs", "reach_pairs_dfs", "pairs_tile_search", "pairs_intervals"):
        assert {(r["qid"], r["source"], r["target"]): r["reachable"] for r in run(name).collect()} == right, name


def test_large_ids_and_seeds(spark, tmp_path):
    """Parts beyond a million keep apart from suppliers, rows of a relation aren't cut, and whole seeds count."""
    rows = [(1, 10**7, 4 * 10**6 + 1, 3), (1, 10**7 + 1, 2 * 10**7, 2)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    run = lambda name: {tuple(r) for r in catalogue.queries()[name](spark, str(tmp_path)).collect()}
    assert {tuple(r) for r in catalogue.supplies(spark, str(tmp_path)).collect()} == {(8 * 10**6 + 2, 2 * 10**7 + 1), (2 * 10**7 + 3, 4 * 10**7)}
    merged = {(i, j) for _, _, s, j in rows for i in (s, s + 1) if i % 3}
    assert run("bit_rows_merged") == merged
    pairs = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(0).alias("dir"))
    turned = [frozenset(tuple(r) for r in grid.orient(pairs, "random", seed=s).collect()) for s in (7, 1007, 7 + grid.PRIME, 7 + (1 << 63))]
    assert len(set(turned)) == 4


def test_all_hops(spark, tmp_path):
    """Every order's arcs, every seed divisible by 20; a part's parity turns its arc."""
    rows = [(i, (i * 7) % 23, (i * i) % 13) for i in range(60)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    arcs = {(2 * s, 2 * p + 1) if p % 2 == 0 else (2 * p + 1, 2 * s) for _, p, s in rows}
    want = set()
    for seed in {a for a, _ in arcs if a % 20 == 0}:
        seen, front, depth = {seed}, {seed}, 0
        while front:
            want |= {(seed, v, depth) for v in front}
            front, depth = {b for a, b in arcs if a in front} - seen, depth + 1
            seen |= front
    assert {tuple(r) for r in catalogue.queries()["hop_depth"](spark, str(tmp_path)).collect()} == want


def test_closure_batches(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(reach, "BATCH", 50)
    edges = [(i, (i + 1) % 30) for i in range(30)] + [(29, 30), (30, 31)]
    got = list(reach.closure_of(pd.DataFrame(edges, columns=["src", "dst"]), 1 << 20))
    want = {(s, t) for s, ts in brute(edges).items() for t in ts if s != t}
    pairs = [p for b in got for p in zip(b["src"], b["dst"], strict=True)]
    assert len(got) > 5 and len(pairs) == len(want) and set(pairs) == want
