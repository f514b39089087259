"""What must not grow with the tables: plans without broadcasts of them, closures by connected parts, trees without closures."""

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from gridreach import campaign, catalogue
from gridreach.operators import blocks, components, generators, grid, reach, tiles
from gridreach.plans.checkpoints import written

from .test_blocks import hops
from .test_tiles import make, random_arcs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tree_is_that_of_the_hierarchy(spark):
    for width, height, group, depth in ((16, 12, (2, 2), 64), (9, 31, (2, 3), 64), (16, 12, (2, 2), 2), (16, 12, (1, 1), 64)):
        tiled, edges = make(spark, width, height, random_arcs(width, height, set(), 3), set())
        across = tiles.tiles_across(width, 4)
        want = sorted(map(str, tiles.region_tree(tiles.hierarchy(edges, tiled, across, group, depth)).collect()))
        assert sorted(map(str, tiles.tree(tiled, across, group, depth).collect())) == want


def test_cap_is_of_a_connected_part():
    pdf = pd.DataFrame({"src": range(0, 2000, 2), "dst": range(1, 2001, 2)})
    assert sum(map(len, reach.closure_of(pdf, 16))) == 1000
    with pytest.raises(reach.SkippedByPolicy):
        list(reach.closure_of(pd.DataFrame({"src": [0, 1], "dst": [1, 2]}), 16))


def test_level_sides_are_not_broadcast(spark):
    tiled, edges = make(spark, 16, 12, random_arcs(16, 12, set(), 3), set())
    levels = tiles.hierarchy(edges, tiled, 4)
    assert all("Broadcast" not in plan(tiles.summary(level)) for level in levels)


def test_complete_in_strips(spark):
    for n in (0, 1, 2, 1023, 1025):
        got = generators.complete(spark, n)
        assert got.count() == n * max(0, n - 1) == got.filter(f"src BETWEEN 0 AND {n - 1} AND dst BETWEEN 0 AND {n - 1} AND src <> dst").distinct().count()
    first = generators.complete(spark, 1500).limit(2048).collect()
    assert len({r.src for r in first}) == 3 and max(r.dst for r in first) < 1024


def test_complete_is_many_tasks(spark):
    """More arcs are more tasks, none of them longer, and no arc divides by a number that changes."""
    for n in (3, 20_000, 360_000):
        got = generators.complete(spark, n)
        assert got.rdd.getNumPartitions() >= n * n >> 26
        assert "least(" not in plan(got)
    for n in (1024, 2047, 2049):
        got = generators.complete(spark, n)
        row = got.selectExpr("count(*)", "sum(src)", "sum(dst)", "count(DISTINCT src * 4096 + dst)", "count_if(src = dst)", "max(src)", "max(dst)").first()
        assert tuple(row) == (n * (n - 1), n * (n - 1) // 2 * (n - 1), n * (n - 1) // 2 * (n - 1), n * (n - 1), 0, n - 1, n - 1)


def test_search_sides_are_not_broadcast(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)], "src long, dst long")
    assert "BroadcastHashJoin" not in plan(reach.reached(edges, edges.select(edges.src.alias("seed"))))


def test_numbers_of_a_large_block_take_turns(monkeypatch):
    monkeypatch.setattr(blocks, "_ROWS", 8 * 5 * 3)  # three sources of five vertices
    widths = []
    spread = blocks._Block.spread_least
    monkeypatch.setattr(blocks._Block, "spread_least", lambda self, rows, step: widths.append(rows.shape[1]) or spread(self, rows, step))
    packed = [np.array([0, 1, 2]), np.array([1, 3, 3], np.int32), np.array([1, 2, -1], np.int32), np.array([7])]
    arrivals = [{"v": b % 3, "bit": b, "value": 10 * b} for b in range(8)]
    row = {"group": [5], "pieces": [1], **{k: [x.tobytes()] for k, x in zip(("ids", "ends", "targets", "far"), packed, strict=True)}, "arrivals": pa.array([arrivals], pa.list_(pa.struct([("v", pa.int64()), ("bit", pa.int32()), ("value", pa.int64())])))}
    batch = pa.RecordBatch.from_pydict(row)
    found = {(r["v"], r["bit"], r["value"]) for b in blocks._relax(8, 1, False)([batch]) for r in b.to_pylist()}
    assert found == {(7, b, 10 * b + 2 - b % 3 if b % 3 < 1 else 10 * b + 1) for b in range(8) if b % 3 < 2} and max(widths) <= 3


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    out = run()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)), out


def test_jobs_of_components_follow_ranges_not_hops(spark):
    """A chain of any length is as many jobs."""
    for k, found in enumerate((reach.strong_components, components.near_components)):
        few, many = (jobs(spark, f"{k}-{n}", lambda n=n: found(spark.range(n).selectExpr("id AS src", "id + 1 AS dst")).count()) for n in (200, 60_000))
        assert (few[1], many[1]) == (201, 60_001) and many[0] <= few[0] + 12


def test_components_by_ranges(spark):
    """Ranges of 8 ids, short arcs and a few long ones, a full range, and what one task isn't to connect."""
    draw = np.random.default_rng(5)
    src = draw.integers(0, 200, 230)
    arcs = {(int(a), int(a + d)) for a, d in zip(src, draw.integers(-3, 4, 230), strict=True)} | {(3, 190), (191, 2), (150, 20), (60, 61), (61, 60)}
    after = {}
    for a, b in arcs:
        after.setdefault(a, set()).add(b)

    def all_from(v, step):
        seen, left = {v}, [v]
        while left:
            fresh = step.get(left.pop(), set()) - seen
            seen |= fresh
            left += fresh
        return seen

    named = {v for a, b in arcs if a != b for v in (a, b)}
    reached = {v: all_from(v, after) for v in named}
    df = spark.createDataFrame(sorted(arcs), "src long, dst long")
    for task_edges in (5, 1000):
        assert dict(map(tuple, reach.strong_components(df, task_edges, 8).collect())) == {v: min(w for w in reached[v] if v in reached[w]) for v in named}
    both = {v: {w for a, b in arcs for w, x in ((a, b), (b, a)) if x == v} for v in named}
    for rest in (0, 1000):
        got = components.near_components(df, size=8, rest=rest).collect()
        assert len(got) == len(named) and dict(map(tuple, got)) == {v: min(all_from(v, both)) for v in named}


def test_jobs_of_a_profile_do_not_follow_the_map(spark):
    def row(high):
        cells = grid.with_coordinates(spark.range(2 * high).selectExpr("id AS v", "true AS passable"), 2)
        return campaign.profile(campaign.Map("m", cells, grid.orient(grid.adjacent_pairs(cells, 2), "acyclic"), 2, high)).first()

    few, many = (jobs(spark, f"profile-{high}", lambda high=high: row(high)) for high in (50, 20_000))
    assert (many[1].largest_undirected_component, many[1].num_sccs, many[1].condensation_edges) == (40_000, 40_000, 59_998) and many[0] <= few[0] + 20


def test_closures_are_not_broadcast_to_pairs(spark):
    """The asked pairs go to the tasks, however large their plan's estimate; the index stays where it is."""
    tiled, edges = make(spark, 16, 12, random_arcs(16, 12, set(), 3), set())
    index = tiles.build(edges, tiled, 16, 4)
    asked = spark.range(60).selectExpr("id AS qid", "id AS source", "(id * 7) % 192 AS target")
    asked = asked.join(asked.select("qid"), "qid").checkpoint()
    local, ports = written(index.local), written(index.ports)
    for df in (*tiles._entries(asked, local, ports), reach.answer_by_labels(asked, *map(written, reach.landmark_labels(edges)))):
        for line in plan(df).splitlines():
            assert "BroadcastHashJoin" not in line or "Inner, BuildLeft" in line or "LeftOuter" in line
    up = tiles._entries(asked, local, ports)[1]
    assert up.join(local.withColumnRenamed("src", "p"), "p")._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 1


def broadcasts(spark, since):
    """Plans that ran after execution ``since`` with a side of a join broadcast by key, and the last execution's number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = spark._jsparkSession.sharedState().statusStore().executionsList()
    ran = [x for x in map(ran.apply, range(ran.size())) if x.executionId() > since]
    return [x.physicalPlanDescription() for x in ran if "BroadcastHashJoin" in x.physicalPlanDescription()], max((x.executionId() for x in ran), default=since)


def test_level_statistics_broadcasts_no_side(spark, tmp_path):
    """In none of the plans that run for the query, from its edges to its counts; small sides are what would be broadcast."""
    rows = [(v, 4 if v * v % 11 in (1, 9) else 1) for v in range(600)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    _, before = broadcasts(spark, -1)
    got = catalogue.queries()["level_statistics"](spark, str(tmp_path)).orderBy("level").collect()
    sent, last = broadcasts(spark, before)
    assert not sent and last > before
    part = duckdb.read_parquet(f"{tmp_path}/part.parquet/*.parquet")  # noqa: F841 named in the SQL
    assert list(map(tuple, got)) == sorted(duckdb.sql(catalogue.oracle_sql()["level_statistics"]).fetchall()) and len(got) == 5


def test_short_searches_pack_nothing(spark, tmp_path, monkeypatch):
    """A search that ends after few hops is joins alone, repeated arcs and all; equal to SQL."""
    rows = [(i, (i * 7) % 23, (i * i) % 13) for i in range(60)] * 2
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(blocks, "build", None)
    got = catalogue.queries()["hop_depth"](spark, str(tmp_path)).collect()
    lineitem = duckdb.read_parquet(f"{tmp_path}/lineitem.parquet/*.parquet")  # noqa: F841 named in the SQL
    assert sorted(map(tuple, got)) == sorted(duckdb.sql(catalogue.oracle_sql()["hop_depth"]).fetchall()) and len(got) > 2


@pytest.mark.parametrize("few", [0, 1000])
def test_searches_go_on_after_joins(spark, monkeypatch, few):
    """What the joined hops leave open is found by blocks, also where a long way is met before a short one; sides are sent to all tasks or not."""
    monkeypatch.setattr(reach, "FEW", few)
    draw = np.random.default_rng(3)
    arcs = [(i, i + 1) for i in range(40)] + [(0, 100), (100, 101), (101, 102), (102, 200), (200, 25), (39, 0), (7, 7), (50, 3), (3, 4)]
    arcs += [(int(a), int(b)) for a, b in draw.integers(300, 340, (45, 2))]
    seeds = sorted({v for arc in arcs for v in arc})[::3]
    want = {(s, v, d) for s in seeds for v, d in hops([(a, b) for a, b in arcs if a != b])[s].items()} | {(10**17, 10**17, 0)}
    got = reach.frontier(spark.createDataFrame(arcs, "src long, dst long"), spark.createDataFrame([(s,) for s in [*seeds, 10**17, None]], "seed long")).collect()
    assert max(d for *_, d in want) > 2 * reach.HOPS
    assert len(got) == len(want) and set(map(tuple, got)) == want
