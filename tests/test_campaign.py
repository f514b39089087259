import random

import pytest
from pyspark.sql import functions as F

from gridreach import campaign
from gridreach.functions import formats, terrain, text
from gridreach.operators import bits, components, generators, grid, measures, reach, tiles
from gridreach.sources import campaigns, maps, pictures, recipes

from .test_reach import brute
from .test_tiles import CASES, make, random_arcs


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_formats():
    assert [formats.nanoseconds(x) for x in (999, 1500, 2.5e6, 3e9)] == ["999 ns", "1.50 us", "2.50 ms", "3.00 s"]
    assert [formats.size(x) for x in (1023, 1536, 3 << 20, 5 << 30, 7 << 40)] == ["1023 B", "1.50 KiB", "3.00 MiB", "5.00 GiB", "7.00 TiB"]
    assert [formats.count(x) for x in (9999, 10000, 2500000, 3 * 10**9, 4 * 10**12)] == ["9999", "10.00 K", "2.50 M", "3.00 B", "4.00 T"]
    assert [formats.speedup(x) for x in (0, float("inf"), 2, 0.01, 0.0099, 0.00001)] == ["-", "-", "2.00x", "0.01x", "0.0099x", "<0.0001x"]
    assert (formats.progress(5, 20000), formats.build_time(1_500_000), formats.build_size(1536), formats.build_size(12)) == ("5 / 20.00 K", "1.5 ms", "1.5 KiB", "12 B")
    assert (formats.status_name(formats.Status.SKIPPED), formats.status_name(7), formats.answer_name(True), formats.answer_name(None)) == ("SkippedByPolicy", "UnknownStatus", "Reachable", "UnknownAnswer")
    assert text.fnv1a(b"") == 0xCBF29CE484222325 and text.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert text.file_name("a b/c-1.map") == "a_b_c-1.map"


def test_name_filter(spark):
    names = spark.createDataFrame([("Arena2.map",), ("lak[1].map",), (None,)], "n string")
    got = lambda w: [r[0] for r in names.select(text.matches(F.col("n"), w)).collect()]
    assert got("") == [True, True, False] and got("RENA") == [True, False, False]
    assert got("a?ena*") == [True, False, False] and got("a?ena") == [False, False, False] and got("*[1]*") == [False, True, False]


def test_maps(spark, tmp_path):
    good = "width 9\ntype octile\nheight 2\r\n\nwidth 2\nmap\n.@x\nTG\nrest"
    bad = {"odd": "colour 1\nmap\n", "open": "height 1\nwidth 1\n", "none": "height 1\nmap\n.", "short": "height 2\nwidth 2\nmap\n..\n.", "few": "height 3\nwidth 1\nmap\n.\n.\n", "huge": "height 99999\nwidth 99999\nmap\n."}
    for k, v in {"good": good, **bad}.items():
        (tmp_path / "s1" / "maps").mkdir(parents=True, exist_ok=True)
        (tmp_path / "s1" / "maps" / f"{k}.map").write_text(v)
    read = maps.texts(spark, str(tmp_path)).withColumn("name", F.regexp_extract("name", r"([^/]+)\.map$", 1))
    assert rows(maps.parse(read).select("x", "y", "v", "ch")) == [(0, 0, 0, "."), (0, 1, 2, "T"), (1, 0, 1, "@"), (1, 1, 3, "G")]
    assert {r["name"]: r["error"] for r in maps.errors(read).collect()} == {
        "odd": "unrecognized header line: colour 1", "open": "no line 'map' after the header", "none": "no positive width or height",
        "short": "row 1 is shorter than the width", "few": "2 of 3 rows", "huge": "too many cells",
    }
    assert [tuple(r)[:2] for r in maps.discover(spark, str(tmp_path)).collect()] == sorted(("s1", f"{k}.map") for k in ("good", *bad))
    cells = maps.parse(read)
    assert rows(maps.layout(cells, "GroundOnly").select("v", "passable")) == [(0, True), (1, False), (2, False), (3, True)]
    asked = spark.createDataFrame([("good", 1, 1), ("good", 2, 0), ("gone", 0, 0)], "name string, x int, y int")
    assert rows(maps.cells_at(cells, asked).select("x", "ch", "terrain")) == [(0, "@", "out_of_bounds"), (1, "G", "ground"), (2, "@", "out_of_bounds")]
    sized = spark.createDataFrame([("a", "x", 5), ("a", "b", 5), ("a", "c", 9), ("b", "y", 10001), ("c", "z", None)], "set string, map string, cells long")
    assert rows(maps.smallest_per_set(sized)) == [("a", "b", 5)]


@pytest.mark.parametrize(("policy", "want"), list(zip(terrain.POLICIES, [".G", ".GS", ".GSW", ".GSWX"], strict=True)))
def test_policies(spark, policy, want):
    df = spark.createDataFrame([(c,) for c in ".GTSW@OXq"], "c string")
    assert "".join(r["c"] for r in df.filter(terrain.is_passable(F.col("c"), policy)).collect()) == want


def test_recipes(spark, tmp_path):
    folder = str(tmp_path / "recipes")
    assert recipes.load(spark, folder).collect() == []
    r = recipes.Recipe("s 1", "m.map", "ground_only", "gradient_flow", 0xFFFFFFFFFFFFFFFF, gradient_angle_degrees=30.5)
    path = recipes.save(spark, folder, r)
    assert path == recipes.save(spark, folder, r) and "/s_1__m.map__gradient_flow__ffffffffffffffff__" in path
    (tmp_path / "recipes" / "old.json").write_text('{"set":"s 1","map":"m.map","policy":"ground_only","mode":"acyclic_east_south","seed": 7, "p_one_way": "x"}')
    (tmp_path / "recipes" / "bad.json").write_text('{"set":"s 1","map":"m.map","policy":"nobody","mode":"acyclic_east_south","seed": 7}')
    got = [recipes.recipe_of(x) for x in recipes.for_map(spark, folder, "s 1", "m.map").collect()]
    assert len(got) == 2 and r in got and recipes.Recipe("s 1", "m.map", "ground_only", "acyclic_east_south", 7) in got
    assert recipes.delete(spark, path) and not recipes.delete(spark, path) and recipes.load(spark, folder).count() == 1
    (tmp_path / "d" / "s" / "maps").mkdir(parents=True)
    (tmp_path / "d" / "s" / "maps" / "m.map").write_text("height 1\nwidth 3\nmap\n..G\n")
    cells, edges, width, height = recipes.graph(spark, str(tmp_path / "d"), recipes.Recipe("s", "m.map", "ground_only", "acyclic_east_south", 1))
    assert (cells.count(), rows(edges), width, height) == (3, [(0, 1), (1, 2)], 3, 1)


def test_chances():
    nan = float("nan")
    assert grid.sanitized(0.9, 0.9) == grid.Chances(0.5, 0.5, 0.05, 45.0) and grid.sanitized(nan, -1, 7, nan) == grid.Chances(0, 0, 1, 45.0)


def test_gradient_angle(spark):
    cells = generators.walled_grid(spark, 6, 6)
    pairs = grid.adjacent_pairs(cells, 6)
    flow = lambda angle: rows(grid.orient(pairs, "gradient", 0, 0, 0, angle=angle))
    step = lambda e: (e[1] - e[0])
    assert {step(e) for e in flow(30)} == {1, 6} and {step(e) for e in flow(225)} == {-1, -6} and {step(e) for e in flow(135)} == {-1, 6}
    assert {step(e) for e in flow(0)} == {1, 6, -6}  # at right angles: either way
    assert {step(e) for e in rows(grid.orient(pairs, "gradient", 0, 0, 1, angle=30))} == {-1, -6}


def test_grid_points(spark):
    cells = generators.walled_grid(spark, 3, 2)
    changed = grid.set_passable(cells, spark.createDataFrame([(4, False), (99, True)], "v long, passable boolean"))
    assert [r["v"] for r in changed.filter("NOT passable").collect()] == [4] and changed.count() == 6
    asked = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (1, 3), (77, 0), (3, 2)], "v long, dir int")
    assert rows(grid.neighbors(changed, asked)) == rows(spark.createDataFrame([(1, 0, 2), (1, 1, None), (1, 2, 0), (1, 3, None), (77, 0, None), (3, 2, None)], "v long, dir int, next long"))
    e = spark.createDataFrame([(0, 1), (0, 1), (1, 1)], "src long, dst long")
    assert rows(grid.checked_edges(e, 2)) == [(0, 1), (1, 1)] and grid.csr_bytes(4, 2) == 28
    with pytest.raises(Exception, match="leaves the 1 vertices"):
        grid.checked_edges(e, 1).collect()


@pytest.mark.parametrize(("w", "h", "seed"), [(1, 1, 0), (5, 4, 1), (8, 8, 2), (1, 6, 3)])
def test_mazes(spark, w, h, seed):
    maze = generators.perfect_maze(spark, w, h, seed)
    open_ = {(r["x"], r["y"]) for r in maze.filter("passable").collect()}
    assert maze.count() == (2 * w + 1) * (2 * h + 1) and all(0 < x < 2 * w and 0 < y < 2 * h for x, y in open_)
    assert len(open_) == 2 * w * h - 1  # rooms, and an opening for each but one
    arcs = [(a, b) for a in open_ for b in ((a[0] + 1, a[1]), (a[0], a[1] + 1)) if b in open_]
    assert len(brute(arcs + [(b, a) for a, b in arcs]).get((1, 1), {(1, 1)})) == len(open_)
    more = generators.open_walls(maze, 3, seed).filter("passable").count()
    assert more == min(len(open_) + 3, len(open_) + (w - 1) * h + w * (h - 1) - (w * h - 1))
    assert generators.perfect_maze(spark, 0, 3).count() == 0


def test_graphs(spark):
    assert rows(generators.chain(spark, 3)) == [(0, 1), (1, 2)] and rows(generators.cycle(spark, 3)) == [(0, 1), (1, 2), (2, 0)]
    assert rows(generators.complete(spark, 3)) == [(a, b) for a in range(3) for b in range(3) if a != b]
    assert rows(generators.star(spark, 3)) == [(0, 1), (0, 2)] and rows(generators.star(spark, 3, False)) == [(1, 0), (2, 0)]
    full = {tuple(r) for r in generators.random_graph(spark, 40, 1.0).collect()}
    some = {tuple(r) for r in generators.random_graph(spark, 40, 0.3).collect()}
    assert len(full) == 40 * 39 and some < full and 300 < len(some) < 640
    apart = rows(generators.separate_random_graphs(spark, 11, 3, 1.0))
    assert len(apart) == 4 * 3 + 4 * 3 + 3 * 2 and all((a < 4) == (b < 4) and (a < 8) == (b < 8) for a, b in apart)
    assert all(a < 5 <= b < 10 for a, b in rows(generators.bipartite(spark, 10, 0.5)))
    for make_ in (generators.chain, generators.cycle, generators.complete, generators.star):
        assert make_(spark, 0).count() == 0


def test_bits(spark):
    m = spark.createDataFrame([(0, 1), (1, 2)], "i long, j long")
    more = bits.set_bits(m, spark.createDataFrame([(0, 0), (0, 9), (2, 2)], "i long, j long"), i=3, j=3)
    assert rows(more) == [(0, 0), (0, 1), (1, 2), (2, 2)]
    assert rows(bits.reset_bits(more, spark.createDataFrame([(0,)], "i long"))) == [(1, 2), (2, 2)]
    assert rows(bits.are_set(more, spark.createDataFrame([(0, 0), (2, 0)], "i long, j long"))) == [(0, 0, True), (2, 0, False)]
    assert rows(bits.or_rows(m, spark.createDataFrame([(1, 0)], "source long, target long"))) == [(0, 1), (0, 2), (1, 2)]
    assert rows(bits.row_counts(more)) == [(0, 2), (1, 1), (2, 1)] and rows(bits.column_counts(more)) == [(0, 1), (1, 1), (2, 2)]
    assert bits.equal(m, m.union(m)) and not bits.equal(m, more) and bits.memory_bytes(3, 65) == 48


def test_measures(spark):
    r = random.Random(3)
    data = {m: [r.randrange(50) for _ in range(n)] for m, n in (("a", 40), ("b", 7), ("c", 1))}
    df = spark.createDataFrame([(m, x) for m, xs in data.items() for x in xs] + [("d", None)], "method string, ns long")
    for row in measures.timing_statistics(df, ["method"]).collect():
        x = sorted(data[row["method"]])
        n = len(x)
        assert (row["count"], row["total_ns"], row["median_ns"], row["p95_ns"], row["min_ns"], row["max_ns"]) == (n, sum(x), x[n // 2], x[min(n - 1, int(n * 0.95))], x[0], x[-1])
    for row in measures.order_statistics(df, ["method"], "ns", {"p10": 0.1, "p50": 0.5, "p90": 0.9}).collect():
        x = sorted(data[row["method"]])
        assert (row["p10"], row["p50"], row["p90"]) == tuple(x[int(q * (len(x) - 1))] for q in (0.1, 0.5, 0.9))
    runs = spark.createDataFrame([("m", "CsrBfs", "Completed", 10, 0, 10, 90, 9.0), ("m", "x", "Completed", 10, 30, 10, 10, 1.0), ("m", "y", "Failed", 0, 1, 1, 1, 1.0), ("n", "x", "Completed", 1, 1, 1, 1, 1.0)],
        "map string, method string, status string, count long, preprocess_ns long, warmup_ns long, query_ns long, mean_ns double")
    got = {(x["map"], x["method"]): (x["total_ns"], x["speedup"], x["total_speedup"]) for x in measures.speedups(runs, ["map"]).collect()}
    assert got == {("m", "CsrBfs"): (100, 1, 1), ("m", "x"): (50, 9, 2), ("m", "y"): (3, 0, 0), ("n", "x"): (3, 0, 0)}
    answers = spark.createDataFrame([(0, True, True), (1, False, False), (2, None, False), (3, True, False)], "qid long, reachable boolean, certified boolean")
    assert rows(measures.answer_counts(answers, [])) == [(4, 2, 2, 0.5, 1, 3)]
    want = spark.createDataFrame([(0, True), (1, True), (3, False)], "qid long, reachable boolean")
    assert rows(measures.mismatches(answers, want)) == [(3, 2)] and rows(measures.mismatches(answers, want, 2)) == [(2, 1)]
    results = spark.createDataFrame([("m", "x", "c", "Completed", 0, "k", 5.0), ("n", "y", "c", "Completed", 0, "k", 5.0), ("n", "z", "c", "Completed", 2, "k", 9.0), ("n", "w", "c", "Failed", 0, None, 9.0), ("o", "x", "c", "Completed", 0, "", 1.0)],
        "map_id string, method string, config_id string, status string, correctness_mismatches long, map_class string, queries_per_second double")
    assert rows(measures.best_by_class(results)) == [("k", "m", "x", "c", 5.0), ("unknown", "o", "x", "c", 1.0)]
    jobs = results.select("map_id", "method", "config_id").union(spark.createDataFrame([("q", "x", "c")], "a string, b string, c string"))
    assert rows(measures.remaining(jobs, results)) == [("n", "w", "c"), ("q", "x", "c")]
    kinds = spark.createDataFrame([("movingai", 0, "x"), ("procedural_maze", 0, "x"), ("procedural_maze", 4, None), ("smoke_grid", 0, "x"), ("other", 0, "mode"), ("other", 0, ""), (None, 0, None)], "g string, n int, o string")
    assert [r[0] for r in kinds.select(measures.map_class(F.col("g"), F.col("n"), F.col("o"))).collect()] == ["movingai", "perfect_maze", "cyclic_maze", "smoke_grid", "mode", "other", "unknown"]
    pairs = spark.createDataFrame([(1, 2, 3), (0, 7, 8)], "qid long, source long, target long")
    assert measures.workload_hash(pairs) == text.fnv1a(b"".join(x.to_bytes(4, "little") for x in (2, 7, 8, 2, 3)))
    assert measures.stop_early(100, 0, 50, 4, 64) and not measures.stop_early(100, 0, 50, 3, 64) and not measures.stop_early(0, 0, 50, 4, 64)


def test_components(spark):
    e = spark.createDataFrame([(5, 9), (9, 7), (70000, 70001)], "src long, dst long")
    labels = components.with_isolated(components.connected_components(e), spark.createDataFrame([(v,) for v in (2, 5, 7, 9, 70000, 70001)], "v long"))
    assert rows(components.dense_labels(labels)) == rows(spark.createDataFrame([(2, 2, 0), (5, 5, 1), (7, 5, 1), (9, 5, 1), (70000, 70000, 2), (70001, 70000, 2)], "v long, c long, l long"))
    probe = spark.createDataFrame([(9,), (3,)], "v long")
    assert rows(components.members(labels, probe)) == [(9, 5), (9, 7), (9, 9)]
    assert rows(components.component_of(labels, probe)) == [(3, 0), (9, 5)]
    assert [tuple(r) for r in components.size_histogram(labels, spark.createDataFrame([(7,), (9,), (2,)], "v long")).collect()] == [(5, 2), (2, 1)]


@pytest.mark.parametrize("closed", [False, True])
def test_component_answers(spark, closed):
    r = random.Random(8)
    edges = [(r.randrange(30), r.randrange(30)) for _ in range(45)]
    want, df = brute(edges), spark.createDataFrame(edges, "src long, dst long")
    asked = [(i * 40 + j, i, j) for i in range(32) for j in range(32)]
    got = reach.answer_by_components(spark.createDataFrame(asked, "qid long, source long, target long"), df, reach.strong_components(df), closed)
    assert {x["qid"]: x["reachable"] for x in got.collect()} == {q: s == t or t in want.get(s, ()) for q, s, t in asked}


def test_squaring_bounds(spark):
    assert [reach.squarings(n) for n in (0, 1, 2, 3, 4, 5, 64, 65)] == [0, 0, 1, 2, 2, 3, 6, 7]
    chain = [e for k in range(10) for e in ((2 * k, 2 * k + 1), (2 * k + 1, 2 * k), (2 * k + 1, 2 * k + 2)) if max(e) < 20]
    assert rows(reach.squaring_bounds(spark.createDataFrame(chain, "src long, dst long"))) == [(20, 10, 2, 5, 4)]


@pytest.mark.parametrize("name", ["random", "remainder", "opposing"])
def test_index(spark, name):
    width, height, arcs, blocked = CASES[name]
    arcs = random_arcs(width, height, blocked, 3) if arcs is None else arcs
    tiled, edges = make(spark, width, height, arcs, blocked)
    r, want = random.Random(2), brute(arcs)
    asked = [(i, r.randrange(width * height), r.randrange(width * height)) for i in range(120)]
    pairs = spark.createDataFrame(asked, "qid long, source long, target long")
    right = {q: s == t or t in want.get(s, ()) for q, s, t in asked}
    index = tiles.build(edges, tiled, width, 4, max_depth=2)
    low = tiles.hierarchical(pairs, index.levels, (index.local, index.ports, index.graph))
    assert {x["qid"]: x["reachable"] for x in low.collect()} == right
    several = index.levels[-1].cells.select("region").distinct().count() > 1
    alone = {x["qid"]: x["reachable"] for x in tiles.hierarchical(pairs, index.levels).collect()}
    assert all(v == right[q] for q, v in alone.items() if v is not None) and (several or None not in alone.values())
    for level in index.levels[1:]:
        assert tiles.differences(level, edges).count() == 0
    tree = rows(tiles.region_tree(index.levels))
    assert {r for k, r, _ in tree if k == 0} == {x["tile"] for x in tiled.select("tile").distinct().collect()}
    assert all((p is None) == (k == len(index.levels) - 1) for k, _, p in tree)
    assert [x["regions"] for x in tiles.level_statistics(index.levels).orderBy("level").collect()] == [sum(k == i for k, _, _ in tree) for i in range(len(index.levels))]
    with pytest.raises(reach.SkippedByPolicy):
        tiles.build(edges, tiled, width, 4, memory_cap=8)


def test_ledger():
    ledger = tiles.Ledger(100)
    assert ledger.charge(60) and not ledger.charge(41) and ledger.charge(40) and ledger.charged == 100
    ledger.release(50)
    assert ledger.charge(0) and ledger.charged == 50 and tiles.Ledger().charge(10**18)
    with pytest.raises(ValueError, match="more released"):
        ledger.release(51)


def test_ports(spark):
    tiled, _ = make(spark, 9, 7, [], {0, 4, 30})
    found = grid.boundary(tiled).filter("tile = 0").orderBy("place").collect()
    assert [x["v"] for x in found] == [0, 1, 2, 3, 12, 21, 30, 27, 28, 29, 9, 18] and "".join(x["side"] for x in found) == "NNNNEEESSSWW"
    ports = sorted(tuple(x) for x in grid.port_index(tiled).collect())
    order = sorted((x["tile"], x["place"], x["v"]) for x in grid.boundary(tiled).collect())
    kept = [(t, v) for t, _, v in order if v not in {0, 4, 30}]
    assert [(t, v) for _, t, _, v in ports] == kept and [p for p, *_ in ports] == list(range(len(kept)))
    assert all(sum(t2 == t for _, t2, _, _ in ports[:i]) == place for i, (_, t, place, _) in enumerate(ports))


def test_pictures(spark, tmp_path):
    cells = grid.set_passable(generators.walled_grid(spark, 2, 2), spark.createDataFrame([(1, False)], "v long, passable boolean"))
    path = f"{tmp_path}/a.ppm"
    value = pictures.write_ppm(spark, cells, path)
    want = "P3\n2 2\n255\n222 222 214 28 28 32 \n222 222 214 222 222 214 \n"
    assert (tmp_path / "a.ppm").read_text() == want and value == text.fnv1a(want.encode())
    edges = spark.createDataFrame([(0, 2)], "src long, dst long")
    got = pictures.svg(cells, edges, 12.5, "a & b").splitlines()
    assert got[0] == '<svg xmlns="http://www.w3.org/2000/svg" width="25" height="25">' and got[-1] == "</svg>" and len(got) == 8
    assert got[2] == '<rect x="12.5" y="0" width="12.5" height="12.5" fill="#cccccc" stroke="#666666"/>'
    assert got[5] == '<line x1="6.25" y1="6.25" x2="6.25" y2="18.75" stroke="#3366cc"/>' and got[6] == '<text x="4" y="9.375">a &amp; b</text>'
    small = {(x["x"], x["y"]): x["share"] for x in pictures.shrunk(cells, 1).collect()}
    assert small == {(0, 0): 0.75} and pictures.shrunk(cells, 2).count() == 4


def test_campaign_names():
    assert campaign.method_names("bfs,FullClosure,warshall") == ["CsrBfs", "FullClosure"]
    with pytest.raises(ValueError, match="unknown method: x"):
        campaign.method_names("x")
    assert campaign.preset(None).methods == campaign.METHODS and campaign.preset("CSR").methods[0] == "CsrBfs" and campaign.preset("no").queries == 256
    base = campaign.preset("smoke")
    assert [len(campaign.sweep(base, s)) for s in ("", "tile", "threads", "tiles", "hierarchy", "all", "tile,tiles")] == [1, 2, 2, 4, 4, 6, 4]
    assert campaign.sweep(base)[0].id == "t4x4_k0_mem512m_hg2x2_dfull"
    with pytest.raises(ValueError, match="unknown sweep"):
        campaign.sweep(base, "x")


def test_campaign(spark, tmp_path):
    """All methods answer alike; what is completed is not run again; tables and summary are read back."""
    folder, small = str(tmp_path / "c"), campaign.smoke_map(spark)
    config = campaign.Config(queries=40, batches=1, warmups=0, checks=40)
    first = campaign.record(spark, folder, small, config)
    assert {(x["method"], x["status"], x["correctness_checks"], x["correctness_mismatches"]) for x in first.collect()} == {(m, "Completed", 40, 0) for m in campaign.METHODS}
    assert campaign.record(spark, folder, small, config).count() == 0
    results = campaigns.read(spark, folder, "results")
    assert results.count() == 10 and results.filter("map_class = 'smoke_grid' AND num_vertices = 64").count() == 10
    capped = campaign.run(spark, small, campaign.replace(config, methods=("CsrBfs", "FullClosure"), memory_cap=8))
    assert {x["method"]: x["status"] for x in capped.collect()} == {"CsrBfs": "Completed", "FullClosure": "SkippedByPolicy"}
    line = campaigns.read(spark, folder, "manifest").first()
    assert (line["grid_width"], line["passable_cells"], line["undirected_component_count"], line["largest_undirected_component"]) == (8, 64, 1, 64)
    page = (tmp_path / "c" / "summary.md") if campaigns.summary(spark, folder, {"a": 1}) else None
    assert page.read_text().count("| smoke_8x8 |") == 11
