"""Benchmark campaigns: methods run over one workload of pairs, timed, checked against a search and recorded.

A batch of pairs is one Spark job, so its time is shared evenly by its pairs: statistics are over
repeated batches. A campaign is a folder (``sources.campaigns``); a run that is already completed
there is not repeated.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from itertools import product
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.formats import Status
from .operators import components, generators, grid, measures, reach, tiles
from .plans.checkpoints import cut_compact
from .sources import campaigns, pictures, recipes

#: Methods by name; a search comes first, as the others are measured against it.
METHODS = ("CsrBfs", "CsrDfs", "SccDagSearch", "SccDagClosure", "TwoHop", "Grail", "TileSearch", "TileClosure", "FullClosure", "Hierarchy")
ALIASES = {"bfs": "CsrBfs", "dfs": "CsrDfs", "warshall": "FullClosure"} | {m.lower(): m for m in METHODS}
_ON_TILES = ("TileSearch", "TileClosure", "Hierarchy")


@dataclass(frozen=True)
class Config:
    """How methods are built and how much is asked. ``max_depth`` None: up to one region; ``memory_cap``: bytes of a closure's bit rows."""

    methods: tuple[str, ...] = METHODS
    queries: int = 256
    batches: int = 3
    warmups: int = 1
    checks: int = 32
    pair_seed: int = 0xCA0151
    tile: int = 4
    group: tuple[int, int] = (2, 2)
    max_depth: int | None = None
    memory_cap: int = 512 << 20
    parallel: bool = False  # Spark decides on parallelism: the flag is recorded only
    threads: int = 0
    early_stop: bool = False

    @property
    def id(self) -> str:
        threads = f"n{self.threads}" if self.parallel else ""
        depth = "full" if self.max_depth is None else self.max_depth
        return f"t{self.tile}x{self.tile}_k{int(self.parallel)}{threads}_mem{self.memory_cap >> 20}m_hg{self.group[0]}x{self.group[1]}_d{depth}" + ("_ces1" if self.early_stop else "")


PRESETS = {
    "all": Config(), "smoke": Config(("CsrBfs", *_ON_TILES), queries=64, checks=16), "csr": Config(tuple(m for m in METHODS if m not in _ON_TILES)),
    "tiles": Config(_ON_TILES), "closure-oracle": Config(("FullClosure", "SccDagClosure", "TileClosure"), queries=64),
}


def preset(name: str | None) -> Config:
    """A preset by name in either case; none is all methods, an unknown one the quick set."""
    return PRESETS["all"] if not name else PRESETS.get(name.lower()) or replace(PRESETS["smoke"], queries=256, checks=32)


def method_names(names: str | list[str]) -> list[str]:
    """Methods by names or aliases in either case (a list, or joined by commas), each once."""
    wanted = [n for n in (names.split(",") if isinstance(names, str) else names) if n]
    unknown = [n for n in wanted if n.lower() not in ALIASES]
    if unknown or not wanted:
        raise ValueError(f"unknown method: {unknown[0]}" if unknown else "no method")
    return list(dict.fromkeys(ALIASES[n.lower()] for n in wanted))


_TILES = [{"tile": t} for t in (4, 8)]
_FLAGS = [{"parallel": p, "threads": 0} for p in (False, True)]
_DEPTHS = [{"group": (2, 2), "max_depth": d} for d in (2, None)]
#: What each sweep varies.
SWEEPS = {"default": [[]], "tile": [[_TILES]], "threads": [[_FLAGS]], "tiles": [[_TILES, _FLAGS]], "hierarchy": [[_TILES, _DEPTHS]], "all": [[_TILES, _FLAGS], [_TILES, _DEPTHS]]}


def sweep(base: Config, names: str = "default") -> list[Config]:
    """The configurations of sweeps (names joined by commas), each configuration id once."""
    out: dict[str, Config] = {}
    for name in [n.strip().lower() for n in names.split(",") if n.strip()] or ["default"]:
        if name not in SWEEPS:
            raise ValueError(f"unknown sweep: {name}")
        for axes in SWEEPS[name]:
            for chosen in product(*axes):
                config = replace(base, **{k: v for part in chosen for k, v in part.items()})
                out.setdefault(config.id, config)
    return list(out.values())


@dataclass(frozen=True)
class Map:
    """A grid with its edges, and what its manifest row says."""

    id: str
    cells: DataFrame
    edges: DataFrame
    width: int
    height: int
    about: dict = field(default_factory=dict)


def workload(spark: SparkSession, universe: DataFrame, n: int, seed: int) -> DataFrame:
    """(qid, source, target): ``n`` pairs from ``universe`` (v) with replacement, by a hash of the pair's number.

    A vertex is met by its rank, made from counts by ``components.dense_labels``.
    """
    ranked = components.dense_labels(universe.select("v", F.col("v").alias("component"))).select(F.col("label").alias("k"), "v")
    size = ranked.count()
    if not size:
        return spark.createDataFrame([], "qid long, source long, target long")
    place = lambda side: F.pmod(F.xxhash64("qid", F.lit(seed), F.lit(side)), F.lit(size))
    asked = spark.range(n).select(F.col("id").alias("qid")).select("qid", place(1).alias("a"), place(2).alias("b"))
    found = asked.join(ranked.toDF("a", "source"), "a").join(ranked.toDF("b", "target"), "b")
    return cut_compact(found.select("qid", "source", "target"))


def profile(map_: Map) -> DataFrame:
    """One row of a manifest: size, passable cells, edges, undirected and strong components, condensation."""
    cells, edges = map_.cells, map_.edges
    open_ = cells.filter("passable").select("v")
    together = components.with_isolated(components.near_components(grid.adjacent_pairs(cells, map_.width).toDF("src", "dst", "dir")), open_)
    strong = cut_compact(cells.select("v").join(reach.strong_components(edges), "v", "left").select("v", F.coalesce("comp", "v").alias("comp")))
    parts = together.groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("undirected_component_count"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_undirected_component"))
    sccs = strong.groupBy("comp").agg(F.count("*").alias("n")).agg(F.count("*").alias("num_sccs"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_scc"))
    counts = cells.agg(F.count_if("passable").alias("passable_cells"), F.count("*").alias("num_vertices"))
    row = counts.crossJoin(edges.agg(F.count("*").alias("num_edges"))).crossJoin(parts).crossJoin(sccs)  # one row each
    row = row.crossJoin(reach.condensation(edges, strong).agg(F.count("*").alias("condensation_edges")))
    return row.select(F.lit(map_.id).alias("map_id"), F.lit(map_.width).alias("grid_width"), F.lit(map_.height).alias("grid_height"), "*", F.col("num_sccs").alias("condensation_vertices"))


def prepare(method: str, map_: Map, config: Config) -> Callable[[DataFrame], DataFrame]:
    """Build a method's index; returns what answers pairs (qid, source, target, reachable)."""
    edges, vertices = map_.edges, map_.cells.select("v")
    if method in ("CsrBfs", "CsrDfs"):
        return lambda pairs: reach.answer_by_search(pairs, edges)
    if method in ("SccDagSearch", "SccDagClosure"):
        comps = cut_compact(reach.strong_components(edges))
        return lambda pairs: reach.answer_by_components(pairs, edges, comps, method == "SccDagClosure")
    if method == "FullClosure":
        closed = cut_compact(reach.reflexive(reach.closure(edges, config.memory_cap), vertices), 200_000)
        return lambda pairs: reach.answer(pairs, closed)
    if method == "TwoHop":
        labels = reach.landmark_labels(edges, memory_cap=config.memory_cap)
        return lambda pairs: reach.answer_by_labels(pairs, *labels)
    if method == "Grail":
        labels = cut_compact(reach.interval_labels(edges))
        return lambda pairs: reach.answer_by_intervals(pairs, labels, edges)
    tiled = grid.tiles_of(map_.cells, map_.width, map_.height, config.tile)
    index = tiles.build(edges, tiled, map_.width, config.tile, config.group if method == "Hierarchy" else None, config.max_depth or 64, config.memory_cap)
    if method == "TileSearch":
        return lambda pairs: tiles.flat_search(pairs, index.local, index.ports, index.graph)
    if method == "TileClosure":
        return lambda pairs: tiles.flat_closure(pairs, index.local, index.ports, index.graph)
    return lambda pairs: tiles.hierarchical(pairs, index.levels, (index.local, index.ports, index.graph))


def timed(action: Callable[[], object]) -> tuple[int, object]:
    """Nanoseconds that an action took, and its result."""
    began = time.perf_counter_ns()
    out = action()
    return time.perf_counter_ns() - began, out


def run(spark: SparkSession, map_: Map, config: Config, done: DataFrame | None = None) -> DataFrame:
    """A row for each method not yet completed in ``done``: status, times, checks, answers and speedups over the search.

    Columns: map_id, method, config_id, status, policy_skip_detail, preprocess_ns, warmup_ns, query_ns, count, positive,
    and the statistics of ``measures``, of times a query.
    """
    jobs = spark.createDataFrame([(map_.id, m, config.id) for m in config.methods], "map_id string, method string, config_id string")
    left = {r["method"] for r in (measures.remaining(jobs, done) if done is not None else jobs).collect()}
    pairs = workload(spark, map_.cells.select("v"), config.queries, config.pair_seed)
    expected = cut_compact(prepare("CsrBfs", map_, config)(pairs))
    rows, samples, reference = [], [], 0
    for method in [m for m in config.methods if m in left]:
        row = {"map_id": map_.id, "method": method, "config_id": config.id, "status": Status.COMPLETED.value, "policy_skip_detail": None, "preprocess_ns": 0, "warmup_ns": 0, "query_ns": 0, "count": 0, "positive": 0, "correctness_checks": 0, "correctness_mismatches": 0}
        try:
            row["preprocess_ns"], ask = timed(lambda m=method: prepare(m, map_, config))
            answers = lambda ask=ask: ask(pairs).collect()  # a stated, bounded workload
            row["warmup_ns"] = sum(timed(answers)[0] for _ in range(config.warmups))
            if config.early_stop and reference and measures.stop_early(reference, row["preprocess_ns"], 0, 1, 1, row["warmup_ns"]):
                raise reach.SkippedByPolicy("projected to be slower than the search")
            for _ in range(config.batches):
                ns, got = timed(answers)
                row["query_ns"] += ns
                row["count"] += len(got)
                samples += [(method, ns // max(1, len(got)))] * len(got)
            row["positive"] = sum(r["reachable"] for r in got)
            found = spark.createDataFrame([(r["qid"], r["reachable"]) for r in got], "qid long, reachable boolean")
            row["correctness_checks"], row["correctness_mismatches"] = measures.mismatches(found, expected, config.checks).first()
            if method == METHODS[0]:
                reference = row["preprocess_ns"] + row["warmup_ns"] + row["query_ns"]
        except reach.SkippedByPolicy as e:
            row |= {"status": Status.SKIPPED.value, "policy_skip_detail": str(e), "count": 0, "query_ns": 0}
            samples = [s for s in samples if s[0] != method]
        rows.append(tuple(row.values()))
    names = "map_id string, method string, config_id string, status string, policy_skip_detail string, preprocess_ns long, warmup_ns long, query_ns long, count long, positive long, correctness_checks long, correctness_mismatches long"
    statistics = measures.timing_statistics(spark.createDataFrame(samples, "method string, ns long"), ["method"]).drop("count", "total_ns")
    return measures.speedups(spark.createDataFrame(rows, names).join(statistics, "method", "left"), ["map_id", "config_id"])


def record(spark: SparkSession, folder: str, map_: Map, config: Config, campaign: str = "campaign") -> DataFrame:
    """Run what is missing and append it to the folder's results, with the map's manifest row and picture if it is new."""
    about = {"generator_type": None, "orientation_mode": None, "extra_openings": 0} | map_.about
    common = {"campaign_schema_version": campaigns.SCHEMA_VERSION, "campaign_id": campaign, "run_timestamp_utc": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")}
    put = lambda df, values: df.select("*", *[F.lit(v).alias(k) for k, v in values.items() if k not in df.columns])
    known = campaigns.read(spark, folder, "manifest").filter(F.col("map_id") == map_.id)
    if known.isEmpty():
        picture = f"{folder.rstrip('/')}/gallery/{map_.id}.ppm"
        image = pictures.write_ppm(spark, map_.cells, picture)
        campaigns.append(put(profile(map_), common | about | {"gallery_image_path": picture, "gallery_image_hash": f"{image:016x}"}), folder, "manifest")
    done = cut_compact(run(spark, map_, config, campaigns.read(spark, folder, "results")))
    facts = {k: v for k, v in campaigns.read(spark, folder, "manifest").filter(F.col("map_id") == map_.id).first().asDict().items() if k in ("num_vertices", "num_edges", "passable_cells", "num_sccs")}
    named = done.select("*", F.col("mean_ns").alias("query_mean_ns"), F.col("median_ns").alias("query_median_ns"), F.col("p95_ns").alias("query_p95_ns"), F.col("min_ns").alias("query_min_ns"), F.col("max_ns").alias("query_max_ns"),
        F.col("total_ns").alias("total_benchmark_ns"), F.col("speedup").alias("speedup_vs_bfs"), F.col("total_speedup").alias("total_speedup_vs_bfs"), F.col("count").alias("query_count_timed"), (F.col("correctness_mismatches") > 0).alias("correctness_failed"),
        measures.map_class(F.lit(about["generator_type"]), F.lit(about["extra_openings"]), F.lit(about["orientation_mode"])).alias("map_class"))
    settings = {"query_count": config.queries, "warmup_queries": config.warmups * config.queries, "correctness_check_count": config.checks, "pair_seed": f"0x{config.pair_seed:x}", "kleene_parallel": config.parallel, "kleene_thread_count": config.threads, "tile_width": config.tile, "tile_height": config.tile,
        "max_memory_bytes": config.memory_cap, "group_width": config.group[0], "group_height": config.group[1], "max_depth": config.max_depth, "closure_early_stop": config.early_stop, "timer_source": "perf_counter_ns"}
    campaigns.append(put(named, common | about | facts | settings), folder, "results")
    return done


def smoke_map(spark: SparkSession, size: int = 8, seed: int = 1) -> Map:
    """A small open grid with random arcs."""
    cells = generators.walled_grid(spark, size, size)
    return Map(f"smoke_{size}x{size}", cells, grid.orient(grid.adjacent_pairs(cells, size), "random", seed=seed), size, size, {"generator_type": "smoke_grid", "orientation_mode": "random_asymmetric"})


def maze_map(spark: SparkSession, width: int, height: int, extra: int = 0, mode: str = "random", seed: int = 1) -> Map:
    """A maze with ``extra`` openings."""
    cells = cut_compact(generators.open_walls(generators.perfect_maze(spark, width, height, seed), extra, seed))
    across = 2 * width + 1
    return Map(f"maze_{width}x{height}_o{extra}_{mode}_s{seed}", cells, grid.orient(grid.adjacent_pairs(cells, across), mode, seed=seed), across, 2 * height + 1, {"generator_type": "procedural_maze", "extra_openings": extra, "orientation_mode": mode, "carve_seed": str(seed)})


def recipe_map(spark: SparkSession, root: str, recipe: recipes.Recipe) -> Map:
    """The map of a recipe below ``root``."""
    cells, edges, width, height = recipes.graph(spark, root, recipe)
    return Map(f"{recipe.set}__{Path(recipe.map).stem}", cells, edges, width, height, {"generator_type": "movingai", "orientation_mode": recipe.mode, "movingai_set": recipe.set, "movingai_map": recipe.map, "datasets_root": root, "passability_policy": recipe.policy})
