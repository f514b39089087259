"""Campaign folders: the tables of maps (manifest) and results, appended run by run, and what describes a campaign.

Tables are folders of CSV files with a header and quoted fields, read by their schema. Columns are fixed
values in this order, so tables are read by position, whatever their header calls a column.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats
from ..operators import measures
from ..plans import files

SCHEMA_VERSION = "2"
MANIFEST = (
    "campaign_schema_version string, campaign_id string, map_id string, generator_type string, recipe_path string, gallery_image_path string, grid_width long, grid_height long, "
    "passable_cells long, num_vertices long, num_edges long, undirected_component_count long, largest_undirected_component long, num_sccs long, largest_scc long, "
    "condensation_vertices long, condensation_edges long, orientation_mode string, carve_seed string, opening_seed string, extra_openings long, p_one_way double, p_bidirectional double, "
    "gradient_angle_degrees double, p_against_gradient double, orientation_seed string, gallery_image_hash string, movingai_set string, movingai_map string, datasets_root string, passability_policy string"
)
RESULTS = (
    "campaign_schema_version string, campaign_id string, run_timestamp_utc string, map_id string, generator_type string, method string, status string, policy_skip_detail string, "
    "num_vertices long, num_edges long, pair_seed string, pair_list_hash string, query_count long, warmup_queries long, correctness_check_count long, preprocess_ns long, "
    "estimated_index_bytes long, peak_preprocess_rss_bytes long, query_count_timed long, query_mean_ns double, query_median_ns long, query_p95_ns long, query_min_ns long, "
    "query_max_ns long, queries_per_second double, total_benchmark_ns long, speedup_vs_bfs double, total_speedup_vs_bfs double, correctness_checks long, correctness_mismatches long, "
    "correctness_failed boolean, warshall_matrix_order long, kleene_parallel boolean, kleene_thread_count long, config_id string, tile_width long, tile_height long, "
    "max_memory_bytes long, group_width long, group_height long, max_depth long, closure_early_stop boolean, map_class string, passable_cells long, num_sccs long, "
    "kleene_rounds_scheduled long, kleene_rounds_effective long, timer_source string"
)
TABLES = {"manifest": MANIFEST, "results": RESULTS}


def shaped(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order and type; missing ones are null, others go."""
    columns = [c.strip().split(" ") for c in TABLES[table].split(",")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in columns])


def append(df: DataFrame, folder: str, table: str) -> None:
    """Add rows to a campaign's table."""
    shaped(df, table).write.mode("append").option("header", True).option("escape", '"').csv(f"{folder.rstrip('/')}/{table}")


def read(spark: SparkSession, folder: str, table: str, version: str | None = SCHEMA_VERSION) -> DataFrame:
    """A campaign's table; rows of another schema version are skipped (None: all stay). No table gives no rows."""
    path = f"{folder.rstrip('/')}/{table}"
    if not files.exists(spark, path):
        return spark.createDataFrame([], TABLES[table])
    rows = spark.read.schema(TABLES[table]).option("header", True).option("escape", '"').option("enforceSchema", True).csv(path)
    return rows if version is None else rows.filter(F.col("campaign_schema_version") == version)


def describe(spark: SparkSession, folder: str, metadata: dict, workload: dict) -> None:
    """Write metadata.json and workload.json."""
    for name, content in (("metadata", metadata), ("workload", workload)):
        files.write_text(spark, f"{folder.rstrip('/')}/{name}.json", json.dumps({"schema_version": SCHEMA_VERSION} | content, indent=2) + "\n")


def summary(spark: SparkSession, folder: str, metadata: dict) -> str:
    """Write summary.md from the results: one line a run, a few thousand at most, and the best of each class."""
    results = read(spark, folder, "results")
    line = lambda *xs: "| " + " | ".join(map(str, xs)) + " |\n"
    out = ["# Benchmark campaign summary\n\n", line("Field", "Value"), line("-", "-"), *(line(k, v) for k, v in metadata.items())]
    out += ["\n## Results\n\n", line("Map", "Class", "Method", "Config", "Status", "QPS", "Total vs BFS", "Mismatches"), line(*["-"] * 8)]
    for r in results.orderBy("map_id", "config_id", "method", "run_timestamp_utc").toLocalIterator():
        out.append(line(r["map_id"], r["map_class"], r["method"], r["config_id"], r["status"], f"{r['queries_per_second'] or 0:g}", formats.speedup(r["total_speedup_vs_bfs"] or 0), r["correctness_mismatches"] or 0))
    best = measures.best_by_class(results).orderBy("map_class").collect()  # a row a class
    if best:
        out += ["\n## Best completed QPS by map class\n\n", line("Class", "Map", "Method", "Config", "QPS"), line(*["-"] * 5)]
        out += [line(r["map_class"], r["map_id"], r["method"], r["config_id"], f"{r['queries_per_second']:g}") for r in best]
    return files.write_text(spark, f"{folder.rstrip('/')}/summary.md", "".join(out))
