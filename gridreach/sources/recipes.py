"""Recipes: how a map becomes a graph, as flat JSON files in a folder, one recipe a file."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terrain import POLICIES
from ..functions.text import file_name, fnv1a
from ..operators import grid
from ..plans import files
from . import maps

#: How policies and modes are written in recipes.
POLICY_NAMES = dict(zip(("ground_only", "ground_and_swamp", "all_traversable", "any_terrain_letter"), POLICIES, strict=True))
MODE_NAMES = {"random_asymmetric": "random", "bidirectional_all": "bidirectional", "acyclic_east_south": "acyclic", "gradient_flow": "gradient"}
SCHEMA = "orientation_recipe_v1"


@dataclass(frozen=True)
class Recipe:
    """The map of a set, who passes, and how adjacencies become edges; probabilities that a file lacks have these defaults."""

    set: str
    map: str
    policy: str
    mode: str
    seed: int
    p_one_way: float = 0.15
    p_bidirectional: float = 0.25
    gradient_angle_degrees: float = 45.0
    p_against_gradient: float = 0.05


def body(recipe: Recipe) -> str:
    text = lambda k, v: f'  "{k}": "{v}"'
    lines = [text("schema", SCHEMA), *(text(k, getattr(recipe, k)) for k in ("set", "map", "policy", "mode")), text("seed", f"0x{recipe.seed:016x}")]
    lines += [f'  "{k}": {getattr(recipe, k):g}' for k in ("p_one_way", "p_bidirectional", "gradient_angle_degrees", "p_against_gradient")]
    return "{\n" + ",\n".join(lines) + "\n}\n"


def name_of(recipe: Recipe) -> str:
    """The file's name: it follows from the content, so a recipe saved again replaces itself."""
    low = fnv1a(body(recipe).encode()) & 0xFFFFFFFF
    return f"{file_name(recipe.set)}__{file_name(recipe.map)}__{recipe.mode}__{recipe.seed:016x}__{low:08x}.json"


def save(spark: SparkSession, folder: str, recipe: Recipe) -> str:
    """Write a recipe; returns its path."""
    if recipe.policy not in POLICY_NAMES or recipe.mode not in MODE_NAMES:
        raise ValueError("unknown policy or mode")
    return files.write_text(spark, f"{folder.rstrip('/')}/{name_of(recipe)}", body(recipe))


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The sound recipes of a folder: path, saved_at, the fields, seed as decimal(20,0).

    A file without set, map, policy, mode or seed, or with an unknown policy or mode, is left out; a
    probability that is missing or no number is null (``recipe_of`` puts in the default).
    """
    schema = "path string, saved_at timestamp, set string, map string, policy string, mode string, seed decimal(20,0), p_one_way double, p_bidirectional double, gradient_angle_degrees double, p_against_gradient double"
    if not files.names(spark, folder, ".json"):
        return spark.createDataFrame([], schema)
    raw = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("saved_at"))

    def field(key: str) -> F.Column:
        found = F.regexp_extract_all("value", F.lit(rf'"{key}"\s*:\s*("[^"]*"|[^\s,}}]+)'), F.lit(1))
        return F.regexp_replace(F.get(found, F.lit(0)), '^"|"$', "")

    hexed = F.regexp_extract(field("seed"), r"^0[xX]([0-9A-Fa-f]{1,16})$", 1)
    seed = F.when(hexed != "", F.conv(hexed, 16, 10)).otherwise(F.regexp_extract(field("seed"), r"^([0-9]+)$", 1)).try_cast("decimal(20,0)")
    floats = [field(k).try_cast("double").alias(k) for k in ("p_one_way", "p_bidirectional", "gradient_angle_degrees", "p_against_gradient")]
    out = raw.select("path", "saved_at", *[field(k).alias(k) for k in ("set", "map", "policy", "mode")], seed.alias("seed"), *floats)
    return out.dropna(subset=["set", "map", "policy", "mode", "seed"]).filter(F.col("policy").isin(*POLICY_NAMES) & F.col("mode").isin(*MODE_NAMES)).orderBy("path")


def for_map(spark: SparkSession, folder: str, set_name: str, map_name: str) -> DataFrame:
    """A map's recipes, the newest first, ties by path."""
    return load(spark, folder).filter((F.col("set") == set_name) & (F.col("map") == map_name)).orderBy(F.desc("saved_at"), "path")


def delete(spark: SparkSession, path: str) -> bool:
    return files.delete(spark, path)


def recipe_of(row) -> Recipe:
    """A row of ``load`` as a recipe."""
    known = {k: v for k, v in row.asDict().items() if k in Recipe.__dataclass_fields__ and v is not None}
    return Recipe(**known | {"seed": int(row["seed"])})


def graph(spark: SparkSession, root: str, recipe: Recipe) -> tuple[DataFrame, DataFrame, int, int]:
    """Cells (v, x, y, passable), edges (src, dst), width and height of the recipe's map below ``root``."""
    stem = re.sub(r"\.map$", "", recipe.map)
    cells = maps.load(spark, f"{root.rstrip('/')}/{recipe.set}/maps/{stem}.map")
    box = cells.agg(F.max("width"), F.max("height")).first()
    if box[0] is None:
        raise ValueError(f"{recipe.set}/{recipe.map} is no sound map")
    open_cells = maps.layout(cells, POLICY_NAMES[recipe.policy]).select("v", "x", "y", "passable")
    p = grid.sanitized(recipe.p_bidirectional, recipe.p_one_way, recipe.p_against_gradient, recipe.gradient_angle_degrees)
    pairs = grid.adjacent_pairs(open_cells, box[0])
    return open_cells, grid.orient(pairs, MODE_NAMES[recipe.mode], p.both, p.one, p.against, recipe.seed, p.angle), box[0], box[1]
