"""Grid map files: a header (type, height, width in any order), the line ``map``, then rows of letters.

A map is malformed if its header has another line, ends without ``map`` or lacks a positive height or
width, if it has more than 2**32 - 1 cells, or if a row is missing or shorter than the width. White
space at a line's end doesn't count; further characters of a row and further rows are dropped; of
repeated header lines the last one counts. ``errors`` says what is wrong with which map; ``parse`` has
the cells of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terrain import is_passable, terrain_class

#: Maps with more cells are no quick ones.
QUICK_CELLS = 10_000


def _read(maps: DataFrame) -> DataFrame:
    """``maps`` (name, text) with kind, width, height, rows and error (null where the map is sound)."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s: F.regexp_replace(s, r"[\r\t ]+$", ""))
    df = maps.select("name", lines.alias("lines"))
    df = df.withColumn("at", F.array_position("lines", "map").cast("int"))
    df = df.withColumn("header", F.when(F.col("at") > 0, F.slice("lines", F.lit(1), F.col("at") - 1)).otherwise(F.col("lines")))
    last = lambda key: F.try_element_at(F.filter("header", lambda s: s.rlike(rf"^{key} \d{{1,10}}$")), F.lit(-1))
    number = lambda key: F.coalesce(F.split(last(key), " ")[1].cast("long"), F.lit(0))
    df = df.select("name", "lines", "at", number("width").alias("width"), number("height").alias("height"), F.regexp_replace(F.coalesce(F.try_element_at(F.filter("header", lambda s: s.startswith("type ")), F.lit(-1)), F.lit("")), "^type ", "").alias("kind"),
        F.filter("header", lambda s: ~s.rlike(r"^(type .*|height \d{1,10}|width \d{1,10}|)$")).alias("odd"))
    df = df.withColumn("rows", F.when(F.col("at") > 0, F.slice("lines", F.col("at") + 1, F.greatest(F.least(F.col("height"), F.size("lines")), F.lit(0)).cast("int"))))
    # A text that ends in a line break has no row behind it.
    df = df.withColumn("rows", F.when((F.size("rows") > 0) & (F.try_element_at("rows", F.lit(-1)) == "") & (F.col("at") + F.size("rows") == F.size("lines")), F.slice("rows", F.lit(1), F.size("rows") - 1)).otherwise(F.col("rows")))
    short = F.array_position(F.transform("rows", lambda s: F.length(s) < F.col("width")), True).cast("int")
    error = F.when(F.size("odd") > 0, F.concat(F.lit("unrecognized header line: "), F.get("odd", F.lit(0))))
    error = error.when(F.col("at") == 0, "no line 'map' after the header").when((F.col("width") <= 0) | (F.col("height") <= 0), "no positive width or height")
    error = error.when(F.col("width").cast("decimal(20,0)") * F.col("height") > 4294967295, "too many cells")
    error = error.when(short > 0, F.format_string("row %d is shorter than the width", short - 1)).when(F.size("rows") < F.col("height"), F.format_string("%d of %d rows", F.size("rows"), F.col("height")))
    return df.select("name", "kind", "width", "height", "rows", error.alias("error"))


def errors(maps: DataFrame) -> DataFrame:
    """(name, error) of the malformed maps."""
    return _read(maps).filter("error IS NOT NULL").select("name", "error")


def parse(maps: DataFrame) -> DataFrame:
    """(name, text) -> (name, width, height, x, y, v, ch) of the sound maps; see ``errors`` for the others."""
    df = _read(maps).filter("error IS NULL").select("name", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.posexplode("rows").alias("y", "row"))
    df = df.select("name", "width", "height", "y", F.posexplode(F.split(F.substring(F.col("row"), F.lit(1), F.col("width")), "")).alias("x", "ch"))
    return df.filter("x < width").select("name", "width", "height", "x", "y", (F.col("y").cast("long") * F.col("width") + F.col("x")).alias("v"), "ch")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of the map files below a folder."""
    files = spark.read.option("pathGlobFilter", "*.map").option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.input_file_name().alias("name"), F.col("value").alias("text"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """Maps below a folder, parsed."""
    return parse(texts(spark, path))


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(set, map, path) of the files ``<set>/maps/<map>.map`` below a folder, sorted by set and map; texts aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.map").option("recursiveFileLookup", "true").load(root).select("path")
    parts = F.split("path", "/")
    found = files.withColumn("p", parts).filter((F.size("p") >= 3) & (F.try_element_at("p", F.lit(-2)) == "maps"))
    return found.select(F.element_at("p", -3).alias("set"), F.element_at("p", -1).alias("map"), "path").orderBy("set", "map")


def smallest_per_set(sized: DataFrame, most: int = QUICK_CELLS) -> DataFrame:
    """(set, map, cells) -> the map of fewest cells in each set, ties by name; sets whose smallest has more than ``most`` drop out."""
    least = sized.filter("cells IS NOT NULL").groupBy("set").agg(F.min(F.struct("cells", "map")).alias("m"))
    return least.filter(F.col("m.cells") <= most).select("set", F.col("m.map").alias("map"), F.col("m.cells").alias("cells")).orderBy("set")


def layout(cells: DataFrame, policy: str) -> DataFrame:
    """Parsed cells -> (name, v, x, y, passable) under a policy."""
    return cells.select("name", "v", "x", "y", is_passable(F.col("ch"), policy).alias("passable"))


def cells_at(cells: DataFrame, points: DataFrame) -> DataFrame:
    """``points`` (name, x, y) with ch and terrain; a point off its map is out of bounds."""
    found = points.join(cells.select("name", "x", "y", "ch"), ["name", "x", "y"], "left")
    ch: Column = F.coalesce("ch", F.lit("@"))
    return found.select("name", "x", "y", ch.alias("ch"), terrain_class(ch).alias("terrain"))
