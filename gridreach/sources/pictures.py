"""Pictures of grids as text: portable pixmaps and SVG, rows of text that are put in order at the end."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terrain import xml_escape
from ..functions.text import fnv1a
from ..plans import files

#: Colours of passable and blocked cells.
OPEN, BLOCKED = "222 222 214", "28 28 32"


def ppm_rows(cells: DataFrame) -> DataFrame:
    """(y, row): a grid's rows of colours, each colour with a blank behind it."""
    colour = F.when(F.col("passable"), f"{OPEN} ").otherwise(f"{BLOCKED} ")
    ordered = F.array_sort(F.collect_list(F.struct("x", colour.alias("c"))))
    return cells.groupBy("y").agg(F.array_join(F.transform(ordered, lambda s: s["c"]), "").alias("row"))


def write_ppm(spark: SparkSession, cells: DataFrame, path: str) -> int:
    """Write a grid as a picture; returns the FNV-1a hash of the file. Rows stream to the driver, which writes the file."""
    box = cells.agg(F.max("x"), F.max("y")).first()
    if box[0] is None:
        raise ValueError("a picture has a cell at least")
    rows = [r["row"] for r in ppm_rows(cells).orderBy("y").toLocalIterator()]
    text = f"P3\n{box[0] + 1} {box[1] + 1}\n255\n" + "".join(f"{r}\n" for r in rows)
    files.write_text(spark, path, text)
    return fnv1a(text.encode())


def _number(x: Column) -> Column:
    """As ``%g`` writes it: six digits, no zeros behind."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x.cast("double")), "0+$", ""), r"\.$", "")


def _tag(name: str, **attributes: Column | str) -> Column:
    parts = [F.lit(f"<{name}")]
    for key, value in attributes.items():
        parts += [F.lit(f' {key}="'), F.lit(value) if isinstance(value, str) else value, F.lit('"')]
    return F.concat(*parts)


def svg_lines(cells: DataFrame, edges: DataFrame, size: float, title: str = "grid graph") -> DataFrame:
    """(part, at, line): a rectangle a cell, a line an edge, a title; by part, then place."""
    side = _number(F.lit(float(size)))
    rect = F.concat(_tag("rect", x=_number(F.col("x") * size), y=_number(F.col("y") * size), width=side, height=side, fill=F.when(F.col("passable"), "#ffffff").otherwise("#cccccc"), stroke="#666666"), F.lit("/>"))
    boxes = cells.select(F.lit(1).alias("part"), F.struct(F.col("v").alias("a"), F.lit(0).cast("long").alias("b")).alias("at"), rect.alias("line"))
    place = cells.select("v", ((F.col("x") + 0.5) * size).alias("cx"), ((F.col("y") + 0.5) * size).alias("cy"))
    ends = edges.join(place.toDF("src", "x1", "y1"), "src").join(place.toDF("dst", "x2", "y2"), "dst")
    line = F.concat(_tag("line", **{k: _number(F.col(k)) for k in ("x1", "y1", "x2", "y2")}, stroke="#3366cc"), F.lit("/>"))
    arcs = ends.select(F.lit(2).alias("part"), F.struct(F.col("src").alias("a"), F.col("dst").alias("b")).alias("at"), line.alias("line"))
    text = F.concat(_tag("text", x=_number(F.lit(4.0)), y=_number(F.lit(size * 0.75))), F.lit(">"), xml_escape(F.lit(title)), F.lit("</text>"))
    head = cells.sparkSession.range(1).select(F.lit(3).alias("part"), F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("at"), text.alias("line"))
    return boxes.union(arcs).union(head)


def svg(cells: DataFrame, edges: DataFrame, size: float, title: str = "grid graph") -> str:
    """A whole picture; its lines stream to the driver, as a picture is looked at as one."""
    box = cells.agg(F.max("x"), F.max("y")).first()
    wide, high = (math.ceil(((m if m is not None else -1) + 1) * size) for m in box)
    lines = (r["line"] for r in svg_lines(cells, edges, size, title).orderBy("part", "at").toLocalIterator())
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{wide}" height="{high}">\n' + "".join(f"{x}\n" for x in lines) + "</svg>\n"


def shrunk(cells: DataFrame, most: int) -> DataFrame:
    """(x, y, share): a grid scaled down to ``most`` cells on its longer side, each cell the mean of those it covers; smaller grids stay."""
    box = cells.agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest("w", "h"))
    new = lambda n: F.greatest(F.floor(F.col(n) * scale), F.lit(1))
    sized = cells.crossJoin(F.broadcast(box.select("w", "h", new("w").alias("nw"), new("h").alias("nh"))))  # one row
    # The new cell k covers the old ones from floor(k * n / m) on: an old cell's is the last k that starts at or before it.
    cover = lambda c, n, m: F.floor(((F.col(c) + 1) * F.col(m) - 1) / F.col(n))
    return sized.groupBy(cover("x", "w", "nw").alias("x"), cover("y", "h", "nh").alias("y")).agg(F.avg(F.col("passable").cast("double")).alias("share"))
