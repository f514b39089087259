"""Boolean vectors and matrices as relations: a matrix is its set bits (i, j), a vector its set places (i).

Sizes are given where an operation needs them. Places outside are no bits: they are never set, and
test as false.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _inside(places: DataFrame, sizes: dict[str, int]) -> DataFrame:
    for name, n in sizes.items():
        places = places.filter(F.col(name).between(0, n - 1))
    return places


def set_bits(bits: DataFrame, more: DataFrame, **sizes: int) -> DataFrame:
    """``bits`` with those of ``more`` that lie inside (``i=5, j=5``: places 0 to 4)."""
    names = list(sizes)
    return bits.select(*names).union(_inside(more.select(*names), sizes)).distinct()


def reset_bits(bits: DataFrame, places: DataFrame) -> DataFrame:
    """``bits`` without these places; ``places`` has some or all of the columns."""
    return bits.join(places, places.columns, "left_anti")


def are_set(bits: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` with ``bit``: whether the place is set."""
    known = bits.select(*asked.columns).distinct().withColumn("__hit", F.lit(True))
    return asked.join(known, asked.columns, "left").select(*asked.columns, F.coalesce("__hit", F.lit(False)).alias("bit"))


def or_rows(matrix: DataFrame, onto: DataFrame) -> DataFrame:
    """``matrix`` with the bits of row ``source`` added to row ``target``, for all rows of ``onto`` at once."""
    added = matrix.join(onto.select(F.col("source").alias("i"), "target"), "i").select(F.col("target").alias("i"), "j")
    return matrix.select("i", "j").union(added).distinct()


def row_counts(matrix: DataFrame) -> DataFrame:
    """(i, bits) of the rows that have any."""
    return matrix.groupBy("i").agg(F.count("*").alias("bits"))


def column_counts(matrix: DataFrame) -> DataFrame:
    """(j, bits) of the columns that have any."""
    return matrix.groupBy("j").agg(F.count("*").alias("bits"))


def equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two relations have the same bits."""
    names = a.columns
    return a.distinct().exceptAll(b.select(*names).distinct()).isEmpty() and b.select(*names).distinct().exceptAll(a.distinct()).isEmpty()


def memory_bytes(rows: int, columns: int) -> int:
    """What a dense matrix takes, each row in whole 64-bit words."""
    return rows * -(-columns // 64) * 8
