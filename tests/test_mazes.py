from pyspark.sql import functions as F

from gridreach.operators import generators


def test_spanning_maze_as_kruskal(spark):
    """The minimum spanning forest of the hashed walls, also where a part of the rooms lies apart."""
    width, gone = 9, {3 * 9 + k for k in range(9)} | {14}
    rooms = spark.range(70).filter(~F.col("id").isin(*gone)).select(F.col("id").alias("v"), (F.col("id") % width).alias("x"), F.floor(F.col("id") / width).alias("y"))
    left = [v for v in range(70) if v not in gone]
    walls = [(a, b) for a in left for b in ([a + 1] if a % width < width - 1 else []) + [a + width] if b in left]
    weights = {(r["a"], r["b"]): r["h"] for r in spark.createDataFrame(walls, "a long, b long").select("a", "b", F.xxhash64("a", "b", F.lit(5)).alias("h")).collect()}
    of, opened = {v: v for v in left}, set()
    for a, b in sorted(walls, key=lambda w: (weights[w], w)):
        if of[a] != of[b]:
            old = of[a]
            of = {v: of[b] if s == old else s for v, s in of.items()}
            opened.add((a % width + b % width + 1, a // width + b // width + 1))
    got = [tuple(r) for r in generators.spanning_maze(rooms, width, seed=5).collect()]
    assert len(got) == len(set(got)) and set(got) == opened | {(2 * (v % width) + 1, 2 * (v // width) + 1) for v in left}
    assert generators.spanning_maze(rooms.limit(0), width).count() == 0
    assert generators.spanning_maze(rooms.filter("v = 5"), width).count() == 1
