import random

from pyspark.sql import functions as F

from gridreach.operators import density


def test_steps_stop_and_go_on(spark, tmp_path):
    """Taken up again it ends with the same figures, and where it is stable it leaves sources out."""
    r = random.Random(4)
    arcs = spark.createDataFrame([(i, r.randrange(150)) for i in range(150)], "src long, dst long")
    universe = spark.range(150).select(F.col("id").alias("v"))
    one = density.Steps.begin(arcs, universe, f"file://{tmp_path}/one", seed=3)
    whole = one.run()
    density.Steps.begin(arcs, universe, f"file://{tmp_path}/two", seed=3).step()
    again = density.Steps(spark, f"file://{tmp_path}/two")
    first = again.snapshot()
    assert first.estimate.sources == density.FIRST and first.left and not first.stable
    (tmp_path / "two/shares/batch=1").mkdir()  # left half written by a driver that was lost
    assert again.run() == whole
    f = whole.estimate
    assert whole.stable == (not density.rounds(one.shares(), 3).filter("stable").isEmpty()) and f.sources == min(150, density.FIRST + density.STEP * (one.done() - 1))
    assert f.sources == 150 or whole.stable and whole.left


def test_a_constant_share_is_stable_at_once(spark, tmp_path):
    ring = spark.range(300).select(F.col("id").alias("src"), ((F.col("id") + 1) % 300).alias("dst"))
    now = density.Steps.begin(ring, ring.select(F.col("src").alias("v")), str(tmp_path)).run()
    assert now.stable and now.left and now.estimate.sources == density.FIRST + 3 * density.STEP and now.estimate.mean == 1.0


def test_small_and_empty_universes_are_exact(spark, tmp_path):
    arcs = spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")
    now = density.Steps.begin(arcs, spark.range(3).select(F.col("id").alias("v")), f"{tmp_path}/a").run()
    assert now.estimate == density.Estimate(2 / 3, 0.0, 3, True) and not now.left
    none = density.Steps.begin(arcs, spark.range(0).select(F.col("id").alias("v")), f"{tmp_path}/b").run()
    assert none.estimate.sources == 0 and none.estimate.mean == 0.0
