"""Density of reachable pairs: the mean share of vertices that a source reaches, exact or by a sample."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans import files
from . import blocks

# When a running estimate counts as stable.
FIRST, STEP, STABLE_ROUNDS = 64, 32, 3
MEAN_FLOOR, MEAN_SHARE, ERROR_FLOOR, ERROR_SHARE = 1e-6, 0.001, 1e-7, 0.03


@dataclass(frozen=True)
class Estimate:
    """A density with its standard error; ``exact`` if every source was looked at (the error is 0 then)."""

    mean: float
    error: float
    sources: int
    exact: bool


def sample_order(column: str, seed: int) -> Column:
    """Place in a sample without replacement: the same integer arithmetic in any engine, ties by the id itself."""
    u = (F.col(column) * 7919 + seed * 104729) % 1000003
    return (u * u) % 1000003


def sample(universe: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` vertices (v) of the universe without replacement, or all; the first ones by ``sample_order``."""
    return universe.select("v").orderBy(sample_order("v", seed), "v").limit(n)


def shares(found: DataFrame, sources: DataFrame, size: int) -> DataFrame:
    """(v, f): of each source, how many vertices it reaches over ``size``; ``found`` holds pairs (src, dst), reflexive."""
    mine = found.join(sources.select(F.col("v").alias("src")), "src", "left_semi")
    return mine.groupBy(F.col("src").alias("v")).agg((F.count("*") / F.lit(size)).alias("f"))


def estimate(f: DataFrame, size: int) -> Estimate:
    """Mean and standard error of the shares (v, f); no rows make a density of 0."""
    r = f.agg(F.avg("f").alias("m"), F.var_pop("f").alias("s"), F.count("*").alias("n")).first()
    exact = r["n"] >= size
    return Estimate(r["m"] or 0.0, 0.0 if exact or not r["n"] else (r["s"] / r["n"]) ** 0.5, r["n"], exact)


def rounds(f: DataFrame, seed: int = 0) -> DataFrame:
    """(n, mean, error, stable): the running estimate after the first ``FIRST`` sources and every ``STEP`` from there on.

    ``f`` holds a sample's shares, a few hundred rows; its order is that of ``sample``.
    """
    order = Window.orderBy(sample_order("v", seed), "v")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    run = f.select(F.row_number().over(order).alias("n"), F.avg("f").over(upto).alias("mean"), F.var_pop("f").over(upto).alias("var"))
    run = run.filter((F.col("n") >= FIRST) & ((F.col("n") - FIRST) % STEP == 0)).select("n", "mean", F.sqrt(F.col("var") / F.col("n")).alias("error"))
    by_n = Window.orderBy("n")
    near = lambda c, floor, share: F.abs(F.col(c) - F.lag(c).over(by_n)) <= F.greatest(F.lit(floor), share * F.greatest(F.col(c), F.lag(c).over(by_n)))
    calm = run.withColumn("calm", F.coalesce(near("mean", MEAN_FLOOR, MEAN_SHARE) & near("error", ERROR_FLOOR, ERROR_SHARE), F.lit(False)).cast("int"))
    last = F.sum("calm").over(by_n.rowsBetween(1 - STABLE_ROUNDS, 0))
    return calm.select("n", "mean", "error", (last >= STABLE_ROUNDS).alias("stable"))


def stop_when_stable(f: DataFrame, seed: int = 0) -> DataFrame:
    """The first stable round (n, mean, error), or the last one if none is."""
    return rounds(f, seed).orderBy(F.desc("stable"), F.when(F.col("stable"), F.col("n")).otherwise(-F.col("n"))).limit(1).select("n", "mean", "error")


@dataclass(frozen=True)
class Snapshot:
    """What is known of a density so far: the estimate, whether it is stable, and whether sources are left."""

    estimate: Estimate
    stable: bool
    left: bool


class Steps:
    """An estimate made in steps: sources are searched from batch by batch, and it may be stopped and taken up again.

    All it knows is in ``folder``, which driver and executors share: the edges, the sample with its
    batches (the first ``FIRST`` sources, then every ``STEP``), and a folder of shares for each batch
    done. A batch that a lost driver left half written is done again; sources and order depend on
    the seed alone, so a run that was taken up again ends with the same figures.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._graph = spark, folder.rstrip("/"), None
        self.sources = spark.read.parquet(f"{self.folder}/sources")
        about = spark.read.parquet(f"{self.folder}/about").first()
        self.size, self.seed, self.batches = about["size"], about["seed"], about["batches"]

    @classmethod
    def begin(cls, edges: DataFrame, universe: DataFrame, folder: str, maximum: int = 512, seed: int = 0) -> "Steps":
        """Write down what is to be done; ``universe`` (v) is searched from in whole if it has at most ``maximum`` vertices."""
        spark, folder = edges.sparkSession, folder.rstrip("/")
        edges.select("src", "dst").write.mode("overwrite").parquet(f"{folder}/edges")
        size = universe.count()
        place = F.row_number().over(Window.orderBy(sample_order("v", seed), "v")) - 1  # over the sample alone
        batch = F.when(F.col("place") < FIRST, 0).otherwise(F.floor((F.col("place") - FIRST) / STEP) + 1)
        sampled = sample(universe, maximum, seed).withColumn("place", place).select("v", batch.cast("int").alias("batch"))
        sampled.write.mode("overwrite").parquet(f"{folder}/sources")
        n = min(size, maximum)
        batches = 0 if not n else 1 + max(0, -(-(n - FIRST) // STEP))
        spark.createDataFrame([(size, seed, batches)], "size long, seed long, batches int").write.mode("overwrite").parquet(f"{folder}/about")
        return cls(spark, folder)

    def done(self) -> int:
        """How many batches are whole: they are done in order."""
        return next((k for k in range(self.batches) if not files.exists(self.spark, f"{self.folder}/shares/batch={k}/_SUCCESS")), self.batches)

    def step(self) -> bool:
        """Search from the next batch's sources; false if none is left."""
        k = self.done()
        if k == self.batches:
            return False
        self._graph = self._graph or blocks.build(self.spark.read.parquet(f"{self.folder}/edges"))
        counts = blocks.search(self._graph, self.sources.filter(F.col("batch") == k).select(F.col("v").alias("seed"))).counts()
        counts.select(F.col("seed").alias("v"), (F.col("reached") / self.size).alias("f")).write.mode("overwrite").parquet(f"{self.folder}/shares/batch={k}")
        return True

    def shares(self) -> DataFrame:
        """(v, f) of the batches done."""
        paths = [f"{self.folder}/shares/batch={k}" for k in range(self.done())]
        return self.spark.read.schema("v long, f double").parquet(*paths) if paths else self.spark.createDataFrame([], "v long, f double")

    def snapshot(self) -> Snapshot:
        f = self.shares()
        return Snapshot(estimate(f, self.size), not rounds(f, self.seed).filter("stable").isEmpty(), self.done() < self.batches)

    def run(self) -> Snapshot:
        """Step until the estimate is stable or no source is left."""
        now = self.snapshot()
        while not now.stable and self.step():
            now = self.snapshot()
        return now
