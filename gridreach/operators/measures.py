"""Statistics of measured runs: order statistics by index, speedups, checks of answers, what is left to run."""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fnv1a
from ..plans.checkpoints import written

#: Bits of a value that a pass over the samples settles.
DIGIT = 16


def select_places(samples: DataFrame, by: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Per group: n, total, least, most, and for each name the sample at the place (0 first) that its function makes of n.

    ``value`` is an integer; null samples don't count. Values are found digit by digit: a pass counts,
    in each group, the samples that agree with what is known of a wanted value by their next
    ``DIGIT`` bits. Counts are combined before they are shuffled, so a group that holds most samples
    is no task's, nothing is sorted but counts, and there are as many passes as the group's range has digits.
    """
    x = samples.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("long").alias("x"))
    groups = x.groupBy(*by).agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.min("x").alias("least"), F.max("x").alias("most"))
    groups = written(groups)  # true sizes: a few groups are broadcast, many are joined
    names = list(places)
    wide = groups.agg(F.max(F.col("most") - F.col("least"))).first()[0] or 0
    wanted = groups.select(*by, "least", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), places[k](F.col("n")).cast("long").alias("place")) for k in names])).alias("w"))
    # known: the leading digits; place: among the samples that have them
    wanted = wanted.select(*by, "least", F.col("w.name").alias("name"), F.col("w.place").alias("place"), F.lit(0).cast("long").alias("known"))
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]
    kept = lambda a: [F.col(f"{a}.{c}").alias(c) for c in by]
    for level in reversed(range(-(-wide.bit_length() // DIGIT))):
        asked = wanted.select(*by, "least", "known").distinct()
        above = F.shiftright(F.col("x") - F.col("least"), DIGIT * level)
        known = F.lit(0).cast("long") == F.col("known") if DIGIT * (level + 1) > 63 else F.shiftright(F.col("x") - F.col("least"), DIGIT * (level + 1)) == F.col("known")
        seen = x.alias("x").join(asked.alias("a"), [*same("x", "a"), known])
        counts = seen.select(*kept("a"), "known", above.bitwiseAND(F.lit((1 << DIGIT) - 1)).alias("digit")).groupBy(*by, "known", "digit").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*by, "known").orderBy("digit"))
        ranges = counts.withColumn("end", upto).withColumn("start", F.col("end") - F.col("n")).withColumnRenamed("known", "before")
        here = wanted.alias("w").join(ranges.alias("r"), [*same("w", "r"), F.col("known") == F.col("before"), F.col("place") >= F.col("start"), F.col("place") < F.col("end")])
        wanted = written(here.select(*kept("w"), "least", "name", (F.col("place") - F.col("start")).alias("place"), F.shiftleft("known", DIGIT).bitwiseOR(F.col("digit")).alias("known")))
    values = wanted.groupBy(*by).agg(*[F.max(F.when(F.col("name") == k, F.col("least") + F.col("known"))).alias(k) for k in names])
    if not by:
        return groups.crossJoin(values)  # one row each
    return groups.alias("g").join(values.alias("v"), same("g", "v")).select(*kept("g"), "n", "total", "least", "most", *names)


def timing_statistics(samples: DataFrame, by: list[str], ns: str = "ns") -> DataFrame:
    """Per group: count, total, mean, median, p95, min, max of the nanoseconds and queries a second.

    The median is the sample at place n / 2, the p95 that at 0.95 n, places from 0, rounded down. Null
    samples don't count; a rate over no time is 0.
    """
    found = select_places(samples, by, ns, {"median_ns": lambda n: F.floor(n / 2), "p95_ns": lambda n: F.least(n - 1, F.floor(n * 0.95))})
    n, total = F.col("n"), F.col("total")
    rate = F.when(total > 0, n / (total / 1e9)).otherwise(0.0)
    return found.select(*by, n.alias("count"), total.alias("total_ns"), (total / n).alias("mean_ns"), "median_ns", "p95_ns", F.col("least").alias("min_ns"), F.col("most").alias("max_ns"), rate.alias("queries_per_second"))


def order_statistics(samples: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per group, for each name: the sample at place share * (n - 1), rounded down."""
    return select_places(samples, by, value, {k: lambda n, q=q: F.floor(F.lit(q) * (n - 1)) for k, q in shares.items()}).select(*by, *shares)


def speedups(runs: DataFrame, by: list[str], method: str = "method", reference: str = "CsrBfs") -> DataFrame:
    """``runs`` with total_ns (preprocess, warm-up and queries), speedup and total_speedup against the reference method of the group.

    ``runs`` has the method, status, count, preprocess_ns, warmup_ns, query_ns and mean_ns. 0 where the
    run or the reference isn't completed, or took no time.
    """
    done = F.col("status") == "Completed"
    total = F.col("preprocess_ns") + F.col("warmup_ns") + F.col("query_ns")
    runs = runs.withColumn("total_ns", total)
    base = done & (F.col(method) == reference) & (F.col("count") > 0)
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    mean = F.max(F.when(base, F.col("mean_ns"))).over(group)
    whole = F.max(F.when(base, F.col("total_ns"))).over(group)
    ratio = lambda a, b, ok: F.when(ok & (a > 0) & (b > 0), a / b).otherwise(0.0)
    return runs.select("*", ratio(mean, F.col("mean_ns"), done & (F.col("count") > 0)).alias("speedup"), ratio(whole, F.col("total_ns"), done).alias("total_speedup"))


def answer_counts(answers: DataFrame, by: list[str]) -> DataFrame:
    """Per group: asked, positive, negative, reachable_ratio; with a ``certified`` column also tree_hits and fallbacks."""
    yes = F.coalesce(F.col("reachable"), F.lit(False))
    out = [F.count("*").alias("asked"), F.count_if(yes).alias("positive"), F.count_if(~yes).alias("negative"), F.avg(F.when(yes, 1.0).otherwise(0.0)).alias("reachable_ratio")]
    if "certified" in answers.columns:
        out += [F.count_if("certified").alias("tree_hits"), F.count_if(~F.col("certified")).alias("fallbacks")]
    return answers.groupBy(*by).agg(*out)


def mismatches(answers: DataFrame, expected: DataFrame, checked: int | None = None) -> DataFrame:
    """(checks, mismatches): answers (qid, reachable) that differ from the expected ones, of the first ``checked`` qids or all."""
    want = expected.select("qid", F.col("reachable").alias("want"))
    both = answers.select("qid", "reachable").join(want, "qid")
    if checked is not None:
        both = both.orderBy("qid").limit(checked)
    return both.agg(F.count("*").alias("checks"), F.count_if(~F.col("reachable").eqNullSafe(F.col("want"))).alias("mismatches"))


def remaining(jobs: DataFrame, results: DataFrame, key: tuple[str, ...] = ("map_id", "method", "config_id")) -> DataFrame:
    """The jobs without a completed result."""
    return jobs.join(results.filter("status = 'Completed'").select(*key).distinct(), list(key), "left_anti")


def best_by_class(results: DataFrame) -> DataFrame:
    """Per map class, the completed run without mismatches that answers most queries a second; ties by map, method and configuration."""
    good = results.filter("status = 'Completed' AND correctness_mismatches = 0").withColumn("map_class", F.when(F.coalesce("map_class", F.lit("")) == "", "unknown").otherwise(F.col("map_class")))
    best = F.struct(F.coalesce(-F.col("queries_per_second"), F.lit(float("inf"))).alias("slow"), "map_id", "method", "config_id", "queries_per_second")
    return good.groupBy("map_class").agg(F.min(best).alias("best")).select("map_class", "best.map_id", "best.method", "best.config_id", "best.queries_per_second")


def map_class(generator: Column, extra_openings: Column, orientation: Column) -> Column:
    """The class of a map from its generator, further openings and orientation mode."""
    known = F.when(generator == "movingai", "movingai").when((generator == "procedural_maze") & (extra_openings == 0), "perfect_maze").when(generator == "procedural_maze", "cyclic_maze").when(generator == "smoke_grid", "smoke_grid")
    return known.when(F.coalesce(orientation, F.lit("")) != "", orientation).when(F.coalesce(generator, F.lit("")) == "", "unknown").otherwise(generator)


def workload_hash(pairs: DataFrame) -> int:
    """FNV-1a over the number of pairs and each source and target, as 32-bit little-endian numbers, by qid.

    The hash is sequential, so the pairs stream through the driver, a partition at a time.
    """
    value = fnv1a(struct.pack("<I", pairs.count()))
    for r in pairs.select("qid", "source", "target").orderBy("qid").toLocalIterator():
        value = fnv1a(struct.pack("<II", r["source"], r["target"]), value)
    return value


def stop_early(reference_ns: int, setup_ns: int, elapsed_ns: int, done: int, total: int, query_ns: int = 0, least: float = 0.5) -> bool:
    """Whether a closure's projected speedup over the reference falls below ``least``, once enough steps are done."""
    if reference_ns <= 0 or total <= 0 or done < (1 if total <= 1 else max(4, total // 16)):
        return False
    projected = setup_ns + elapsed_ns * total / done + query_ns
    return projected > 0 and reference_ns / projected < least
