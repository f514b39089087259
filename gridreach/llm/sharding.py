"""Sharding by a hypergeometric communication matrix.

A uniform shuffle into shards of exact sizes, in one exchange: the driver draws how many rows
of each partition go to each shard (a matrix whose row sums are the partitions' sizes and whose
column sums are the shards' sizes, with the law of a uniform permutation), each partition deals
its rows by a random permutation of those labels, rows are exchanged, and each shard is permuted
again, block by block of a random key, so that no task holds a shard.

The driver holds one row of counts per partition: numbers that grow with the partitions, not with
the rows. Where a shard's blocks start is counted in a table.

Defined results: null ids and texts are rows like any other; repeated rows each get a slot; an
empty table gives no rows; other columns, whatever their names, are kept as they are, except that
``shard`` and ``slot``, in whatever case, are replaced; rows whose random keys are equal (some 1 in
10^18) have slots in the order in which they are met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.checkpoints import cut
from ..plans.shipping import ship

#: Rows of a shard that are permuted together, about; a block is one group of one task.
BLOCK_ROWS = 20_000


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` taken without replacement are good: exact at any size.

    Inverts the distribution outwards from its mode; the ratios of neighbouring
    probabilities are rational, so no logarithm of a factorial is needed.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    total = good + bad
    spread = int(12 * np.sqrt(draws * (good / total) * (bad / total) * max(total - draws, 1) / max(total - 1, 1))) + 40
    a, b = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(mode, b, dtype=np.float64)  # from k to k + 1
    up = np.cumprod((good - k) * (draws - k) / ((k + 1) * (bad - draws + k + 1)))
    k = np.arange(mode, a, -1, dtype=np.float64)  # from k to k - 1
    down = np.cumprod(k * (bad - draws + k) / ((good - k + 1) * (draws - k + 1)))
    weights = np.concatenate([down[::-1], [1.0], up])
    return a + int(np.searchsorted(np.cumsum(weights), rng.random() * weights.sum(), side="right").clip(0, len(weights) - 1))


def communication_matrix(rng: np.random.Generator, rows: list[int], columns: list[int]) -> np.ndarray:
    """Counts with these row and column sums, as a uniform permutation would give them."""
    left = [int(c) for c in columns]
    out = np.zeros((len(rows), len(columns)), dtype=np.int64)
    for i, n in enumerate(map(int, rows)):
        rest = sum(left)
        for j, c in enumerate(left):
            rest -= c
            out[i, j] = k = draw_hypergeometric(rng, c, rest, n)
            left[j] -= k
            n -= k
    return out


def deal(docs: DataFrame, shards: int, seed: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with ``shard`` int and ``slot`` long (0, 1, ... without gaps in each shard).

    Shard sizes differ by one at most; which rows go where, and their order, is a uniform
    shuffle that ``seed`` fixes for a given layout of partitions.
    """
    spark = docs.sparkSession
    ship(spark)
    kept = [(i, c) for i, c in enumerate(docs.columns) if c.lower() not in ("shard", "slot")]
    docs = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))]).select(*[f"__c{i}" for i, _ in kept])  # by position, so no name clashes
    # Fixed files: a recomputed task meets the same partitions and the same order of rows.
    fixed = cut(docs)
    counts = {r["p"]: r["n"] for r in fixed.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    parts = fixed.rdd.getNumPartitions()
    rows = [counts.get(p, 0) for p in range(parts)]
    total = sum(rows)
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = spark.sparkContext.broadcast(communication_matrix(np.random.default_rng(seed), rows, sizes))
    blocks = max(1, -(-max(sizes) // block_rows))
    width = len(docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("__key", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        p = TaskContext.get().partitionId()
        rng, at = np.random.default_rng([seed, p]), 0
        labels = np.repeat(np.arange(shards, dtype=np.int32), matrix.value[p])
        rng.shuffle(labels)
        for b in batches:
            n = b.num_rows
            keys = rng.integers(0, 1 << 62, n)
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(labels[at : at + n]), pa.array(keys)], names=[*b.schema.names[:width], "shard", "__key"])
            at += n

    dealt = fixed.mapInArrow(run, schema)
    block = F.shiftright("__key", 31) * blocks  # keys have 62 bits: the upper 31, scaled to 0 .. blocks - 1
    dealt = dealt.withColumn("__block", F.shiftright(block, 31).cast("int"))
    upto = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("shard", "__block").agg(F.count("*").alias("n")).select("shard", "__block", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("__start"))
    dealt = dealt.withColumn("__rank", F.row_number().over(Window.partitionBy("shard", "__block").orderBy("__key")))
    placed = dealt.join(first, ["shard", "__block"])
    return placed.select(*[F.col(f"__c{i}").alias(c) for i, c in kept], "shard", (F.col("__start") + F.col("__rank") - 1).alias("slot"))
