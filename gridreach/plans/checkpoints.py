"""Reliable checkpoints: files in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows that every task may hold.
FEW = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, put to use.

    A local session may do without the setting: it gets a folder of its own, which goes when the
    program ends. On a cluster no other machine would see such a folder, so there it is an error.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if sc.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="gridreach-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: as ``cut``, but with its true size for the plans that read it.

    A checkpoint keeps the size that was estimated for its plan, and the estimate of a join is a
    product: in a loop of joins its digits would double with every round.
    """
    path = f"{shared_dir(df.sparkSession)}/table_{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame) -> DataFrame:
    """``df`` written out for joins with larger tables: at most ``FEW`` rows go to every task, more are shuffled, so the other side never passes through the driver."""
    seen = Observation()
    done = written(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return done.hint("broadcast" if (seen.get["n"] or 0) <= FEW else "merge")


def cut_compact(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """``cut``, then read back in partitions of about ``rows`` rows: no swarm of tiny shuffle files."""
    done = cut(df)
    return done.coalesce(max(1, -(-done.count() // rows)))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files (and, where it is set to, checkpoints) of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
