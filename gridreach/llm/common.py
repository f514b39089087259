"""Helpers that the operators share."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns of these exact names; any others, however named, are left out.

    Columns are addressed by position, so that further columns whose names differ
    only in case, or that an operator uses for its own results, do no harm.
    """
    cols = df.columns
    flat = df.toDF(*[f"__c{i}" for i in range(len(cols))])
    return flat.select(*[F.col(f"__c{cols.index(n)}").alias(n) for n in names])


def fresh(taken: list[str], name: str) -> str:
    """``name``, with underscores behind it until no column is called so, in whatever case."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name += "_"
    return name


def hex_sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
