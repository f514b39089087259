"""Small driver-side files (recipes, summaries, pictures) in any store that Spark's Hadoop client reaches."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """Write a whole file, in place of any old one."""
    fs, p = _open(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return path


def delete(spark: SparkSession, path: str) -> bool:
    """Remove a regular file; false where there is none."""
    fs, p = _open(spark, path)
    return bool(fs.exists(p) and fs.getFileStatus(p).isFile() and fs.delete(p, False))


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _open(spark, path)
    return bool(fs.exists(p))


def names(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """The paths of a folder's regular files with this suffix, sorted; none where there is no folder."""
    fs, p = _open(spark, folder)
    if not fs.exists(p):
        return []
    return sorted(str(s.getPath().toString()) for s in fs.listStatus(p) if s.isFile() and s.getPath().getName().endswith(suffix))
