"""Make this package importable in the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per SparkContext.

    Spark's own file server distributes the archive, so executors need neither
    a shared folder nor an installed copy.
    """
    sc = spark.sparkContext
    if getattr(sc, "_gridreach_shipped", False):
        return
    folder = Path(tempfile.mkdtemp(prefix="gridreach-")).resolve()
    archive = folder / f"{_PACKAGE.name}_src.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(archive))
    sc._gridreach_shipped = True
