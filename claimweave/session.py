"""What a Spark session needs for this package's Python functions."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
#: The session whose workers have the package.
_shipped: list[str] = []


def importable_by_workers(spark: SparkSession) -> SparkSession:
    """Ship the package to the Python workers of every executor, once in a session.

    The archive is written on the driver and served by Spark's own file
    server, so that executors need no folder in common with the driver.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{PACKAGE.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(PACKAGE.rglob("*.py")):
                out.write(file, file.relative_to(PACKAGE.parent))
        context.addPyFile(str(archive))
        _shipped[:] = [context.applicationId]
    return spark


def cut(frame: DataFrame) -> DataFrame:
    """``frame`` written once to the checkpoint folder that the cluster names; below the warehouse only where none is named."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        context.setCheckpointDir(named or f"{frame.sparkSession.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return frame.checkpoint()
