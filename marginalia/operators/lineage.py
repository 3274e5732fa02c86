"""Where lineage is cut: checkpoints in the folder that the driver and the executors share, never on an executor's own disk."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. A folder of our own only where the session names none and runs on one machine, as in tests."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        found = f"file://{tempfile.mkdtemp(prefix='marginalia-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: a lost executor costs no recomputation of what came before."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
