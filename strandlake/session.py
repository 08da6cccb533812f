"""Session settings shared by the bench, the tests and the examples."""

from __future__ import annotations

import os
import pathlib
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Local files are small; a low bound keeps every core busy after a shuffle.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("strandlake")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the package to all Python workers of the session, wherever the driver found it; once a session."""
    context = spark.sparkContext
    if getattr(context, "_strandlake_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent
    packed = os.path.join(tempfile.mkdtemp(prefix="strandlake-"), "strandlake.zip")
    with zipfile.ZipFile(packed, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(packed)  # the driver serves it; executors need not see the file
    context._strandlake_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise an iterative step in the shared checkpoint folder.

    The folder named in ``spark.checkpoint.dir`` is used; only a local session may go without, on a cluster a folder
    of one machine would be lost with it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        configured = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not configured and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint()
