"""Session defaults, table access and shared-folder checkpoints."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(app: str = "voxelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; `conf` entries override them."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per session, unless their path already has it."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent.parent
    if getattr(sc, "_voxelake_shipped", False) or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    d = tempfile.mkdtemp(prefix="voxelake-")
    atexit.register(shutil.rmtree, d, ignore_errors=True)  # executors fetch the file as they start
    sc.addPyFile(shutil.make_archive(os.path.join(d, "voxelake_code"), "zip", root, "voxelake"))
    sc._voxelake_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder (a file or a folder of parts)."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that setting is missing and the session is local (tests, a single machine)
    is a temporary folder chosen; on a cluster a missing setting is an error, since a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="voxelake-checkpoint-", dir=os.environ.get("TMPDIR"))
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        named = "file://" + folder
    sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written once to the shared checkpoint folder and read from there afterwards."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_unused(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of DataFrames that nothing refers to any more. It does so
    only after a collection of the driver's heap, which may be long in coming."""
    gc.collect()  # handles in Python hold those of the JVM
    spark.sparkContext._jvm.System.gc()
