"""Session helpers: table access and lineage cuts that survive the loss of executors."""

from __future__ import annotations

import atexit
import os
import pathlib
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    ``spark.checkpoint.dir`` is read from the session; only where it is unset and no folder was set by code, and all executors are
    threads of this machine (tests, local runs), a folder of our own is made. On a cluster that is an error: a folder of one
    machine would lose rows.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not configured and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    folder = configured or os.path.join(tempfile.gettempdir(), f"intakeforge-checkpoints-{os.getpid()}")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table written to the shared checkpoint folder, from which the plan goes on.

    A table rather than ``checkpoint()``, whose files hold serialized rows: later readers get columns, sizes for their joins
    and cheap scans. It outlives lost executors as well, and goes with the application, or with `release` where a long one has
    read its results.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    _CUTS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


_CUTS: dict[str, list[str]] = {}


def release(spark: SparkSession) -> int:
    """Deletes all tables that `cut` wrote so far, and returns their number: frames that read them can't be read again."""
    paths = _CUTS.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return len(paths)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers: its zip goes to the executors once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = pathlib.Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="intakeforge-")  # executors fetch from here, so it stays as long as the driver
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, f"{package.name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
