"""Session helpers for tests, the bench and local runs.

On a cluster the session is built by the platform; library code only reads
settings from it (see :func:`checkpoint_dir`).
"""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "skewmatch") -> SparkSession:
    """A local session with AQE on and the web UI off."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SKEWMATCH_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    Uses ``spark.checkpoint.dir`` when the cluster names one. Only when it is
    unset (local runs, tests) a fresh scratch folder is created and set.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    scratch = tempfile.mkdtemp(prefix="skewmatch-ckpt-", dir="/tmp")
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir() or scratch


#: The folder of the run that is under way, if a run was opened.
_run: contextvars.ContextVar[str | None] = contextvars.ContextVar("skewmatch_run", default=None)


def _path(spark: SparkSession, folder: str):
    """The Hadoop file system of ``folder`` and its path there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder, wherever Spark's file systems have it; one that is not there is no error."""
    fs, path = _path(spark, folder)
    fs.delete(path, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, path = _path(spark, source)
    if not fs.rename(path, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"could not move {source} to {target}")


def exists(spark: SparkSession, folder: str) -> bool:
    fs, path = _path(spark, folder)
    return fs.exists(path)


def run_dir(spark: SparkSession) -> str:
    """Where intermediate tables go: the folder of the open run, else one per application in the shared checkpoint folder, which
    the driver's JVM removes when it ends."""
    if _run.get():
        return _run.get()
    folder = f"{checkpoint_dir(spark).rstrip('/')}/skewmatch-{spark.sparkContext.applicationId}"
    fs, path = _path(spark, folder)
    if fs.mkdirs(path):
        fs.deleteOnExit(path)
    return folder


@contextlib.contextmanager
def run(spark: SparkSession):
    """A run whose intermediate tables are removed when it ends, in whichever way. Its results must be written (or collected)
    inside::

        with run(spark):
            write_matches(split_match(entities), "out/")
    """
    folder = f"{checkpoint_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"
    token = _run.set(folder)
    try:
        yield folder
    finally:
        _run.reset(token)
        remove(spark, folder)
