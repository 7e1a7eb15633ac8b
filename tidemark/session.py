"""Session helpers: where shared intermediate tables go, and how workers get this package."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "tidemark") -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one of our own where that is unset and the session has one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found and context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines share: {context.master} has more than one")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return (found or context.getCheckpointDir()).rstrip("/")


def _gone_at_the_end(spark: SparkSession, path: str) -> None:
    """Let a folder that exists go with the application."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)


def scratch(spark: SparkSession, name: str) -> str:
    """A path in a new folder of the shared one, for a table that the caller writes; the folder goes with the application."""
    folder = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    _gone_at_the_end(spark, folder)
    return f"{folder}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back, which cuts its lineage.

    The table goes with the application, if drop_table() hasn't removed it before. It has no _SUCCESS file: nothing looks
    for one, and on a local file system the driver starts two processes to set its mode and its checksum file's.
    """
    path = f"{shared_dir(df.sparkSession)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    _gone_at_the_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove a table that materialize() wrote and that nothing reads any more."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        if "/tidemark-" in path.toString():
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, wherever the driver imported it from (once an application)."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tidemark-ship-"), "tidemark_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    p = os.path.join(folder, n)
                    z.write(p, os.path.join("tidemark", os.path.relpath(p, root)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)
