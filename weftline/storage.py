"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Whether shuffle files go at the end of what is run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this machine's only where that is unset and the session is one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="weftline-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the cluster's Hadoop API, for any scheme."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _remove(spark: SparkSession, path: str) -> None:
    try:
        fs, target = hadoop_path(spark, path)
        fs.delete(target, True)
    except Exception:  # the session has ended: the cluster's own clean-up has the folder
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and reread it; files go when the driver exits.

    Lineage and inferred predicates end there, so loops over the result neither replan
    their history nor carry a filter of an earlier round. Shuffle files that led to it go as
    soon as it is written, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/weftline/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)  # digests as hex take half the room that they take with the default
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    atexit.register(_remove, spark, path)
    written = spark.read.schema(df.schema).parquet(path)
    written._folder = path
    return written


def release(*tables: DataFrame) -> None:
    """Remove the files of tables that ``materialize`` gave and nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, t._folder)
