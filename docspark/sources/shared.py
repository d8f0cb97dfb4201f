"""The folder that the driver and all executors share, for what is written on the way to a result."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, the warehouse if the driver's machine runs all tasks, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir")
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the reliable checkpoint folder.

    Spark's context cleaner removes the files once nothing refers to them, if the cluster sets
    ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, which goes away when the driver ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    fs, path = file_system(spark, folder)
    fs.mkdirs(path)  # deleteOnExit asks for a path that is there
    fs.deleteOnExit(path)
    return folder


def file_system(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system of a path, and the path for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, folder: str) -> bool:
    fs, path = file_system(spark, folder)
    return fs.delete(path, True)
