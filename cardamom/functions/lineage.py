"""Cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where none is set, a local session (tests) gets a temporary folder, any other an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


#: Whether shuffles of a DataFrame that is made now leave the disk once its job is done.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back, so lost executors never replay its lineage.

    The shuffles that led to it are removed then; they would stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # as a DataFrame of its own
    finally:
        spark.conf.set(_CLEAN_UP, before)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that was written under the shared one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
