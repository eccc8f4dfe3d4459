"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and all runs in one process.

    On a cluster a machine's own folder would hold a part of each table, so the setting is asked for.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='sourceloom-')}")
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def staged_path(df: DataFrame, name: str) -> str:
    """Write df to the shared folder as Parquet; where it lies. The folder goes when the application ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/sourceloom-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again. A lost executor then costs at most a re-read."""
    schema = df.schema
    return df.sparkSession.read.schema(schema).parquet(staged_path(df, name))
