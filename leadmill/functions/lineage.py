"""Cutting the lineage of tables that several later steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

#: Rows up to which Spark may choose by itself to broadcast a table of files.
FEW = 1 << 15


def _shared(df: DataFrame) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Only a local session without that setting gets a folder of its own."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")


def settled(df: DataFrame) -> DataFrame:
    """Checkpointed in the shared folder, computed once, safe against lost executors."""
    _shared(df)
    return df.checkpoint()


def merging(df: DataFrame) -> DataFrame:
    """A table of files that joins by a shuffle if it has more than FEW rows; an explicit broadcast, of either side, comes first.

    Spark goes by the files' size. Regular values take a hundredth of their size in Parquet, so millions of rows would pass for a few MB and be broadcast through the driver.
    """
    return df if df.count() <= FEW else df.hint("merge")


def stored(df: DataFrame) -> DataFrame:
    """Settled as Parquet in the shared folder: smaller than a checkpoint's rows, and later steps read only the columns that they use.

    The files go when the application ends. A table's order and partitions aren't kept. One of many rows isn't broadcast for its small files.
    """
    path = f"{_shared(df).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = df.sparkSession.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return merging(df.sparkSession.read.schema(df.schema).parquet(path))
