"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def _shared(spark) -> str:
    """spark.checkpoint.dir. Where that is unset a local session (tests) gets a folder of its own; on a cluster, whose
    executors would not see its files, it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None:
        if not where and (not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(where or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return where or spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the shared folder."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """The same as a Parquet table: a fraction of a checkpoint's size for many rows."""
    where = os.path.join(_shared(df.sparkSession), "tables", uuid.uuid4().hex)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def discard(kept: DataFrame) -> None:
    """Deletes a table of keep(), once all that was read from it is itself materialised."""
    for name in kept.inputFiles()[:1]:
        folder = kept.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(kept.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
