"""Reading tables and cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that may be broadcast to thin out a scan (about 16 MB as longs in a hash relation).
BROADCAST_IDS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where none is set a new local folder becomes it, in a local session (tests)
    only: executors elsewhere would not see its files."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not where and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return where or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df reliably, so that a lost executor costs a read and not a recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """The same as a Parquet table in the shared folder: a third of a checkpoint's size for many narrow rows."""
    where = os.path.join(shared_dir(df.sparkSession), "tables", uuid.uuid4().hex)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def discard(kept: DataFrame) -> None:
    """Deletes a table of keep(), once all that was read from it is itself materialised."""
    for name in kept.inputFiles()[:1]:
        folder = kept.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(kept.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def semi(df: DataFrame, ids: DataFrame, key: str, n_ids: int) -> DataFrame:
    """Rows of df whose key is in ids (a materialised, distinct column of that name, n_ids long).

    The ids are broadcast while they are few; beyond BROADCAST_IDS the join shuffles."""
    return df.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, key, "left_semi")


def most_frequent(counts: DataFrame, count: str, most: int) -> DataFrame:
    """Rows of counts from some count on, no more than `most`. A histogram of bounded size tells from where; no rows are
    sorted, so nothing gathers in one task."""
    bins = F.when(F.col(count) < 4096, F.col(count)).otherwise(F.floor(F.log2(count) * 16) + 4096)
    total, least = 0, None
    for r in counts.groupBy(bins.alias("bin")).agg(F.count("*").alias("n"), F.min(count).alias("least")).orderBy(F.desc("bin")).collect():
        total += r["n"]
        if total > most:
            break
        least = r["least"]
    return counts.where(F.lit(False) if least is None else F.col(count) >= least)
