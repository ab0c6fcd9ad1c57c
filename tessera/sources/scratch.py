"""Tables that cut lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[int, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where it is unset, a temporary one of the session's on a local master, and an error on a cluster, whose executors would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = id(spark.sparkContext)
    if key not in _OWN:
        _OWN[key] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _OWN[key]


def _stashes(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/tessera/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing has been written to, in a folder that clear_stashes() deletes."""
    return f"{_stashes(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there, and lost executors cost no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_stashes(spark: SparkSession) -> None:
    """Delete all that was written under new_path() in this application. Results that are not stored elsewhere are lost, so only the caller can tell when."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_stashes(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
