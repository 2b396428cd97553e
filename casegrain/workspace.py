"""Where intermediate tables go, and how a scan is spread over the cores."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=None)
def _local_folder(application_id: str) -> str:
    folder = tempfile.mkdtemp(prefix=f"casegrain-{application_id}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: what ``spark.checkpoint.dir`` names.

    Only a session whose driver is its only process (``local``, ``local[n]``) may
    go without that setting; it gets a temporary folder, removed when it ends.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_folder(sc.applicationId)


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/casegrain-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_intermediate(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; results that still read them are lost.

    A result is lazy and may read them at any later time, so only the caller knows when.
    """
    remove(spark, _own_folder(spark))


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder of intermediate tables that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, lets several plans hang off one computation, and
    survives the loss of an executor.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan over all cores when the input has fewer splits than cores.

    Meant for a narrow scan followed by heavy per-row text work. Large inputs
    have many splits and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < 2 * cores:
        return df.repartition(cores)
    return df
