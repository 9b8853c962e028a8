"""Written tables that cut lineage: in the folder all executors share, never on a machine's own disk."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.lru_cache(maxsize=1)
def _local() -> str:
    return tempfile.mkdtemp(prefix="plumbline-")


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the session has it; where it is unset a temporary folder serves a local master only."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{_local()}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: readers see the same rows, and a lost executor costs its own tasks only.

    The table is the owner's of that folder; ``drop`` deletes it when it is no longer read.
    """
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the table that ``written`` made and ``df`` reads."""
    if files := df.inputFiles():
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
