"""Shared-folder tables: how the operators of this subpackage cut lineage."""

from __future__ import annotations

import contextvars
import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


@functools.lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="plumbline-")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir`` as the session has it.

    Where it is unset, a temporary folder serves a local master only; a
    cluster without the setting is refused, as a local folder would be lost
    with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + _local_folder()


#: Spark's own setting: shuffle files go when the write that made them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables written since the innermost ``settled`` began.
_open: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("open", default=None)


def _write(df: DataFrame, name: str) -> str:
    spark = df.sparkSession
    path, before = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    A lost executor then costs its own tasks only, and several readers of the
    result do not repeat the work before it. Inside ``settled`` the table goes
    with it.
    """
    path = _write(df, name)
    if (held := _open.get()) is not None:
        held.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop(df: DataFrame) -> None:
    """Delete the table that ``staged`` or ``settled`` wrote and ``df`` reads."""
    if files := df.inputFiles():
        discard(df.sparkSession, files[0].rsplit("/", 1)[0])


def settled(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The rows of ``build()`` as a written table; the tables staged on the way to it are deleted."""
    mark = _open.set(held := [])
    try:
        df = build()
        path = _write(df, name)
    finally:
        _open.reset(mark)
        for old in held:
            discard(spark, old)
    if (outer := _open.get()) is not None:
        outer.append(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
