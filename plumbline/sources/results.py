"""Result tables: append, upsert by key, runs, and JSON columns read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def append(df: DataFrame, path: str, run_id: str) -> None:
    """Add rows to a result table, one folder a run."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables' rows, a new row replacing the old one of its key; of new rows with one key the last by all columns stays."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    order = [F.desc("__new"), *[F.desc(c) for c in new.columns if c not in keys]]
    ranked = both.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__rn = 1").drop("__rn", "__new")


#: Buckets of a keyed result table.
BUCKETS = 64


def _bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int"))


def write_keyed(df: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """Write a result table laid out by a hash of its keys, one folder a bucket."""
    rows = upsert(df.where("false"), df, keys)
    _bucketed(rows, keys, buckets).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(path)


def upsert_keyed(new: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> list[int]:
    """Upsert into a table that ``write_keyed`` wrote; only the buckets that ``new`` touches are read and rewritten, and returned.

    ``buckets`` is the number the table was written with.
    """
    spark = new.sparkSession
    marked = _bucketed(new, keys, buckets)
    touched = sorted(r.bucket for r in marked.select("bucket").distinct().collect())  # no more than there are buckets
    if not touched:
        return []
    old = spark.read.schema(marked.schema).parquet(path).where(F.col("bucket").isin(touched))
    rows = upsert(old, marked, ["bucket", *keys])
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def replace_run(df: DataFrame, path: str, run_id: str) -> None:
    """Write a run's rows, replacing what that run wrote before and nothing else."""
    out = df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("run_id").parquet(path)


def finish_run(run: DataFrame, findings: DataFrame, status: str) -> DataFrame:
    """The run's row with its status and its findings counted."""
    n = findings.groupBy("run_id").agg(F.count("*").alias("__n"))
    return run.join(n, "run_id", "left").withColumns({"status": F.lit(status), "findings_total": F.coalesce("__n", F.lit(0))}).drop("__n")


def list_runs(runs: DataFrame, limit: int, completed_only: bool = False) -> DataFrame:
    out = runs.where("status = 'completed'") if completed_only else runs
    return out.orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)


def decode(column: Column, kind: T.DataType | str = "array<map<string,string>>") -> Column:
    """JSON text as a structure; null or malformed text as an empty one."""
    return F.coalesce(F.from_json(column, kind), F.from_json(F.lit("[]"), kind))


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
