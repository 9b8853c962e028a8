"""Ordered work on keys of any size: ranges of (key, order) in many tasks, and what one range carries to the next.

Rows are range-partitioned by key and order and written once, so a key with
half of all rows lies in many ranges. Each range is worked on alone; a small
table of what its keys' last rows or sums are then carries over to the ranges
after it. Only keys that span ranges carry anything: at most two rows a range,
which is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.sources import scratch

#: Rows of a key from which it is spread over ranges, and keys up to which their list is broadcast.
HOT_ROWS, BROADCAST_KEYS = 1_000_000, 50_000
#: Rows that one task of ``spread`` is meant for.
TASK_ROWS = 500_000
PART = "__part"


def spread(df: DataFrame, *keys: str, source: DataFrame | None = None, each: int = 1) -> DataFrame:
    """``df`` hash-partitioned by ``keys`` into a task for every ``TASK_ROWS`` rows, one a core at least.

    Left to itself Spark joins partitions up to 64 MB of compressed bytes, which
    may be millions of narrow rows to sort in one task; a number that is asked
    for it leaves alone. ``source`` is the table ``df`` is made from, counted in its place if
    ``df`` observes its rows or makes them with some work; of a Parquet table only footers are
    read. A row counts as ``each`` rows, if it makes or weighs as much.
    """
    rows = (df if source is None else source).count() * each
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


def ranged(df: DataFrame, *by: str) -> DataFrame:
    """``df`` written by ranges of ``by`` (null first), each with its number, which grows with the order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scratch.written(df.repartitionByRange(n, *by).withColumn(PART, F.spark_partition_id()), "ranges")


def _carried(each: DataFrame, key: str, what: Column) -> DataFrame:
    """(__key, __at, carry) of keys that span ranges; ``each`` has one row a key and range."""
    own = Window.partitionBy(key)
    spans = each.withColumns({"__n": F.count("*").over(own), "carry": what}).where("__n > 1")
    return spans.select(F.col(key).alias("__key"), F.col(PART).alias("__at"), "carry")


def _with_carry(df: DataFrame, key: str, carry: DataFrame) -> DataFrame:
    # At most two keys a range span it and another: bounded by the number of ranges.
    return df.join(F.broadcast(carry), F.col(key).eqNullSafe(F.col("__key")) & (F.col(PART) == F.col("__at")), "left").drop("__key", "__at")


def running_before(df: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the key's rows before each row; (key, order) is unique."""
    rows = ranged(df, key, order)
    within = Window.partitionBy(PART, key).orderBy(F.asc_nulls_first(order)).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(key, PART).agg(F.sum(value).alias("__sum"))
    earlier = F.sum("__sum").over(Window.partitionBy(key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    out = _with_carry(rows.withColumn("__own", F.sum(value).over(within)), key, _carried(totals, key, earlier))
    return out.withColumn(name, F.coalesce("__own", F.lit(0)) + F.coalesce("carry", F.lit(0))).drop(PART, "__own", "carry")


def previous(df: DataFrame, key: str, order_by: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the key's value in the row before, by ``order_by`` (ascending, null first) and then by value."""
    rows = ranged(df, key, *order_by, value)
    within = Window.partitionBy(PART, key).orderBy(*[F.asc_nulls_first(c) for c in (*order_by, value)])
    tails = rows.groupBy(key, PART).agg(F.max_by(value, F.struct(*order_by, value)).alias("__tail"))
    before = F.lag("__tail").over(Window.partitionBy(key).orderBy(PART))
    marked = rows.withColumns({"__first": F.row_number().over(within) == 1, "__lag": F.lag(value).over(within)})
    out = _with_carry(marked, key, _carried(tails, key, before))
    return out.withColumn(name, F.when(F.col("__first"), F.col("carry")).otherwise(F.col("__lag"))).drop(PART, "__first", "__lag", "carry")


def hot_and_cold(df: DataFrame, key: str, hot_rows: int) -> tuple[DataFrame | None, DataFrame]:
    """Rows of keys with more than ``hot_rows`` rows (None if there is none), and all others."""
    hot = scratch.written(df.groupBy(key).count().where(F.col("count") > hot_rows).select(F.col(key).alias("__key")), "hot-keys")
    if not (n := hot.count()):
        scratch.drop(hot)
        return None, df
    keys = F.broadcast(hot) if n <= BROADCAST_KEYS else hot
    same = F.col(key).eqNullSafe(F.col("__key"))
    return df.join(keys, same, "left_semi"), df.join(keys, same, "left_anti")
