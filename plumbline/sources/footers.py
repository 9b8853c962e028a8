"""Column statistics of Parquet tables from the files' footers, as a table; data pages are read only where statistics lack.

A footer is a few kilobytes a file. The files are dealt to tasks, which read
footers through pyarrow's file systems; where those do not reach a store, the
table has no statistics and everything is scanned.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import drift, invariants

SCHEMA = "file string, row_group int, column_name string, rows bigint, nulls bigint, low string, high string, low_number double, high_number double"
#: Footers read by one task at a time.
FILES_A_TASK = 64
EPOCH = dt.datetime(1970, 1, 1)


def _number(x) -> float | None:
    """A statistic as a number: dates and timestamps without zone as microseconds; none for floats, whose NaN rows statistics hide."""
    if isinstance(x, bool) or isinstance(x, float):
        return None
    if isinstance(x, int | Decimal):
        return float(x)
    if isinstance(x, dt.datetime):
        return None if x.tzinfo else float((x - EPOCH) // dt.timedelta(microseconds=1))
    if isinstance(x, dt.date):
        return float((dt.datetime(x.year, x.month, x.day) - EPOCH) // dt.timedelta(microseconds=1))
    return None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    for batch in batches:
        for uri in batch.column("file").to_pylist():
            fs, path = pyarrow.fs.FileSystem.from_uri(uri)
            footer = pq.read_metadata(path, filesystem=fs)
            rows = []
            for g in range(footer.num_row_groups):
                group = footer.row_group(g)
                for k in range(footer.num_columns):
                    leaf, own = footer.schema.column(k), group.column(k)
                    flat, stats = leaf.path == leaf.name and leaf.max_repetition_level == 0, own.statistics
                    nulls = stats.null_count if flat and stats is not None and stats.has_null_count else None
                    low, high = (stats.min, stats.max) if flat and stats is not None and stats.has_min_max else (None, None)
                    text = [x.decode(errors="replace") if isinstance(x, bytes) else None if x is None else str(x) for x in (low, high)]
                    rows.append((uri, g, leaf.path if flat else leaf.path.split(".")[0], group.num_rows, nulls, *text, _number(low), _number(high)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def statistics(spark: SparkSession, path: str) -> DataFrame | None:
    """(file, row_group, column_name, rows, nulls, low, high, low_number, high_number) of every column chunk; None where footers cannot be read.

    ``nulls`` is null where a file does not state it, and for columns inside lists, maps and structs.
    """
    files = spark.read.parquet(path).inputFiles()
    try:
        for uri in files[:1]:
            pyarrow.fs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None
    table = spark.createDataFrame([(f,) for f in files], "file string")
    return table.repartition(max(1, -(-len(files) // FILES_A_TASK))).mapInArrow(_read, SCHEMA)


def columns(stats: DataFrame) -> DataFrame:
    """(column_name, rows, nulls, low_number, high_number, counted, bounded): one row a column.

    ``counted``: every chunk states its nulls; ``bounded``: and, unless all its rows are null, its bounds as numbers.
    """
    known = F.col("nulls").isNotNull()
    bounds = known & ((F.col("nulls") == F.col("rows")) | (F.col("low_number").isNotNull() & F.col("high_number").isNotNull()))
    return stats.groupBy("column_name").agg(F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.min("low_number").alias("low_number"), F.max("high_number").alias("high_number"), F.bool_and(known).alias("counted"), F.bool_and(bounds).alias("bounded"))


def dead_columns(spark: SparkSession, path: str, name: str) -> DataFrame:
    """As ``drift.dead_columns``, from statistics; only columns without them are scanned."""
    df = spark.read.parquet(path)
    stats = statistics(spark, path)
    if stats is None:
        return drift.dead_columns(df, name)
    each = {r.column_name: r for r in columns(stats).collect()}  # one row a column
    dead = [(name, c, each[c].rows) for c in df.columns if c in each and each[c].counted and 0 < each[c].rows == each[c].nulls]
    out = spark.createDataFrame(dead, "table_name string, column_name string, rows_total bigint")
    left = [c for c in df.columns if c not in each or not each[c].counted]
    return out.union(drift.dead_columns(df.select(*[f"`{c}`" for c in left]), name)) if left and each else out


def measure(spark: SparkSession, path: str, rules: list[invariants.Invariant]) -> DataFrame:
    """As ``invariants.measure`` on the table at ``path``; a bound is held against statistics first.

    Where every row group of a column states its bounds, only files with a row
    group beyond the rule's bounds are read, to count its rows; other rules
    are measured together by a scan.
    """
    df, stats = spark.read.parquet(path), statistics(spark, path)
    if stats is None:
        return invariants.measure(df, rules)
    each = {r.column_name: r for r in columns(stats).collect()}  # one row a column
    bound = [i for i in rules if i.column and (i.low is not None or i.high is not None) and i.column in each and each[i.column].bounded]
    rest = [i for i in rules if i not in bound]
    parts = [invariants.measure(df, rest)] if rest else []
    for rule in bound:
        s = each[rule.column]
        beyond = F.lit(False)
        if rule.low is not None:
            beyond = beyond | (F.col("low_number") < rule.low)
        if rule.high is not None:
            beyond = beyond | (F.col("high_number") > rule.high)
        files = [r.file for r in stats.where((F.col("column_name") == rule.column) & beyond).select("file").distinct().collect()]  # no longer than the listing of the table
        broken = invariants.measure(spark.read.schema(df.schema).parquet(*files), [rule]).select("violations") if files else spark.createDataFrame([(0,)], "violations bigint")
        text = (lambda x: F.timestamp_micros(F.lit(None if x is None else int(x)).cast("bigint")).cast("date").cast("string")) if rule.kind == "future_date" else lambda x: F.lit(x).cast("double").cast("string")
        low, high = (text(x) if there is not None else F.lit(None).cast("string") for x, there in ((s.low_number, rule.lowest), (s.high_number, rule.highest)))
        parts.append(broken.select(F.lit(rule.check_id).alias("check_id"), F.lit(rule.kind).alias("kind"), F.lit(s.rows - s.nulls).cast("bigint").alias("rows_scanned"), "violations", F.lit(0).cast("bigint").alias("non_numeric"), low.alias("lowest"), high.alias("highest")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
