"""Tables by name, their scope, sampling, inventory and row counts."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: column names that look like secrets.
SECRET = r"pass|pwd|secret|token|api_?key|salt|hash|credential"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def parquet(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """``<folder>/<name>.parquet`` for each name."""
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names or TABLES}


def jdbc(spark: SparkSession, url: str, table: str, *, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options) -> DataFrame:
    """A database table; with a numeric ``column`` it is read in ranges by many tasks."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column:
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


@dataclass(frozen=True)
class Scope:
    """Which tables and columns may be read. Names match whatever their case; an exclusion is a full or a bare name."""

    schemas: tuple[str, ...] = ()
    excluded_tables: tuple[str, ...] = ()
    excluded_columns: tuple[str, ...] = ()

    def filter_tables(self, tables: DataFrame) -> DataFrame:
        """(schema_name, table_name, …) rows in scope, sorted."""
        return self.with_reason(tables).where("reason IS NULL").drop("reason").orderBy("schema_name", "table_name")

    def with_reason(self, tables: DataFrame) -> DataFrame:
        """``tables`` with the reason for leaving each out, null for those in scope."""
        schema, bare = F.lower("schema_name"), F.lower("table_name")
        gone = [x.lower() for x in self.excluded_tables]
        reason = F.when(bare.isin(gone) | F.concat_ws(".", schema, bare).isin(gone), "table is excluded")
        if self.schemas:
            reason = F.when(~schema.isin([s.lower() for s in self.schemas]), "schema is not in scope").otherwise(reason)
        return tables.withColumn("reason", reason)

    def columns(self, inventory: DataFrame) -> DataFrame:
        """Inventory rows whose column may be read."""
        table, column = F.lower("table_name"), F.lower("column_name")
        gone = [x.lower() for x in self.excluded_columns]
        return inventory.where(~column.rlike(SECRET) & ~column.isin(gone) & ~F.concat_ws(".", table, column).isin(gone))

    def select(self, df: DataFrame, table: str) -> DataFrame:
        import re

        gone = {x.lower() for x in self.excluded_columns}
        return df.select(*[c for c in df.columns if not re.search(SECRET, c.lower()) and c.lower() not in gone and f"{table}.{c}".lower() not in gone])


def sampled(df: DataFrame, rows: int, limit: int = 2_000_000, percent: float = 2.0, seed: int = 7) -> tuple[DataFrame, bool]:
    """The table, or a row sample of it above ``limit`` rows, and whether it is one; counts on it are of the sample."""
    return (df.sample(fraction=percent / 100, seed=seed), True) if rows > limit else (df, False)


@dataclass(frozen=True)
class BlockSample:
    """Whole files of a table, chosen before any is read."""

    df: DataFrame
    files_read: int
    files_total: int
    rows_total: int

    def estimate(self, condition: Column, z: float = 3.0) -> DataFrame:
        """One row: sample_rows, hits, estimate (of the table's hits), error (``z`` standard errors), low, high.

        Files are clusters: the estimate is the sample's share of hits times
        the table's rows, which footers state; its error comes from how far
        the files differ, and is 0 where all of them were read.
        """
        each = self.df.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("m"), F.count_if(condition).alias("y"))
        s = each.agg(F.count("*").alias("n"), F.coalesce(F.sum("m"), F.lit(0)).alias("sample_rows"), F.coalesce(F.sum("y"), F.lit(0)).alias("hits"), *[F.coalesce(F.sum(F.col(a).cast("double") * F.col(b)), F.lit(0.0)).alias(a + b) for a, b in (("y", "y"), ("y", "m"), ("m", "m"))])
        share = F.when(F.col("sample_rows") > 0, F.col("hits") / F.col("sample_rows")).otherwise(0.0)
        spread = F.greatest(F.lit(0.0), F.col("yy") - 2 * share * F.col("ym") + share * share * F.col("mm"))
        n, total = F.lit(float(max(self.files_read, 1))), F.lit(float(self.files_total))
        error = F.when(n >= total, 0.0).otherwise(z * total * F.sqrt((1 - n / total) / n * spread / F.greatest(n - 1, F.lit(1.0))))
        estimate = share * self.rows_total
        return s.select("sample_rows", "hits", estimate.alias("estimate"), error.alias("error"), F.greatest(F.col("hits").cast("double"), estimate - error).alias("low"), F.least(F.lit(float(self.rows_total)), estimate + error).alias("high"))


def block_sample(spark: SparkSession, path: str, percent: float = 2.0, seed: int = 7, at_least: int = 8) -> BlockSample:
    """About ``percent`` of a table's files, and ``at_least`` so many, by a hash of seed and name; the others are never opened.

    A row sample reads every row to drop most; this reads only what it keeps,
    and pays with a wider error where rows of a file are alike. A table of no
    more than ``at_least`` files is read whole. The choice depends on file
    names only, so it stays the same while the table does.
    """
    whole = spark.read.parquet(path)
    files = sorted(whole.inputFiles(), key=lambda f: zlib.crc32(f"{seed}:{f.rsplit('/', 1)[-1]}".encode()))
    chosen = files[: max(at_least, math.ceil(len(files) * percent / 100))]
    df = whole if len(chosen) == len(files) else spark.read.schema(whole.schema).option("basePath", path).parquet(*chosen)
    return BlockSample(df, len(chosen), len(files), whole.count())


def inventory(spark: SparkSession, tables: dict[str, DataFrame], schema: str = "main") -> DataFrame:
    """schema_name, table_name, column_name, data_type, nullable, length, ordinal of every column."""
    rows = [(schema, t, f.name, f.dataType.simpleString(), f.nullable, None, k) for t, df in tables.items() for k, f in enumerate(df.schema, 1)]
    return spark.createDataFrame(rows, "schema_name string, table_name string, column_name string, data_type string, nullable boolean, length int, ordinal int")


def live_inventory(tables: dict[str, DataFrame], schema: str = "main") -> DataFrame:
    """The inventory as the data have it: tables with rows, columns with a value, whether nulls occur, and the longest text; one scan a table."""
    out = []
    for name, df in sorted(tables.items()):
        text = {f.name for f in df.schema if f.dataType.typeName() == "string"}
        sums = [x for k, f in enumerate(df.schema) for x in (F.count(F.col(f"`{f.name}`")).alias(f"c{k}"), (F.max(F.length(F.col(f"`{f.name}`"))) if f.name in text else F.lit(None)).cast("int").alias(f"l{k}"))]
        cells = [F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"), (F.col(f"c{k}") < F.col("n")).alias("nullable"), F.col(f"l{k}").alias("length"), F.lit(k + 1).alias("ordinal"), F.col(f"c{k}").alias("filled")) for k, f in enumerate(df.schema)]
        out.append(df.agg(F.count("*").alias("n"), *sums).select(F.lit(schema).alias("schema_name"), F.lit(name).alias("table_name"), F.inline(F.array(*cells))).where("filled > 0").drop("filled"))
    return reduce(DataFrame.unionByName, out)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) of each table."""
    each = [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in sorted(tables.items())]
    return reduce(DataFrame.union, each)
