"""Profiling: tables in scope, columns with their null share and distinct count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expressions import pct


def describe_table(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """(column_name, data_type, rows, filled, null_pct, distinct) of each column.

    Exact distinct counts go column by column as (column, value) groups, which
    shuffles each distinct value once and never multiplies a row per column in
    one aggregation; ``approximate`` takes one pass with fixed-size sketches.
    """
    names = columns or df.columns
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    if approximate:
        one = df.agg(F.count("*").alias("n"), *[x for k, c in enumerate(names) for x in (F.count(c).alias(f"f{k}"), F.approx_count_distinct(c).alias(f"d{k}"))])
        cells = [F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("data_type"), F.col("n").alias("rows"), F.col(f"f{k}").alias("filled"), F.col(f"d{k}").alias("distinct_values")) for k, c in enumerate(names)]
        out = one.select(F.inline(F.array(*cells)))
    else:
        cells = [F.struct(F.lit(k).alias("k"), F.col(c).cast("string").alias("v")) for k, c in enumerate(names)]
        values = df.select(F.inline(F.array(*cells))).groupBy("k", "v").agg(F.count("*").alias("n"))
        each = values.groupBy("k").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("filled"), F.count("v").alias("distinct_values"))
        named = F.element_at(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(kinds[c]).alias("t")) for c in names]), F.col("k") + 1)
        out = each.select(named.c.alias("column_name"), named.t.alias("data_type"), "rows", "filled", "distinct_values")
    return out.select("column_name", "data_type", "rows", "filled", pct(F.col("rows") - F.col("filled"), F.col("rows")).alias("null_pct"), "distinct_values")


#: Log2 of the registers of a kept distinct-count sketch.
LG_REGISTERS = 12


def distinct_error(lg: int = LG_REGISTERS) -> float:
    """Relative standard error of a distinct count from sketches of 2 ** ``lg`` registers, merged or not."""
    return 1.04 / 2 ** (lg / 2)


def partial_profile(df: DataFrame, part: str, columns: list[str] | None = None, lg: int = LG_REGISTERS) -> DataFrame:
    """(part, column_name, rows, filled, sketch) of one part of a table, such as a day or a run: one scan, a few kilobytes a column."""
    names = columns or df.columns
    one = df.agg(F.count("*").alias("n"), *[x for k, c in enumerate(names) for x in (F.count(F.col(f"`{c}`")).alias(f"f{k}"), F.hll_sketch_agg(F.col(f"`{c}`").cast("string"), lg).alias(f"s{k}"))])
    cells = [F.struct(F.lit(part).alias("part"), F.lit(c).alias("column_name"), F.col("n").alias("rows"), F.col(f"f{k}").alias("filled"), F.col(f"s{k}").alias("sketch")) for k, c in enumerate(names)]
    return one.select(F.inline(F.array(*cells)))


def keep_profile(df: DataFrame, path: str, part: str, columns: list[str] | None = None) -> None:
    """Store a part's profile, replacing what was stored for it; no other part is read or written."""
    out = partial_profile(df, part, columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("part").parquet(path)


def merged_profile(parts: DataFrame) -> DataFrame:
    """(column_name, rows, filled, null_pct, distinct_values) over all kept parts; distinct counts are within ``distinct_error``."""
    out = parts.groupBy("column_name").agg(F.sum("rows").alias("rows"), F.sum("filled").alias("filled"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"))
    return out.select("column_name", "rows", "filled", pct(F.col("rows") - F.col("filled"), F.col("rows")).alias("null_pct"), "distinct_values")


def capped(df: DataFrame, n: int) -> DataFrame:
    """The first n rows, as a page for a reader."""
    return df.limit(n)


def test_execute(df: DataFrame, cap: int, sample: int = 10) -> tuple[int, list]:
    """(rows up to the cap, a few of them) of a candidate check."""
    page = df.limit(cap).persist()
    try:
        return page.count(), page.take(sample)
    finally:
        page.unpersist()
