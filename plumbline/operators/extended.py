"""Further rules: spelling variants, allowed values, lookups, variance, contribution, monotonicity, outliers, counter-queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.expressions import count_if, key_prefix, normal_key
from plumbline.operators import ranges
from plumbline.operators.quantiles import exact_medians, exact_quantiles


def spelling_variants(df: DataFrame, column: str) -> DataFrame:
    """(normal, spellings, rows): normal forms with more than one stored spelling."""
    each = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("raw")).agg(F.count("*").alias("n"))
    out = each.groupBy(normal_key(F.col("raw")).alias("normal")).agg(F.count("*").alias("spellings"), F.sum("n").alias("rows"))
    return out.where("spellings > 1")


def allowed_values(df: DataFrame, column: str, allowed: list) -> DataFrame:
    """(value, rows, verdict): allowed, not allowed, or missing for null."""
    c = F.col("value")
    verdict = F.when(c.isNull(), "missing").when(c.isin(allowed), "allowed").otherwise("not allowed")
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows")).withColumn("verdict", verdict)


def without_pii(df: DataFrame, columns: list[str], mask: bool = False) -> DataFrame:
    """Personal columns dropped, or replaced by a digest so that counts stay possible."""
    if not mask:
        return df.drop(*columns)
    return df.withColumns({c: F.sha2(F.col(c).cast("string"), 256) for c in columns if c in df.columns})


def two_hop(df: DataFrame, code: str, first: DataFrame, first_key: str, via: str, second: DataFrame, second_key: str, label: str, mark: str = "-") -> DataFrame:
    """``df`` with prefix and group: the code's prefix looked up twice by left joins; null where either hop finds nothing."""
    a = first.select(F.col(first_key).alias("prefix"), F.col(via).alias("__via")).distinct()
    b = second.select(F.col(second_key).alias("__via"), F.col(label).alias("group")).distinct()
    return df.withColumn("prefix", key_prefix(F.col(code), mark)).join(a, "prefix", "left").join(b, "__via", "left").drop("__via")


def breakdown(df: DataFrame, group: str, task: str, unmapped: str = "(unmapped)") -> DataFrame:
    """(group, tasks): distinct tasks of each group, unmapped ones as a row of their own."""
    return df.groupBy(F.coalesce(F.col(group).cast("string"), F.lit(unmapped)).alias("group_name")).agg(F.countDistinct(task).alias("tasks"))


def group_tally(df: DataFrame, group: str, task: str) -> DataFrame:
    """groups, unmapped_tasks: the unmapped are never counted as a group."""
    return df.agg(F.countDistinct(group).alias("groups"), F.countDistinct(F.when(F.col(group).isNull(), F.col(task))).alias("unmapped_tasks"))


def mapped_listing(df: DataFrame, other: DataFrame, on: str, columns: list[str]) -> DataFrame:
    return df.join(other, on).select(*columns).distinct()


def deadline_missed(due: Column, started: Column, as_of: Column) -> Column:
    """Past the day before the due date with no start."""
    return F.coalesce((as_of > F.date_sub(due, 1)) & started.isNull(), F.lit(False))


def signed_variance(actual: Column, expected: Column) -> tuple[Column, Column]:
    """(days, class): negative is ahead, never taken as absolute."""
    days = F.date_diff(actual, expected)
    return days, F.when(days < 0, "ahead").when(days == 0, "on schedule").when(days > 0, "behind")


def effective_deadline(actual: Column, expected: Column, days: int = 2) -> Column:
    return F.date_add(F.coalesce(actual, expected), days)


def contribution(df: DataFrame, group: str, weight: Column) -> DataFrame:
    """``df`` with contribution: the group's weight over its number of rows."""
    n = df.groupBy(group).agg(F.count("*").alias("__n"))
    return df.join(n, group).withColumn("contribution", weight / F.col("__n")).drop("__n")


def group_counts(df: DataFrame, column: str, missing: str = "(not recorded)") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("value")).agg(F.count("*").alias("rows"))


def delay_owner(kind: Column, owners: dict[str, str], otherwise: str = "unknown") -> Column:
    out = F.lit(otherwise)
    for k, owner in owners.items():
        out = F.when(kind == k, owner).otherwise(out)
    return out


def inconsistent_duration(df: DataFrame, duration: Column, start: Column, end: Column) -> DataFrame:
    """rows_scanned, violations where duration is not end - start + 1."""
    both = duration.isNotNull() & start.isNotNull() & end.isNotNull()
    return df.agg(count_if(both).alias("rows_scanned"), count_if(both & (duration != F.date_diff(end, start) + 1)).alias("violations"))


def reversals(df: DataFrame, key: str, order_by: list[str], value: str, hot_rows: int = ranges.HOT_ROWS) -> DataFrame:
    """Rows whose cumulative value is below the one before it, with ``previous``; rows of equal order go by value.

    A key of more than ``hot_rows`` rows is compared range by range, in as many tasks as it fills.
    """
    hot, cold = ranges.hot_and_cold(df, key, hot_rows)
    window = Window.partitionBy(key).orderBy(*[F.asc_nulls_first(c) for c in (*order_by, value)])
    out = cold.withColumn("previous", F.lag(value).over(window))
    if hot is not None:
        out = out.unionByName(ranges.previous(hot, key, order_by, value, "previous"))
    return out.where(F.col(value) < F.col("previous"))


def coverage_against(df: DataFrame, declared: dict[str, float], tolerance: float = 0.01) -> DataFrame:
    """(column_name, coverage, declared, off) of each declared column."""
    one = df.agg(F.count("*").alias("n"), *[F.count(c).alias(f"c{k}") for k, c in enumerate(declared)])
    cells = [F.struct(F.lit(c).alias("column_name"), F.round(F.col(f"c{k}") / F.col("n"), 4).alias("coverage"), F.lit(float(d)).alias("declared")) for k, (c, d) in enumerate(declared.items())]
    return one.select(F.inline(F.array(*cells))).withColumn("off", F.abs(F.col("coverage") - F.col("declared")) > tolerance)


def iqr_bounds(df: DataFrame, group: str, value: str, k: float = 1.5) -> DataFrame:
    """(group, q1, q3, low, high); groups of any size, see ``quantiles``."""
    q = exact_quantiles(df, group, value, {"q1": 0.25, "q3": 0.75})
    return q.withColumns({"low": F.col("q1") - k * (F.col("q3") - F.col("q1")), "high": F.col("q3") + k * (F.col("q3") - F.col("q1"))})


def iqr_outliers(df: DataFrame, group: str, value: str, k: float = 1.5) -> DataFrame:
    bounds = iqr_bounds(df, group, value, k).select(group, "low", "high")
    return df.join(bounds, group).where((F.col(value) < F.col("low")) | (F.col(value) > F.col("high")))


def mad(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median, mad): the median and the median distance from it."""
    middle = exact_medians(df, group, value)
    far = df.join(middle, group).select(group, F.abs(F.col(value) - F.col("median")).alias("__d"))
    return middle.join(exact_medians(far, group, "__d", "mad"), group)


def mad_outliers(df: DataFrame, group: str, value: str, k: float = 3.0) -> DataFrame:
    return df.join(mad(df, group, value), group).where(F.abs(F.col(value) - F.col("median")) > k * 1.4826 * F.col("mad"))


def metric_drift(now: DataFrame, then: DataFrame, share: float = 0.2) -> DataFrame:
    """Metrics that moved by more than ``share`` of their earlier value."""
    keys = ["table_name", "column_name", "metric"]
    both = now.select(*keys, F.col("value").try_cast("double").alias("now")).join(then.select(*keys, F.col("value").try_cast("double").alias("then")), keys)
    return both.where(F.abs(F.col("now") - F.col("then")) > share * F.abs("then"))


def agreeing(first: DataFrame, second: DataFrame, key: str, count: str) -> DataFrame:
    """``first`` with verified: whether an independent counter-query found the same number."""
    other = second.select(key, F.col(count).alias("__other"))
    return first.join(other, key, "left").withColumn("verified", F.col(count).eqNullSafe(F.col("__other"))).drop("__other")
