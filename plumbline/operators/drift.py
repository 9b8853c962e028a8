"""Schema fingerprints, drift against an earlier run, coverage and dead columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.reports import finding, text


def column_fingerprints(inventory: DataFrame) -> DataFrame:
    """The inventory with ``fp``: type, nullability and length; the position does not count."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("data_type", "nullable", "length")]
    return inventory.withColumn("fp", F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12))


def table_fingerprints(inventory: DataFrame) -> DataFrame:
    """(table_name, columns, fp) over the sorted column fingerprints."""
    each = column_fingerprints(inventory).groupBy("table_name").agg(F.array_sort(F.collect_list(F.concat_ws(":", "column_name", "fp"))).alias("cols"))
    return each.select("table_name", F.size("cols").cast("bigint").alias("columns"), F.sha1(F.concat_ws("|", "cols")).alias("fp"))


def snapshot_metrics(inventory: DataFrame, row_counts: DataFrame, run_id: str) -> DataFrame:
    """The snapshot as metric rows: row_count and table_fp of tables, column_fp of columns."""
    none = F.lit("").alias("column_name")
    rows = row_counts.select("table_name", none, F.lit("row_count").alias("metric"), F.col("row_count").cast("string").alias("value"))
    tables = table_fingerprints(inventory).select("table_name", none, F.lit("table_fp").alias("metric"), F.col("fp").alias("value"))
    columns = column_fingerprints(inventory).select("table_name", "column_name", F.lit("column_fp").alias("metric"), F.col("fp").alias("value"))
    return rows.union(tables).union(columns).select(F.lit(run_id).alias("run_id"), "*")


def baseline(metrics: DataFrame, runs: DataFrame, exclude_run: str) -> DataFrame:
    """The latest value of each metric in a completed run other than this one, for all metrics at once."""
    done = runs.where((F.col("status") == "completed") & (F.col("run_id") != exclude_run)).select("run_id", "started_at")
    newest = Window.partitionBy("table_name", "column_name", "metric").orderBy(F.desc("started_at"), F.desc("run_id"))
    ranked = metrics.join(done, "run_id").withColumn("__rn", F.row_number().over(newest))
    return ranked.where("__rn = 1").drop("__rn")


def diff(current: DataFrame, earlier: DataFrame) -> DataFrame:
    """(table_name, column_name, change): added, removed or changed columns; silent if nothing came earlier."""
    now = current.select("table_name", "column_name", F.col("fp").alias("fp_now"))
    then = earlier.select("table_name", "column_name", F.col("fp").alias("fp_then"))
    both = now.join(then, ["table_name", "column_name"], "full_outer")
    change = F.when(F.col("fp_then").isNull(), "added").when(F.col("fp_now").isNull(), "removed").when(F.col("fp_now") != F.col("fp_then"), "changed")
    first_run = earlier.agg(F.count("*").alias("__n"))  # one row
    out = both.withColumn("change", change).where("change IS NOT NULL").crossJoin(F.broadcast(first_run)).where("__n > 0")
    return out.select("table_name", "column_name", "change")


def table_diff(changes: DataFrame, current: DataFrame, earlier: DataFrame) -> DataFrame:
    """(table_name, change) of whole tables that came or went."""
    now, then = current.select("table_name").distinct(), earlier.select("table_name").distinct()
    kind = changes.select("table_name", "change").distinct()
    gone = kind.where("change = 'removed'").join(now, "table_name", "left_anti")
    new = kind.where("change = 'added'").join(then, "table_name", "left_anti")
    return gone.union(new)


# Severity and class of each kind of change, and what it means.
DRIFT = {
    "added": ("info", "design", "new columns are read from now on, under no rule until one is declared"),
    "removed": ("medium", "risk", "rules and reports that name them no longer run"),
    "changed": ("high", "risk", "a rule that relied on the old type or nullability may no longer hold"),
    "table added": ("info", "design", "it is read from now on, under no rule until one is declared"),
    "table removed": ("medium", "risk", "it was dropped, renamed or is out of reach; what reads it must be looked at"),
}


def drift_findings(current: DataFrame, earlier: DataFrame, shown: int = 8) -> DataFrame:
    """PIP-007 in the schema of findings: one for each table that came or went, and one for each other table and kind of column change.

    ``current`` and ``earlier`` are column fingerprints; without an earlier run there is nothing to tell.
    The title names the first columns, the evidence all of them.
    """
    changes = diff(current, earlier)
    whole = table_diff(changes, current, earlier).select("table_name", F.concat(F.lit("table "), "change").alias("change"), F.lit(0).cast("bigint").alias("n"), F.array().cast("array<string>").alias("columns"))
    rest = changes.join(whole.select("table_name"), "table_name", "left_anti")
    columns = rest.groupBy("table_name", "change").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("column_name")).alias("columns"))
    pick = lambda k: reduce(lambda out, x: F.when(F.col("change") == x[0], x[1][k]).otherwise(out), DRIFT.items(), F.lit(None).cast("string"))
    names = F.concat(F.array_join(F.slice("columns", 1, shown), ", "), F.when(F.col("n") > shown, " ...").otherwise(""))
    title = F.when(F.col("n") == 0, text(F.col("change"), ": ", F.col("table_name"))).otherwise(text(F.col("n"), " columns of ", F.col("table_name"), " ", F.col("change"), ": ", names))
    evidence = F.when(F.col("n") > 0, F.to_json(F.struct("change", "columns", pick(2).alias("meaning")))).otherwise(F.to_json(F.struct("change", pick(2).alias("meaning"))))
    return finding(whole.unionByName(columns), "PIP-007", pick(0), pick(1), title, F.col("table_name"), "n", evidence=evidence)


def empty_tables(row_counts: DataFrame) -> DataFrame:
    """PIP-010: tables measured at 0 rows; an unmeasured one (null count) is not listed."""
    return row_counts.where("row_count = 0").select("table_name")


def confirm_empty(tables: dict[str, DataFrame], candidates: list[str]) -> list[str]:
    """Candidates that a real read finds empty: a stale count of 0 proves nothing."""
    return sorted(t for t in candidates if t in tables and tables[t].isEmpty())


def unexamined(row_counts: DataFrame, declared: DataFrame) -> DataFrame:
    """PIP-011: tables with rows that no rule declares, largest first."""
    known = declared.select(F.lower("table_name").alias("t")).distinct()
    left = row_counts.where("row_count > 0").join(F.broadcast(known), F.lower("table_name") == F.col("t"), "left_anti")  # the rule set: one row a declared table
    return left.select("table_name", "row_count").orderBy(F.desc("row_count"), "table_name")


def coverage(row_counts: DataFrame, declared: DataFrame) -> DataFrame:
    """checked, in_scope, rows_unchecked."""
    known = declared.select(F.lower("table_name").alias("t")).distinct()
    both = row_counts.join(F.broadcast(known), F.lower("table_name") == F.col("t"), "left")
    return both.agg(F.count("t").alias("checked"), F.count("*").alias("in_scope"), F.coalesce(F.sum(F.when(F.col("t").isNull(), F.col("row_count"))), F.lit(0)).cast("bigint").alias("rows_unchecked"))


def dead_columns(df: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """(table_name, column_name, rows_total) of columns that are null on every row, from one full scan; none for an empty table."""
    names = columns or df.columns
    counted = df.agg(F.count("*").alias("__n"), *[F.count(F.col(f"`{c}`")).alias(f"__c{k}") for k, c in enumerate(names)])
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"__c{k}").alias("filled"), F.col("__n").alias("rows_total")) for k, c in enumerate(names)]
    out = counted.select(F.inline(F.array(*cells))).where("filled = 0 AND rows_total > 0")
    return out.select(F.lit(name).alias("table_name"), "column_name", "rows_total")


def dead_columns_of(tables: dict[str, DataFrame], counts: dict[str, int], max_rows: int, max_columns: int | None = None) -> tuple[DataFrame | None, list[str]]:
    """Dead columns of all tables up to ``max_rows``, and the names of what was passed over: tables, and columns beyond ``max_columns`` of one."""
    small = [t for t in sorted(tables) if 0 < counts.get(t, 0) <= max_rows]
    found = [dead_columns(tables[t], t, tables[t].columns[:max_columns]) for t in small]
    beyond = [f"{t}.{c}" for t in small for c in tables[t].columns[max_columns:] if max_columns is not None]
    return (reduce(DataFrame.unionByName, found) if found else None), [t for t in sorted(tables) if counts.get(t, 0) > max_rows] + beyond
