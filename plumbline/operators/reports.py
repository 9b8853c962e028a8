"""Measurements as findings: one row of the finding schema for each thing worth a look, nothing where there is none.

Every builder takes what an operator measured, so what is reported and what
was done rest on the same predicate. All are projections of small aggregates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.expressions import pct
from plumbline.plans.model import FINDING, ROW, DedupRule, Grain, PhantomKeyRule, SnapshotRule


def finding(df: DataFrame, check_id: str | Column, severity: str | Column, finding_class: str | Column, title: Column, entity_id: str | Column, affected: str | Column, *, entity_type: str = "table", grain: Grain | str = "aggregate", baseline: str = "NONE", evidence: Column | None = None) -> DataFrame:
    """Each row of ``df`` as a finding; plain text is taken as a value, ``affected`` as a column."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    cells = {
        "check_id": lit(check_id), "family": F.substring_index(lit(check_id), "-", 1), "severity": lit(severity), "finding_class": lit(finding_class), "title": title, "entity_type": F.lit(entity_type), "entity_id": lit(entity_id),
        "affected_count": F.col(affected) if isinstance(affected, str) else affected, "grain": F.lit(str(grain)), "baseline": F.lit(baseline), "sampled": F.lit(False), "evidence": evidence if evidence is not None else F.lit(None),
    }
    return df.select(*[cells[f.name].cast(f.dataType).alias(f.name) for f in FINDING])


def text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def pinned(report: DataFrame, table: str, rule: SnapshotRule, check_id: str = "PIP-001") -> DataFrame:
    """From ``normalise.pin_report``: the table keeps history, and only its newest snapshots are read."""
    total = report.agg(F.sum("rows_set_aside").alias("aside"), F.max("snapshots").alias("snapshots"), F.sum("rows_total").alias("rows")).where("rows > 0")
    return finding(total, check_id, "info", "design", text(f"{table} holds up to ", F.col("snapshots"), " snapshots; the newest of each partition is read"), table, "aside", grain=f"snapshot_pinned({', '.join(rule.partition_by)})", evidence=F.to_json(F.struct("rows", "aside", "snapshots")))


def duplicates(measured: DataFrame, table: str, rule: DedupRule, check_id: str = "DUP-000", severity: str = "medium") -> DataFrame:
    """From ``normalise.measure_duplicates``: surplus rows of a key, and, apart, groups whose rows disagree (CON-011)."""
    keys, any_ = ", ".join(rule.keys), F.col("excess_rows") > 0
    left = "all are counted" if rule.mode == "exact_only" else "one row a key is counted"
    surplus = finding(
        measured, check_id, F.when(any_, severity).otherwise("info"), F.when(any_, "defect").otherwise("design"), text(f"{table}: ", F.col("excess_rows"), f" rows repeat a key ({keys}); {left}"), table, "excess_rows",
        evidence=F.to_json(F.struct("dup_groups", "excess_rows", "worst_group", "groups_identical", "groups_disagreeing")),
    )
    torn = finding(measured.where("groups_disagreeing > 0"), "CON-011", "high", "defect", text(f"{table}: ", F.col("groups_disagreeing"), f" keys ({keys}) have rows that contradict each other"), table, "groups_disagreeing", grain=f"group by ({keys})", evidence=F.to_json(F.struct("groups_disagreeing", "groups_identical")))
    return surplus.unionByName(torn)


def phantom(measured: DataFrame, table: str, rule: PhantomKeyRule, check_id: str = "VAL-018", severity: str = "medium") -> DataFrame:
    """From ``normalise.measure_phantom``: rows whose key stands for no entity; a defect where they are left out, a gap where they stay."""
    out = rule.mode == "exclude"
    return finding(measured.where("rows_phantom > 0"), check_id, severity, "defect" if out else "gap", text(f"{table}: ", F.col("rows_phantom"), f" rows with a key that is no entity in {rule.column}, {'left out' if out else 'kept'}"), f"{table}.{rule.column}", "rows_phantom", entity_type="column", grain=ROW, evidence=F.to_json(F.struct("rows_phantom", "rows_total")))


def cleanups(measured: DataFrame, table: str, severity: dict[str, str] | None = None) -> DataFrame:
    """From ``normalise.measure_cleanups``: one finding for each kind that changed a value, naming the worst column."""
    worst = F.max_by("column_name", F.struct("hits", "column_name")).alias("worst")
    each = measured.where("hits > 0").groupBy("check_id", "kind").agg(F.max("rows_any").alias("rows_any"), F.max("rows_total").alias("rows_total"), worst)
    level = reduce(lambda out, x: F.when(F.col("kind") == x[0], x[1]).otherwise(out), (severity or {}).items(), F.lit("medium"))
    return finding(each, F.col("check_id"), level, "defect", text(f"{table}: ", F.col("rows_any"), " rows hold a ", F.col("kind"), " in place of a value, most in ", F.col("worst")), table, "rows_any", grain=ROW, evidence=F.to_json(F.struct("rows_any", "rows_total", pct(F.col("rows_any"), F.col("rows_total")).alias("pct"))))


def missing_columns(found: DataFrame) -> DataFrame:
    """From ``normalise.missing_columns`` or ``missing_of``: CFG-001 for each rule that names columns its table lacks."""
    told = F.struct(*[c for c in ("context", "missing", "rows_read") if c in found.columns])
    return finding(found, "CFG-001", "high", "risk", text(F.col("table_name"), ": the ", F.col("context"), " rule names columns that are not there and did not run on them"), F.col("table_name"), F.size("missing"), evidence=F.to_json(told))


def failed_tables(spark: SparkSession, failed: list[tuple[str, str]]) -> DataFrame:
    """From ``normalise.build_all``: CFG-002 for each table that could not be normalised."""
    rows = spark.createDataFrame(failed, "table_name string, reason string")
    return finding(rows, "CFG-002", "high", "risk", text(F.col("table_name"), " was not normalised and is left out of this run"), F.col("table_name"), F.lit(0), evidence=F.to_json(F.struct("reason")))


# Severity and class of the three sides of a deadline.
DEADLINE = {"late": ("high", "violation", "past the deadline"), "gap": ("high", "gap", "missing though due"), "pending": ("info", "pending", "not yet due")}


def deadlines(split: DataFrame, check_id: str, table: str, label: str, *, grain: Grain = ROW, baseline: str = "ACTUAL") -> DataFrame:
    """From ``rules.deadline_split``: up to three findings; what is not yet due is told apart from what is missing."""
    cells = [F.struct(F.lit(b).alias("bucket"), F.lit(s).alias("severity"), F.lit(c).alias("kind"), F.lit(w).alias("words"), F.col(b).alias("n")) for b, (s, c, w) in DEADLINE.items()]
    rows = split.select(F.inline(F.array(*cells))).where("n > 0")
    return finding(rows, check_id, F.col("severity"), F.col("kind"), text(f"{label}: ", F.col("n"), " ", F.col("words")), table, "n", grain=grain, baseline=baseline, evidence=F.to_json(F.struct("bucket", "n")))


def empty_tables(names: DataFrame) -> DataFrame:
    """From ``drift.empty_tables``: one PIP-010 for all tables without a row."""
    rows = names.agg(F.count("*").alias("n"), F.array_sort(F.collect_list("table_name")).alias("names")).where("n > 0")
    return finding(rows, "PIP-010", "medium", "gap", text(F.col("n"), " tables hold no row"), F.element_at("names", 1), "n", evidence=F.to_json(F.struct("names")))


def unexamined(row_counts: DataFrame, declared: DataFrame, shown: int = 20) -> DataFrame:
    """One PIP-011: tables with rows that no rule declares; the largest are named, all are counted."""
    known = declared.select(F.lower("table_name").alias("t")).distinct()
    both = row_counts.where("row_count IS NOT NULL").join(known, F.lower("table_name") == F.col("t"), "left").withColumn("open", F.col("t").isNull() & (F.col("row_count") > 0))
    largest = F.slice(F.reverse(F.array_sort(F.collect_list(F.when(F.col("open"), F.struct("row_count", "table_name"))))), 1, shown).alias("largest")
    rows = both.agg(F.sum(F.col("open").cast("bigint")).alias("unchecked"), F.count("*").alias("in_scope"), F.sum(F.when(F.col("open"), F.col("row_count"))).alias("rows_unchecked"), F.sum((F.col("t").isNotNull() & (F.col("row_count") > 0)).cast("bigint")).alias("checked"), largest).where("unchecked > 0")
    return finding(rows, "PIP-011", "info", "design", text(F.col("unchecked"), " tables with rows are under no check; ", F.col("checked"), " of ", F.col("in_scope"), " are"), F.col("largest")[0]["table_name"], "unchecked", evidence=F.to_json(F.struct("unchecked", "checked", "in_scope", "rows_unchecked", "largest")))


def dead_columns(found: DataFrame, passed_over: list[str] = ()) -> DataFrame:
    """From ``drift.dead_columns``: one PIP-012 for all columns that are null on every row; tables not read are named."""
    each = found.groupBy("table_name").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("column_name")).alias("columns"))
    rows = each.agg(F.sum("n").alias("total"), F.count("*").alias("tables"), F.max_by("table_name", F.struct("n", "table_name")).alias("worst"), F.array_sort(F.collect_list(F.struct("table_name", "columns"))).alias("by_table")).where("total > 0")
    skipped = F.array(*[F.lit(t) for t in passed_over]).cast("array<string>").alias("passed_over")
    return finding(rows, "PIP-012", "low", "gap", text(F.col("total"), " columns of ", F.col("tables"), " tables are null on every row"), F.col("worst"), "total", entity_type="column", evidence=F.to_json(F.struct("by_table", skipped)))


def bad_groups(groups: DataFrame, check_id: str, table: str, key: str, *, severity: str = "medium", grain: Grain | str = "aggregate", baseline: str = "NONE") -> DataFrame:
    """A finding for each group that a rule names, such as those of ``rules.weight_groups``."""
    return finding(groups, check_id, severity, "violation", text(f"{table}: {key} ", F.coalesce(F.col(key).cast("string"), F.lit("null")), " breaks the rule"), F.col(key).cast("string"), F.lit(1), entity_type=key, grain=grain, baseline=baseline)
