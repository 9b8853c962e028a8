"""Cross-field and cross-table rule checks as generic operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.expressions import count_if, number
from plumbline.operators import ranges
from plumbline.sources import scratch


def missing_prerequisite(df: DataFrame, later: str, earlier: str) -> DataFrame:
    """Rows with the later milestone set and the earlier one missing: rows_scanned, violations."""
    return df.agg(F.count("*").alias("rows_scanned"), count_if(F.col(later).isNotNull() & F.col(earlier).isNull()).alias("violations"))


def child_after_master(child: DataFrame, parent: DataFrame, key: str, child_date: str, master_date: str, slack: int = 0) -> DataFrame:
    """Children dated after their parent's master date plus ``slack`` days: compared, violations, parents_affected, worst_days."""
    both = child.join(parent, key)
    days = F.date_diff(F.col(child_date).cast("date"), F.date_add(F.col(master_date).cast("date"), slack))
    compared = both.where(days.isNotNull()).select(key, days.alias("days"))
    return compared.agg(F.count("*").alias("compared"), count_if(F.col("days") > 0).alias("violations"), F.countDistinct(F.when(F.col("days") > 0, F.col(key))).alias("parents_affected"), F.max("days").alias("worst_days"))


def children_of(child: DataFrame, key: str, done: Column) -> DataFrame:
    return child.groupBy(key).agg(F.count("*").alias("children"), count_if(F.coalesce(done, F.lit(False))).alias("children_done"))


def closed_parent_open_children(parent: DataFrame, child: DataFrame, key: str, closed: Column, done: Column) -> DataFrame:
    """parents_affected, open_children of parents that are closed while children are not done."""
    both = parent.where(closed).select(key).distinct().join(children_of(child, key, done), key)
    return both.where("children_done < children").agg(F.count("*").alias("parents_affected"), F.coalesce(F.sum(F.col("children") - F.col("children_done")), F.lit(0)).cast("bigint").alias("open_children"))


def done_children_no_start(parent: DataFrame, child: DataFrame, key: str, started: Column, done: Column, more_than: int) -> DataFrame:
    """parents_affected, children_done of parents without a start that have more than so many finished children."""
    both = parent.where(~F.coalesce(started, F.lit(False))).select(key).distinct().join(children_of(child, key, done), key)
    return both.where(F.col("children_done") > more_than).agg(F.count("*").alias("parents_affected"), F.coalesce(F.sum("children_done"), F.lit(0)).cast("bigint").alias("children_done"))


def deadline_bucket(actual: Column, deadline: Column, as_of: Column) -> Column:
    """late, gap (missing though due), pending (missing, not yet due); null for on time or without a deadline."""
    return F.when(actual.isNotNull() & (actual > deadline), "late").when(actual.isNull() & (deadline < as_of), "gap").when(actual.isNull() & (deadline >= as_of), "pending")


def deadline_split(df: DataFrame, actual: Column, deadline: Column, as_of: Column) -> DataFrame:
    """late, gap, pending, total in one pass."""
    b = deadline_bucket(actual, deadline, as_of)
    return df.select(b.alias("b")).agg(*[count_if(F.col("b") == x).alias(x) for x in ("late", "gap", "pending")], F.count("*").alias("total"))


def interval_overlaps(df: DataFrame, resource: str, entity: str, start: str, end: str, bucket_days: int | None = 31) -> DataFrame:
    """Pairs (resource, a, b) of entities a < b whose closed intervals on one resource meet; inverted intervals are left out.

    With ``bucket_days`` (31 unless said otherwise) intervals meet inside time buckets, so one busy
    resource is spread over many tasks; a pair is kept in the bucket where the
    later of the two starts.
    """
    good = df.where(F.col(start) <= F.col(end)).select(F.col(resource).alias("resource"), F.col(entity).alias("e"), F.col(start).cast("date").alias("s"), F.col(end).cast("date").alias("t"))
    day = lambda c: F.floor(F.unix_date(c) / (bucket_days or 1))
    if bucket_days:
        good = good.withColumn("bucket", F.explode(F.sequence(day(F.col("s")), day(F.col("t")))))
    keys = ["resource", "bucket"] if bucket_days else ["resource"]
    a, b = good.alias("a"), good.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    meet = (F.col("a.e") < F.col("b.e")) & (F.col("a.s") <= F.col("b.t")) & (F.col("b.s") <= F.col("a.t"))
    if bucket_days:
        meet = meet & (day(F.greatest("a.s", "b.s")) == F.col("a.bucket"))
    pairs = a.join(b, [*on, meet])
    return pairs.select(F.col("a.resource").alias("resource"), F.col("a.e").alias("a"), F.col("b.e").alias("b"))


def overlap_counts(df: DataFrame, resource: str, entity: str, start: str, end: str, bucket_days: int = 31, unit: str = "date") -> DataFrame:
    """(resource, pairs): pairs of entities whose closed intervals on one resource meet, counted by a sweep.

    Of n intervals, those pairs do not meet in which one ends before the other
    starts: a running sum of ends counts them, and no pair is listed. With
    ``unit`` date, ends are summed by day first, so a resource has no more rows
    than days; with timestamp it may have as many as intervals, and the running
    sum goes over ranges. That holds for entities with one interval on the resource; pairs
    with an entity that has several are listed once each, as intervals of one
    pair may meet more than once. Resources without a pair are left out.
    """
    good = df.where(F.col(start) <= F.col(end)).select(F.col(resource).alias("resource"), F.col(entity).alias("e"), F.col(start).cast(unit).alias("s"), F.col(end).cast(unit).alias("t"))
    good = good.where("s <= t AND resource IS NOT NULL AND e IS NOT NULL")
    # Written once: the sweep's ranges and the search for entities with several intervals read it.
    each = scratch.written(good.groupBy("resource", "e").agg(F.count("*").alias("n"), F.min("s").alias("s"), F.max("t").alias("t")), "intervals")
    single, several = each.where("n = 1"), each.where("n > 1")

    both = single.select("resource", F.inline(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("starts"), F.lit(0).alias("ends")), F.struct(F.col("t").alias("at"), F.lit(0).alias("starts"), F.lit(1).alias("ends")))))
    # Dealt by day before they meet: left to itself a task sums all days of a file's split, and sorts 64 MB of compressed ones.
    events = ranges.spread(both, "resource", "at", source=each, each=2).groupBy("resource", "at").agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends"))
    if unit == "date":
        events = ranges.spread(events, "resource", source=each, each=2)
        earlier = Window.partitionBy("resource").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        events = events.withColumn("ended", F.coalesce(F.sum("ends").over(earlier), F.lit(0)))
    else:
        events = ranges.running_before(events, "resource", "at", "ends", "ended")
    swept = events.groupBy("resource").agg(F.sum("starts").alias("n"), F.sum(F.col("starts") * F.col("ended")).alias("apart"))
    swept = swept.select("resource", (F.expr("n * (n - 1) div 2") - F.col("apart")).alias("pairs"))

    if several.isEmpty():
        return swept.where("pairs > 0")
    day = lambda c: F.floor(F.unix_date(c.cast("date")) / bucket_days)
    cut = good.withColumn("bucket", F.explode(F.sequence(day(F.col("s")), day(F.col("t")))))
    a, b = cut.join(several.select("resource", "e"), ["resource", "e"], "left_semi").alias("a"), cut.alias("b")
    meet = (F.col("a.e") != F.col("b.e")) & (F.col("a.s") <= F.col("b.t")) & (F.col("b.s") <= F.col("a.t")) & (day(F.greatest("a.s", "b.s")) == F.col("a.bucket"))
    listed = a.join(b, [F.col("a.resource") == F.col("b.resource"), F.col("a.bucket") == F.col("b.bucket"), meet])
    listed = listed.select(F.col("a.resource").alias("resource"), F.least("a.e", "b.e").alias("x"), F.greatest("a.e", "b.e").alias("y")).distinct().groupBy("resource").agg(F.count("*").alias("pairs"))
    return swept.union(listed).groupBy("resource").agg(F.sum("pairs").alias("pairs")).where("pairs > 0")


def overlap_totals(counts: DataFrame) -> DataFrame:
    """pairs, resources of ``overlap_counts``."""
    return counts.agg(F.coalesce(F.sum("pairs"), F.lit(0)).cast("bigint").alias("pairs"), F.count("*").alias("resources"))


def overlap_summary(pairs: DataFrame) -> DataFrame:
    """pairs, resources; each pair of entities counts once on a resource."""
    each = pairs.distinct().groupBy("resource").agg(F.count("*").alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("pairs"), F.count("*").alias("resources"))


def gate_versus_progress(state: DataFrame, parent: DataFrame, key: str, gate: Column, progress: Column, at_least: float) -> DataFrame:
    """compared, violations: entities past the gate whose latest progress is below ``at_least``."""
    both = state.join(parent, key)
    return both.agg(F.count("*").alias("compared"), count_if(gate & (progress < at_least)).alias("violations"))


def contradiction(df: DataFrame, says: Column, unless: Column, entity: str) -> DataFrame:
    """rows_scanned, violations, entities of rows where ``says`` holds and ``unless`` does not."""
    bad = F.coalesce(says, F.lit(False)) & ~F.coalesce(unless, F.lit(False))
    return df.agg(F.count("*").alias("rows_scanned"), count_if(bad).alias("violations"), F.countDistinct(F.when(bad, F.col(entity))).alias("entities"))


def progress_without_date(df: DataFrame, progress: str, threshold: float, date: str, strictly: bool = False) -> DataFrame:
    """rows_scanned, violations: progress reached while the date, after clean-up, is missing."""
    v = number(F.col(progress))
    reached = v > threshold if strictly else v >= threshold
    return df.agg(F.count("*").alias("rows_scanned"), count_if(reached & F.col(date).isNull()).alias("violations"))


def weight_groups(df: DataFrame, group: str, code: str, weight: str, total: float = 100.0, tolerance: float = 0.5) -> DataFrame:
    """Groups whose distinct (code, weight) do not sum to the total: group, codes, weight_sum (null counts as bad)."""
    each = df.select(F.col(group).alias("group_key"), F.col(code).alias("code"), F.col(weight).cast("decimal(14,4)").alias("w")).distinct()
    out = each.groupBy("group_key").agg(F.countDistinct("code").alias("codes"), F.sum("w").cast("decimal(14,4)").alias("weight_sum"))
    return out.where(F.col("weight_sum").isNull() | (F.abs(F.col("weight_sum") - F.lit(total)) > tolerance))
