"""Registered queries of the data-quality operators, each with its SQL.

The given tables are clean, so some queries derive dirt from keys, and the SQL
derives the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import expressions as X
from plumbline.operators import drift, evidence, extended, findings, grain, invariants, normalise, profile, quantiles, ranges, reports, rules
from plumbline.plans import checks
from plumbline.plans.model import FINDING, ROW, CleanupRule, ColumnRule, DateOrderRule, DedupRule, PhantomKeyRule, SnapshotRule, TableRules, actionable, latest_per, severity_rank
from plumbline.sources import footers, registry, results, scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return wrap


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


LINE_RULE = DedupRule(("l_orderkey", "l_linenumber"), ("l_shipdate desc", "l_partkey desc", "l_suppkey desc", "l_extendedprice desc", "l_quantity desc", "l_discount desc", "l_tax desc", "l_returnflag", "l_linestatus"), compare=("l_quantity", "l_returnflag"))
LINE_ORDER = "l_shipdate DESC NULLS LAST, l_partkey DESC NULLS LAST, l_suppkey DESC NULLS LAST, l_extendedprice DESC NULLS LAST, l_quantity DESC NULLS LAST, l_discount DESC NULLS LAST, l_tax DESC NULLS LAST, l_returnflag NULLS FIRST, l_linestatus NULLS FIRST"
LINE_LATEST = f"SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE_ORDER}) = 1"


# Flagship: lines at their grain against their orders, one finding row.
@query(f"""
SELECT 'TMP-SHIP' AS check_id, count(*) AS rows_scanned,
       CAST(sum(CASE WHEN CAST(o_orderdate AS DATE) > CAST(l_shipdate AS DATE) THEN 1 ELSE 0 END) AS BIGINT) AS violations,
       CAST(max(date_diff('day', CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE))) AS VARCHAR) AS worst_days
FROM ({LINE_LATEST}) JOIN orders ON l_orderkey = o_orderkey""")
def order_before_shipping(spark, sf):
    lines = grain.at_grain(read(spark, sf, "lineitem"), latest_per(list(LINE_RULE.keys), list(LINE_RULE.order_by)))
    both = lines.join(read(spark, sf, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = invariants.measure(both, [invariants.date_order(DateOrderRule("TMP-SHIP", "o_orderdate", "l_shipdate"))])
    return out.select("check_id", "rows_scanned", "violations", F.col("highest").alias("worst_days"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate FROM ({LINE_LATEST})")
def dedup_keep_latest(spark, sf):
    return normalise.dedup(read(spark, sf, "lineitem"), LINE_RULE).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")


GROUPS = "SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT concat_ws('|', l_quantity, l_returnflag)) AS d FROM lineitem GROUP BY ALL"


@query(f"""
SELECT count(*) FILTER (WHERE n > 1) AS dup_groups, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rows_in_dup_groups,
       CAST(coalesce(sum(n - 1) FILTER (WHERE n > 1), 0) AS BIGINT) AS excess_rows, coalesce(max(n) FILTER (WHERE n > 1), 0) AS worst_group,
       count(*) FILTER (WHERE n > 1 AND d > 1) AS groups_disagreeing, count(*) FILTER (WHERE n > 1 AND d = 1) AS groups_identical
FROM ({GROUPS})""")
def dedup_measure(spark, sf):
    return normalise.measure_duplicates(read(spark, sf, "lineitem"), LINE_RULE)


@query(f"SELECT l_orderkey, l_linenumber, n FROM ({GROUPS}) WHERE n > 1 AND d > 1")
def dup_conflicts(spark, sf):
    return normalise.conflicting_groups(read(spark, sf, "lineitem"), LINE_RULE)


@query(f"SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, l.l_returnflag FROM lineitem l SEMI JOIN (SELECT * FROM ({GROUPS}) WHERE n > 1 AND d > 1) g ON l.l_orderkey = g.l_orderkey AND l.l_linenumber = g.l_linenumber")
def dup_conflict_rows(spark, sf):
    return normalise.conflicting_rows(read(spark, sf, "lineitem"), LINE_RULE).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query(f"SELECT CAST(coalesce(sum(CASE WHEN n > 1 AND d = 1 THEN 1 ELSE n END), 0) AS BIGINT) AS rows_left FROM ({GROUPS})")
def dedup_collapse_identical(spark, sf):
    rule = DedupRule(LINE_RULE.keys, mode="collapse_identical", compare=LINE_RULE.compare)
    return normalise.dedup(read(spark, sf, "lineitem"), rule).agg(F.count("*").alias("rows_left"))


PIN = SnapshotRule("ts", ("user_id",))


@query("SELECT e.event_id, e.user_id, e.ts FROM events e JOIN (SELECT user_id, max(ts) AS m FROM events GROUP BY user_id) USING (user_id) WHERE e.ts = m")
def snapshot_pin(spark, sf):
    return normalise.pin_snapshot(read(spark, sf, "events"), PIN).select("event_id", "user_id", "ts")


@query("SELECT event_id, ts FROM events WHERE ts = (SELECT max(ts) FROM events)")
def snapshot_pin_global(spark, sf):
    return normalise.pin_snapshot(read(spark, sf, "events"), SnapshotRule("ts")).select("event_id", "ts")


@query("""
SELECT e.user_id, max(ts) AS pinned_at, count(*) AS rows_total, count(*) FILTER (WHERE ts = m) AS rows_kept, count(DISTINCT ts) AS snapshots, count(*) - count(*) FILTER (WHERE ts = m) AS rows_set_aside
FROM events e JOIN (SELECT user_id, max(ts) AS m FROM events GROUP BY user_id) g ON e.user_id = g.user_id GROUP BY e.user_id""")
def pin_report(spark, sf):
    return normalise.pin_report(read(spark, sf, "events"), PIN)


@query("SELECT event_id, user_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC NULLS LAST) = 1")
def grain_latest(spark, sf):
    return grain.at_grain(read(spark, sf, "events"), latest_per(["user_id", "event_type"], ["ts desc", "event_id desc"])).select("event_id", "user_id", "event_type", "ts")


@query("SELECT conv_id, turn, role, text FROM conversations WHERE turn IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) = 1")
def grain_custom(spark, sf):
    return grain.latest_state(read(spark, sf, "conversations"), ["conv_id"], ["turn desc", "role desc"]).select("conv_id", "turn", "role", "text")


@query("""
WITH p AS (SELECT e.* FROM events e JOIN (SELECT user_id, max(ts) AS m FROM events GROUP BY user_id) g ON e.user_id = g.user_id AND e.ts = m)
SELECT event_id, user_id, event_type FROM p QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def grain_snapshot_pinned(spark, sf):
    built = normalise.build(read(spark, sf, "events"), TableRules("events", latest_per(["user_id", "event_type"], ["ts desc", "event_id desc"]), snapshot=PIN))
    return built.at_grain().select("event_id", "user_id", "event_type")


PHANTOM = PhantomKeyRule("user_id", (0,), "exclude")


@query("SELECT count(*) AS rows_total, count(*) FILTER (WHERE user_id IN (0)) AS rows_phantom FROM events")
def phantom_flag(spark, sf):
    return normalise.measure_phantom(read(spark, sf, "events"), PHANTOM)


@query("SELECT event_id, user_id FROM events WHERE user_id IS NULL OR user_id NOT IN (0)")
def phantom_exclude(spark, sf):
    return normalise.apply_phantom(read(spark, sf, "events"), PHANTOM).select("event_id", "user_id")


def dirty_orders(spark, sf):
    """Orders with placeholder dates, blank and sentinel status text, derived from the key."""
    key, date = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    d = F.when(key % 11 == 0, F.lit("1900-01-01").cast("date")).when(key % 13 == 0, F.lit("1899-12-30").cast("date")).otherwise(date)
    st = F.when(key % 7 == 0, "  ").when(key % 17 == 0, " n/a ").when(key % 19 == 0, "Unknown").otherwise(F.col("o_orderstatus"))
    return read(spark, sf, "orders").select("o_orderkey", "o_totalprice", d.alias("d"), st.alias("st"))


DIRTY = """(SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 11 = 0 THEN DATE '1900-01-01' WHEN o_orderkey % 13 = 0 THEN DATE '1899-12-30' ELSE CAST(o_orderdate AS DATE) END AS d,
  CASE WHEN o_orderkey % 7 = 0 THEN '  ' WHEN o_orderkey % 17 = 0 THEN ' n/a ' WHEN o_orderkey % 19 = 0 THEN 'Unknown' ELSE o_orderstatus END AS st FROM orders)"""
CLEAN = f"(SELECT o_orderkey, o_totalprice, CASE WHEN d IN (DATE '1900-01-01', DATE '1899-12-30') THEN NULL ELSE d END AS d, CASE WHEN trim(st) = '' OR upper(trim(st)) IN ('N/A', 'UNKNOWN') THEN NULL ELSE trim(st) END AS st FROM {DIRTY})"
CLEANUPS = [CleanupRule("blank", ("st",)), CleanupRule("sentinel", ("st",), ("N/A", "unknown")), CleanupRule("placeholder", ("d",), ("1900-01-01", "1899-12-30"))]


@query(f"SELECT o_orderkey, d, st FROM {CLEAN}")
def cleanup_apply(spark, sf):
    return normalise.clean(dirty_orders(spark, sf), CLEANUPS).select("o_orderkey", "d", "st")


@query(f"""
SELECT 'BLK-001' AS check_id, 'blank' AS kind, 'st' AS column_name, count(*) FILTER (WHERE trim(st) = '') AS hits, count(*) FILTER (WHERE trim(st) = '') AS rows_any, count(*) AS rows_total FROM {DIRTY}
UNION ALL SELECT 'SNT-001', 'sentinel', 'st', count(*) FILTER (WHERE upper(trim(st)) IN ('N/A', 'UNKNOWN')), count(*) FILTER (WHERE upper(trim(st)) IN ('N/A', 'UNKNOWN')), count(*) FROM {DIRTY}
UNION ALL SELECT 'PLC-001', 'placeholder', 'd', count(*) FILTER (WHERE d IN (DATE '1900-01-01', DATE '1899-12-30')), count(*) FILTER (WHERE d IN (DATE '1900-01-01', DATE '1899-12-30')), count(*) FROM {DIRTY}""")
def cleanup_measure(spark, sf):
    return normalise.measure_cleanups(dirty_orders(spark, sf), CLEANUPS)


@query(f"""
SELECT 'orders' AS target, kind, n AS rows_affected, t AS rows_total, round(100.0 * n / t, 2) AS pct, c || '=' || n AS detail FROM (
  SELECT 'blank' AS kind, 'st' AS c, count(*) FILTER (WHERE trim(st) = '') AS n, count(*) AS t FROM {DIRTY}
  UNION ALL SELECT 'sentinel', 'st', count(*) FILTER (WHERE upper(trim(st)) IN ('N/A', 'UNKNOWN')), count(*) FROM {DIRTY}
  UNION ALL SELECT 'placeholder', 'd', count(*) FILTER (WHERE d IN (DATE '1900-01-01', DATE '1899-12-30')), count(*) FROM {DIRTY}) WHERE n > 0""")
def normalisation_log(spark, sf):
    return normalise.action_log(normalise.actions(normalise.measure_cleanups(dirty_orders(spark, sf), CLEANUPS), "orders"))


@query("""
SELECT 'events' AS table_name, (SELECT count(*) FROM events) AS rows_raw, count(*) AS rows_effective
FROM (SELECT user_id, event_type FROM events WHERE user_id <> 0 GROUP BY ALL)
UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), (SELECT count(*) FROM orders)""")
def normalise_all_counts(spark, sf):
    tables = {"events": read(spark, sf, "events"), "orders": dirty_orders(spark, sf)}
    declared = [
        TableRules("events", phantom=(PHANTOM,), dedup=DedupRule(("user_id", "event_type"), ("ts desc", "event_id desc"))),
        TableRules("orders", cleanups=tuple(CLEANUPS)),
        TableRules("not_there"),
    ]
    built, _ = normalise.build_all(tables, declared)
    return reduce(DataFrame.union, [b.counts() for b in built.values()])


@query(f"SELECT CAST(a + b AS BIGINT) AS rows_raw, CAST(c AS BIGINT) AS rows_effective, CAST(a + b - c AS BIGINT) AS rows_removed FROM (SELECT (SELECT count(*) FROM events) AS a, (SELECT count(*) FROM lineitem) AS b, (SELECT count(*) FROM events WHERE user_id <> 0) + (SELECT count(*) FROM ({LINE_LATEST})) AS c)")
def normalisation_summary(spark, sf):
    built = [normalise.build(read(spark, sf, "events"), TableRules("events", phantom=(PHANTOM,))), normalise.build(read(spark, sf, "lineitem"), TableRules("lineitem", dedup=LINE_RULE))]
    return normalise.action_summary(reduce(DataFrame.union, [b.counts() for b in built]))


def misdeclared(spark, sf):
    """Rules of two tables, some of which name columns that are not there."""
    orders = TableRules("orders", cleanups=(CleanupRule("blank", ("ST", "no_such_column")), CleanupRule("sentinel", ("gone",), ("N/A",))), phantom=(PhantomKeyRule("o_orderkey", (-1,), "exclude"),))
    events = TableRules("events", dedup=DedupRule(("User_Id", "event_type"), ("ts desc", "event_id desc"), compare=("value", "lost")), snapshot=SnapshotRule("TS", ("event_type", "region")))
    return normalise.build_all({"orders": dirty_orders(spark, sf), "events": read(spark, sf, "events")}, [orders, events])[0]


MISDECLARED = """(
  SELECT 'orders' AS table_name, 'blank' AS context, 'no_such_column' AS missing, count(*) AS rows_read FROM orders UNION ALL SELECT 'orders', 'sentinel', 'gone', count(*) FROM orders
  UNION ALL SELECT 'events', 'snapshot', 'region', count(*) FROM events UNION ALL SELECT 'events', 'dedup compare', 'lost', count(*) FROM events)"""


@query(f"SELECT * FROM {MISDECLARED}")
def config_missing_columns(spark, sf):
    """What building the tables found their rules to name in vain, with the rows read without them."""
    return normalise.missing_of(spark, misdeclared(spark, sf)).withColumn("missing", F.array_join("missing", ", "))


@query("""
WITH pinned AS (SELECT * FROM events JOIN (SELECT event_type, max(ts) AS m FROM events GROUP BY 1) USING (event_type) WHERE ts = m)
SELECT 'events' AS table_name, (SELECT count(*) FROM events) AS rows_raw, (SELECT count(DISTINCT (user_id, event_type)) FROM pinned) AS rows_effective
UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), (SELECT count(*) FROM orders)""")
def misdeclared_counts(spark, sf):
    """The rules do what they can: the snapshot is pinned by the column that is there, blanks go where a column is."""
    return reduce(DataFrame.union, [b.counts() for b in misdeclared(spark, sf).values()])


@query(f"""
SELECT 'rows_raw' AS figure, count(*) AS n FROM {DIRTY} UNION ALL SELECT 'rows_effective', count(*) FROM {DIRTY} WHERE o_orderkey % 5 <> 0
UNION ALL SELECT 'blank st', count(*) FILTER (WHERE trim(st) = '') FROM {DIRTY}
UNION ALL SELECT 'sentinel st', count(*) FILTER (WHERE upper(trim(st)) IN ('N/A', 'UNKNOWN')) FROM {DIRTY}
UNION ALL SELECT 'placeholder d', count(*) FILTER (WHERE d IN (DATE '1900-01-01', DATE '1899-12-30')) FROM {DIRTY}
UNION ALL SELECT 'null st written', count(*) FILTER (WHERE st IS NULL) FROM {CLEAN} WHERE o_orderkey % 5 <> 0""")
def measured_write(spark, sf):
    """One pass writes the cleaned table and yields its counts and hits."""
    dirty = dirty_orders(spark, sf).withColumn("junk", F.when(F.col("o_orderkey") % 5 == 0, 0))
    built = normalise.build(dirty, TableRules("orders", phantom=(PhantomKeyRule("junk", (0,), "exclude"),), cleanups=tuple(CLEANUPS)))
    out = normalise.write_measured(built, f"{scratch.folder(spark)}/measured-write-{uuid.uuid4().hex}")
    rows = spark.createDataFrame(list(out.counts.items()), "figure string, n bigint")
    hits = out.cleanups.select(F.concat_ws(" ", "kind", "column_name").alias("figure"), F.col("hits").alias("n"))
    return rows.union(hits).union(out.df.agg(F.count_if(F.col("st").isNull()).alias("n")).select(F.lit("null st written"), "n"))


# Invariants.
def joined_lines(spark, sf):
    return read(spark, sf, "lineitem").join(read(spark, sf, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))


@query("SELECT count(*) AS rows_scanned, count(*) FILTER (WHERE CAST(o_orderdate AS DATE) > CAST(l_shipdate AS DATE)) AS violations, CAST(min(date_diff('day', CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE))) AS VARCHAR) AS lowest, CAST(max(date_diff('day', CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE))) AS VARCHAR) AS highest FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def date_order(spark, sf):
    return invariants.measure(joined_lines(spark, sf), [invariants.date_order(DateOrderRule("TMP-01", "o_orderdate", "l_shipdate"))]).select("rows_scanned", "violations", "lowest", "highest")


@query("SELECT count(*) AS rows_scanned, count(*) FILTER (WHERE l_shipdate > TIMESTAMP '2001-08-01') AS violations, CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) AS latest FROM lineitem WHERE l_shipdate IS NOT NULL")
def future_date(spark, sf):
    return invariants.measure(read(spark, sf, "lineitem"), [invariants.future_date("FUT-01", "l_shipdate", "2001-08-01")]).select("rows_scanned", "violations", F.col("highest").alias("latest"))


@query("SELECT count(*) AS rows_scanned, count(*) FILTER (WHERE l_discount < 0 OR l_discount > 0.08) AS violations FROM lineitem WHERE l_discount IS NOT NULL")
def range_check(spark, sf):
    return invariants.measure(read(spark, sf, "lineitem"), [invariants.in_range("RNG-01", "l_discount", 0, 0.08, True)]).select("rows_scanned", "violations")


@query("SELECT count(*) AS rows_scanned, count(*) FILTER (WHERE c_acctbal < 0) AS violations, round(min(c_acctbal), 2) AS lowest FROM customer WHERE c_acctbal IS NOT NULL")
def minimum_check(spark, sf):
    return invariants.measure(read(spark, sf, "customer"), [invariants.in_range("MIN-01", "c_acctbal", 0, None, True)]).select("rows_scanned", "violations", F.round(F.col("lowest").cast("double"), 2).alias("lowest"))


def text_numbers(spark, sf):
    """Number text from the events' JSON, every ninth with a unit."""
    k = F.get_json_object("props", "$.k")
    return read(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, F.concat(k, F.lit(" m"))).otherwise(k).alias("reading"))


TEXT_NUMBERS = "(SELECT event_id, CASE WHEN event_id % 9 = 0 THEN json_extract_string(props, '$.k') || ' m' ELSE json_extract_string(props, '$.k') END AS reading FROM events)"


@query(rf"""
SELECT count(*) AS rows_scanned, count(*) FILTER (WHERE v < 10 OR v > 90 OR v IS NULL) AS violations, count(*) FILTER (WHERE v IS NULL) AS non_numeric
FROM (SELECT CASE WHEN regexp_full_match(reading, '\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*') THEN TRY_CAST(trim(reading) AS DOUBLE) END AS v FROM {TEXT_NUMBERS} WHERE reading IS NOT NULL)""")
def non_numeric(spark, sf):
    return invariants.measure(text_numbers(spark, sf), [invariants.in_range("RNG-02", "reading", 10, 90, False)]).select("rows_scanned", "violations", "non_numeric")


LINE_COLUMNS = [ColumnRule("l_shipdate", "actual"), ColumnRule("l_discount", low=0, high=0.08), ColumnRule("l_quantity", low=2), ColumnRule("l_tax", low=0.01, high=0.05), ColumnRule("l_comment", low=0), ColumnRule("l_extendedprice", low=0, all_null=True)]


def line_invariants(spark, sf):
    both = joined_lines(spark, sf)
    return both, invariants.generate(both, LINE_COLUMNS, [DateOrderRule("TMP-SHIP", "o_orderdate", "l_shipdate"), DateOrderRule("TMP-GONE", "o_orderdate", "no_column")], "2001-08-01")


FUSED = """
SELECT * FROM (
  SELECT 'TMP-SHIP' AS check_id, 'date_order' AS kind, count(*) AS rows_scanned, count(*) FILTER (WHERE CAST(o_orderdate AS DATE) > CAST(l_shipdate AS DATE)) AS violations FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 'FUT-l_shipdate', 'future_date', count(*), count(*) FILTER (WHERE l_shipdate > TIMESTAMP '2001-08-01') FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 'RNG-l_discount', 'range', count(*), count(*) FILTER (WHERE l_discount < 0 OR l_discount > 0.08) FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 'MIN-l_quantity', 'minimum', count(*), count(*) FILTER (WHERE l_quantity < 2) FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 'RNG-l_tax', 'range', count(*), count(*) FILTER (WHERE l_tax < 0.01 OR l_tax > 0.05) FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(FUSED)
def invariants_fused(spark, sf):
    both, found = line_invariants(spark, sf)
    return invariants.measure(both, found).select("check_id", "kind", "rows_scanned", "violations")


@query(f"SELECT check_id, split_part(check_id, '-', 1) AS family, 'high' AS severity, 'violation' AS finding_class, violations AS affected_count, 'row' AS grain, 'NONE' AS baseline FROM ({FUSED}) WHERE violations > 0")
def invariant_findings(spark, sf):
    both, found = line_invariants(spark, sf)
    out = checks.invariant_findings(invariants.measure(both, found), severity="high", grain=ROW, baseline="NONE")
    return out.select("check_id", "family", "severity", "finding_class", "affected_count", "grain", "baseline")


@query(f"SELECT count(*) AS checks_run, count(*) FILTER (WHERE violations = 0) AS checks_passed, count(*) FILTER (WHERE violations > 0) AS checks_failed, 0::BIGINT AS checks_skipped, 0::BIGINT AS checks_error, CAST(sum(rows_scanned) AS BIGINT) AS rows_scanned, CAST(sum(violations) AS BIGINT) AS violations FROM ({FUSED})")
def run_roll_up(spark, sf):
    both, found = line_invariants(spark, sf)
    return findings.roll_up(checks.invariant_results(invariants.measure(both, found)))


@query(f"SELECT check_id, split_part(check_id, '-', 1) AS family, CASE WHEN violations > 0 THEN 'fail' ELSE 'pass' END AS status, rows_scanned, violations FROM ({FUSED})")
def check_catalogue(spark, sf):
    both, found = line_invariants(spark, sf)
    return findings.catalogue(checks.invariant_results(invariants.measure(both, found))).select("check_id", "family", "status", "rows_scanned", "violations")


@query(f"SELECT CASE WHEN violations > 0 THEN 'fail' ELSE 'pass' END AS status, count(*) AS checks FROM ({FUSED}) GROUP BY 1")
def check_status_counts(spark, sf):
    both, found = line_invariants(spark, sf)
    return findings.status_counts(checks.invariant_results(invariants.measure(both, found)))


# Rule checks.
def milestones(spark, sf):
    o = read(spark, sf, "orders")
    date, status = F.col("o_orderdate").cast("date"), F.col("o_orderstatus")
    seen = o.groupBy("o_custkey").agg(F.min(F.when(status == "F", date)).alias("finished"), F.min(F.when(status == "O", date)).alias("opened"))
    return read(spark, sf, "customer").select("c_custkey").join(seen, F.col("c_custkey") == F.col("o_custkey"), "left")


@query("""
SELECT count(*) AS rows_scanned, count(*) FILTER (WHERE f IS NOT NULL AND o IS NULL) AS violations
FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS f, min(o_orderdate) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""")
def missing_prerequisite(spark, sf):
    return rules.missing_prerequisite(milestones(spark, sf), "finished", "opened")


@query("""
SELECT count(*) AS compared, count(*) FILTER (WHERE d > 0) AS violations, count(DISTINCT l_orderkey) FILTER (WHERE d > 0) AS parents_affected, CAST(max(d) AS INTEGER) AS worst_days
FROM (SELECT l_orderkey, date_diff('day', CAST(o_orderdate AS DATE) + 90, CAST(l_shipdate AS DATE)) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""")
def child_after_master(spark, sf):
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_shipdate")
    return rules.child_after_master(lines, read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_orderdate"), "k", "l_shipdate", "o_orderdate", 90)


@query("""
SELECT count(*) AS parents_affected, CAST(coalesce(sum(n - d), 0) AS BIGINT) AS open_children
FROM (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_linestatus <> 'O') AS d FROM lineitem GROUP BY l_orderkey) JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND d < n""")
def closed_parent_open_children(spark, sf):
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linestatus")
    orders = read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    return rules.closed_parent_open_children(orders, lines, "k", F.col("o_orderstatus") == "F", F.col("l_linestatus") != "O")


@query("""
SELECT count(*) AS parents_affected, CAST(coalesce(sum(d), 0) AS BIGINT) AS children_done
FROM customer JOIN (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS d, count(*) FILTER (WHERE o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '2001-01-01') AS s FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey
WHERE s = 0 AND d > 5""")
def done_children_no_start(spark, sf):
    o = read(spark, sf, "orders")
    started = o.where((F.col("o_orderstatus") == "P") & (F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz"))).select(F.col("o_custkey").alias("s")).distinct()
    parents = read(spark, sf, "customer").select(F.col("c_custkey").alias("k")).join(started, F.col("k") == F.col("s"), "left")
    return rules.done_children_no_start(parents, o.select(F.col("o_custkey").alias("k"), "o_orderstatus"), "k", F.col("s").isNotNull(), F.col("o_orderstatus") == "F", 5)


def finished_orders(spark, sf):
    done = read(spark, sf, "lineitem").where("l_linestatus = 'F'").groupBy("l_orderkey").agg(F.max("l_shipdate").cast("date").alias("done"))
    return read(spark, sf, "orders").join(done, F.col("o_orderkey") == F.col("l_orderkey"), "left")


FINISHED = "(SELECT o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) + 60 AS due, done FROM orders LEFT JOIN (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS done FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) ON o_orderkey = l_orderkey)"
LATE, GAP, PENDING = "done > due", "done IS NULL AND due < DATE '2001-07-01'", "done IS NULL AND due >= DATE '2001-07-01'"


@query(f"SELECT count(*) FILTER (WHERE {LATE}) AS late, count(*) FILTER (WHERE {GAP}) AS gap, count(*) FILTER (WHERE {PENDING}) AS pending, count(*) AS total FROM {FINISHED}")
def deadline_split(spark, sf):
    return rules.deadline_split(finished_orders(spark, sf), F.col("done"), F.date_add(F.col("o_orderdate").cast("date"), 60), F.lit("2001-07-01").cast("date"))


@query(f"SELECT o_orderpriority, CASE WHEN {LATE} THEN 'late' WHEN {GAP} THEN 'gap' WHEN {PENDING} THEN 'pending' ELSE 'on time' END AS bucket, count(*) AS orders FROM {FINISHED} GROUP BY ALL")
def deadline_buckets(spark, sf):
    bucket = rules.deadline_bucket(F.col("done"), F.date_add(F.col("o_orderdate").cast("date"), 60), F.lit("2001-07-01").cast("date"))
    return finished_orders(spark, sf).groupBy("o_orderpriority", F.coalesce(bucket, F.lit("on time")).alias("bucket")).agg(F.count("*").alias("orders"))


def supplier_orders(spark, sf):
    """Each supplier's orders as intervals from order date to the last shipment."""
    lines = ranges.spread(read(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_shipdate"), "l_orderkey")
    lines = lines.join(read(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("s")), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy("l_suppkey", "l_orderkey", "s").agg(F.max("l_shipdate").cast("date").alias("t"))


def supplier_intervals(spark, sf):
    """``supplier_orders`` shipped within a month of the order, whose pairs are listed."""
    return supplier_orders(spark, sf).where("t <= date_add(s, 30)")


@query("""
WITH i AS (SELECT l_suppkey, l_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(max(l_shipdate) AS DATE) AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT count(*) AS pairs, count(DISTINCT a.l_suppkey) AS resources FROM i a JOIN i b ON a.l_suppkey = b.l_suppkey AND a.l_orderkey < b.l_orderkey AND a.s <= b.t AND b.s <= a.t WHERE a.s <= a.t AND b.s <= b.t""")
def interval_overlap(spark, sf):
    return rules.overlap_totals(rules.overlap_counts(supplier_orders(spark, sf), "l_suppkey", "l_orderkey", "s", "t"))


@query("""
WITH i AS (SELECT l_suppkey, l_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(max(l_shipdate) AS DATE) AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL HAVING t <= s + 30)
SELECT a.l_suppkey AS resource, a.l_orderkey AS a, b.l_orderkey AS b FROM i a JOIN i b ON a.l_suppkey = b.l_suppkey AND a.l_orderkey < b.l_orderkey AND a.s <= b.t AND b.s <= a.t WHERE a.s <= a.t AND b.s <= b.t""")
def interval_overlap_pairs(spark, sf):
    """The pairs themselves, for a resource's report."""
    return rules.interval_overlaps(supplier_intervals(spark, sf), "l_suppkey", "l_orderkey", "s", "t", bucket_days=31)


@query("""
WITH s AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
g AS (SELECT user_id, min(ts) FILTER (WHERE event_type = 'purchase' AND value > 20) AS gate FROM events GROUP BY user_id)
SELECT count(*) AS compared, count(*) FILTER (WHERE gate IS NOT NULL AND value < 10) AS violations FROM s JOIN g USING (user_id)""")
def gate_vs_progress(spark, sf):
    e = read(spark, sf, "events")
    gates = e.groupBy("user_id").agg(F.min(F.when((F.col("event_type") == "purchase") & (F.col("value") > 20), F.col("ts"))).alias("gate"))
    return rules.gate_versus_progress(grain.latest_state(e, ["user_id"], ["ts desc", "event_id desc"]), gates, "user_id", F.col("gate").isNotNull(), F.col("value"), 10)


@query("SELECT count(*) AS rows_scanned, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'O') AS violations, count(DISTINCT l_orderkey) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'O') AS entities FROM lineitem")
def flag_contradiction(spark, sf):
    return rules.contradiction(read(spark, sf, "lineitem"), F.col("l_returnflag") == "R", F.col("l_linestatus") != "O", "l_orderkey")


@query(f"SELECT count(*) AS rows_scanned, count(*) FILTER (WHERE o_totalprice >= 100000 AND d IS NULL) AS violations FROM {CLEAN}")
def date_contradiction(spark, sf):
    cleaned = normalise.clean(dirty_orders(spark, sf), CLEANUPS).withColumn("p", F.col("o_totalprice").cast("string"))
    return rules.progress_without_date(cleaned, "p", 100000, "d")


@query("""
SELECT l_returnflag AS group_key, count(DISTINCT l_linenumber) AS codes, CAST(sum(w) AS DOUBLE) AS weight_sum
FROM (SELECT DISTINCT l_returnflag, l_linenumber, CAST(l_discount AS DECIMAL(14,4)) AS w FROM lineitem) GROUP BY 1 HAVING sum(w) IS NULL OR abs(sum(w) - 100) > 0.5""")
def weights_100(spark, sf):
    return rules.weight_groups(read(spark, sf, "lineitem"), "l_returnflag", "l_linenumber", "l_discount").withColumn("weight_sum", F.col("weight_sum").cast("double"))


@query(f"SELECT 'BIZ-1' AS check_id, 'fail' AS status, count(*) AS rows_scanned, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'O') AS violations FROM lineitem UNION ALL SELECT 'BIZ-2', 'pass', (SELECT count(*) FROM orders), 0 UNION ALL SELECT 'BIZ-3', 'skipped', NULL, NULL UNION ALL SELECT 'BIZ-4', 'error', NULL, NULL")
def registered_checks(spark, sf):
    found = checks.Registry()
    found.add("BIZ-1", lambda c: rules.contradiction(c.table("lineitem"), F.col("l_returnflag") == "R", F.col("l_linestatus") != "O", "l_orderkey"), grain=ROW, baseline="NONE")
    found.add("BIZ-2", lambda c: rules.missing_prerequisite(c.table("orders"), "o_orderdate", "o_orderkey"), grain=ROW, baseline="NONE")
    found.add("BIZ-3", lambda c: c.table("absent"), grain=ROW, baseline="NONE")
    found.add("BIZ-4", lambda c: c.table("orders").select("no_such_column"), grain=ROW, baseline="NONE")
    built = {t: normalise.build(read(spark, sf, t), TableRules(t)) for t in ("lineitem", "orders")}
    return found.run(checks.Context(spark, built, "2001-07-01"))[1].select("check_id", "status", "rows_scanned", "violations")


# Schema, coverage.
NAMES = registry.TABLES
COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in NAMES)


@query(COUNTS)
def table_row_counts(spark, sf):
    return registry.row_counts(registry.parquet(spark, sf))


@query(f"SELECT table_name, row_count FROM ({COUNTS}) WHERE table_name NOT IN ('embeddings', 'labels')")
def table_scope(spark, sf):
    counts = registry.row_counts(registry.parquet(spark, sf)).withColumn("schema_name", F.lit("main"))
    return registry.Scope(("MAIN",), ("Embeddings", "main.labels")).filter_tables(counts).select("table_name", "row_count")


@query(f"SELECT table_name, row_count, CASE WHEN table_name = 'labels' THEN 'table is excluded' END AS reason FROM ({COUNTS})")
def table_scope_reasons(spark, sf):
    counts = registry.row_counts(registry.parquet(spark, sf)).withColumn("schema_name", F.lit("main"))
    return registry.Scope(("main",), ("labels",)).with_reason(counts).select("table_name", "row_count", "reason")


@query("SELECT count(*) AS n, count(DISTINCT c_custkey) AS keys FROM customer")
def column_scope(spark, sf):
    c = read(spark, sf, "customer").withColumns({"api_key": F.lit("x"), "password_hash": F.lit("y")})
    shown = registry.Scope(excluded_columns=("customer.c_name", "c_mktsegment")).select(c, "customer")
    assert shown.columns == ["c_custkey", "c_nationkey", "c_acctbal"]
    return shown.agg(F.count("*").alias("n"), F.countDistinct("c_custkey").alias("keys"))


@query()
def sampled_counts(spark, sf):
    """Tables above 50,000 rows are sampled at 2 % and say so."""
    out = []
    for name in ("lineitem", "orders"):
        df = read(spark, sf, name)
        part, is_sample = registry.sampled(df, df.count(), limit=50_000)
        out.append(part.agg(F.count("*").alias("rows_read")).select(F.lit(name).alias("table_name"), "rows_read", F.lit(is_sample).alias("sampled")))
    return out[0].union(out[1])


@query("""SELECT table_name, rows > 50000 AS sampled, true AS within FROM (
SELECT 'lineitem' AS table_name, count(*) AS rows FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders) n""")
def sample_bounds(spark, sf):
    """Whether a sample's rows lie within five standard deviations of 2 %, and a table that is not sampled is whole."""
    counts = registry.row_counts({name: read(spark, sf, name) for name in ("lineitem", "orders")})
    got = sampled_counts(spark, sf).join(counts, "table_name")
    off = F.abs(F.col("rows_read") - 0.02 * F.col("row_count"))
    within = F.when(F.col("sampled"), off <= 5 * F.sqrt(0.02 * 0.98 * F.col("row_count"))).otherwise(F.col("rows_read") == F.col("row_count"))
    return got.select("table_name", "sampled", within.alias("within"))


def measured_inventory(spark, sf):
    """The inventory of all tables that hold rows."""
    tables = registry.parquet(spark, sf)
    live = registry.row_counts(tables).where("row_count > 0").select("table_name")
    return registry.inventory(spark, tables).join(live, "table_name", "left_semi")


TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "FLOAT[]": "array<float>", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz"}
INVENTORY = f"""SELECT table_name, column_name, CASE data_type {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPES.items())} END AS data_type, ordinal_position AS ordinal
FROM information_schema.columns WHERE table_name IN ({", ".join(f"'{t}'" for t in registry.TABLES)})"""


@query(INVENTORY)
def schema_inventory(spark, sf):
    return measured_inventory(spark, sf).select("table_name", "column_name", "data_type", "ordinal")


@query(f"""SELECT table_name, count(*) AS columns, sha1(string_agg(col, '|' ORDER BY col)) AS fp
FROM (SELECT table_name, concat(column_name, ':', substr(sha1(concat(data_type, '|true|')), 1, 12)) AS col FROM ({INVENTORY}) i) c GROUP BY table_name""")
def schema_fingerprints(spark, sf):
    return drift.table_fingerprints(measured_inventory(spark, sf))


def drifted(spark, sf):
    """Column fingerprints now and earlier, as the data had them: earlier runs saw a third of the orders and half of the customers."""
    o, e, c = (read(spark, sf, t) for t in ("orders", "events", "customer"))
    third = o.where("o_orderkey % 3 = 0")
    note = lambda df: df.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 1, F.lit("n")).alias("note"), F.when(F.col("o_orderkey") % 3 == 2, F.lit("m")).alias("mark"), F.expr("repeat('a', CAST(o_orderkey % 3 + 1 AS INT))").alias("tag"))
    earlier = {"orders": note(third).withColumn("old", F.lit("x")), "events": e.where("user_id < 0"), "customers_old": c.where("c_custkey % 2 = 0").select("c_custkey")}
    now = {"orders": note(o).withColumn("old", F.lit(None).cast("string")), "events": e.select("event_id", "user_id"), "customers_old": c.where("c_custkey < 0").select("c_custkey")}
    return drift.column_fingerprints(registry.live_inventory(now)), drift.column_fingerprints(registry.live_inventory(earlier))


# Keys by their remainder decide which columns had values and how long texts were.
DRIFTED = """(
  SELECT 'orders' AS t, 'note' AS c, 'added' AS change FROM orders HAVING count(*) FILTER (WHERE o_orderkey % 3 = 1) > 0
  UNION ALL SELECT 'orders', 'mark', 'added' FROM orders HAVING count(*) FILTER (WHERE o_orderkey % 3 = 2) > 0
  UNION ALL SELECT 'orders', 'old', 'removed' FROM orders HAVING count(*) FILTER (WHERE o_orderkey % 3 = 0) > 0
  UNION ALL SELECT 'orders', 'tag', 'changed' FROM orders HAVING max(o_orderkey % 3) > 0 AND count(*) FILTER (WHERE o_orderkey % 3 = 0) > 0
  UNION ALL SELECT 'events', unnest(['event_id', 'user_id']), 'added' FROM events HAVING count(*) > 0
  UNION ALL SELECT 'customers_old', 'c_custkey', 'removed' FROM customer HAVING count(*) FILTER (WHERE c_custkey % 2 = 0) > 0)"""


@query(f"SELECT t AS table_name, c AS column_name, change FROM {DRIFTED}")
def schema_drift(spark, sf):
    return drift.diff(*drifted(spark, sf))


@query(f"SELECT DISTINCT t AS table_name, change FROM {DRIFTED} WHERE t IN ('events', 'customers_old')")
def table_drift(spark, sf):
    """Whole tables that came or went."""
    current, earlier = drifted(spark, sf)
    return drift.table_diff(drift.diff(current, earlier), current, earlier)


@query(f"""
WITH k AS (SELECT * FROM (VALUES ('added', 'info', 'design', 'new columns are read from now on, under no rule until one is declared'), ('removed', 'medium', 'risk', 'rules and reports that name them no longer run'),
  ('changed', 'high', 'risk', 'a rule that relied on the old type or nullability may no longer hold'), ('table added', 'info', 'design', 'it is read from now on, under no rule until one is declared'),
  ('table removed', 'medium', 'risk', 'it was dropped, renamed or is out of reach; what reads it must be looked at')) v(change, severity, kind, meaning)),
g AS (SELECT t, change, count(*) AS n, string_agg(c, ', ' ORDER BY c) AS names, string_agg('"' || c || '"', ',' ORDER BY c) AS quoted FROM {DRIFTED} WHERE t = 'orders' GROUP BY t, change
  UNION ALL SELECT DISTINCT t, 'table ' || change, 0, NULL, NULL FROM {DRIFTED} WHERE t <> 'orders')
SELECT 'PIP-007' AS check_id, 'PIP' AS family, severity, kind AS finding_class, CASE WHEN n = 0 THEN change || ': ' || t ELSE n || ' columns of ' || t || ' ' || change || ': ' || names END AS title, 'table' AS entity_type, t AS entity_id,
  CAST(n AS BIGINT) AS affected_count, 'aggregate' AS grain, 'NONE' AS baseline, false AS sampled,
  CASE WHEN n = 0 THEN '{{"change":"' || change || '","meaning":"' || meaning || '"}}' ELSE '{{"change":"' || change || '","columns":[' || quoted || '],"meaning":"' || meaning || '"}}' END AS evidence FROM g JOIN k USING (change)""")
def drift_findings(spark, sf):
    """Drift in the schema of findings, so that it goes where all findings go."""
    return drift.drift_findings(*drifted(spark, sf))


@query("SELECT 'run2' AS run_id, t AS table_name, m AS metric, CAST(v AS VARCHAR) AS value FROM (SELECT 'lineitem' AS t, 'row_count' AS m, count(*) AS v FROM lineitem UNION ALL SELECT 'orders', 'row_count', count(*) FROM orders)")
def baseline_metrics(spark, sf):
    """The latest completed run's counts, past a failed run and the current one."""
    counts = registry.row_counts(registry.parquet(spark, sf, ["lineitem", "orders"])).select("table_name", F.lit("").alias("column_name"), F.lit("row_count").alias("metric"), F.col("row_count").cast("string").alias("value"))
    runs = spark.createDataFrame([("run1", "completed", 1), ("run2", "completed", 2), ("run3", "failed", 3), ("run4", "completed", 4)], "run_id string, status string, started_at int")
    metrics = counts.crossJoin(F.broadcast(runs.select("run_id")))  # four runs
    metrics = metrics.withColumn("value", F.when(F.col("run_id") == "run2", F.col("value")).otherwise(F.lit("0")))
    return drift.baseline(metrics, runs, "run4").select("run_id", "table_name", "metric", "value")


@query("SELECT 'no_events' AS table_name WHERE (SELECT count(*) FROM events WHERE user_id < 0) = 0")
def empty_tables(spark, sf):
    tables = {"events": read(spark, sf, "events"), "no_events": read(spark, sf, "events").where("user_id < 0")}
    return drift.empty_tables(registry.row_counts(tables))


@query(f"SELECT table_name, row_count FROM ({COUNTS}) WHERE row_count > 0 AND table_name NOT IN ('lineitem', 'orders', 'events')")
def unexamined_tables(spark, sf):
    declared = spark.createDataFrame([("LineItem",), ("orders",), ("events",)], "table_name string")
    return drift.unexamined(registry.row_counts(registry.parquet(spark, sf)), declared)


@query(f"SELECT count(*) FILTER (WHERE table_name IN ('lineitem', 'orders')) AS checked, count(*) AS in_scope, CAST(sum(row_count) FILTER (WHERE table_name NOT IN ('lineitem', 'orders')) AS BIGINT) AS rows_unchecked FROM ({COUNTS})")
def table_coverage(spark, sf):
    declared = spark.createDataFrame([("LineItem",), ("orders",)], "table_name string")
    return drift.coverage(registry.row_counts(registry.parquet(spark, sf)), declared)


@query("SELECT count(*) AS rows_total, count(*) FILTER (WHERE l_returnflag = 'R') AS hits_total, true AS within, true AS files_unread FROM lineitem")
def block_sampled_count(spark, sf):
    """A count estimated from some of a table's files, with the bound it states."""
    path, lines = f"{scratch.folder(spark)}/blocks-{uuid.uuid4().hex}", read(spark, sf, "lineitem")
    lines.select("l_orderkey", "l_linenumber", "l_returnflag").repartition(40, "l_orderkey").write.parquet(path)
    sample = registry.block_sample(spark, path, percent=25, seed=3)
    hit = F.col("l_returnflag") == "R"
    truth = lines.agg(F.count("*").alias("rows_total"), F.count_if(hit).alias("hits_total"))
    both = truth.crossJoin(F.broadcast(sample.estimate(hit, z=4.0)))  # one row each
    return both.select("rows_total", "hits_total", F.col("hits_total").between(F.col("low"), F.col("high")).alias("within"), F.lit(sample.files_read < sample.files_total).alias("files_unread"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS rows, count({c}) AS filled, true AS within FROM documents" for c in ("doc_id", "text", "lang", "source")))
def kept_profile(spark, sf):
    """Profiles kept by part and merged: the last part costs its own scan only; distinct counts are within three standard errors."""
    docs, path = read(spark, sf, "documents").select("doc_id", "text", "lang", "source"), f"{scratch.folder(spark)}/profile-{uuid.uuid4().hex}"
    for part in range(3):
        profile.keep_profile(docs.where(F.col("doc_id") % 3 == part), path, str(part))
    found = profile.merged_profile(spark.read.parquet(path))
    exact = profile.describe_table(docs).select("column_name", F.col("distinct_values").alias("exact"))
    room = 3 * profile.distinct_error()
    return found.join(exact, "column_name").select("column_name", "rows", "filled", (F.abs(F.col("distinct_values") - F.col("exact")) <= F.greatest(F.lit(1.0), room * F.col("exact"))).alias("within"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 97 = 0 THEN 'new' ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT -1 - c_custkey, 'added' FROM customer WHERE c_custkey % 97 = 1")
def keyed_upsert(spark, sf):
    """A table laid out by key; an upsert rewrites the buckets it touches."""
    path, old = f"{scratch.folder(spark)}/keyed-{uuid.uuid4().hex}", read(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    results.write_keyed(old, path, ["c_custkey"], 16)
    key = F.col("c_custkey")
    new = old.where(key % 97 == 0).withColumn("segment", F.lit("new")).union(old.where(key % 97 == 1).select(-1 - key, F.lit("added")))
    results.upsert_keyed(new, path, ["c_custkey"], 16)
    return results.read_keyed(spark, path)


@query("SELECT 'orders' AS table_name, 'note' AS column_name, count(*) AS rows_total FROM orders HAVING count(*) > 0")
def dead_columns_by_footers(spark, sf):
    """The same from the statistics in the files' footers."""
    path = f"{scratch.folder(spark)}/footers-{uuid.uuid4().hex}"
    read(spark, sf, "orders").withColumn("note", F.when(F.col("o_orderkey") < 0, F.lit("x"))).write.parquet(path)
    return footers.dead_columns(spark, path, "orders")


@query("""
SELECT 'RNG-q' AS check_id, count(*) AS rows_scanned, count(*) FILTER (WHERE l_linenumber > 5) AS violations FROM lineitem
UNION ALL SELECT 'MIN-k', count(*), count(*) FILTER (WHERE l_orderkey < 0) FROM lineitem
UNION ALL SELECT 'FUT-s', count(*), count(*) FILTER (WHERE l_shipdate > TIMESTAMP '2001-08-01') FROM lineitem
UNION ALL SELECT 'RNG-d', count(*), count(*) FILTER (WHERE l_discount > 0.08) FROM lineitem""")
def bounds_by_footers(spark, sf):
    """Bounds held against statistics first; only files beyond them are read, and floats are scanned."""
    rules_ = [invariants.in_range("RNG-q", "l_linenumber", 0, 5, True), invariants.in_range("MIN-k", "l_orderkey", 0, None, True), invariants.future_date("FUT-s", "l_shipdate", "2001-08-01"), invariants.in_range("RNG-d", "l_discount", 0, 0.08, True)]
    return footers.measure(spark, f"{sf}/lineitem.parquet", rules_).select("check_id", "rows_scanned", "violations")


@query("SELECT 'orders' AS table_name, 'note' AS column_name, count(*) AS rows_total FROM orders HAVING count(*) > 0")
def dead_columns(spark, sf):
    o = read(spark, sf, "orders").withColumn("note", F.when(F.col("o_orderkey") < 0, F.lit("x")))
    return drift.dead_columns(o, "orders")


# Findings of two runs: late orders by customer, judged on two as-of dates.
def run_findings(spark, sf, as_of: str):
    """Findings per customer and order status class."""
    o = read(spark, sf, "orders").where(F.col("o_orderdate") < F.lit(as_of).cast("timestamp_ntz"))
    severity = F.when(F.col("o_orderpriority").startswith("1"), "critical").when(F.col("o_orderpriority").startswith("2"), "high").when(F.col("o_orderpriority").startswith("3"), "medium").otherwise("low")
    kind = F.when(F.col("o_orderstatus") == "F", "violation").when(F.col("o_orderstatus") == "O", "gap").otherwise("pending")
    each = o.select(F.concat(F.lit("BIZ-"), F.substring("o_orderpriority", 1, 1)).alias("check_id"), F.col("o_custkey").cast("string").alias("entity_id"), severity.alias("severity"), kind.alias("finding_class"))
    return each.groupBy("check_id", "entity_id", "severity", "finding_class").agg(F.count("*").alias("affected_count")).withColumn("title", F.concat(F.lit("Orders of customer "), F.col("entity_id"), F.lit(" are "), F.col("finding_class")))


def FOUND(as_of: str) -> str:
    return f"""(SELECT 'BIZ-' || left(o_orderpriority, 1) AS check_id, CAST(o_custkey AS VARCHAR) AS entity_id,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS severity,
  CASE o_orderstatus WHEN 'F' THEN 'violation' WHEN 'O' THEN 'gap' ELSE 'pending' END AS finding_class, count(*) AS affected_count,
  'Orders of customer ' || o_custkey || ' are ' || CASE o_orderstatus WHEN 'F' THEN 'violation' WHEN 'O' THEN 'gap' ELSE 'pending' END AS title
  FROM orders WHERE o_orderdate < TIMESTAMP '{as_of}' GROUP BY ALL)"""


NOW, THEN = "2001-08-01", "2000-01-01"
RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'cleared' THEN 4 WHEN 'info' THEN 5 ELSE 6 END"


@query(f"SELECT check_id, entity_id, severity, finding_class, affected_count, {RANK} AS rank FROM {FOUND(NOW)} WHERE finding_class IN ('violation', 'defect', 'gap') AND severity = 'critical'")
def findings_register(spark, sf):
    return findings.register(run_findings(spark, sf, NOW), actionable_only=True, severity="critical").select("check_id", "entity_id", "severity", "finding_class", "affected_count", "rank")


@query(f"SELECT check_id, entity_id, severity, finding_class, affected_count FROM {FOUND(NOW)} ORDER BY {RANK}, affected_count DESC, check_id, entity_id, finding_class LIMIT 20 OFFSET 10")
def findings_page(spark, sf):
    """Page 2 of the register: a limit is the feature."""
    found = run_findings(spark, sf, NOW)
    out = found.orderBy(severity_rank(F.col("severity")), F.desc("affected_count"), "check_id", "entity_id", "finding_class").offset(10).limit(20)
    return out.select("check_id", "entity_id", "severity", "finding_class", "affected_count")


@query(f"SELECT check_id, entity_id, title FROM {FOUND(NOW)} WHERE contains(lower(title), 'customer 12') OR contains(lower(check_id), 'customer 12')")
def findings_search(spark, sf):
    return findings.search(run_findings(spark, sf, NOW), "Customer 12").select("check_id", "entity_id", "title")


@query(f"SELECT DISTINCT finding_class FROM {FOUND(NOW)}")
def findings_classes(spark, sf):
    return findings.picker(run_findings(spark, sf, NOW), "finding_class")


@query(f"SELECT severity, count(*) AS findings, CAST(sum(affected_count) AS BIGINT) AS affected FROM {FOUND(NOW)} GROUP BY severity")
def severity_counts(spark, sf):
    return findings.counts(run_findings(spark, sf, NOW), "severity")


@query(f"SELECT finding_class, count(*) AS findings, CAST(sum(affected_count) AS BIGINT) AS affected FROM {FOUND(NOW)} GROUP BY finding_class")
def class_counts(spark, sf):
    return findings.counts(run_findings(spark, sf, NOW), "finding_class")


CARD = f"SELECT entity_id, count(*) AS findings, CAST(sum(affected_count) AS BIGINT) AS affected, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE finding_class IN ('violation', 'defect', 'gap')) AS actionable FROM {FOUND(NOW)} GROUP BY entity_id"


@query(CARD)
def scorecard(spark, sf):
    return findings.scorecard(run_findings(spark, sf, NOW))


@query(f"{CARD} ORDER BY actionable DESC, findings DESC, entity_id LIMIT 25")
def scorecard_top(spark, sf):
    return findings.top_scorecard(run_findings(spark, sf, NOW), 25)


@query(f"SELECT n.check_id, n.entity_id, n.finding_class, CASE WHEN t.check_id IS NULL THEN 'new' ELSE 'recurring' END AS lifecycle, CASE WHEN t.check_id IS NOT NULL THEN 'run1' END AS first_seen FROM {FOUND(NOW)} n LEFT JOIN (SELECT DISTINCT check_id, entity_id FROM {FOUND(THEN)}) t ON n.check_id = t.check_id AND n.entity_id = t.entity_id")
def findings_lifecycle(spark, sf):
    return findings.lifecycle(run_findings(spark, sf, NOW), run_findings(spark, sf, THEN), "run1").select("check_id", "entity_id", "finding_class", "lifecycle", "first_seen")


@query(f"SELECT check_id, entity_id, finding_class FROM {FOUND(NOW)} n ANTI JOIN (SELECT DISTINCT check_id, entity_id FROM {FOUND(THEN)}) t USING (check_id, entity_id)")
def findings_resolved(spark, sf):
    """The later run's findings taken as the earlier side: those the other run no longer has."""
    return findings.resolved(run_findings(spark, sf, THEN), run_findings(spark, sf, NOW)).select("check_id", "entity_id", "finding_class")


@query(f"SELECT run_id, count(*) AS findings, count(note) AS notes FROM (SELECT 'a' AS run_id, NULL AS note FROM {FOUND(NOW)} UNION ALL SELECT 'b', 'x' FROM {FOUND(THEN)}) GROUP BY run_id")
def findings_union(spark, sf):
    a, b = run_findings(spark, sf, NOW).withColumn("run_id", F.lit("a")), run_findings(spark, sf, THEN).withColumns({"run_id": F.lit("b"), "note": F.lit("x")})
    return findings.union_all([a, b]).groupBy("run_id").agg(F.count("*").alias("findings"), F.count("note").alias("notes"))


@query(f"SELECT 'run1' AS run_id, 'completed' AS status, (SELECT count(*) FROM {FOUND(NOW)}) AS findings_total")
def finish_run(spark, sf):
    run = spark.createDataFrame([("run1", "running")], "run_id string, status string")
    return results.finish_run(run, run_findings(spark, sf, NOW).withColumn("run_id", F.lit("run1")), "completed").select("run_id", "status", "findings_total")


@query("SELECT strftime(d, '%Y-%m') AS run_id, n AS findings_total FROM (SELECT date_trunc('month', o_orderdate) AS d, count(*) AS n FROM orders GROUP BY 1) ORDER BY d DESC LIMIT 5")
def latest_runs(spark, sf):
    """Months of orders as runs, newest first: a limit is the feature."""
    runs = read(spark, sf, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("started_at")).agg(F.count("*").alias("findings_total"))
    runs = runs.withColumns({"run_id": F.date_format("started_at", "yyyy-MM"), "status": F.lit("completed")})
    return results.list_runs(runs, 5, completed_only=True).select("run_id", "findings_total")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS value FROM (SELECT DISTINCT o_orderkey FROM orders)")
def metric_upsert(spark, sf):
    keys = read(spark, sf, "orders").select("o_orderkey").distinct()
    old, new = keys.withColumn("value", F.lit("old")), keys.where("o_orderkey % 3 = 0").withColumn("value", F.lit("new"))
    return results.upsert(old, new, ["o_orderkey"])


@query("SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN 0 ELSE 1 END AS n FROM events")
def json_decode(spark, sf):
    """Evidence text that is null or malformed decodes to an empty list."""
    text = F.when(F.col("event_id") % 5 == 0, F.lit(None)).when(F.col("event_id") % 5 == 1, F.lit("{not valid json")).otherwise(F.concat(F.lit("["), F.col("props"), F.lit("]")))
    return read(spark, sf, "events").select("event_id", F.size(results.decode(text)).alias("n"))


SECTIONS = "(VALUES (1, 'Scope'), (4, 'Milestones'), (5, 'Deadlines'), (7, 'Ownership')) s(section, title)"
REFS = "(SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '§4, §7' WHEN o_orderkey % 4 = 1 THEN '§4/§5' WHEN o_orderkey % 4 = 2 THEN 'unknown' END AS rule_ref, 'BIZ-' || left(o_orderpriority, 1) AS check_id FROM (SELECT DISTINCT o_orderkey, min(o_orderpriority) AS o_orderpriority FROM orders GROUP BY 1))"


def cited(spark, sf):
    key = F.col("o_orderkey")
    ref = F.when(key % 4 == 0, "§4, §7").when(key % 4 == 1, "§4/§5").when(key % 4 == 2, "unknown")
    refs = read(spark, sf, "orders").groupBy("o_orderkey").agg(F.min("o_orderpriority").alias("p")).select("o_orderkey", ref.alias("rule_ref"), F.concat(F.lit("BIZ-"), F.substring("p", 1, 1)).alias("check_id"))
    return refs, spark.createDataFrame([(1, "Scope"), (4, "Milestones"), (5, "Deadlines"), (7, "Ownership")], "section int, title string")


@query(f"""
WITH e AS (SELECT o_orderkey, trim(unnest(string_split_regex(rule_ref, '[,/]'))) AS token FROM {REFS} WHERE rule_ref IS NOT NULL)
SELECT o_orderkey, string_agg(label, '; ' ORDER BY k, label) AS described FROM (
  SELECT DISTINCT o_orderkey, coalesce(section, 1000000000) AS k, coalesce('§' || s.section || ' ' || s.title, token) AS label
  FROM e LEFT JOIN {SECTIONS} ON s.section = TRY_CAST(regexp_extract(token, '(\\d+)', 1) AS INTEGER)) GROUP BY o_orderkey""")
def rule_refs(spark, sf):
    refs, sections = cited(spark, sf)
    return findings.describe(refs, sections, "o_orderkey")


@query(f"""
WITH e AS (SELECT check_id, TRY_CAST(regexp_extract(trim(unnest(string_split_regex(rule_ref, '[,/]'))), '(\\d+)', 1) AS INTEGER) AS section FROM {REFS} WHERE rule_ref IS NOT NULL)
SELECT section, string_agg(check_id, ',' ORDER BY check_id) AS checks FROM (SELECT DISTINCT section, check_id FROM e WHERE section IS NOT NULL) GROUP BY section""")
def rule_compliance(spark, sf):
    return findings.compliance(*cited(spark, sf))


def incidents_of(spark, sf):
    """Each customer's findings as one incident; every seventh customer names a finding that does not exist."""
    found = run_findings(spark, sf, NOW).withColumn("finding_id", F.concat_ws("/", "check_id", "entity_id", "finding_class"))
    ids = F.array_sort(F.collect_list("finding_id"))
    grouped = found.groupBy("entity_id").agg(ids.alias("ids"))
    stray = F.when(F.col("entity_id").cast("bigint") % 7 == 0, F.array(F.concat(F.lit("stray/"), F.col("entity_id")))).otherwise(F.array().cast("array<string>"))
    return found, grouped.select(F.col("entity_id").alias("incident_id"), F.concat("ids", stray).alias("finding_ids"))


@query(f"SELECT entity_id AS incident_id, CASE min({RANK}) WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity FROM {FOUND(NOW)} GROUP BY entity_id")
def incident_severity(spark, sf):
    found, incidents = incidents_of(spark, sf)
    return findings.incident_severity(incidents, found)


@query(f"SELECT DISTINCT entity_id AS incident_id, 'stray/' || entity_id AS finding_id FROM {FOUND(NOW)} WHERE CAST(entity_id AS BIGINT) % 7 = 0")
def incident_references(spark, sf):
    found, incidents = incidents_of(spark, sf)
    return findings.unknown_references(incidents, found)


@query(f"""
SELECT check_id, 'BIZ' AS family, severity, finding_class AS class, title, affected_count, CASE WHEN check_id <> 'BIZ-5' THEN 'rule ' || right(check_id, 1) END AS business_rule_ref, CASE WHEN check_id = 'BIZ-1' THEN 'planning' ELSE 'sales' END AS owner,
  'row' AS grain, 'TARGET' AS baseline, CASE WHEN entity_id IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01') THEN 'recurring' ELSE 'new' END AS status,
  CASE WHEN check_id <> 'BIZ-5' THEN 'late orders of priority ' || right(check_id, 1) END AS why_it_matters, CASE WHEN affected_count > 1 THEN 'seen ' || affected_count || ' times' END AS llm_explanation, CAST(NULL AS VARCHAR) AS llm_root_cause,
  CASE WHEN affected_count > 1 THEN 'call customer ' || entity_id END AS llm_remediation, entity_id, CAST(entity_id AS BIGINT) AS well_id, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS rank FROM {FOUND(NOW)}""")
def register_sheet(spark, sf):
    """The register with narrations and rules looked up."""
    old = read(spark, sf, "orders").where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")).select(F.col("o_custkey").cast("string").alias("entity_id"), F.lit("recurring").alias("seen")).distinct()
    f = run_findings(spark, sf, NOW).join(old, "entity_id", "left")
    f = f.select("*", F.lit("BIZ").alias("family"), F.lit("row").alias("grain"), F.lit("TARGET").alias("baseline"), F.coalesce("seen", F.lit("new")).alias("status"), F.col("entity_id").cast("bigint").alias("well_id"), F.when(F.col("check_id") == "BIZ-1", "planning").alias("owner"), F.concat_ws("|", "check_id", "entity_id", "finding_class").alias("finding_id"))
    told = f.where("affected_count > 1").select("finding_id", F.concat(F.lit("seen "), F.col("affected_count"), F.lit(" times")).alias("llm_explanation"), F.concat(F.lit("call customer "), "entity_id").alias("llm_remediation"))
    known = spark.createDataFrame([(f"BIZ-{k}", f"rule {k}" if k < 5 else None, "sales", f"late orders of priority {k}" if k < 5 else None) for k in range(1, 6)], "check_id string, business_rule_ref string, owner string, why_it_matters string")
    return findings.register_sheet(f, told, known)


CHECKED = f"""(SELECT *, CASE WHEN e % 13 = 0 THEN NULL ELSE 'row' END AS grain, CASE WHEN e % 17 = 0 THEN 'COMMITTED' ELSE 'ACTUAL' END AS baseline, CASE WHEN e % 11 <> 0 THEN affected_count + CASE WHEN e % 7 = 0 THEN 1 ELSE 0 END END AS counter
  FROM (SELECT *, CAST(entity_id AS BIGINT) AS e FROM {FOUND(NOW)}))"""


def checked_findings(spark, sf):
    """Findings held against counts of the same orders found the other way round: all of the customer's less those of other classes."""
    f, e = run_findings(spark, sf, NOW), F.col("entity_id").cast("bigint")
    f = f.withColumns({"grain": F.when(e % 13 != 0, "row"), "baseline": F.when(e % 17 == 0, "COMMITTED").otherwise("ACTUAL")})
    whole = f.groupBy("check_id", "entity_id").agg(F.sum("affected_count").alias("whole"), F.collect_list(F.struct("finding_class", "affected_count")).alias("each"))
    others = F.aggregate(F.filter("each", lambda x: x["finding_class"] != F.col("finding_class")), F.lit(0).cast("bigint"), lambda total, x: total + x["affected_count"])
    counters = f.select("check_id", "entity_id", "finding_class").join(whole, ["check_id", "entity_id"]).where(e % 11 != 0)
    counters = counters.select("check_id", "entity_id", "finding_class", (F.col("whole") - others + F.when(e % 7 == 0, 1).otherwise(0)).alias("counter_query_count"))
    return findings.verified(f, counters, keys=["check_id", "entity_id", "finding_class"], least=2)


@query(f"""
SELECT check_id, entity_id, finding_class, affected_count, counter AS counter_query_count,
  CASE WHEN counter IS NULL THEN CASE severity WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' ELSE 'low' END ELSE severity END AS severity,
  array_to_string(['grain', 'baseline', 'materiality'] || CASE WHEN counter = affected_count THEN ['counter-query'] ELSE [] END, ',') AS verified_by
FROM {CHECKED} WHERE grain IS NOT NULL AND baseline = 'ACTUAL' AND affected_count >= 2 AND coalesce(counter = affected_count, true)""")
def verified_findings(spark, sf):
    """Findings that pass every gate; one without a counter-query stays, a step less severe."""
    return findings.kept(checked_findings(spark, sf)).select("check_id", "entity_id", "finding_class", "affected_count", "counter_query_count", "severity", F.array_join("verified_by", ",").alias("verified_by"))


@query(f"""
SELECT check_id, reason AS rejected_for, count(*) AS findings FROM (SELECT check_id, CASE WHEN grain IS NULL THEN 'grain' WHEN baseline <> 'ACTUAL' THEN 'baseline' WHEN affected_count < 2 THEN 'materiality' WHEN counter <> affected_count THEN 'counter-query' END AS reason FROM {CHECKED})
WHERE reason IS NOT NULL GROUP BY ALL""")
def rejected_findings(spark, sf):
    """What was dropped, and why."""
    return findings.rejections(checked_findings(spark, sf))


# Text against evidence.
@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '-?\d[\d,]*(?:\.\d+)?%?'), lambda x: replace(x, ',', '')))), ' ') AS numbers FROM documents")
def numbers_in_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(X.numbers_in(F.col("text"))), " ").alias("numbers"))


def statements(spark, sf):
    """Each order's statement of its price (rounded), date and, for every fifth, a number from nowhere; the source has the true values."""
    o = read(spark, sf, "orders")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    said = F.concat_ws(" ", F.lit("Order of"), F.date_format("o_orderdate", "d"), F.lit("at about"), F.bround(price, 0).cast("bigint").cast("string"), F.when(F.col("o_orderkey") % 5 == 0, "or 987654321%"))
    return o.select("o_orderkey", "o_custkey", said.alias("said"), F.concat_ws(" ", price.cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("source"))


@query("SELECT o_orderkey, o_orderkey % 5 <> 0 AS ok, CASE WHEN o_orderkey % 5 = 0 THEN '987654321%' ELSE '' END AS unsupported FROM orders")
def unsupported_numbers(spark, sf):
    out = evidence.validate(statements(spark, sf), ["said"], "source")
    return out.select("o_orderkey", "ok", F.array_join("unsupported", " ").alias("unsupported"))


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderkey % 5 = 0) = 0 AS ok FROM orders GROUP BY o_custkey")
def group_statements(spark, sf):
    s = statements(spark, sf)
    # A group's statement cites its members' own statements.
    groups = ranges.spread(s, "o_custkey", each=4).groupBy("o_custkey").agg(F.concat_ws(" ", F.collect_list("said")).alias("story"))
    return evidence.validate_groups(groups, s, "o_custkey", "story", "source").select("o_custkey", "ok")


@query("SELECT doc_id, sha256(CAST(doc_id AS VARCHAR) || chr(0) || coalesce(text, '') || chr(0) || coalesce(lang, '') || chr(0) || 'model-1' || chr(0) || sha256('prompt')) AS key FROM documents")
def narration_key(spark, sf):
    return read(spark, sf, "documents").select("doc_id", evidence.narration_key(["doc_id", "text", "lang"], "model-1", "prompt").alias("key"))


@query("SELECT d.doc_id, t.s AS reused_text, t.s IS NOT NULL AS reused FROM documents d LEFT JOIN (SELECT text, max_by(CAST(doc_id AS VARCHAR), doc_id) AS s FROM documents WHERE doc_id % 3 <> 0 GROUP BY text) t ON d.text = t.text")
def fingerprint_reuse(spark, sf):
    """Texts narrated before, by content; rows whose narration is null are never a hit."""
    docs = read(spark, sf, "documents").withColumn("key", X.fingerprint(F.col("text")))
    earlier = docs.select("key", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id").cast("string")).alias("narration"), "doc_id")
    return evidence.reuse(docs.select("doc_id", "key"), earlier, "key", "narration", "doc_id").select("doc_id", "reused_text", "reused")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'ahead of schedule' WHEN o_orderkey % 9 = 1 THEN 'sooner than' END AS first_hit, o_orderkey % 9 IN (0, 1, 2) AS rejected FROM orders")
def keyword_screen(spark, sf):
    key = F.col("o_orderkey")
    title = F.when(key % 9 == 0, "Tasks Ahead of Schedule").when(key % 9 == 1, "Work done sooner than planned").when(key % 9 == 2, "  ").otherwise("Tasks late")
    df = read(spark, sf, "orders").select("o_orderkey", title.alias("title"), F.lit("a hypothesis").alias("hypothesis"))
    return evidence.screen(df, ["title", "hypothesis"]).select("o_orderkey", "first_hit", "rejected")


# Profiling.
PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS rows, count({c}) AS filled, round(100.0 * (count(*) - count({c})) / count(*), 2) AS null_pct, count(DISTINCT {c}) AS distinct_values FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars"))


@query(PROFILE)
def profile_table(spark, sf):
    return profile.describe_table(read(spark, sf, "documents")).drop("data_type")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def capped_result(spark, sf):
    """The first page of a sorted result: a limit is the feature."""
    return profile.capped(read(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey"), 100)


# Further rules.
def part_names(spark, sf):
    """Part brands, some with other case, line breaks and blanks."""
    b, k = F.col("p_brand"), F.col("p_partkey")
    spelt = F.when(k % 5 == 0, F.upper(b)).when(k % 7 == 0, F.concat(F.lit(" "), F.replace(b, F.lit(" "), F.lit("\n\t ")))).otherwise(b)
    return read(spark, sf, "part").select("p_partkey", spelt.alias("brand"))


@query(r"""
WITH r AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN upper(p_brand) WHEN p_partkey % 7 = 0 THEN ' ' || replace(p_brand, ' ', chr(10) || chr(9) || ' ') ELSE p_brand END AS raw FROM part)
SELECT lower(trim(regexp_replace(raw, '\s+', ' ', 'g'))) AS normal, count(DISTINCT raw) AS spellings, count(*) AS rows FROM r WHERE raw IS NOT NULL GROUP BY 1 HAVING count(DISTINCT raw) > 1""")
def phantom_keys(spark, sf):
    return extended.spelling_variants(part_names(spark, sf), "brand")


@query("SELECT page_id, regexp_matches(html, '&(amp|lt|gt|quot|#39);') AS has_entity, length(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')) AS decoded_chars FROM pages")
def html_entities(spark, sf):
    p = read(spark, sf, "pages")
    return p.select("page_id", X.has_entity(F.col("html")).alias("has_entity"), F.length(X.decode_entities(F.col("html"))).cast("bigint").alias("decoded_chars"))


@query("SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN text || 'é’' ELSE text END) AS digest FROM documents")
def mojibake(spark, sf):
    broken = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("Ã©â€™"))).otherwise(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.sha2(X.repair_mojibake(broken), 256).alias("digest"))


STATUS = "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderstatus END"


@query(f"SELECT {STATUS} AS value, count(*) AS rows, CASE WHEN {STATUS} IS NULL THEN 'missing' WHEN {STATUS} IN ('F', 'O') THEN 'allowed' ELSE 'not allowed' END AS verdict FROM orders GROUP BY ALL")
def allowed_values(spark, sf):
    o = read(spark, sf, "orders").withColumn("s", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderstatus")))
    return extended.allowed_values(o, "s", ["F", "O"])


@query("SELECT sha256(c_name) AS c_name, c_nationkey, c_acctbal FROM customer")
def pii_masked(spark, sf):
    return extended.without_pii(read(spark, sf, "customer"), ["c_name"], mask=True).select("c_name", "c_nationkey", "c_acctbal")


@query("""
SELECT c.c_custkey, CASE WHEN contains(code, '-') THEN split_part(code, '-', 1) END AS prefix, n.n_name AS "group"
FROM (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'none' ELSE CAST(c_nationkey AS VARCHAR) || '-x' END AS code FROM customer) c
LEFT JOIN nation m ON CASE WHEN contains(code, '-') THEN split_part(code, '-', 1) END = CAST(m.n_nationkey AS VARCHAR) LEFT JOIN (SELECT r_regionkey, r_name AS n_name FROM region) n ON m.n_regionkey = n.r_regionkey""")
def two_hop_lookup(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 6 == 0, "none").otherwise(F.concat(F.col("c_nationkey").cast("string"), F.lit("-x"))).alias("code"))
    nation = read(spark, sf, "nation").withColumn("k", F.col("n_nationkey").cast("string"))
    return extended.two_hop(c, "code", nation, "k", "n_regionkey", read(spark, sf, "region"), "r_regionkey", "r_name").select("c_custkey", "prefix", "group")


def labelled(spark, sf):
    return read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels"), "doc_id", "left")


@query("SELECT coalesce(CAST(quality AS VARCHAR), '(unmapped)') AS group_name, count(DISTINCT d.doc_id) AS tasks FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def group_breakdown(spark, sf):
    return extended.breakdown(labelled(spark, sf), "quality", "doc_id")


@query("SELECT count(DISTINCT quality) AS groups, count(DISTINCT d.doc_id) FILTER (WHERE quality IS NULL) AS unmapped_tasks FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def unmapped_tally(spark, sf):
    return extended.group_tally(labelled(spark, sf), "quality", "doc_id")


@query("SELECT DISTINCT lang, quality FROM documents JOIN labels USING (doc_id)")
def mapped_listing(spark, sf):
    return extended.mapped_listing(read(spark, sf, "documents").select("doc_id", "lang"), read(spark, sf, "labels"), "doc_id", ["lang", "quality"])


@query(f"SELECT o_orderkey, done IS NULL AND DATE '2001-07-01' > due - 1 AS missed FROM {FINISHED}")
def deadline_missed(spark, sf):
    missed = extended.deadline_missed(F.date_add(F.col("o_orderdate").cast("date"), 60), F.col("done"), F.lit("2001-07-01").cast("date"))
    return finished_orders(spark, sf).select("o_orderkey", missed.alias("missed"))


@query("SELECT CASE WHEN d < 0 THEN 'ahead' WHEN d = 0 THEN 'on schedule' ELSE 'behind' END AS class, count(*) AS lines, CAST(sum(d) AS BIGINT) AS days FROM (SELECT date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1")
def signed_variance(spark, sf):
    days, kind = extended.signed_variance(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    return joined_lines(spark, sf).select(days.alias("d"), kind.alias("class")).groupBy("class").agg(F.count("*").alias("lines"), F.sum("d").alias("days"))


@query(f"SELECT o_orderkey, coalesce(done, due) + 2 AS deadline FROM {FINISHED}")
def effective_deadline(spark, sf):
    deadline = extended.effective_deadline(F.col("done"), F.date_add(F.col("o_orderdate").cast("date"), 60))
    return finished_orders(spark, sf).select("o_orderkey", deadline.alias("deadline"))


@query("SELECT p_brand, count(*) AS parts, round(sum(c), 6) AS total FROM (SELECT p_brand, 1.0 / count(*) OVER (PARTITION BY p_brand) AS c FROM part) GROUP BY p_brand")
def contribution(spark, sf):
    out = extended.contribution(read(spark, sf, "part"), "p_brand", F.lit(1.0).cast("double"))
    return out.groupBy("p_brand").agg(F.count("*").alias("parts"), F.round(F.sum("contribution"), 6).alias("total"))


@query(f"SELECT coalesce({STATUS}, '(not recorded)') AS value, count(*) AS rows FROM orders GROUP BY 1")
def recorded_counts(spark, sf):
    return extended.group_counts(read(spark, sf, "orders").withColumn("s", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderstatus"))), "s")


@query(f"SELECT CASE WHEN {LATE} THEN 'operations' WHEN {GAP} THEN 'planning' ELSE 'nobody' END AS owner, count(*) AS orders FROM {FINISHED} GROUP BY 1")
def delay_owner(spark, sf):
    bucket = rules.deadline_bucket(F.col("done"), F.date_add(F.col("o_orderdate").cast("date"), 60), F.lit("2001-07-01").cast("date"))
    owner = extended.delay_owner(bucket, {"late": "operations", "gap": "planning"}, "nobody")
    return finished_orders(spark, sf).groupBy(owner.alias("owner")).agg(F.count("*").alias("orders"))


@query("SELECT count(*) AS rows_scanned, count(*) FILTER (WHERE CAST(l_quantity AS INTEGER) <> date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) + 1) AS violations FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def duration_consistency(spark, sf):
    return extended.inconsistent_duration(joined_lines(spark, sf), F.col("l_quantity").cast("int"), F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date"))


@query("SELECT event_id, user_id, value, previous FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE value < previous")
def monotonic_reversal(spark, sf):
    return extended.reversals(read(spark, sf, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "user_id", "value", "previous")


@query("SELECT 'a' AS column_name, round(count(CASE WHEN o_orderkey % 4 <> 0 THEN 1 END) / count(*), 4) AS coverage, CAST(0.75 AS DOUBLE) AS declared, abs(round(count(CASE WHEN o_orderkey % 4 <> 0 THEN 1 END) / count(*), 4) - 0.75) > 0.01 AS off FROM orders UNION ALL SELECT 'o_totalprice', round(count(o_totalprice) / count(*), 4), 0.5, abs(round(count(o_totalprice) / count(*), 4) - 0.5) > 0.01 FROM orders")
def column_coverage(spark, sf):
    o = read(spark, sf, "orders").withColumn("a", F.when(F.col("o_orderkey") % 4 != 0, 1))
    return extended.coverage_against(o, {"a": 0.75, "o_totalprice": 0.5})


@query("WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1) SELECT event_id, event_type, value FROM events JOIN q USING (event_type) WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)")
def outlier_iqr(spark, sf):
    return extended.iqr_outliers(read(spark, sf, "events"), "event_type", "value").select("event_id", "event_type", "value")


@query("WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1), d AS (SELECT event_type, median(abs(value - m)) AS d FROM events JOIN m USING (event_type) GROUP BY 1) SELECT event_id, event_type, value FROM events JOIN m USING (event_type) JOIN d USING (event_type) WHERE abs(value - m) > 3 * 1.4826 * d")
def outlier_mad(spark, sf):
    return extended.mad_outliers(read(spark, sf, "events"), "event_type", "value").select("event_id", "event_type", "value")


@query("SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1")
def grouped_quartiles(spark, sf):
    """Every group by rank refinement, whatever its size."""
    return quantiles.exact_quantiles(read(spark, sf, "events"), "event_type", "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, whole_group=0)


@query("SELECT event_type, count(value) AS rows, true AS within FROM events GROUP BY 1")
def sketched_medians(spark, sf):
    """Daily sketches merged: the estimate's rank is within twice the stated error of the middle."""
    e = read(spark, sf, "events").withColumn("day", F.to_date("ts"))
    daily = quantiles.sketches(e.withColumn("k", F.struct("event_type", "day")), "k", "value").withColumn("event_type", F.col("k.event_type"))
    found = quantiles.estimates(quantiles.merged(daily, "event_type"), {"median": 0.5}).drop("sketch")
    below = e.join(found, "event_type").groupBy("event_type", "rows").agg(F.count_if(F.col("value") < F.col("median")).alias("below"), F.count_if(F.col("value") <= F.col("median")).alias("upto"))
    room = 2 * quantiles.rank_error(quantiles.K) * F.col("rows") + 1
    return below.select("event_type", "rows", ((F.col("below") <= F.col("rows") / 2 + room) & (F.col("upto") >= F.col("rows") / 2 - room)).alias("within"))


@query("SELECT 'orders' AS table_name, CAST(count(*) AS DOUBLE) AS now, CAST(count(*) FILTER (WHERE o_orderkey % 2 = 0) AS DOUBLE) AS \"then\" FROM orders")
def metric_drift(spark, sf):
    def metric(df, name):
        return df.agg(F.count("*").cast("string").alias("value")).select(F.lit(name).alias("table_name"), F.lit("").alias("column_name"), F.lit("row_count").alias("metric"), "value")

    o, n = read(spark, sf, "orders"), read(spark, sf, "nation")
    now, then = metric(o, "orders").union(metric(n, "nation")), metric(o.where("o_orderkey % 2 = 0"), "orders").union(metric(n, "nation"))
    return extended.metric_drift(now, then).select("table_name", "now", "then")


@query("SELECT l_returnflag, count(*) AS n, true AS verified FROM lineitem WHERE l_discount > 0.05 GROUP BY 1")
def counter_query(spark, sf):
    """A rule's count against the same number found another way: all rows less those within the bound."""
    lines = read(spark, sf, "lineitem")
    first = lines.where("l_discount > 0.05").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    within = F.count_if(F.coalesce(F.col("l_discount") <= 0.05, F.lit(True)))
    second = lines.groupBy("l_returnflag").agg((F.count("*") - within).alias("n"))
    return extended.agreeing(first, second, "l_returnflag", "n")


@query("SELECT finding_class, finding_class IN ('violation', 'defect', 'gap') AS actionable, count(*) AS findings FROM " + FOUND(NOW) + " GROUP BY 1")
def actionable_classes(spark, sf):
    return run_findings(spark, sf, NOW).groupBy("finding_class").agg(F.count("*").alias("findings")).withColumn("actionable", actionable(F.col("finding_class")))


# Findings from measurements, every column of the schema compared.
ALL_COLUMNS = [f.name for f in FINDING]


def told(check_id: str, severity: str, kind: str, title: str, entity: str, n: str, evidence: str, *, entity_type: str = "table", grain: str = "aggregate", baseline: str = "NONE") -> str:
    """A finding's columns in SQL; severity, class, title, entity, count and evidence are expressions."""
    return f"'{check_id}' AS check_id, '{check_id.split('-')[0]}' AS family, {severity} AS severity, {kind} AS finding_class, {title} AS title, '{entity_type}' AS entity_type, {entity} AS entity_id, CAST({n} AS BIGINT) AS affected_count, '{grain}' AS grain, '{baseline}' AS baseline, false AS sampled, {evidence} AS evidence"


def json_of(**values: str) -> str:
    """A JSON text of numbers in SQL."""
    return "'{' || " + " || ',' || ".join(f"""'"{k}":' || {v}""" for k, v in values.items()) + " || '}'"


@query(f"""
WITH g AS (SELECT user_id, max(ts) AS m, count(DISTINCT ts) AS s, count(*) AS n FROM events GROUP BY user_id),
t AS (SELECT CAST(sum(n) AS BIGINT) AS total, max(s) AS s, CAST(sum(n) AS BIGINT) - (SELECT count(*) FROM events JOIN g USING (user_id) WHERE ts = m) AS aside FROM g)
SELECT {told("PIP-001", "'info'", "'design'", "'events holds up to ' || s || ' snapshots; the newest of each partition is read'", "'events'", "aside", json_of(rows="total", aside="aside", snapshots="s"), grain="snapshot_pinned(user_id)")} FROM t WHERE total > 0""")
def finding_pinned(spark, sf):
    return reports.pinned(normalise.pin_report(read(spark, sf, "events"), PIN), "events", PIN).select(*ALL_COLUMNS)


@query(f"""
WITH m AS (SELECT count(*) FILTER (WHERE n > 1) AS g, CAST(coalesce(sum(n - 1) FILTER (WHERE n > 1), 0) AS BIGINT) AS e, coalesce(max(n) FILTER (WHERE n > 1), 0) AS w, count(*) FILTER (WHERE n > 1 AND d = 1) AS i, count(*) FILTER (WHERE n > 1 AND d > 1) AS x FROM ({GROUPS}))
SELECT {told("DUP-001", "CASE WHEN e > 0 THEN 'critical' ELSE 'info' END", "CASE WHEN e > 0 THEN 'defect' ELSE 'design' END", "'lineitem: ' || e || ' rows repeat a key (l_orderkey, l_linenumber); one row a key is counted'", "'lineitem'", "e", json_of(dup_groups="g", excess_rows="e", worst_group="w", groups_identical="i", groups_disagreeing="x"))} FROM m
UNION ALL SELECT {told("CON-011", "'high'", "'defect'", "'lineitem: ' || x || ' keys (l_orderkey, l_linenumber) have rows that contradict each other'", "'lineitem'", "x", json_of(groups_disagreeing="x", groups_identical="i"), grain="group by (l_orderkey, l_linenumber)")} FROM m WHERE x > 0""")
def finding_duplicates(spark, sf):
    return reports.duplicates(normalise.measure_duplicates(read(spark, sf, "lineitem"), LINE_RULE), "lineitem", LINE_RULE, "DUP-001", "critical").select(*ALL_COLUMNS)


@query(f"""
WITH m AS (SELECT count(*) FILTER (WHERE user_id IN (0, 1, 2)) AS n, count(*) AS t FROM events)
SELECT {told("VAL-018", "'medium'", "'defect'", "'events: ' || n || ' rows with a key that is no entity in user_id, left out'", "'events.user_id'", "n", json_of(rows_phantom="n", rows_total="t"), entity_type="column", grain="row")} FROM m WHERE n > 0""")
def finding_phantom(spark, sf):
    rule = PhantomKeyRule("user_id", (0, 1, 2), "exclude")
    return reports.phantom(normalise.measure_phantom(read(spark, sf, "events"), rule), "events", rule).select(*ALL_COLUMNS)


def cleaned_sql(check_id: str, kind: str, column: str, severity: str, condition: str) -> str:
    share = "CASE WHEN round(100.0 * n / t, 2) = floor(round(100.0 * n / t, 2)) THEN CAST(round(100.0 * n / t, 2) AS DECIMAL(9, 1))::VARCHAR ELSE rtrim(CAST(round(100.0 * n / t, 2) AS DECIMAL(9, 2))::VARCHAR, '0') END"
    one = told(check_id, f"'{severity}'", "'defect'", f"'orders: ' || n || ' rows hold a {kind} in place of a value, most in {column}'", "'orders'", "n", json_of(rows_any="n", rows_total="t", pct=share), grain="row")
    return f"SELECT {one} FROM (SELECT count(*) FILTER (WHERE {condition}) AS n, count(*) AS t FROM {DIRTY}) WHERE n > 0"


@query(" UNION ALL ".join([cleaned_sql("BLK-001", "blank", "st", "medium", "trim(st) = ''"), cleaned_sql("SNT-001", "sentinel", "st", "medium", "upper(trim(st)) IN ('N/A', 'UNKNOWN')"), cleaned_sql("PLC-001", "placeholder", "d", "critical", "d IN (DATE '1900-01-01', DATE '1899-12-30')")]))
def finding_cleanups(spark, sf):
    return reports.cleanups(normalise.measure_cleanups(dirty_orders(spark, sf), CLEANUPS), "orders", {"placeholder": "critical"}).select(*ALL_COLUMNS)


@query(f"SELECT o_orderkey, d, st FROM {CLEAN}")
def cleanup_apply_any_case(spark, sf):
    """Rules that spell columns in another case rewrite what they count."""
    shouted = [CleanupRule(r.kind, tuple(c.upper() for c in r.columns), r.values) for r in CLEANUPS]
    return normalise.build(dirty_orders(spark, sf), TableRules("orders", cleanups=tuple(shouted))).df.select("o_orderkey", "d", "st")


@query(f"""
SELECT 'CFG-001' AS check_id, 'CFG' AS family, 'high' AS severity, 'risk' AS finding_class, table_name || ': the ' || context || ' rule names columns that are not there and did not run on them' AS title,
       'table' AS entity_type, table_name AS entity_id, CAST(1 AS BIGINT) AS affected_count, 'aggregate' AS grain, 'NONE' AS baseline, false AS sampled,
       '{{"context":"' || context || '","missing":["' || missing || '"],"rows_read":' || rows_read || '}}' AS evidence FROM {MISDECLARED}""")
def finding_missing_columns(spark, sf):
    return reports.missing_columns(normalise.missing_of(spark, misdeclared(spark, sf))).select(*ALL_COLUMNS)


@query(f"SELECT {told('CFG-002', repr('high'), repr('risk'), repr('events was not normalised and is left out of this run'), repr('events'), '0', chr(39) + '{' + chr(34) + 'reason' + chr(34) + ':' + chr(34) + 'AnalysisException' + chr(34) + '}' + chr(39))} FROM events HAVING count(*) > 0")
def finding_failed_table(spark, sf):
    """A table whose order column is missing cannot be normalised; the others are."""
    tables = {t: read(spark, sf, t) for t in ("events", "orders")}
    broken = TableRules("events", dedup=DedupRule(("user_id",), ("no_such desc",)))
    _, failed = normalise.build_all(tables, [broken, TableRules("orders")])
    live = registry.row_counts({"events": tables["events"]}).where("row_count > 0").select(F.col("table_name").alias("entity_id"))
    return reports.failed_tables(spark, failed).join(live, "entity_id", "left_semi").select(*ALL_COLUMNS)


def bucket_sql(bucket: str, severity: str, kind: str, words: str, condition: str) -> str:
    one = told("BIZ-201", f"'{severity}'", f"'{kind}'", f"'Shipment: ' || n || ' {words}'", "'orders'", "n", f"""'{{"bucket":"{bucket}","n":' || n || '}}'""", grain="row", baseline="ACTUAL")
    return f"SELECT {one} FROM (SELECT count(*) FILTER (WHERE {condition}) AS n FROM {FINISHED}) WHERE n > 0"


@query(" UNION ALL ".join([bucket_sql("late", "high", "violation", "past the deadline", LATE), bucket_sql("gap", "high", "gap", "missing though due", GAP), bucket_sql("pending", "info", "pending", "not yet due", PENDING)]))
def finding_deadlines(spark, sf):
    return reports.deadlines(deadline_split(spark, sf), "BIZ-201", "orders", "Shipment").select(*ALL_COLUMNS)


@query(f"""SELECT {told("PIP-010", "'medium'", "'gap'", "'1 tables hold no row'", "'no_events'", "1", """'{"names":["no_events"]}'""")} FROM events HAVING count(*) FILTER (WHERE user_id < 0) = 0""")
def finding_empty_tables(spark, sf):
    return reports.empty_tables(empty_tables(spark, sf)).select(*ALL_COLUMNS)


@query(f"""
WITH c AS (SELECT *, table_name IN ('lineitem', 'orders', 'events') AS known FROM ({COUNTS})),
m AS (SELECT count(*) FILTER (WHERE row_count > 0 AND NOT known) AS u, count(*) FILTER (WHERE row_count > 0 AND known) AS k, count(*) AS s, CAST(sum(row_count) FILTER (WHERE row_count > 0 AND NOT known) AS BIGINT) AS r FROM c),
l AS (SELECT string_agg('{{"row_count":' || row_count || ',"table_name":"' || table_name || '"}}', ',' ORDER BY row_count DESC, table_name DESC) AS largest, max_by(table_name, (row_count, table_name)) AS top FROM c WHERE row_count > 0 AND NOT known)
SELECT {told("PIP-011", "'info'", "'design'", "u || ' tables with rows are under no check; ' || k || ' of ' || s || ' are'", "top", "u", """'{"unchecked":' || u || ',"checked":' || k || ',"in_scope":' || s || ',"rows_unchecked":' || r || ',"largest":[' || largest || ']}'""")} FROM m, l WHERE u > 0""")
def finding_unexamined(spark, sf):
    declared = spark.createDataFrame([("LineItem",), ("orders",), ("events",)], "table_name string")
    return reports.unexamined(registry.row_counts(registry.parquet(spark, sf)), declared).select(*ALL_COLUMNS)


@query(f"""SELECT {told("PIP-012", "'low'", "'gap'", "'2 columns of 1 tables are null on every row'", "'orders'", "2", """'{"by_table":[{"table_name":"orders","columns":["note","remark"]}],"passed_over":[]}'""", entity_type="column")} FROM orders HAVING count(*) > 0""")
def finding_dead_columns(spark, sf):
    o = read(spark, sf, "orders").withColumns({c: F.when(F.col("o_orderkey") < 0, F.lit("x")) for c in ("note", "remark")})
    found, passed = drift.dead_columns_of({"orders": o}, {"orders": 1}, 10)
    return reports.dead_columns(found, passed).select(*ALL_COLUMNS)


@query(f"""
SELECT {told("WGT-001", "'medium'", "'violation'", "'lineitem: group_key ' || l_returnflag || ' breaks the rule'", "l_returnflag", "1", "NULL", entity_type="group_key")}
FROM (SELECT DISTINCT l_returnflag, l_linenumber, CAST(l_discount AS DECIMAL(14,4)) AS w FROM lineitem) GROUP BY l_returnflag HAVING sum(w) IS NULL OR abs(sum(w) - 100) > 0.5""")
def finding_bad_groups(spark, sf):
    """A check that names several bad groups, run by the registry."""
    registry_ = checks.Registry()
    registry_.add("WGT-001", lambda c: reports.bad_groups(rules.weight_groups(c.table("lineitem"), "l_returnflag", "l_linenumber", "l_discount"), "WGT-001", "lineitem", "group_key"), grain=ROW, baseline="NONE")
    found, _ = registry_.run(checks.Context(spark, {"lineitem": normalise.build(read(spark, sf, "lineitem"), TableRules("lineitem"))}, "2001-01-01"))
    return found.select(*ALL_COLUMNS)
