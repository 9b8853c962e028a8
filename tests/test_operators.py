"""Semantics on small tables: nulls, ties, dirty text, guards."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.functions import expressions as X
from plumbline.operators import drift, evidence, extended, findings, grain, invariants, normalise, profile, reports, rules
from plumbline.plans import checks
from plumbline.plans.model import ROW, CleanupRule, DateOrderRule, DedupRule, Grain, PhantomKeyRule, SnapshotRule, TableRules, actionable, latest_per, severity_rank
from plumbline.sources import registry, results
from plumbline.streaming import cleaning


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(df):
    return df.collect()[0].asDict()


def test_latest_per_key_puts_null_last_when_falling(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, 5, "b"), (2, None, "c"), (None, 1, "d")], "k int, o int, v string")
    assert {r.v for r in grain.latest(df, ["k"], ["o desc", "v"]).collect()} == {"b", "c", "d"}
    assert {r.v for r in grain.latest_state(df, ["k"], ["o desc", "v"]).collect()} == {"b", "d"}


def test_pin_keeps_ties_and_drops_null_partitions(spark):
    df = spark.createDataFrame([("p", 1), ("p", 2), ("p", 2), (None, 9), ("q", 1)], "part string, ts int")
    assert rows(normalise.pin_snapshot(df, SnapshotRule("ts", ("part",)))) == [("p", 2), ("p", 2), ("q", 1)]
    assert rows(normalise.pin_snapshot(df.where("part IS NOT NULL"), SnapshotRule("ts"))) == [("p", 2), ("p", 2)]
    report = {r.part: r.rows_set_aside for r in normalise.pin_report(df, SnapshotRule("ts", ("part",))).collect()}
    assert report["p"] == 1 and report["q"] == 0


def test_duplicate_groups_tell_null_from_value(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, None), (3, "x")], "k int, v string")
    rule = DedupRule(("k",), mode="exact_only", compare=("v",))
    assert one(normalise.measure_duplicates(df, rule)) == {"dup_groups": 2, "rows_in_dup_groups": 4, "excess_rows": 2, "worst_group": 2, "groups_disagreeing": 1, "groups_identical": 1}
    assert normalise.dedup(df, rule).count() == 5
    assert normalise.dedup(df, DedupRule(("k",), mode="collapse_identical", compare=("v",))).count() == 4
    assert {r.k for r in normalise.conflicting_rows(df, rule).collect()} == {2}


def test_empty_table_measures_to_zero(spark):
    df = spark.createDataFrame([], "k int, v string")
    assert set(one(normalise.measure_duplicates(df, DedupRule(("k",), mode="exact_only"))).values()) == {0}


def test_phantom_exclusion_keeps_null_keys(spark):
    df = spark.createDataFrame([(0,), (None,), (5,)], "k int")
    rule = PhantomKeyRule("k", (0,), "exclude")
    assert {r.k for r in normalise.apply_phantom(df, rule).collect()} == {None, 5}
    assert one(normalise.measure_phantom(df, rule)) == {"rows_total": 3, "rows_phantom": 1}


CLEANUPS = [CleanupRule("blank", ("s",)), CleanupRule("sentinel", ("s",), ("N/A", "-")), CleanupRule("placeholder", ("d",), ("1900-01-01",))]


def dirty(spark):
    day = dt.date(1900, 1, 1)
    return spark.createDataFrame([("  ", day), (" n/a ", dt.date(2000, 1, 1)), ("-", None), (" real n/a text ", day), (None, None)], "s string, d date")


def test_cleanups_rewrite_what_they_count(spark):
    df = dirty(spark)
    cleaned = normalise.clean(df, CLEANUPS)
    assert [r.s for r in cleaned.collect()] == [None, None, None, "real n/a text", None]
    hits = {r.kind: r.hits for r in normalise.measure_cleanups(df, CLEANUPS).collect()}
    assert hits == {"blank": 1, "sentinel": 2, "placeholder": 2}
    lost = df.where("s IS NOT NULL").count() - cleaned.where("s IS NOT NULL").count()
    assert lost == hits["blank"] + hits["sentinel"]
    none = normalise.measure_cleanups(df.where("false"), CLEANUPS)
    assert normalise.actions(none, "t").count() == 0


def test_build_runs_dedup_on_raw_values(spark):
    df = spark.createDataFrame([("n/a", 1, 0), ("-", 2, 0), ("x", 3, 7)], "s string, o int, k int")
    built = normalise.build(df, TableRules("t", dedup=DedupRule(("s",), ("o desc",)), phantom=(PhantomKeyRule("k", (7,), "exclude"),), cleanups=(CleanupRule("sentinel", ("s",), ("n/a", "-")), CleanupRule("blank", ("gone",)))))
    assert built.df.count() == 2 and built.df.where("s IS NULL").count() == 2
    assert built.transforms == ["phantom k", "dedup keep_latest", "clean sentinel"]


def test_failed_table_is_left_out(spark):
    bad = TableRules("t", dedup=DedupRule(("k",), ("no_such",)))
    built, failed = normalise.build_all({"t": spark.createDataFrame([(1,)], "k int")}, [bad, TableRules("absent")])
    assert not built and failed[0][0] == "t"


@pytest.mark.parametrize(("text", "value"), [("", None), (" 1.5 ", 1.5), ("12f", None), ("1,000", None), ("NaN", None), ("1e5", 1e5), (None, None), ("-.5", -0.5)])
def test_number_text(spark, text, value):
    assert spark.createDataFrame([(text,)], "s string").select(X.number(F.col("s")).alias("v")).first().v == value


def test_non_numeric_is_counted_apart(spark):
    df = spark.createDataFrame([("5",), ("50",), ("x",), (None,)], "v string")
    m = one(invariants.measure(df, [invariants.in_range("RNG-1", "v", 0, 10, False)]))
    assert (m["rows_scanned"], m["violations"], m["non_numeric"]) == (3, 2, 1)
    got = {r.check_id: r.finding_class for r in checks.invariant_findings(invariants.measure(df, [invariants.in_range("RNG-1", "v", 0, 10, False)]), severity="high", grain=ROW, baseline="NONE").collect()}
    assert got == {"RNG-1": "violation", "RNG-1-NONNUMERIC": "defect"}


def test_date_order_reports_the_worst_inversion(spark):
    d = dt.date
    df = spark.createDataFrame([(d(2020, 1, 9), d(2020, 1, 1)), (d(2020, 1, 1), d(2021, 1, 1)), (None, d(2020, 1, 1))], "b date, a date")
    m = one(invariants.measure(df, [invariants.date_order(DateOrderRule("T", "b", "a"))]))
    assert (m["rows_scanned"], m["violations"], m["highest"]) == (2, 1, "8")


def test_future_date_counts_later_the_same_day(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'2020-01-01 00:00:00'), (TIMESTAMP_NTZ'2020-01-01 00:00:01') t(x)")
    assert one(invariants.measure(df, [invariants.future_date("F", "x", "2020-01-01")]))["violations"] == 1


def test_generator_refuses_a_repeated_id(spark):
    df = spark.createDataFrame([], "a date, b date")
    with pytest.raises(ValueError, match="twice"):
        invariants.generate(df, [], [DateOrderRule("X", "a", "b"), DateOrderRule("X", "b", "a")], "2020-01-01")


def test_deadline_edges(spark):
    df = spark.sql("SELECT * FROM VALUES (DATE'2020-01-05', DATE'2020-01-05'), (NULL, DATE'2020-01-10'), (NULL, DATE'2020-01-09'), (DATE'2020-01-06', DATE'2020-01-05'), (NULL, NULL) t(actual, due)")
    assert one(rules.deadline_split(df, F.col("actual"), F.col("due"), F.lit("2020-01-10").cast("date"))) == {"late": 1, "gap": 1, "pending": 1, "total": 5}


@pytest.mark.parametrize("days", [None, 7])
def test_interval_overlap_touching_nested_inverted(spark, days):
    d = dt.date
    data = [("r", 1, d(2020, 1, 1), d(2020, 1, 5)), ("r", 2, d(2020, 1, 5), d(2020, 3, 8)), ("r", 3, d(2020, 2, 1), d(2020, 2, 2)), ("r", 4, d(2020, 2, 9), d(2020, 2, 1)), ("s", 5, d(2020, 1, 1), d(2021, 1, 1))]
    df = spark.createDataFrame(data, "res string, e int, s date, t date")
    pairs = rules.interval_overlaps(df, "res", "e", "s", "t", bucket_days=days)
    assert rows(pairs) == [("r", 1, 2), ("r", 2, 3)]
    assert one(rules.overlap_summary(pairs)) == {"pairs": 2, "resources": 1}


def test_weights_null_sum_is_bad(spark):
    df = spark.createDataFrame([("a", 1, 60.0), ("a", 2, 40.0), ("a", 2, 40.0), ("b", 1, None), ("c", 1, 99.0)], "g string, c int, w double")
    assert {r.group_key for r in rules.weight_groups(df, "g", "c", "w").collect()} == {"b", "c"}


def findings_table(spark, data):
    return spark.createDataFrame(data, "check_id string, entity_id string, severity string, finding_class string, affected_count int, title string")


def test_lifecycle_does_not_fan_out(spark):
    now = findings_table(spark, [("A", "1", "high", "gap", 1, "t"), ("A", "1", "high", "violation", 2, "t"), ("B", None, "low", "gap", 1, "t")])
    then = findings_table(spark, [("A", "1", "high", "gap", 1, "t"), ("A", "1", "high", "pending", 1, "t"), ("C", "9", "low", "gap", 1, "t")])
    out = findings.lifecycle(now, then, "run0")
    assert rows(out.select("check_id", "lifecycle")) == [("A", "recurring"), ("A", "recurring"), ("B", "new")]
    assert [r.first_seen for r in out.where("check_id = 'A'").collect()] == ["run0", "run0"]
    assert rows(findings.resolved(now, then).select("check_id")) == [("C",)]
    assert rows(findings.lifecycle(now, then.where("false"), "x").select("lifecycle").distinct()) == [("new",)]


def test_register_orders_by_severity_then_rows(spark):
    f = findings_table(spark, [("A", "1", "low", "gap", 9, "t"), ("B", "1", "critical", "gap", 1, "t"), ("C", "1", "critical", "pending", 5, "t")])
    assert [r.check_id for r in findings.register(f, limit=10).collect()] == ["C", "B", "A"]
    assert [r.check_id for r in findings.register(f, limit=10, actionable_only=True).collect()] == ["B", "A"]
    card = findings.top_scorecard(f, 5).collect()[0]
    assert (card.findings, card.critical, card.actionable) == (3, 2, 2)
    assert findings.register_sheet(f).columns == [*findings.REGISTER, "rank"]


def test_previous_run_ignores_failures(spark):
    runs = spark.createDataFrame([("a", "completed", 1), ("b", "failed", 2), ("c", "completed", 3)], "run_id string, status string, started_at int")
    assert findings.previous_run(runs, "c").first().run_id == "a"


def test_incident_severity_and_unknown_members(spark):
    f = spark.createDataFrame([("f1", "low"), ("f2", "high")], "finding_id string, severity string")
    i = spark.createDataFrame([("i1", ["f1", "f2"]), ("i2", []), ("i3", ["f9"])], "incident_id string, finding_ids array<string>")
    assert {r.incident_id: r.severity for r in findings.incident_severity(i, f).collect()} == {"i1": "high", "i2": "medium", "i3": "medium"}
    assert rows(findings.unknown_references(i, f)) == [("i3", "f9")]


@pytest.mark.parametrize(
    ("said", "source", "missing"),
    [("14003 rows", "14,003 rows", []), ("1.1167 days", "1.1166666666666667", []), ("by 19 October", "2026-10-19", []), ("about 9.9999", "10.5", ["9.9999"]), ("12345", "1", ["12345"]), ("51%", "51", []), ("1 well", "100 wells", ["1"]), (None, "1", []), ("3", None, ["3"])],
)
def test_numbers_must_come_from_the_source(spark, said, source, missing):
    df = spark.createDataFrame([(said, source)], "said string, source string")
    assert evidence.validate(df, ["said"], "source").first().unsupported == missing


def test_group_statement_uses_all_members(spark):
    groups = spark.createDataFrame([("g", "5 and 7"), ("h", "8")], "g string, said string")
    members = spark.createDataFrame([("g", "5"), ("g", "7"), ("h", "9")], "g string, source string")
    assert {r.g: r.ok for r in evidence.validate_groups(groups, members, "g", "said", "source").collect()} == {"g": True, "h": False}


def test_fingerprint_changes_with_each_field(spark):
    df = spark.createDataFrame([("a", "b"), ("ab", ""), ("a", None), ("a", "")], "x string, y string")
    keys = [r.k for r in df.select(evidence.narration_key(["x", "y"], "m", "p").alias("k")).collect()]
    assert len(set(keys)) == 3 and keys[2] == keys[3]
    assert df.select(evidence.narration_key(["x", "y"], "m", "q").alias("k")).first().k != keys[0]


@pytest.mark.parametrize("phrase", evidence.EARLY_PHRASES)
def test_screen_rejects_each_phrase(spark, phrase):
    df = spark.createDataFrame([(f"Tasks {phrase.upper()}", "h"), ("Tasks late", "h"), ("", "h"), (None, "h")], "title string, hyp string")
    assert [r.rejected for r in evidence.screen(df, ["title", "hyp"]).collect()] == [True, False, True, True]


def test_drift_finds_added_removed_changed_and_is_silent_first(spark):
    kind = "table_name string, column_name string, data_type string, nullable boolean, length int, ordinal int"
    now = drift.column_fingerprints(spark.createDataFrame([("t", "a", "int", True, None, 2), ("t", "b", "string", True, None, 1)], kind))
    then = drift.column_fingerprints(spark.createDataFrame([("t", "a", "int", True, None, 1), ("t", "b", "int", True, None, 2), ("u", "c", "int", True, None, 1)], kind))
    assert rows(drift.diff(now, then)) == [("t", "b", "changed"), ("u", "c", "removed")]
    assert rows(drift.table_diff(drift.diff(now, then), now, then)) == [("u", "removed")]
    assert drift.diff(now, then.where("false")).count() == 0


def test_emptiness_needs_a_real_count(spark):
    counts = spark.createDataFrame([("a", 0), ("v", None), ("b", 3)], "table_name string, row_count bigint")
    assert [r.table_name for r in drift.empty_tables(counts).collect()] == ["a"]
    assert drift.confirm_empty({"a": spark.range(11).toDF("x")}, ["a"]) == []
    declared = spark.createDataFrame([("B",)], "table_name string")
    assert drift.unexamined(counts, declared).count() == 0
    dead, passed = drift.dead_columns_of({"b": spark.sql("SELECT 1 AS x, CAST(NULL AS INT) AS y")}, {"b": 1, "big": 99}, 10)
    assert [r.column_name for r in dead.collect()] == ["y"] and passed == []


def test_registry_guards():
    r = checks.Registry()
    for bad in ({"grain": None, "baseline": "NONE"}, {"grain": ROW, "baseline": None}, {"grain": ROW, "baseline": "COMMITTED"}):
        with pytest.raises(ValueError, match="X-1"):
            r.add("X-1", lambda c: None, **bad)
    r.add("X-1", lambda c: None, grain=ROW, baseline="NONE")
    with pytest.raises(ValueError, match="already"):
        r.add("X-1", lambda c: None, grain=ROW, baseline="NONE")
    with pytest.raises(ValueError):
        Grain("latest_per", ("k",))
    assert str(latest_per(["k"], ["t desc"])) == "latest_per(k ORDER BY t desc)"
    for mode in (lambda: DedupRule(("k",), mode="drop"), lambda: PhantomKeyRule("k", (), "hide"), lambda: CleanupRule("x", ())):
        with pytest.raises(ValueError):
            mode()


def test_error_in_one_check_stays_its_own(spark):
    r = checks.Registry()
    r.add("A-1", lambda c: c.table("t").select("missing"), grain=ROW, baseline="NONE")
    r.add("A-2", lambda c: rules.missing_prerequisite(c.table("t"), "a", "b"), grain=ROW, baseline="ACTUAL")
    built = {"t": normalise.build(spark.createDataFrame([(1, None)], "a int, b int"), TableRules("t"))}
    found, results_ = r.run(checks.Context(spark, built, "2020-01-01"))
    assert {x.check_id: x.status for x in results_.collect()} == {"A-1": "error", "A-2": "fail"}
    assert one(found)["baseline"] == "ACTUAL" and one(findings.roll_up(results_))["checks_error"] == 1


def test_severity_and_classes(spark):
    df = spark.createDataFrame([("critical", "violation"), ("info", "risk"), ("odd", None)], "s string, c string")
    assert [tuple(r) for r in df.select(severity_rank(F.col("s")), actionable(F.col("c"))).collect()] == [(0, True), (5, False), (6, False)]


def test_scope_and_sampling(spark):
    t = spark.createDataFrame([("main", "A"), ("main", "b"), ("other", "c")], "schema_name string, table_name string")
    assert rows(registry.Scope(("MAIN",), ("a",)).filter_tables(t)) == [("main", "b")]
    df = spark.range(1000).toDF("x")
    assert registry.sampled(df, 1000, limit=2000) == (df, False)
    part, flag = registry.sampled(df, 1000, limit=10, percent=50)
    assert flag and 0 < part.count() < 1000


def test_results_round_trip(spark, tmp_path):
    path = str(tmp_path / "t")
    results.append(spark.createDataFrame([(1,)], "x int"), path, "r1")
    results.append(spark.createDataFrame([(2,)], "x int"), path, "r2")
    results.replace_run(spark.createDataFrame([(3,)], "x int"), path, "r2")
    assert sorted((r.x, r.run_id) for r in results.read(spark, path).collect()) == [(1, "r1"), (3, "r2")]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string")
    assert rows(results.upsert(old, new, ["k"])) == [(1, "a"), (2, "c")]


def test_profile_and_candidates(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, None)], "x int, y string")
    exact = {r.column_name: (r.rows, r.filled, r.null_pct, r.distinct_values) for r in profile.describe_table(df).collect()}
    assert exact == {"x": (3, 3, 0.0, 2), "y": (3, 1, 66.67, 1)}
    assert {r.column_name: r.distinct_values for r in profile.describe_table(df, approximate=True).collect()} == {"x": 2, "y": 1}
    assert profile.test_execute(df, 2)[0] == 2


def test_extended_rules(spark):
    df = spark.createDataFrame([("A-1",), ("B",), (None,)], "c string")
    assert [r[0] for r in df.select(X.key_prefix(F.col("c"))).collect()] == ["A", None, None]
    assert spark.range(1).select(X.decode_entities(F.lit("&amp;lt; &lt;"))).first()[0] == "&lt; <"
    assert rows(extended.spelling_variants(spark.createDataFrame([("a  b",), ("A b",), ("c",)], "s string"), "s")) == [("a b", 2, 2)]
    pair = spark.createDataFrame([("r", 1)], "k string, n int")
    assert extended.agreeing(pair, pair.where("false"), "k", "n").first().verified is False


def test_clean_ups_on_a_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.sql("SELECT ' n/a ' AS s, 0 AS k, TIMESTAMP'2020-01-01 10:00:00' AS t UNION ALL SELECT 'x', 1, TIMESTAMP'2020-01-01 10:30:00' UNION ALL SELECT '', 2, TIMESTAMP'2020-01-01 11:10:00'").write.parquet(source)
    stream = spark.readStream.schema("s string, k int, t timestamp").parquet(source)
    cleaned = cleaning.clean_stream(stream, [CleanupRule("blank", ("s",)), CleanupRule("sentinel", ("s",), ("N/A",))], [PhantomKeyRule("k", (0,), "exclude")])
    q = cleaned.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.k, r.s) for r in spark.read.parquet(out).collect()) == [(1, "x"), (2, None)]
    counts = cleaning.windowed_violations(stream, "t", F.col("k") == 0)
    q = counts.writeStream.format("memory").queryName("violations").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.rows_scanned, r.violations) for r in spark.table("violations").collect()) == [(1, 0), (2, 1)]


def test_registry_takes_several_findings_and_never_passes_what_it_cannot_read(spark):
    groups = spark.createDataFrame([("a",), ("b",), (None,)], "group_key string")
    figures = spark.createDataFrame([(10, 2, "x"), (5, 0, "y"), (5, 1, "z")], "rows_scanned int, violations int, entity_id string")
    r = checks.Registry()
    r.add("WGT-1", lambda c: groups, grain=ROW, baseline="NONE")
    r.add("WGT-2", lambda c: reports.bad_groups(groups, "WGT-2", "t", "group_key"), grain=ROW, baseline="NONE")
    r.add("WGT-3", lambda c: figures, grain=ROW, baseline="NONE")
    found, results_ = r.run(checks.Context(spark, {}, "2020-01-01"))
    assert {x.check_id: (x.status, x.violations) for x in results_.collect()} == {"WGT-1": ("error", None), "WGT-2": ("fail", 3), "WGT-3": ("fail", 3)}
    assert sorted((x.check_id, str(x.entity_id)) for x in found.collect()) == [("WGT-2", "None"), ("WGT-2", "a"), ("WGT-2", "b"), ("WGT-3", "x"), ("WGT-3", "z")]


def test_cleanups_count_what_they_rewrite_in_any_case(spark):
    df = spark.createDataFrame([(" n/a ",), ("ok",)], "status string")
    rules_ = TableRules("t", cleanups=(CleanupRule("sentinel", ("Status",), ("N/A",)),))
    assert [x.status for x in normalise.build(df, rules_).df.collect()] == [None, "ok"]
    assert normalise.measure_cleanups(df, list(rules_.cleanups)).first().hits == 1


def test_payloads_do_not_collide(spark):
    rows = [(1, "a|b", "c"), (1, "a", "b|c"), (2, "<NULL>", None), (2, None, "<NULL>"), (3, None, "x"), (3, None, "x")]
    df = spark.createDataFrame(rows, "k int, u string, v string")
    rule = DedupRule(("k",), mode="collapse_identical")
    m = normalise.measure_duplicates(df, rule).first()
    assert (m.groups_disagreeing, m.groups_identical) == (2, 1) and normalise.dedup(df, rule).count() == 5
    assert normalise.payload_columns(df, rule, ["u", "v"]) == ["u", "v"] and normalise.payload_columns(df, rule, ["u", "v"], 1) == ["u"]


def test_early_phrases(spark):
    texts = ["this well finished ahead of schedule", "results show an acceleration of the timeline", "completed sooner than planned", "the actual date is before its target date", "a date after the expected date, a real delay"]
    df = spark.createDataFrame([("x", t) for t in texts], "title string, hypothesis string")
    assert [r.rejected for r in evidence.screen(df, ["title", "hypothesis"]).collect()] == [True] * 4 + [False]


def test_findings_of_a_clean_table_are_none(spark):
    none = spark.createDataFrame([], "table_name string, row_count bigint")
    assert reports.empty_tables(none).count() == reports.unexamined(none, none).count() == 0
    split = spark.createDataFrame([(0, 0, 2, 5)], "late int, gap int, pending int, total int")
    assert [(r.finding_class, r.affected_count) for r in reports.deadlines(split, "BIZ-1", "t", "x").collect()] == [("pending", 2)]
    assert reports.failed_tables(spark, []).count() == 0
