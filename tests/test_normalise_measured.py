"""Rules that name missing columns, and figures that come out of the write."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import normalise, reports
from plumbline.plans.model import FINDING, CleanupRule, DedupRule, PhantomKeyRule, SnapshotRule, TableRules


def test_a_missing_column_leaves_the_rest_of_its_rule(spark):
    df = spark.createDataFrame([("N/A", "x"), ("b", " ")], "a string, c string")
    built = normalise.build(df, TableRules("t", cleanups=(CleanupRule("sentinel", ("a", "missing"), ("n/a",)), CleanupRule("blank", ("C",)), CleanupRule("blank", ("gone",)))))
    assert [tuple(r) for r in built.df.collect()] == [(None, "x"), ("b", None)]
    assert built.transforms == ["clean sentinel", "clean blank"]
    assert built.missing == [("sentinel", ["missing"]), ("blank", ["gone"])]
    found = reports.missing_columns(normalise.missing_of(spark, {"t": built})).collect()
    assert [f.name for f in FINDING] == list(found[0].asDict())
    assert sorted(json.loads(f.evidence)["missing"][0] for f in found) == ["gone", "missing"]
    assert all(json.loads(f.evidence)["rows_read"] == 2 and f.check_id == "CFG-001" and f.affected_count == 1 for f in found)


def test_what_each_rule_needs(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (2, 1, 9)], "k int, ts int, v int")
    build = lambda **rules: normalise.build(df, TableRules("t", **rules))
    pinned = build(snapshot=SnapshotRule("TS", ("K", "region")))
    assert pinned.missing == [("snapshot", ["region"])] and pinned.df.count() == 2
    lost = build(snapshot=SnapshotRule("at", ("k",)))
    assert lost.missing == [("snapshot", ["at"])] and lost.df.count() == 3 and not lost.transforms
    torn = build(dedup=DedupRule(("k", "gone"), ("ts desc",)))
    assert torn.missing == [("dedup", ["gone"])] and torn.df.count() == 3
    merged = build(dedup=DedupRule(("k",), mode="collapse_identical", compare=("V", "gone")))
    assert merged.missing == [("dedup compare", ["gone"])] and merged.df.count() == 2
    junk = build(phantom=(PhantomKeyRule("K", (2,), "exclude"), PhantomKeyRule("none", (2,), "exclude")))
    assert junk.missing == [("phantom key", ["none"])] and junk.df.count() == 2
    assert normalise.missing_of(spark, {"t": build()}).count() == 0


@pytest.fixture
def ordered(spark):
    rows = [(k % 50, dt.date(1900, 1, 1) if k % 4 == 0 else dt.date(2020, 1, 1 + k % 28), " " if k % 3 == 0 else "n/a" if k % 5 == 0 else "ok", k // 100) for k in range(400)]
    return spark.createDataFrame(rows, "k int, d date, s string, ts int").repartition(3)


RULES = TableRules("t", snapshot=SnapshotRule("ts", ("k",)), phantom=(PhantomKeyRule("k", (7,), "exclude"),), dedup=DedupRule(("k",), ("d desc", "s desc")), cleanups=(CleanupRule("blank", ("s",)), CleanupRule("sentinel", ("s",), ("N/A",)), CleanupRule("placeholder", ("d",), ("1900-01-01",))))


def figures(df):
    return sorted(tuple(r) for r in df.collect())


def test_figures_come_out_of_the_write(spark, ordered, tmp_path, monkeypatch):
    built = normalise.build(ordered, RULES)
    want = figures(normalise.measure_cleanups(ordered, list(RULES.cleanups)))
    monkeypatch.setattr(normalise, "measure_cleanups", lambda *a: pytest.fail("a second scan"))
    out = normalise.write_measured(built, str(tmp_path / "t"))
    assert out.observed and out.counts == {"rows_raw": 400, "rows_effective": 49}
    assert figures(out.cleanups) == want and figures(out.df) == figures(built.df)
    assert [r[1:] for r in built.counts().collect()] == [(400, 49)]


def test_figures_that_do_not_add_up_are_measured_again(spark, ordered, tmp_path, monkeypatch):
    """As after a stage that ran twice: the observed count is not the files'."""
    built = normalise.build(ordered, RULES)
    want = figures(normalise.measure_cleanups(ordered, list(RULES.cleanups)))
    observed = type(ordered).observe
    monkeypatch.setattr(type(ordered), "observe", lambda self, name, *sums: observed(self.union(self) if len(sums) > 1 else self, name, *sums))
    out = normalise.write_measured(built, str(tmp_path / "t"))
    assert not out.observed and out.counts["rows_raw"] == 400 and figures(out.cleanups) == want


def test_no_rules_and_no_rows(spark, tmp_path):
    df = spark.createDataFrame([], "a int, s string")
    out = normalise.write_measured(normalise.build(df, TableRules("t")), str(tmp_path / "a"))
    assert out.counts == {"rows_raw": 0, "rows_effective": 0} and out.cleanups.count() == 0
    out = normalise.write_measured(normalise.build(df, TableRules("t", cleanups=(CleanupRule("blank", ("s",)),))), str(tmp_path / "b"))
    assert [tuple(r)[3:] for r in out.cleanups.collect()] == [(0, 0, 0)]


def test_exact_only_changes_nothing(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c")], "k int, v string")
    rule = DedupRule(("k",), mode="exact_only")
    assert normalise.build(df, TableRules("t", dedup=rule)).df.count() == 4
    m = normalise.measure_duplicates(df, rule).first()
    assert (m.dup_groups, m.excess_rows, m.groups_disagreeing) == (1, 2, 1)


def test_missing_rows_of_an_inventory(spark):
    """The stand-alone form, by an inventory."""
    have = spark.createDataFrame([("T", "A")], "table_name string, column_name string")
    found = normalise.missing_columns(spark, have, [("t", "a", "dedup"), ("t", "b", "dedup"), ("t", "c", "dedup")])
    assert [(r.table_name, r.context, r.missing) for r in found.collect()] == [("t", "dedup", ["b", "c"])]
    assert reports.missing_columns(found).select(F.get_json_object("evidence", "$.missing")).first()[0] == '["b","c"]'
