"""Steps where keys meet: their tasks follow the rows, so that no task grows with the table."""

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.operators import evidence, normalise, ranges
from plumbline.plans import queries
from plumbline.plans.model import DedupRule, TableRules

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(ranges, "TASK_ROWS", 300, raising=False)


def test_supplier_intervals_fill_many_tasks(spark, small_tasks):
    lines = queries.read(spark, FOLDER, "lineitem").count()
    rows = [r["count"] for r in queries.supplier_intervals(spark, FOLDER).groupBy(F.spark_partition_id()).count().collect()]
    assert len(rows) >= lines // 400 and max(rows) <= 300


def test_pairs_of_many_tasks_match_sql(spark, small_tasks):
    """The pairs' own rows are dealt by order in many tasks, and none is lost or listed twice."""
    found = queries.interval_overlap_pairs(spark, FOLDER)
    asked = found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [l_orderkey")
    c = duckdb.connect()
    for name in ("orders", "lineitem"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    want = c.sql(queries.ORACLES["interval_overlap_pairs"])
    order = [want.columns.index(x) for x in found.columns]
    assert sorted(map(tuple, found.collect())) == sorted(tuple(r[k] for k in order) for r in want.fetchall())
    assert asked == 2  # both sides of the pair, one exchange that they share


def test_collapsed_groups_fill_many_tasks_and_sort_once(spark, small_tasks):
    lines = queries.read(spark, FOLDER, "lineitem")
    doubled = lines.union(lines.where("l_orderkey % 3 = 0")).union(lines.where("l_orderkey % 5 = 0").withColumn("l_quantity", F.col("l_quantity") + 1))
    rule = DedupRule(("l_orderkey", "l_linenumber"), mode="collapse_identical", compare=("l_quantity", "l_returnflag"))
    out = normalise.dedup(doubled, rule)
    tasks = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) >= doubled.count() // 400 and max(tasks) <= 450
    assert out._jdf.queryExecution().sparkPlan().toString().count("Window [") == 1
    kinds = lines.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.countDistinct("l_quantity", "l_returnflag").alias("d"))
    kinds = kinds.select("l_orderkey", "n", "d").collect()
    want = sum(r.n * (1 + (r.l_orderkey % 3 == 0) + 1) if r.l_orderkey % 5 == 0 else 1 if r.d == 1 else r.n * (1 + (r.l_orderkey % 3 == 0)) for r in kinds)
    assert sum(tasks) == want and want > lines.count()


def test_a_measured_write_still_observes_its_own_rows(spark, tmp_path, small_tasks):
    """The rows are counted on the table itself, not on the one that observes them."""
    lines = queries.read(spark, FOLDER, "lineitem")
    lines = lines.union(lines.where("l_orderkey % 3 = 0"))
    rule = DedupRule(("l_orderkey", "l_linenumber"), mode="collapse_identical", compare=("l_quantity", "l_returnflag"))
    built = normalise.build(lines, TableRules("lineitem", dedup=rule))
    out = normalise.write_measured(built, str(tmp_path / "lines"))
    assert out.observed and out.counts == {"rows_raw": lines.count(), "rows_effective": built.df.count()}


def test_group_statements_meet_in_one_step_and_many_tasks(spark, small_tasks):
    """A hot group's texts are spread, no join by group is left but the last, and a null group is judged as any other."""
    source = F.concat(F.lit("at "), (F.col("id") * 3 + 0.5).cast("decimal(9,2)").cast("string"), F.lit(" on 2020-03-07"))
    members = spark.range(4_000).select(F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 5 > 0, 8).alias("g"), source.alias("source"))
    groups = members.select("g").distinct().withColumn("story", F.lit("in 2020, 03 and 3, at 6.5, 6, 15.50, 24, 36.5%, 3.5%, 18.51, 5,998 and 47"))
    out = evidence.validate_groups(groups, members, "g", "story", "source")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert out.columns == ["g", "story", "unsupported", "ok"]
    assert plan.count("Join ") == 1 and "RepartitionByExpression [g" in plan
    # Values: 6.5, 24.5, 36.5 .. (7); 3.5, 9.5, 21.5 .. (8); 15.5, 45.5 .. (null), of which only 15.5 is written as 15.50.
    assert {r.g: r.unsupported for r in out.collect()} == {
        7: ["15.50", "18.51", "3.5%", "47", "5998"],
        8: ["15.50", "18.51", "24", "36.5%", "47", "6", "6.5"],  # 5997.5 is a 5998
        None: ["18.51", "24", "3.5%", "36.5%", "47", "5998", "6", "6.5"],
    }
