"""Samples by blocks, profiles kept by part, keyed result tables; profiling pages; database source."""

import os

import pytest
from pyspark.sql import functions as F

from plumbline.operators import drift, profile
from plumbline.sources import registry, results


@pytest.fixture(scope="module")
def blocks(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("blocks") / "t")
    spark.range(20_000).select("id", (F.rand(5) < 0.3).alias("hit"), (F.col("id") % 100).alias("v")).repartition(50).write.parquet(path)
    return path


def test_block_samples_hold_the_truth(spark, blocks):
    truth = spark.read.parquet(blocks).where("hit").count()
    inside = 0
    for seed in range(25):
        sample = registry.block_sample(spark, blocks, percent=20, seed=seed)
        e = sample.estimate(F.col("hit"), z=2.5).first()
        assert (sample.files_read, sample.files_total, sample.rows_total) == (10, 50, 20_000)
        assert e.low <= e.estimate <= e.high and e.high - e.low < 3_000
        inside += e.low <= truth <= e.high
    assert inside >= 22


def test_unread_files_are_not_in_the_plan(spark, blocks):
    sample = registry.block_sample(spark, blocks, percent=10, seed=1)
    assert len(sample.df.inputFiles()) == 8 and sample.df.count() < 4_500
    again = registry.block_sample(spark, blocks, percent=10, seed=1)
    assert sorted(again.df.inputFiles()) == sorted(sample.df.inputFiles()) != sorted(registry.block_sample(spark, blocks, percent=10, seed=2).df.inputFiles())


def test_small_and_empty_tables_are_read_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).repartition(3).write.parquet(path)
    sample = registry.block_sample(spark, path)
    assert tuple(sample.estimate(F.col("id") < 10).first()) == (100, 10, 10.0, 0.0, 10.0, 10.0)
    path = str(tmp_path / "e")
    spark.range(0).write.parquet(path)
    assert registry.block_sample(spark, path).estimate(F.col("id") < 10).first().estimate == 0


def test_profiles_kept_by_part(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.range(30_000).select("id", (F.col("id") % 5000).cast("string").alias("s"), F.when(F.col("id") % 4 == 0, 1).alias("n"), F.lit(None).cast("string").alias("dead"), F.col("id").alias("a.b"))
    for day in range(3):
        profile.keep_profile(df.where(F.col("id") % 3 == day), path, f"d{day}")
    files = {f: os.path.getmtime(f"{path}/part=d0/{f}") for f in os.listdir(f"{path}/part=d0")}
    profile.keep_profile(df.where(F.col("id") % 3 == 2), path, "d2")  # a part stored again counts once
    assert files == {f: os.path.getmtime(f"{path}/part=d0/{f}") for f in os.listdir(f"{path}/part=d0")}
    found = {r.column_name: r for r in profile.merged_profile(spark.read.parquet(path)).collect()}
    assert {c: (r.rows, r.filled, r.null_pct) for c, r in found.items()} == {"id": (30_000, 30_000, 0.0), "s": (30_000, 30_000, 0.0), "n": (30_000, 7_500, 75.0), "dead": (30_000, 0, 100.0), "a.b": (30_000, 30_000, 0.0)}
    for column, exact in (("id", 30_000), ("s", 5_000), ("n", 1), ("dead", 0)):
        assert abs(found[column].distinct_values - exact) <= 3 * profile.distinct_error() * exact
    assert profile.distinct_error() == pytest.approx(0.01625)


def test_an_upsert_leaves_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "k")
    old = spark.range(1_000).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit(1).alias("w"))
    results.write_keyed(old, path, ["k"], 16)
    stamp = lambda: {f"{d}/{f}": os.path.getmtime(f"{path}/{d}/{f}") for d in os.listdir(path) if d.startswith("bucket=") for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")}
    before = stamp()
    assert len({f.split("/")[0] for f in before}) == 16
    new = spark.createDataFrame([(3, "new", 2), (3, "newer", 0), (None, "none", 5), (5_000, "added", 9)], "k bigint, v string, w int")
    touched = results.upsert_keyed(new, path, ["k"], 16)
    after = stamp()
    assert 1 <= len(touched) <= 3
    changed = {f.split("/")[0] for f in before.keys() ^ after.keys()} | {f.split("/")[0] for f in before.keys() & after.keys() if before[f] != after[f]}
    assert changed == {f"bucket={b}" for b in touched}
    want = sorted(map(tuple, results.upsert(old, new, ["k"]).collect()), key=str)
    assert sorted(map(tuple, results.read_keyed(spark, path).select("k", "v", "w").collect()), key=str) == want
    assert results.upsert_keyed(new.where("false"), path, ["k"], 16) == [] and stamp() == after


def test_runs_append(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = spark.createDataFrame([("T-1", 5)], "check_id string, n int")
    results.append(rows, path, "run1")
    results.append(rows, path, "run2")
    assert sorted(r.run_id for r in spark.read.parquet(path).collect()) == ["run1", "run2"]
    results.replace_run(rows.union(rows), path, "run2")
    assert sorted(r.run_id for r in spark.read.parquet(path).collect()) == ["run1", "run2", "run2"]


def test_a_candidate_check_is_tried_on_a_page(spark):
    n, rows = profile.test_execute(spark.range(1_000), cap=50, sample=3)
    assert n == 50 and len(rows) == 3 and profile.capped(spark.range(10), 4).count() == 4


def test_snapshot_metrics_go_round(spark, tmp_path):
    """Written by one run, read back by the next as its baseline, and compared: end to end."""
    kind = "schema_name string, table_name string, column_name string, data_type string, nullable boolean, length int, ordinal int"
    before = spark.createDataFrame([("m", "t", "a", "int", True, None, 1), ("m", "t", "b", "string", True, None, 2), ("m", "gone", "x", "int", True, None, 1)], kind)
    now = spark.createDataFrame([("m", "t", "a", "bigint", True, None, 1), ("m", "t", "c", "string", True, None, 2), ("m", "new", "y", "int", True, None, 1)], kind)
    counts = spark.createDataFrame([("t", 10), ("gone", 3)], "table_name string, row_count bigint")
    path = str(tmp_path / "metrics")
    for run, inventory in (("r1", before), ("r2", now)):
        drift.snapshot_metrics(inventory, counts, run).write.mode("append").parquet(path)
    metrics = spark.read.parquet(path)
    assert metrics.where("run_id = 'r1' AND metric = 'row_count'").count() == 2 and metrics.where("run_id = 'r1' AND metric = 'table_fp'").count() == 2
    runs = spark.createDataFrame([("r1", "completed", 1), ("r2", "running", 2)], "run_id string, status string, started_at int")
    base = drift.baseline(metrics, runs, "r2")
    fp = lambda m: m.where("metric = 'column_fp'").select("table_name", "column_name", F.col("value").alias("fp"))
    current, earlier = fp(metrics.where("run_id = 'r2'")), fp(base)
    changes = drift.diff(current, earlier)
    assert {tuple(r) for r in changes.collect()} == {("t", "a", "changed"), ("t", "b", "removed"), ("t", "c", "added"), ("gone", "x", "removed"), ("new", "y", "added")}
    assert {tuple(r) for r in drift.table_diff(changes, current, earlier).collect()} == {("gone", "removed"), ("new", "added")}


def test_database_source(spark):
    """A table of an embedded database, read whole, by a query's text and in ranges of a column."""
    url = "jdbc:derby:memory:plumbline;create=true"
    rows = spark.range(100).select(F.col("id").alias("ID"), (F.col("id") % 7).cast("int").alias("V"))
    rows.write.format("jdbc").option("url", url).option("dbtable", "T").mode("overwrite").save()
    want = sorted(map(tuple, rows.collect()))
    assert sorted(map(tuple, registry.jdbc(spark, url, "T").collect())) == want
    ranged = registry.jdbc(spark, url, "T", column="ID", low=0, high=100, parts=4, fetchsize="10")
    assert sorted(map(tuple, ranged.collect())) == want
    parts = [r["count"] for r in ranged.groupBy(F.spark_partition_id()).count().collect()]
    assert len(parts) == 4 and max(parts) <= 40
    assert registry.jdbc(spark, url, "(SELECT V FROM T WHERE ID < 10) Q").count() == 10
    assert registry.row_counts({"T": registry.jdbc(spark, url, "T")}).first().row_count == 100
