"""Statistics from footers: equal to scans, and no data page read where they are enough."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from plumbline.operators import drift, invariants
from plumbline.sources import footers


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("footers") / "t")
    df = spark.range(4_000).select(
        F.col("id").alias("k"), F.when(F.col("id") % 7 != 0, F.col("id") % 100).cast("int").alias("v"), F.lit(None).cast("string").alias("dead"), F.lit(None).cast("array<int>").alias("gone"), F.array().cast("array<int>").alias("empty"),
        F.expr("CAST(date_add(date'2020-01-01', CAST(id / 10 AS INT)) AS TIMESTAMP_NTZ)").alias("at"), F.expr("date_add(date'2020-01-01', CAST(id / 10 AS INT))").alias("d"), (F.col("id") / 3).cast("decimal(12,2)").alias("m"),
        F.when(F.col("id") == 17, F.lit(float("nan"))).otherwise(F.col("id").cast("double")).alias("f"), F.struct(F.lit(1).alias("x")).alias("s"), F.concat(F.lit("t"), F.col("id")).alias("a.b"),
    )
    df.repartitionByRange(8, "k").write.parquet(path)
    return path


@pytest.fixture(scope="module")
def bounds(spark):
    return [
        invariants.in_range("R1", "v", 0, 50, True), invariants.in_range("R2", "v", -5, 200, True), invariants.in_range("R3", "m", None, 1200, True), invariants.in_range("R4", "f", 0, 1e9, True),
        invariants.future_date("F1", "at", "2020-12-31"), invariants.future_date("F2", "d", "2020-06-01 12:00:00"), invariants.future_date("F3", "at", "2099-01-01"),
    ]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_measures_equal_scans(spark, table, bounds):
    assert rows(footers.measure(spark, table, bounds)) == rows(invariants.measure(spark.read.parquet(table), bounds))
    assert rows(footers.measure(spark, table, bounds[:1])) == rows(invariants.measure(spark.read.parquet(table), bounds[:1]))


def test_only_files_beyond_the_bound_are_read(spark, table, bounds, monkeypatch):
    read = []
    monkeypatch.setattr(invariants, "measure", lambda df, rules, f=invariants.measure: read.append((rules[0].check_id, len(df.inputFiles()))) or f(df, rules))
    footers.measure(spark, table, [bounds[1], bounds[2], bounds[6]]).collect()
    assert read == [("R3", 1)]


def test_dead_columns_without_a_data_page(spark, table, monkeypatch):
    want = rows(drift.dead_columns(spark.read.parquet(table), "t", ["k", "v", "dead", "gone", "empty", "at", "a.b"]))
    assert rows(footers.dead_columns(spark, table, "t")) == want and [r[1] for r in want] == ["dead", "gone"]
    scanned = []
    monkeypatch.setattr(drift, "dead_columns", lambda df, name, f=drift.dead_columns: scanned.extend(df.columns) or f(df, name))
    footers.dead_columns(spark, table, "t").collect()
    assert scanned == ["gone", "empty", "s"]  # lists and structs state no nulls of their own


def test_the_table_itself(spark, table):
    stats = footers.statistics(spark, table)
    k = stats.where("column_name = 'k'").orderBy("low_number").collect()
    assert len(k) == 8 and sum(r.rows for r in k) == 4_000 and {r.nulls for r in k} == {0}
    assert all(a.high_number < b.low_number for a, b in zip(k, k[1:])) and (k[0].low, k[-1].high) == ("0", "3999")
    at = stats.where("column_name = 'at'").agg(F.max("high_number")).first()[0]
    assert dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=at) == dt.datetime(2021, 2, 3)
    assert stats.where("column_name = 'f' AND low_number IS NOT NULL").count() == 0


def test_stores_without_reach_are_scanned(spark, table, bounds, monkeypatch):
    monkeypatch.setattr(footers, "statistics", lambda *a: None)
    assert [r[1] for r in rows(footers.dead_columns(spark, table, "t"))] == ["dead", "gone"]
    assert rows(footers.measure(spark, table, bounds)) == rows(invariants.measure(spark.read.parquet(table), bounds))


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "e")
    spark.createDataFrame([], "a int, b string").write.parquet(path)
    assert footers.dead_columns(spark, path, "e").count() == 0
    assert os.path.isdir(path) and [r[2:4] for r in rows(footers.measure(spark, path, [invariants.in_range("R", "a", 0, 1, True)]))] == [(0, 0)]
