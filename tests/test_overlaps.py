"""The overlap query counts intervals of every length, and its sweep's tasks follow the rows."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.operators import ranges, rules
from plumbline.plans import queries

ORDERS = {1: "2020-01-01", 2: "2020-02-15", 3: "2020-05-01", 4: "2020-09-01", 5: "2015-01-01", 6: "2020-06-02"}
LINES = [(7, 1, "2020-01-20"), (7, 1, "2020-06-01"), (7, 2, "2020-03-01"), (7, 3, "2020-12-31"), (7, 4, "2020-08-01"), (8, 5, "2021-01-01"), (8, 4, "2020-09-03"), (8, 1, "2020-01-31"), (9, 6, "2020-06-09"), (9, 1, "2020-06-01")]


def test_intervals_longer_than_a_month_count(spark, tmp_path):
    day = dt.datetime.fromisoformat
    spark.createDataFrame([(k, day(d)) for k, d in ORDERS.items()], "o_orderkey long, o_orderdate timestamp").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(s, k, day(d)) for s, k, d in LINES], "l_suppkey long, l_orderkey long, l_shipdate timestamp").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    # 7: 1 meets 2 and 3, 2 ends before 3, 4 is inverted; 8: 5 spans 1 and 4; 9: one ends the day before the other.
    assert tuple(queries.interval_overlap(spark, str(tmp_path)).first()) == (4, 2)
    c = duckdb.connect()
    for name in ("orders", "lineitem"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert c.sql(queries.ORACLES["interval_overlap"]).fetchall() == [(4, 2)]


@pytest.mark.parametrize("hot", [False, True])
def test_the_sweep_fills_many_tasks(spark, monkeypatch, hot):
    monkeypatch.setattr(ranges, "TASK_ROWS", 300)
    rows = spark.range(3_000).select((F.col("id") % (1 if hot else 500)).alias("r"), F.col("id").alias("e"), F.expr("date_add(date'2020-01-01', CAST(id * 7 % 900 AS INT))").alias("s"))
    df = rows.withColumn("t", F.expr("date_add(s, CAST(e % 400 AS INT))"))
    found = rules.overlap_counts(df, "r", "e", "s", "t")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # 3,000 intervals, 6,000 starts and ends, 300 a task: by resource and day, and then by resource.
    assert [x.endswith(", 20") for x in plan.splitlines() if "RepartitionByExpression [resource" in x] == [True, True]
    want = {r.resource: r["count"] for r in rules.interval_overlaps(df, "r", "e", "s", "t").groupBy("resource").count().collect()}
    assert {r.resource: r.pairs for r in found.collect()} == want
