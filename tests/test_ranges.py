"""Work on keys of any size: reversals, running sums and overlaps of a hot key against plain versions."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators import extended, ranges, rules

DAY = "date_add(date'2020-01-01', {})"


@pytest.fixture(scope="module")
def meter(spark):
    """Half of all rows under one key; nulls, ties and keys of one row."""
    rng = random.Random(4)
    rows = [(7, n // 2, rng.choice([None, n % 50, n])) for n in range(8_000)] + [(rng.randrange(100, 900), rng.choice([None, *range(40)]), rng.randrange(60)) for _ in range(8_000)] + [(None, n, 5 - n) for n in range(6)]
    return spark.createDataFrame(rows, "key int, at int, total int").withColumns({"carry": F.lit(1), "extra": F.lit("x")}).repartition(5)


def rows_of(df):
    return sorted(map(tuple, df.select("key", "at", "total", "previous").collect()), key=str)


@pytest.mark.parametrize("hot_rows", [10**6, 1_000, 5])
def test_reversals_of_a_hot_key(meter, hot_rows):
    slim = meter.drop("carry")
    window = Window.partitionBy("key").orderBy("at", "total")
    want = rows_of(slim.withColumn("previous", F.lag("total").over(window)).where("total < previous"))
    found = extended.reversals(slim, "key", ["at"], "total", hot_rows)
    assert rows_of(found) == want and len(want) > 3_000
    assert found.columns == ["key", "at", "total", "extra", "previous"]


def test_a_hot_key_fills_many_tasks(meter):
    parts = ranges.ranged(meter, "key", "at").where("key = 7").groupBy(ranges.PART).count().collect()
    assert len(parts) >= 3 and max(r["count"] for r in parts) < 4_500


def test_running_sums(meter):
    each = meter.where("key IS NOT NULL AND at IS NOT NULL").groupBy("key", "at").agg(F.sum("total").alias("total"))
    window = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    want = sorted(map(tuple, each.withColumn("x", F.coalesce(F.sum("total").over(window), F.lit(0))).select("key", "at", "x").collect()))
    assert sorted(map(tuple, ranges.running_before(each, "key", "at", "total", "x").select("key", "at", "x").collect())) == want


def intervals(spark, seed, several):
    rng = random.Random(seed)
    rows = []
    for n in range(900):
        s = rng.randrange(700)
        entity = rng.randrange(250) if several and n % 3 == 0 else 1_000 + n
        rows.append((rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([entity, entity, entity, None]), s, s + rng.choice([-2, 0, 1, 5, 30, 100])))
    rows += [("lone", 1, 0, 5), ("apart", 1, 0, 5), ("apart", 2, 6, 9), ("touch", 1, 0, 5), ("touch", 2, 5, 9), ("self", 1, 0, 5), ("self", 1, 3, 9)]
    df = spark.createDataFrame(rows, "r string, e int, s int, t int")
    return df.select("r", "e", F.expr(DAY.format("s")).alias("s"), F.expr(DAY.format("t")).alias("t")).repartition(4)


@pytest.mark.parametrize("several", [False, True])
def test_overlaps_counted_as_listed(spark, several):
    df = intervals(spark, 6, several)
    want = {r.resource: r["count"] for r in rules.interval_overlaps(df, "r", "e", "s", "t").distinct().groupBy("resource").count().collect()}
    assert {r.resource: r.pairs for r in rules.overlap_counts(df, "r", "e", "s", "t").collect()} == want
    assert want["touch"] == 1 and "apart" not in want and "self" not in want
    assert tuple(rules.overlap_totals(rules.overlap_counts(df, "r", "e", "s", "t")).first()) == tuple(rules.overlap_summary(rules.interval_overlaps(df, "r", "e", "s", "t")).first())
    assert tuple(rules.overlap_totals(rules.overlap_counts(df.where("false"), "r", "e", "s", "t")).first()) == (0, 0)


@pytest.mark.parametrize("several", [False, True])
def test_overlaps_by_the_second(spark, several):
    df = intervals(spark, 9, several).selectExpr("r", "e", "CAST(s AS TIMESTAMP) + make_dt_interval(0, e % 24, e % 60, 7) AS s", "CAST(t AS TIMESTAMP) + make_dt_interval(0, e % 13) AS t")
    rows = [r for r in df.collect() if r.r is not None and r.e is not None and r.s <= r.t]
    pairs = {(a.r, a.e, b.e) for a in rows for b in rows if a.r == b.r and a.e < b.e and a.s <= b.t and b.s <= a.t}
    want = {r: sum(p[0] == r for p in pairs) for r in {p[0] for p in pairs}}
    assert {r.resource: r.pairs for r in rules.overlap_counts(df, "r", "e", "s", "t", unit="timestamp").collect()} == want


def test_a_resource_with_a_million_intervals(spark):
    """Half a million million pairs, none of them listed: all meet but those a year apart."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("r").alias("r"), F.col("id").alias("e"), F.expr("date_add(date'2020-01-01', cast(id % 1000 as int))").alias("s"))
    df = df.withColumn("t", F.date_add("s", 364))
    per_day = n // 1000
    apart = sum(per_day * per_day * max(0, d - 364) for d in range(1000))
    assert rules.overlap_counts(df, "r", "e", "s", "t").first().pairs == n * (n - 1) // 2 - apart
