"""Exact quantiles by rank refinement against the built-in percentile, and the sketches' stated error."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import extended, quantiles

WANTED = {"low": 0.0, "q1": 0.25, "median": 0.5, "high": 0.995}


@pytest.fixture(scope="module")
def skewed(spark):
    """A group with most of the rows, two values only, values far apart, null groups and values, NaN, infinities of range."""
    rng = random.Random(2)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(30_000)] + [("two", float(rng.randrange(2))) for _ in range(6_000)] + [("far", 2.0 ** -rng.randrange(1000)) for _ in range(3_000)]
    rows += [(None, rng.random()) for _ in range(2_000)] + [("one", 1.0), ("one", float("nan")), ("none", None), ("pair", 3.0), ("pair", 5.0)] + [("wide", 1e308 if n % 2 else -1e308) for n in range(2_000)]
    return spark.createDataFrame(rows, "g0 string, val double").repartition(6)


def plain(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("how", [{}, {"whole_group": 1_000, "k": 512, "picked": 2_000}, {"whole_group": 2_500, "k": 256, "picked": 300}])
def test_exact_quantiles_equal_percentile(skewed, how):
    good = skewed.where("val IS NOT NULL AND NOT isnan(val)")
    want = plain(good.groupBy("g0").agg(*[F.percentile("val", F.lit(q)) for q in WANTED.values()]))
    assert plain(quantiles.exact_quantiles(skewed, "g0", "val", WANTED, **how)) == want


def test_no_task_holds_a_group(skewed, monkeypatch):
    """The plan that picks sees only what lies in the brackets, far fewer than the hot group's rows."""
    seen = []
    written = quantiles.scratch.written
    monkeypatch.setattr(quantiles.scratch, "written", lambda df, name: seen.append((name, out := written(df, name))) or out)
    monkeypatch.setattr(quantiles.scratch, "drop", lambda df: None)
    quantiles.exact_quantiles(skewed, "g0", "val", {"m": 0.5}, whole_group=1_000, k=512, picked=2_000).count()
    last = [df for name, df in seen if name == "quantile-state"][-1].where("g = 'hot'").first()
    inside = skewed.where((F.col("g0") == "hot") & (F.col("val") > last.lo0) & (F.col("val") < last.hi0)).count()
    assert last.base0 is not None and inside <= 2_000


def test_empty_table(spark):
    none = spark.createDataFrame([], "g0 string, val double")
    assert quantiles.exact_quantiles(none, "g0", "val", WANTED).count() == 0
    assert quantiles.exact_quantiles(none, "g0", "val", WANTED, whole_group=0).count() == 0
    assert extended.iqr_bounds(none, "g0", "val").columns == ["g0", "q1", "q3", "low", "high"]


def test_sketches_merge_within_their_error(skewed):
    hot = skewed.where("g0 = 'hot'").withColumn("day", F.floor(F.rand(1) * 10))
    daily = quantiles.sketches(hot.withColumn("k", F.struct("g0", "day")), "k", "val").withColumn("g0", F.col("k.g0"))
    found = quantiles.estimates(quantiles.merged(daily, "g0"), WANTED).first()
    assert daily.count() == 10 and found.rows == 30_000
    values = sorted(r.val for r in hot.select("val").collect())
    for name, q in WANTED.items():
        rank = sum(v <= found[name] for v in values) / len(values)
        assert abs(rank - q) <= 2 * quantiles.rank_error(quantiles.K)
    assert quantiles.rank_error(200) == pytest.approx(0.0193, abs=5e-4)


def test_mad_of_a_hot_group(skewed):
    good = skewed.where("g0 = 'hot'")
    m = good.agg(F.median("val")).first()[0]
    d = good.agg(F.median(F.abs(F.col("val") - m))).first()[0]
    r = extended.mad(good, "g0", "val").first()
    assert (r["median"], r["mad"]) == (m, d)
