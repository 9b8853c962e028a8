"""Numbers held against evidence by rounding intervals: equal to writing every rounding out."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import expressions as X
from plumbline.operators import evidence


def written_out(df):
    """The plain version: every rounding of every source number as text."""
    known, dates = X.numbers_in(F.col("source")), X.date_parts(F.col("source"))
    either = F.transform(F.array_union(F.array_union(X.variants(known), dates), known), X.bare)
    bad = F.filter(X.numbers_in(F.col("said")), lambda x: ~F.array_contains(either, X.bare(x)))
    return df.withColumn("unsupported", bad)


NUMBERS = ["0", "0.5", "1.5", "2.5", "-0.5", "-2.5", "3", "1.25", "1.35", "0.125", "1,234.5678", "99.995", "1234567.8915", "0.0000005", "0.0000015", "12%", "7.0", "100", "1e3", "-7.45", "123456789012345678901234567890", "0.05", "2020-03-07", "1.00", "007"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    out = []
    for n in range(600):
        source = [rng.choice(NUMBERS) if rng.random() < 0.6 else f"{rng.uniform(-50, 50):.{rng.randrange(8)}f}" for _ in range(rng.choice([0, 1, 3, 8, 40]))]
        said = [f"{float(x.replace(',', '').rstrip('%')):.{rng.randrange(8)}f}" for x in source if x.replace(",", "").replace(".", "").replace("-", "").rstrip("%").isdigit() and "-0" not in x][:12]
        said += [rng.choice(NUMBERS) for _ in range(rng.randrange(6))] + ["0", "1.2", "1.4", "2", "-2", "-0", "0.1", "1.25%", "1.3", "0.12", "0.000002", "0.000001"][: rng.randrange(13)]
        out.append((n, n % 40, f"says {' and '.join(said)}." if n % 50 else None, f"has {'; '.join(source)}" if n % 60 else None))
    return spark.createDataFrame(out, "id int, grp int, said string, source string").repartition(4)


def unsupported(df):
    return {r.id: sorted(r.unsupported) for r in df.select("id", "unsupported").collect()}


def test_intervals_equal_roundings(rows):
    want = unsupported(written_out(rows))
    found = evidence.validate(rows, ["said"], "source")
    assert unsupported(found) == want
    assert found.columns == ["id", "grp", "said", "source", "unsupported", "ok"]
    assert 100 < sum(bool(x) for x in want.values()) < 590


def test_groups_equal_roundings(rows):
    groups = rows.groupBy("grp").agg(F.concat_ws(" ", F.sort_array(F.collect_list("said"))).alias("story"))
    sources = rows.groupBy("grp").agg(F.concat_ws(" ; ", F.collect_list("source")).alias("source"))
    joined = groups.join(sources, "grp").select(F.col("grp").alias("id"), F.col("story").alias("said"), "source")
    want = unsupported(written_out(joined))
    found = {r.grp: sorted(r.unsupported or []) for r in evidence.validate_groups(groups, rows, "grp", "story", "source").collect()}
    assert found == want


@pytest.mark.parametrize(("value", "token", "ok"), [("2.5", "2", True), ("3.5", "4", True), ("2.5", "3", False), ("3.5", "3", False), ("-2.5", "-2", True), ("0.125", "0.12", True), ("0.125", "0.13", False), ("0.135", "0.14", True), ("1.999", "2", True), ("1.999", "2.0", False), ("12.3%", "12%", True), ("12.3", "12%", True)])
def test_half_even_ties(spark, value, token, ok):
    df = spark.createDataFrame([(f"of {token} items", f"it is {value}")], "said string, source string")
    assert evidence.validate(df, ["said"], "source").first().ok is ok


def test_binary_search_of_long_sources(spark):
    """Beyond the arrays that are looked through one by one."""
    df = spark.range(300).select(F.col("id").alias("id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(199)), lambda k: (k * 10 + 0.25).cast("decimal(10,2)").cast("string"))).alias("source"), F.concat(F.lit("x "), F.col("id").cast("string")).alias("said"))
    found = {r.id: r.ok for r in evidence.validate(df, ["said"], "source").collect()}
    assert found == {n: n % 10 == 0 for n in range(300)}
