"""Quantiles of groups of any size: mergeable sketches, and exact order statistics by rank refinement.

A sketch (KLL, built in) has a size fixed by ``k`` and merges over partitions,
days and runs. The exact answer needs no sort of a group: a sketch brackets the
wanted rank between two values, a pass counts what lies below, on and between
them, and sketches what lies between; the counts, not the sketch, decide where
the rank is, so a sketch that erred costs a pass and never a wrong result. Each
pass leaves a few thousandths of the rows between; when a few thousand are
left, those are sorted and the value is picked.

Null and NaN are no values; a group without values has no row; groups may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.sources import scratch

#: Sketch sizes: for stored sketches, and for brackets.
K, BRACKET_K = 200, 4096
#: Evenly spaced ranks at which a bracket may end.
GRID = 512
#: Rows of a group up to which its values meet in one task, rows between a bracket that are picked from, and groups up to which their state is broadcast.
WHOLE_GROUP, PICKED, BROADCAST_GROUPS = 1_000_000, 10_000, 50_000


def rank_error(k: int) -> float:
    """Largest error of a rank, as a share of the rows, at 99 % confidence (the sketch's published bound)."""
    return 2.296 / k**0.9021


def _values(df: DataFrame, group: str, value: str) -> DataFrame:
    out = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    return out.where(F.col("v").isNotNull() & ~F.isnan("v"))


def sketches(df: DataFrame, group: str, value: str, k: int = K) -> DataFrame:
    """(group, rows, sketch): one mergeable sketch a group."""
    return _values(df, group, value).groupBy(F.col("g").alias(group)).agg(F.count("*").alias("rows"), F.kll_sketch_agg_double("v", k).alias("sketch"))


def merged(parts: DataFrame, group: str) -> DataFrame:
    """Sketches of several partitions, days or runs as one a group."""
    return parts.groupBy(group).agg(F.sum("rows").alias("rows"), F.kll_merge_agg_double("sketch").alias("sketch"))


def estimates(sketched: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """``sketched`` with an estimate of each named quantile; its rank is within ``rank_error`` of the wanted one."""
    return sketched.withColumns({name: F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))) for name, q in quantiles.items()})


def _bracket(sketch: Column, rank: Column, rows: Column, k: int) -> tuple[Column, Column]:
    """Values whose ranks lie on either side of ``rank``, by one and a half times the sketch's error."""
    room, steps = 1.5 * rank_error(k), F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(x / GRID) for x in range(GRID + 1)]))
    low, high = F.greatest(F.lit(0.0), rank / rows - room), F.least(F.lit(1.0), (rank + 1) / rows + room)
    return F.get(steps, F.floor(low * GRID).cast("int")), F.get(steps, F.ceil(high * GRID).cast("int"))


def _refined(values: DataFrame, quantiles: list[float], k: int, picked: int) -> DataFrame:
    """(g, n, x0, x1, …): the order statistics at the floor and the ceiling of each quantile's place, for all groups of ``values``."""
    ranks = [F.floor(F.lit(q) * (F.col("n") - 1)).cast("bigint") for q in quantiles] + [F.ceil(F.lit(q) * (F.col("n") - 1)).cast("bigint") for q in quantiles]
    targets = range(len(ranks))
    first = values.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("bottom"), F.max("v").alias("top"), F.kll_sketch_agg_double("v", k).alias("s"))
    first = first.withColumns({f"r{j}": r for j, r in enumerate(ranks)})
    brackets = [_bracket(F.col("s"), F.col(f"r{j}"), F.col("n"), k) for j in targets]
    none = F.lit(None).cast("double")
    state = first.select("g", "n", "bottom", "top", *[x for j in targets for x in (F.col(f"r{j}"), brackets[j][0].alias(f"lo{j}"), brackets[j][1].alias(f"hi{j}"), F.lit(None).cast("bigint").alias(f"base{j}"), none.alias(f"x{j}"))])
    state = scratch.written(state, "quantile-state")
    kept = ["g", "n", "bottom", "top", *[f"{c}{j}" for j in targets for c in ("r", "lo", "hi", "base", "x")]]

    def joined(state: DataFrame) -> DataFrame:
        small = F.broadcast(state) if state.count() <= BROADCAST_GROUPS else state
        return values.withColumnRenamed("g", "of").join(small, F.expr("g <=> of")).drop("of")

    def pending(j: int) -> Column:
        return F.col(f"x{j}").isNull() & F.col(f"base{j}").isNull()

    while True:
        # One row a group: counts of what lies below, on and between each bracket.
        open_ = state.where(F.greatest(*[pending(j).cast("int") for j in targets]) == 1) if len(ranks) > 1 else state.where(pending(0))
        if open_.isEmpty():
            break
        v, sums = F.col("v"), []
        for j in targets:
            lo, hi, wanted = F.col(f"lo{j}"), F.col(f"hi{j}"), pending(j)
            between = wanted & (v > lo) & (v < hi)
            sums += [F.count_if(wanted & (v < lo)).alias(f"below{j}"), F.count_if(wanted & (v == lo)).alias(f"at_lo{j}"), F.count_if(between).alias(f"in{j}"), F.count_if(wanted & (v == hi) & (v > lo)).alias(f"at_hi{j}"), F.kll_sketch_agg_double(F.when(between, v), k).alias(f"s{j}")]
        counted = joined(open_).groupBy(*kept).agg(*sums)
        moved = {}
        for j in targets:
            r, below, at_lo, inside, at_hi, lo, hi = (F.col(f"{c}{j}") for c in ("r", "below", "at_lo", "in", "at_hi", "lo", "hi"))
            start = below + at_lo
            found = F.when(r < below, none).when(r < start, lo).when(r < start + inside, none).when(r < start + inside + at_hi, hi)
            within = (r >= start) & (r < start + inside)
            low, high = _bracket(F.col(f"s{j}"), r - start, inside, k)
            ready = within & (inside <= picked)
            moved[f"x{j}"] = F.when(pending(j), found).otherwise(F.col(f"x{j}"))
            moved[f"base{j}"] = F.when(pending(j) & ready, start).otherwise(F.col(f"base{j}"))
            narrow = pending(j) & within & ~ready
            moved[f"lo{j}"] = F.when(narrow, low).when(pending(j) & (r < below), F.col("bottom")).when(pending(j) & (r >= start + inside + at_hi), hi).otherwise(lo)
            moved[f"hi{j}"] = F.when(narrow, high).when(pending(j) & (r < below), lo).when(pending(j) & (r >= start + inside + at_hi), F.col("top")).otherwise(hi)
        after = counted.select("g", "n", "bottom", "top", *[x for j in targets for x in (F.col(f"r{j}"), moved[f"lo{j}"].alias(f"lo{j}"), moved[f"hi{j}"].alias(f"hi{j}"), moved[f"base{j}"].alias(f"base{j}"), moved[f"x{j}"].alias(f"x{j}"))])
        done = state.join(open_.select(F.col("g").alias("of")), F.expr("g <=> of"), "left_anti")
        state, old = scratch.written(done.unionByName(after), "quantile-state"), state
        scratch.drop(old)

    # At most ``picked`` values a group and target are left.
    v = F.col("v")
    lists = [F.array_sort(F.collect_list(F.when(F.col(f"base{j}").isNotNull() & (v > F.col(f"lo{j}")) & (v < F.col(f"hi{j}")), v))).alias(f"l{j}") for j in targets]
    left = joined(state.where(F.coalesce(*[F.col(f"base{j}") for j in targets]).isNotNull())).groupBy(*kept).agg(*lists)
    picks = left.select("g", "n", *[F.coalesce(F.col(f"x{j}"), F.get(F.col(f"l{j}"), (F.col(f"r{j}") - F.col(f"base{j}")).cast("int"))).alias(f"x{j}") for j in targets])
    rest = state.where(F.coalesce(*[F.col(f"base{j}") for j in targets]).isNull()).select("g", "n", *[f"x{j}" for j in targets])
    out = scratch.written(picks.unionByName(rest), "quantiles")
    scratch.drop(state)
    return out


def exact_quantiles(df: DataFrame, group: str, value: str, quantiles: dict[str, float], *, whole_group: int = WHOLE_GROUP, k: int = BRACKET_K, picked: int = PICKED) -> DataFrame:
    """(group, one column a quantile), interpolated between the two nearest values.

    A group of up to ``whole_group`` rows is ordered where it meets; larger
    ones go by rank refinement, whose tasks hold sketches and at most ``picked``
    values. Both give the same numbers.
    """
    values, names, shares = _values(df, group, value), list(quantiles), [float(q) for q in quantiles.values()]
    whole = lambda rows: rows.groupBy("g").agg(*[F.percentile("v", F.lit(q)).alias(n) for n, q in zip(names, shares)])
    large = values.groupBy("g").count().where(F.col("count") > whole_group).select(F.col("g").alias("of"))
    large = scratch.written(large, "large-groups")
    if not (n_large := large.count()):
        scratch.drop(large)
        return whole(values).withColumnRenamed("g", group)
    hint = F.broadcast(large) if n_large <= BROADCAST_GROUPS else large
    found = _refined(values.join(hint, F.expr("g <=> of"), "left_semi"), shares, k, picked)
    cells = []
    for j, (name, q) in enumerate(zip(names, shares)):
        place = F.lit(q) * (F.col("n") - 1)
        low, high = F.col(f"x{j}"), F.col(f"x{j + len(names)}")
        cells.append(F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high).alias(name))
    small = values.join(hint, F.expr("g <=> of"), "left_anti")
    return found.select("g", *cells).unionByName(whole(small)).withColumnRenamed("g", group)


def exact_medians(df: DataFrame, group: str, value: str, name: str = "median", **how) -> DataFrame:
    return exact_quantiles(df, group, value, {name: 0.5}, **how)
