"""Invariants of one table, fused: however many rules there are, the table is scanned once."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.expressions import count_if, number
from plumbline.plans.model import ColumnRule, DateOrderRule

MEASURE = "check_id string, kind string, rows_scanned bigint, violations bigint, non_numeric bigint, lowest string, highest string"


@dataclass(frozen=True)
class Invariant:
    """One rule as the condition that rows are in scope and the condition that they break it.

    A rule on one stored column states it with its bounds as numbers
    (microseconds for dates), for measuring by statistics.
    """

    check_id: str
    kind: str
    scope: Column
    broken: Column
    non_numeric: Column | None = None
    lowest: Column | None = None
    highest: Column | None = None
    column: str | None = None
    low: float | None = None
    high: float | None = None


def date_order(rule: DateOrderRule) -> Invariant:
    """``before`` must not be later than ``after``; lowest and highest are days by which it is later (highest: the worst inversion)."""
    b, a = F.col(rule.before).cast("date"), F.col(rule.after).cast("date")
    days = F.date_diff(b, a)
    return Invariant(rule.check_id, "date_order", b.isNotNull() & a.isNotNull(), b > a, lowest=days, highest=days)


def future_date(check_id: str, column: str, as_of: str) -> Invariant:
    """A date later than midnight of the as-of day."""
    c = F.col(column)
    return Invariant(check_id, "future_date", c.isNotNull(), c > F.lit(as_of).cast("timestamp_ntz"), highest=c.cast("date"), column=column, high=(dt.datetime.fromisoformat(as_of) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))


def in_range(check_id: str, column: str, low: float | None, high: float | None, numeric: bool) -> Invariant:
    """Bounds inclusive; text is parsed, and text that is no number counts apart and as broken."""
    c = F.col(column)
    v = c.cast("double") if numeric else number(c)
    bad = F.lit(False)
    if low is not None:
        bad = bad | (v < low)
    if high is not None:
        bad = bad | (v > high)
    text = F.lit(False) if numeric else c.isNotNull() & v.isNull()
    kind = "range" if high is not None else "minimum"
    stored = {"column": column, "low": low, "high": high} if numeric else {}
    return Invariant(check_id, kind, c.isNotNull(), F.coalesce(bad, F.lit(False)) | text, text, v, v, **stored)


def generate(df: DataFrame, columns: list[ColumnRule], orders: list[DateOrderRule], as_of: str, prefix: str = "") -> list[Invariant]:
    """Rules times live columns: all-null and missing columns are left out, and a repeated id is refused."""
    types = {f.name: f.dataType for f in df.schema}
    dates = (T.DateType, T.TimestampType, T.TimestampNTZType)
    numbers = (T.NumericType,)
    out = [date_order(r) for r in orders if isinstance(types.get(r.before), dates) and isinstance(types.get(r.after), dates)]
    for rule in columns:
        kind = types.get(rule.name)
        if kind is None or rule.all_null:
            continue
        if rule.role == "actual" and isinstance(kind, dates):
            out.append(future_date(f"{prefix}FUT-{rule.name}", rule.name, as_of))
        if rule.low is not None or rule.high is not None:
            out.append(in_range(f"{prefix}{'RNG' if rule.high is not None else 'MIN'}-{rule.name}", rule.name, rule.low, rule.high, isinstance(kind, numbers)))
    if len({i.check_id for i in out}) < len(out):
        raise ValueError("a check id is used twice")
    return out


def measure(df: DataFrame, invariants: list[Invariant]) -> DataFrame:
    """One row for each invariant, from a single aggregation of the table."""
    sums, cells = [], []
    for k, i in enumerate(invariants):
        low = F.min(F.when(i.scope, i.lowest)) if i.lowest is not None else F.lit(None)
        high = F.max(F.when(i.scope, i.highest)) if i.highest is not None else F.lit(None)
        none = i.non_numeric if i.non_numeric is not None else F.lit(False)
        sums += [count_if(i.scope).alias(f"n{k}"), count_if(i.scope & i.broken).alias(f"v{k}"), count_if(i.scope & none).alias(f"t{k}"), low.cast("string").alias(f"lo{k}"), high.cast("string").alias(f"hi{k}")]
        cells.append(F.struct(F.lit(i.check_id).alias("check_id"), F.lit(i.kind).alias("kind"), F.col(f"n{k}").alias("rows_scanned"), F.col(f"v{k}").alias("violations"), F.col(f"t{k}").alias("non_numeric"), F.col(f"lo{k}").alias("lowest"), F.col(f"hi{k}").alias("highest")))
    return df.agg(*sums).select(F.inline(F.array(*cells)))


def broken_rows(df: DataFrame, invariant: Invariant) -> DataFrame:
    return df.where(invariant.scope & invariant.broken)
