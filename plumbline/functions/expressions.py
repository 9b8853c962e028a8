"""Column expressions shared by the operators. Each is one expression, so a rewrite and its measurement cannot differ."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: text that stands for a number (an optional sign, digits, a fraction, an exponent).
NUMERIC = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
# Fixed value: a number as prose writes it.
NUMBER_IN_TEXT = r"-?\d[\d,]*(?:\.\d+)?%?"
ISO_DATE = r"(\d{4})-(\d{2})-(\d{2})"


def count_if(condition: Column) -> Column:
    """Rows where the condition holds, 0 over no rows."""
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("bigint")


def order(names: Iterable[str]) -> list[Column]:
    """``a`` ascending, ``a desc`` descending; null is least either way."""
    return [F.col(n[:-5]).desc_nulls_last() if n.lower().endswith(" desc") else F.col(n).asc_nulls_first() for n in names]


def number(text: Column) -> Column:
    """Text as a double; null if it is not a plain number (units, thousands commas, NaN and the like are none)."""
    plain = text.cast("string")
    return F.when(plain.rlike(NUMERIC), F.trim(plain)).try_cast("double")


def is_blank(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) == "", F.lit(False))


def is_sentinel(c: Column, values: Iterable[str]) -> Column:
    return F.coalesce(F.upper(F.trim(c.cast("string"))).isin([v.strip().upper() for v in values]), F.lit(False))


def is_placeholder(c: Column, dates: Iterable[str]) -> Column:
    return F.coalesce(c.cast("date").isin([F.lit(d).cast("date") for d in dates]), F.lit(False))


def null_if(c: Column, condition: Column) -> Column:
    return F.when(condition, F.lit(None)).otherwise(c)


def payload(columns: Iterable[str], width: int | None = None) -> Column:
    """One text for the columns' values, null distinct from every value; ``width`` compares leading characters only."""
    parts = [F.col(c).cast("string") for c in columns]
    parts = [F.substring(p, 1, width) if width else p for p in parts]
    return F.to_json(F.struct(*[p.alias(f"v{k}") for k, p in enumerate(parts)]), {"ignoreNullFields": "false"})


def pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, 2))


def normal_key(c: Column) -> Column:
    """Grouping key: line breaks and runs of white space become one space, trimmed, lower-case."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


# Character references and broken encodings with what they stand for.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
MOJIBAKE = (("â€™", "’"), ("â€“", "–"), ("â€œ", "“"), ("Ã©", "é"), ("Ã¨", "è"), ("Â ", " "))


def has_entity(c: Column) -> Column:
    return F.coalesce(c.rlike("&(amp|lt|gt|quot|#39);"), F.lit(False))


def decode_entities(c: Column) -> Column:
    for name, plain in ENTITIES:  # &amp; last, so that its result is not decoded again
        c = F.replace(c, F.lit(name), F.lit(plain))
    return c


def repair_mojibake(c: Column) -> Column:
    for broken, right in MOJIBAKE:
        c = F.replace(c, F.lit(broken), F.lit(right))
    return c


def key_prefix(c: Column, mark: str = "-") -> Column:
    """Text before the first mark; null where there is none."""
    return F.when(F.instr(c, mark) > 0, F.substring_index(c, mark, 1))


def numbers_in(text: Column) -> Column:
    """Distinct number tokens of a text, thousands commas removed."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER_IN_TEXT), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(""))))


def plain_text(value: Column) -> Column:
    """A decimal as text; zeros are cut after a decimal point only."""
    text = value.cast("decimal(38,6)").cast("string")  # always with a point
    return F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))


def variants(numbers: Column) -> Column:
    """Each number token with its roundings to 0 .. 6 places."""
    plain = F.filter(F.transform(numbers, number_of), lambda x: x.isNotNull())
    rounded = F.transform(plain, lambda x: F.array(*[plain_text(F.bround(x, d)) for d in range(MOST_PLACES + 1)]))
    return F.array_distinct(F.concat(numbers, F.flatten(rounded)))


#: Places after the decimal point up to which a rounding is recognised.
MOST_PLACES = 6


def bare(token: Column) -> Column:
    return F.rtrim(token, F.lit("%"))


def number_of(token: Column) -> Column:
    """A number token's value; null beyond 22 digits before the point."""
    return bare(token).try_cast("decimal(32,10)")


def places(token: Column) -> Column:
    """Digits after the decimal point of a number token."""
    point = F.instr(bare(token), ".")
    return F.when(point > 0, F.length(bare(token)) - point).otherwise(0)


def is_rounding(token: Column) -> Column:
    """Whether a token is written as a rounding is: at most six places, no zeros that say nothing."""
    plain, d = bare(token), places(token)
    text = plain.try_cast(f"decimal(38,{MOST_PLACES})").cast("string")  # always with six places
    kept = F.substring(text, F.lit(1), F.length(text) - F.when(d == 0, MOST_PLACES + 1).otherwise(MOST_PLACES - d))
    return F.coalesce((d <= MOST_PLACES) & (kept == plain) & ((d == 0) | (F.right(plain, F.lit(1)) != "0")), F.lit(False))


def rounding_interval(token: Column) -> tuple[Column, Column, Column]:
    """(low, high, closed): the values that round half-even to the token at its own places; the ends belong to it if its last digit is even."""
    half = reduce(lambda out, d: F.when(places(token) == d, F.lit(f"0.{'0' * d}5").cast("decimal(32,10)")).otherwise(out), range(MOST_PLACES + 1), F.lit(None).cast("decimal(32,10)"))
    value = number_of(token)
    return (value - half).cast("decimal(32,10)"), (value + half).cast("decimal(32,10)"), F.right(bare(token), F.lit(1)).isin("0", "2", "4", "6", "8")


#: Values up to which a sorted array is looked through one by one.
FEW = 16


def any_between(values: Column, low: Column, high: Column, closed: Column) -> Column:
    """Whether a sorted array has a value from ``low`` to ``high`` (ends only if ``closed``): one by one in a short array, else by binary search."""
    inside = lambda x: F.when(closed, (x >= low) & (x <= high)).otherwise((x > low) & (x < high))
    # The number of values below the interval is narrowed to [a, b] with b - a halved each step.
    start = F.struct(F.lit(0).alias("a"), F.size(values).alias("b"))

    def step(span: Column, _: Column) -> Column:
        a, b = span["a"], span["b"]
        middle = F.floor((a + b) / 2).cast("int")
        x = F.get(values, middle)
        below = F.when(closed, x < low).otherwise(x <= low)
        return F.when(a >= b, span).when(below, F.struct((middle + 1).alias("a"), b.alias("b"))).otherwise(F.struct(a.alias("a"), middle.alias("b")))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(values) + 1)).cast("int") + 1)
    found = F.get(values, F.reduce(steps, start, step)["a"])
    return F.when(F.size(values) <= FEW, F.exists(values, inside)).otherwise(F.coalesce(inside(found), F.lit(False)))


def date_parts(text: Column) -> Column:
    """Year, month and day of each ISO date in a text, with and without leading zeros."""
    dates = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ISO_DATE), F.lit(0))
    parts = F.flatten(F.transform(dates, lambda d: F.array(F.substring(d, 1, 4), F.substring(d, 6, 2), F.substring(d, 9, 2))))
    return F.array_distinct(F.concat(parts, F.transform(parts, lambda x: x.cast("int").cast("string"))))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the values with NUL between them, null as empty."""
    return F.sha2(F.concat_ws("\u0000", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)
