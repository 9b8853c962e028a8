"""Text held against evidence: numbers a statement uses must come from its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.expressions import ISO_DATE, MOST_PLACES, NUMBER_IN_TEXT, any_between, bare, date_parts, fingerprint, is_rounding, number_of, numbers_in, places, plain_text, rounding_interval
from plumbline.operators import ranges

# Phrases that claim an early finish is a fault.
EARLY_PHRASES = ("earlier than", "ahead of schedule", "acceleration", "accelerat", "sooner than", "before its expected", "before the expected", "before its target", "before the target")


def validate(df: DataFrame, statements: list[str], source: str) -> DataFrame:
    """``df`` with unsupported (number tokens of the statements that the source does not hold, round or name as part of a date) and ok.

    A token with d places is a rounding of every source value in its rounding
    interval (half-even), so the source's sorted values are searched and no
    rounding is ever written out. Each step is a projection of its own and is
    read more than once by the next, so that Spark works it out once a row and
    not once a token.
    """
    out = df.withColumns({"__used": numbers_in(F.concat_ws(" ", *statements)), "__known": numbers_in(F.col(source)), "__dates": date_parts(F.col(source))})
    # Most tokens are in the source as they stand; only the others are looked at as numbers.
    out = out.withColumn("__odd", F.array_except("__used", F.array_union("__known", "__dates")))
    some = F.size("__odd") > 0
    texts = F.transform(F.array_union("__known", "__dates"), bare)
    values = F.array_sort(F.filter(F.transform("__known", number_of), lambda x: x.isNotNull()))

    def token(x: Column) -> Column:
        low, high, closed = rounding_interval(x)
        return F.struct(x.alias("text"), bare(x).alias("bare"), is_rounding(x).alias("rounding"), low.alias("low"), high.alias("high"), closed.alias("closed"))

    empty = lambda kind: F.array().cast(f"array<{kind}>")
    out = out.withColumns({"__bare": F.when(some, texts).otherwise(empty("string")), "__values": F.when(some, values).otherwise(empty("decimal(32,10)")), "__tokens": F.transform("__odd", token)})

    def supported(t: Column) -> Column:
        return F.array_contains("__bare", t["bare"]) | (t["rounding"] & F.coalesce(any_between(F.col("__values"), t["low"], t["high"], t["closed"]), F.lit(False)))

    # Named again in the last step, so that the arrays are made once a row.
    bad = F.when(F.size("__bare") + F.size("__tokens") == 0, empty("string")).otherwise(F.transform(F.filter("__tokens", lambda t: ~supported(t)), lambda t: t["text"]))
    return out.withColumn("unsupported", bad).withColumn("ok", F.size("unsupported") == 0).drop("__used", "__known", "__dates", "__odd", "__bare", "__values", "__tokens")


#: What ``validate_groups`` knows of a text in a group: a statement has it plain, with a percent sign, or a source supports it.
PLAIN, PERCENT, SUPPORTED = 1, 2, 4
#: Texts that a member is taken to bring with its source and its group's statement; it only sets the number of tasks.
TEXTS = 12


def _used(df: DataFrame, group: str, text: str) -> DataFrame:
    """(group, text, seen) of each number token as it stands, not yet distinct."""
    tokens = df.select(group, F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER_IN_TEXT), F.lit(0))).alias("x"))
    tokens = tokens.select(group, F.replace("x", F.lit(","), F.lit("")).alias("x"))
    return tokens.select(group, bare(F.col("x")).alias("text"), F.when(F.col("x").endswith("%"), PERCENT).otherwise(PLAIN).alias("seen"))


def _supported(df: DataFrame, group: str, source: str) -> DataFrame:
    """(group, text, seen) of each text that a source supports: its numbers, their roundings, and parts of its dates; not yet distinct.

    All roundings to fewer places than a number has are written out; to more places it is itself.
    Tokens are exploded before they are worked on, as lambdas over arrays are slow.
    """
    found = lambda pattern: F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit(pattern), F.lit(0))
    tokens = df.select(group, F.col(source).alias(source)).select(group, F.explode(F.concat(found(NUMBER_IN_TEXT), found(ISO_DATE))).alias("x"))
    x = F.col("x")
    is_date = F.instr(F.substring(x, 2, 1 << 30), "-") > 0  # a number has a sign in front only
    tokens = tokens.select(group, "x", is_date.alias("dated"), F.when(~is_date, bare(F.replace(x, F.lit(","), F.lit("")))).alias("bare"))
    tokens = tokens.select("*", number_of(F.col("bare")).alias("v"), F.when(~F.col("dated"), places(F.col("bare"))).alias("d"))
    parts = [F.substring(x, at, n) for at, n in ((1, 4), (6, 2), (9, 2))]
    other = lambda text, than: F.when(text != than, text)
    dates = F.array(*parts, *[other(p.cast("int").cast("string"), p) for p in parts])
    numbers = F.array("bare", *[F.when(F.col("d") >= k, other(plain_text(F.bround("v", k)), F.col("bare"))) for k in range(MOST_PLACES + 1)])
    texts = tokens.select(group, F.explode(F.when(F.col("dated"), dates).otherwise(numbers)).alias("text"))
    return texts.where("text IS NOT NULL").select(group, "text", F.lit(SUPPORTED).alias("seen"))


def validate_groups(groups: DataFrame, members: DataFrame, group: str, statement: str, source: str) -> DataFrame:
    """Each group's statement against the numbers of all its members' sources.

    A rounding is written in one way only, so tokens and all that the sources
    support meet by their text in one aggregation. It is spread by group and
    text: a group of any size fills many tasks.
    """
    both = _used(groups, group, statement).union(_supported(members, group, source))
    # Few texts occur twice in a task, so they are dealt out before any is grouped.
    met = ranges.spread(both, group, "text", source=members, each=TEXTS).groupBy(group, "text").agg(F.bit_or("seen").alias("seen"))
    seen = lambda what: F.col("seen").bitwiseAND(what) > 0
    tokens = F.array(F.when(seen(PLAIN), F.col("text")), F.when(seen(PERCENT), F.concat("text", F.lit("%"))))
    missing = met.where(~seen(SUPPORTED)).select(F.col(group).alias("__group"), F.explode(tokens).alias("token")).where("token IS NOT NULL")
    found = missing.groupBy("__group").agg(F.array_sort(F.collect_set("token")).alias("unsupported"))
    out = groups.join(found, groups[group].eqNullSafe(F.col("__group")), "left").drop("__group")
    return out.select(group, *[c for c in out.columns if c != group]).withColumn("ok", F.col("unsupported").isNull())


def narration_key(fields: list[str], model: str, prompt: str) -> Column:
    """Fingerprint of the fields a narration depends on, with model and prompt."""
    return fingerprint(*[F.col(c) for c in fields], F.lit(model), F.sha2(F.lit(prompt), 256))


def reuse(now: DataFrame, earlier: DataFrame, key: str, text: str, newest: str) -> DataFrame:
    """``now`` with reused_text: the newest earlier text of the same key; a null text is never a hit."""
    last = Window.partitionBy(key).orderBy(F.desc(newest), F.desc(text))
    best = earlier.where(F.col(text).isNotNull()).withColumn("__rn", F.row_number().over(last)).where("__rn = 1").select(key, F.col(text).alias("reused_text"))
    return now.join(best, key, "left").withColumn("reused", F.col("reused_text").isNotNull())


def screen(df: DataFrame, columns: list[str], phrases: tuple[str, ...] = EARLY_PHRASES) -> DataFrame:
    """``df`` with missing (a required field is empty), first_hit (the first phrase found) and rejected."""
    text = F.lower(F.concat_ws(" ", *columns))
    empty = F.lit(False)
    for c in columns:
        empty = empty | (F.coalesce(F.trim(c), F.lit("")) == "")
    hits = F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(text, p))
    first = F.when(F.size(hits) > 0, F.element_at(hits, 1))
    return df.withColumns({"missing": empty, "first_hit": first}).withColumn("rejected", F.col("missing") | F.col("first_hit").isNotNull())
