"""Rewrites that measure themselves.

Order inside a table: snapshot pin, phantom exclusion, de-duplication on raw
values, then value clean-ups (blank, sentinel, placeholder). The predicate that
rewrites is the one that is counted.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.expressions import count_if, is_blank, is_placeholder, is_sentinel, null_if, order, payload, pct
from plumbline.operators import ranges
from plumbline.operators.grain import at_grain, latest
from plumbline.plans.model import ACTION, CleanupRule, DedupRule, Grain, PhantomKeyRule, SnapshotRule, TableRules

# Clean-up kinds in the order they apply, with the check that reports them.
CLEANUPS = {"blank": "BLK-001", "sentinel": "SNT-001", "placeholder": "PLC-001"}


def pin_snapshot(df: DataFrame, rule: SnapshotRule, source: DataFrame | None = None) -> DataFrame:
    """Rows whose timestamp is the greatest of their partition; a null partition key or timestamp falls out.

    ``source`` is the same table, where the greatest timestamps are read if ``df`` observes its rows.
    """
    source = df if source is None else source
    if not rule.partition_by:
        top = source.agg(F.max(rule.timestamp).alias("__pin"))  # one row
        return df.join(F.broadcast(top), F.col(rule.timestamp) == F.col("__pin")).drop("__pin")
    keys = list(rule.partition_by)
    top = source.groupBy(*keys).agg(F.max(rule.timestamp).alias("__pin"))
    return df.join(top, keys).where(F.col(rule.timestamp) == F.col("__pin")).select(*df.columns)


def pin_report(df: DataFrame, rule: SnapshotRule) -> DataFrame:
    """Per partition: pinned_at, rows, kept rows, snapshots, rows set aside."""
    keys, ts = list(rule.partition_by), rule.timestamp
    # Rows per snapshot first: the distinct count is then a plain count.
    each = df.groupBy(*keys, ts).agg(F.count("*").alias("n"))
    out = each.groupBy(*keys).agg(
        F.max(ts).alias("pinned_at"), F.sum("n").alias("rows_total"), F.max_by("n", ts).alias("rows_kept"), F.count(ts).alias("snapshots")
    )
    return out.withColumn("rows_set_aside", F.col("rows_total") - F.col("rows_kept"))


def dedup(df: DataFrame, rule: DedupRule, source: DataFrame | None = None) -> DataFrame:
    """``keep_latest``: one row a key; ``collapse_identical``: agreeing groups become one row; ``exact_only``: unchanged.

    ``source`` is the table ``df`` comes from, where rows are counted if ``df`` observes them.
    """
    if rule.mode == "keep_latest":
        return latest(df, list(rule.keys), list(rule.order_by))
    if rule.mode == "exact_only":
        return df
    # One order for all three, so that a group is sorted once.
    group = Window.partitionBy(*rule.keys).orderBy(*(order(rule.order_by) or [F.col("__p")]))
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    text = payload(rule.compare or [c for c in df.columns if c not in rule.keys])
    marked = ranges.spread(df, *rule.keys, source=source).withColumn("__p", text)
    marked = marked.withColumns({"__lo": F.min("__p").over(whole), "__hi": F.max("__p").over(whole), "__rn": F.row_number().over(group)})
    return marked.where("__lo <> __hi OR __rn = 1").select(*df.columns)


def _groups(df: DataFrame, rule: DedupRule) -> DataFrame:
    """Keys with their rows and whether these disagree: in some column the least and the greatest value differ, or only some are null."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    names = list(rule.compare) or [c for c in df.columns if c not in rule.keys]
    comparable = lambda c: F.col(c) if kinds.get(c) not in ("map", "variant", "array", "struct") else payload([c])
    keyed = df.select(*rule.keys, *[comparable(c).alias(f"__v{k}") for k, c in enumerate(names)])
    differ = F.lit(False)
    for k in range(len(names)):
        v = F.col(f"__v{k}")
        differ = differ | F.coalesce(F.min(v) != F.max(v), F.lit(False)) | F.count(v).between(1, F.count("*") - 1)
    return keyed.groupBy(*rule.keys).agg(F.count("*").alias("n"), differ.alias("disagree"))


def measure_duplicates(df: DataFrame, rule: DedupRule) -> DataFrame:
    """One row: dup_groups, rows_in_dup_groups, excess_rows, worst_group, groups_disagreeing, groups_identical."""
    many = F.col("n") > 1
    zero = F.lit(0).cast("bigint")
    return _groups(df, rule).agg(
        count_if(many).alias("dup_groups"),
        F.coalesce(F.sum(F.when(many, F.col("n"))), zero).alias("rows_in_dup_groups"),
        F.coalesce(F.sum(F.when(many, F.col("n") - 1)), zero).alias("excess_rows"),
        F.coalesce(F.max(F.when(many, F.col("n"))), zero).alias("worst_group"),
        count_if(many & F.col("disagree")).alias("groups_disagreeing"),
        count_if(many & ~F.col("disagree")).alias("groups_identical"),
    )


def conflicting_groups(df: DataFrame, rule: DedupRule) -> DataFrame:
    """Keys whose rows disagree, with the number of rows."""
    return _groups(df, rule).where("n > 1 AND disagree").drop("disagree")


def conflicting_rows(df: DataFrame, rule: DedupRule) -> DataFrame:
    return df.join(conflicting_groups(df, rule).select(*rule.keys), list(rule.keys), "left_semi")


def payload_columns(df: DataFrame, rule: DedupRule, authoritative: list[str], limit: int | None = None) -> list[str]:
    """The columns that must agree: those declared, else authoritative columns of plain types outside the key, all of them unless there is a limit."""
    if rule.compare:
        return list(rule.compare)
    plain = {f.name for f in df.schema if f.dataType.typeName() not in ("binary", "map", "array", "struct")}
    return [c for c in authoritative if c in plain and c not in rule.keys][:limit]


def is_phantom(rule: PhantomKeyRule) -> Column:
    return F.coalesce(F.col(rule.column).isin(list(rule.values)), F.lit(False))


def apply_phantom(df: DataFrame, rule: PhantomKeyRule) -> DataFrame:
    """``exclude`` drops rows with a junk key and keeps null keys."""
    return df.where(~is_phantom(rule)) if rule.mode == "exclude" else df


def measure_phantom(df: DataFrame, rule: PhantomKeyRule) -> DataFrame:
    return df.agg(F.count("*").alias("rows_total"), count_if(is_phantom(rule)).alias("rows_phantom"))


def hit(rule: CleanupRule, column: str) -> Column:
    """Whether the clean-up changes this value: used to rewrite it and to count it."""
    c = F.col(column)
    return {"blank": lambda: is_blank(c), "sentinel": lambda: is_sentinel(c, rule.values), "placeholder": lambda: is_placeholder(c, rule.values)}[rule.kind]()


def clean(df: DataFrame, rules: list[CleanupRule]) -> DataFrame:
    """All clean-ups in one projection; a blank goes before a sentinel, a sentinel before a placeholder; blank rules trim the rest."""
    out = {}
    for name in df.columns:
        own = [r for kind in CLEANUPS for r in rules if r.kind == kind and name.lower() in {c.lower() for c in r.columns}]
        if own:
            value = F.trim(F.col(name)) if any(r.kind == "blank" for r in own) else F.col(name)
            for rule in own:
                value = null_if(value, hit(rule, name))
            out[name] = value
    return df.withColumns(out) if out else df


def _cleanup_sums(rules: list[CleanupRule]) -> tuple[dict[str, Column], list[Column]]:
    """The named sums that count every rule's hits, and the rows they become."""
    sums, cells = {"__n": F.count("*")}, []
    for k, rule in enumerate(rules):
        any_ = F.lit(False)
        for column in rule.columns:
            any_ = any_ | hit(rule, column)
        sums[f"__any{k}"] = count_if(any_)
        for j, column in enumerate(rule.columns):
            sums[f"__h{k}_{j}"] = count_if(hit(rule, column))
            cells.append(F.struct(F.lit(CLEANUPS[rule.kind]).alias("check_id"), F.lit(rule.kind).alias("kind"), F.lit(column).alias("column_name"), F.col(f"__h{k}_{j}").alias("hits"), F.col(f"__any{k}").alias("rows_any"), F.col("__n").alias("rows_total")))
    return sums, cells


def _cleanup_rows(sums: DataFrame, cells: list[Column]) -> DataFrame:
    kind = "array<struct<check_id:string,kind:string,column_name:string,hits:bigint,rows_any:bigint,rows_total:bigint>>"
    return sums.select(F.inline(F.array(*cells) if cells else F.array().cast(kind)))


def measure_cleanups(df: DataFrame, rules: list[CleanupRule]) -> DataFrame:
    """(check_id, kind, column_name, hits, rows_any, rows_total) of every rule and column, from one scan."""
    sums, cells = _cleanup_sums(rules)
    return _cleanup_rows(df.agg(*[c.alias(n) for n, c in sums.items()]), cells)


def missing_columns(spark, inventory: DataFrame, required: list[tuple[str, str, str]]) -> DataFrame:
    """CFG-001: (table_name, context, missing) of rules that name a column the table lacks, whatever its case."""
    asked = spark.createDataFrame(required, "table_name string, column_name string, context string")
    have = inventory.select(F.lower("table_name").alias("t"), F.lower("column_name").alias("c"))
    left = asked.join(have, (F.lower("table_name") == F.col("t")) & (F.lower("column_name") == F.col("c")), "left_anti")
    return left.groupBy("table_name", "context").agg(F.array_sort(F.collect_list("column_name")).alias("missing"))


def resolve(df: DataFrame, names: tuple[str, ...]) -> list[str] | None:
    """The table's own spelling of the columns; None if one is missing."""
    have = {c.lower(): c for c in df.columns}
    return [have[n.lower()] for n in names] if all(n.lower() in have for n in names) else None


@dataclass
class Normalised:
    """A lazy cleaned table with what was done to it, and what its rules name in vain."""

    name: str
    df: DataFrame
    grain: Grain
    raw: DataFrame
    transforms: list[str]
    sampled: bool = False
    missing: list[tuple[str, list[str]]] = field(default_factory=list)
    rules: TableRules | None = None

    def at_grain(self) -> DataFrame:
        return at_grain(self.df, self.grain)

    def counts(self) -> DataFrame:
        """(table_name, rows_raw, rows_effective)."""
        raw = self.raw.agg(F.count("*").alias("rows_raw"))
        return raw.crossJoin(self.df.agg(F.count("*").alias("rows_effective"))).select(F.lit(self.name).alias("table_name"), "rows_raw", "rows_effective")  # one row each


def live_rules(df: DataFrame, rules: TableRules) -> tuple[TableRules, list[tuple[str, list[str]]]]:
    """The rules as far as the table has their columns, in its own spelling, and (context, missing columns) of the rest.

    A clean-up keeps the columns that are there; a snapshot keeps its
    timestamp with those of its partition columns that are there; a dedup needs
    all its keys and keeps the compared columns that are there; a phantom rule
    needs its column.
    """
    have, missing = {c.lower(): c for c in df.columns}, []

    def there(names: tuple[str, ...], context: str) -> tuple[str, ...]:
        if gone := [n for n in names if n.lower() not in have]:
            missing.append((context, gone))
        return tuple(have[n.lower()] for n in names if n.lower() in have)

    snapshot, dedup_rule = rules.snapshot, rules.dedup
    if snapshot:
        stamp, parts = there((snapshot.timestamp,), "snapshot"), there(snapshot.partition_by, "snapshot")
        snapshot = replace(snapshot, timestamp=stamp[0], partition_by=parts) if stamp else None
    phantoms = [replace(r, column=c) for r in rules.phantom for c in there((r.column,), "phantom key")]
    if dedup_rule:
        keys, compare = there(dedup_rule.keys, "dedup"), there(dedup_rule.compare, "dedup compare")
        dedup_rule = replace(dedup_rule, keys=keys, compare=compare) if len(keys) == len(dedup_rule.keys) else None
    cleanups = [replace(r, columns=kept) for r in rules.cleanups if (kept := there(r.columns, r.kind))]
    return replace(rules, snapshot=snapshot, phantom=tuple(phantoms), dedup=dedup_rule, cleanups=tuple(cleanups)), missing


def _rewritten(df: DataFrame, source: DataFrame, live: TableRules) -> tuple[DataFrame, list[str]]:
    """``df`` after the rules, and what they did; ``source`` is the same table for side reads."""
    out, done = df, []
    if live.snapshot:
        out = pin_snapshot(out, live.snapshot, source)
        done.append("snapshot pin")
    for rule in live.phantom:
        if rule.mode == "exclude":
            out = apply_phantom(out, rule)
            done.append(f"phantom {rule.column}")
    if live.dedup and live.dedup.mode != "exact_only":
        out = dedup(out, live.dedup, source)
        done.append(f"dedup {live.dedup.mode}")
    if live.cleanups:
        out = clean(out, list(live.cleanups))
        done += [f"clean {r.kind}" for r in live.cleanups]
    return out, done


def build(df: DataFrame, rules: TableRules, sampled: bool = False) -> Normalised:
    """Apply the table's rules in their order, as far as it has their columns; ``missing`` says what they lack."""
    live, missing = live_rules(df, rules)
    out, done = _rewritten(df, df, live)
    return Normalised(rules.name, out, rules.grain, df, done, sampled, missing, live)


def missing_of(spark, built: dict[str, Normalised]) -> DataFrame:
    """CFG-001: (table_name, context, missing, rows_read) of all built tables' rules; ``rows_read`` rows were read without the rule."""
    rows = [(b.name, context, names) for b in built.values() for context, names in b.missing]
    asked = spark.createDataFrame(rows, "table_name string, context string, missing array<string>")
    counts = [b.raw.agg(F.count("*").alias("rows_read")).select(F.lit(b.name).alias("of"), "rows_read") for b in built.values() if b.missing]
    if not counts:
        return asked.withColumn("rows_read", F.lit(0).cast("bigint"))
    found = reduce(DataFrame.union, counts)
    return asked.join(F.broadcast(found), F.col("table_name") == F.col("of")).drop("of")  # one row a declared table


@dataclass
class Written:
    """A cleaned table as written, with the figures of the write."""

    df: DataFrame
    counts: dict[str, int]
    cleanups: DataFrame
    observed: bool


def write_measured(built: Normalised, path: str) -> Written:
    """Write the cleaned table; its counts and its clean-ups' hits come out of the same pass.

    The figures are observed where the raw rows enter and where the cleaned
    ones leave. A stage that runs again after a lost executor may count its
    rows twice, so the two row counts are held against the files' own (footers
    only); if they differ, the clean-ups are measured by a scan of their own.
    """
    spark, live = built.raw.sparkSession, built.rules
    sums, cells = _cleanup_sums(list(live.cleanups))
    raw, effective = Observation("raw"), Observation("effective")
    seen = built.raw.observe(raw, *[c.alias(n) for n, c in sums.items()])
    out, _ = _rewritten(seen, built.raw, live)
    out.observe(effective, F.count("*").alias("rows_effective")).write.mode("overwrite").parquet(path)
    written = spark.read.schema(out.schema).parquet(path)
    figures = {"rows_raw": int(raw.get["__n"]), "rows_effective": int(effective.get["rows_effective"])}
    files = {"rows_raw": built.raw.count(), "rows_effective": written.count()}
    if figures != files:
        return Written(written, files, measure_cleanups(built.raw, list(live.cleanups)), False)
    one = spark.createDataFrame([tuple(int(raw.get[n]) for n in sums)], ", ".join(f"`{n}` bigint" for n in sums))
    return Written(written, figures, _cleanup_rows(one, cells), True)


def build_all(tables: dict[str, DataFrame], rules: list[TableRules], allowed=lambda name: True) -> tuple[dict[str, Normalised], list[tuple[str, str]]]:
    """Every declared table in scope; those that fail are left out and returned as (table, reason) for CFG-002."""
    built, failed = {}, []
    for rule in rules:
        if rule.name not in tables or not allowed(rule.name):
            continue
        try:
            built[rule.name] = build(tables[rule.name], rule)
        except Exception as error:  # analysis errors of one table must not stop the others
            failed.append((rule.name, type(error).__name__))
    return built, failed


def actions(measured: DataFrame, target: str) -> DataFrame:
    """Clean-up measurements as normalisation actions; nothing for a rule without a hit."""
    out = measured.where("hits > 0").groupBy("kind").agg(F.max("rows_any").alias("rows_affected"), F.max("rows_total").alias("rows_total"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "column_name", "hits"))), ", ").alias("detail"))
    out = out.select("kind", F.lit(target).alias("target"), "rows_affected", "rows_total", pct(F.col("rows_affected"), F.col("rows_total")).alias("pct"), "detail")
    return out.select(*[F.col(f.name).cast(f.dataType) for f in ACTION])


def action_log(table: DataFrame) -> DataFrame:
    """Actions with their share, largest first."""
    return table.withColumn("pct", pct(F.col("rows_affected"), F.col("rows_total"))).orderBy(F.desc("rows_affected"), "kind", "target")


def action_summary(counts: DataFrame) -> DataFrame:
    return counts.agg(F.sum("rows_raw").alias("rows_raw"), F.sum("rows_effective").alias("rows_effective"), (F.sum("rows_raw") - F.sum("rows_effective")).alias("rows_removed"))
