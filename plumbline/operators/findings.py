"""Queries over findings, check results and runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.expressions import count_if
from plumbline.plans.model import BASELINES, DISABLED_BASELINES, SEVERITIES, actionable, severity_name, severity_rank


def register(findings: DataFrame, *, limit: int | None = None, offset: int = 0, actionable_only: bool = False, **equal) -> DataFrame:
    """Findings that equal the given values, worst severity first, then most rows; a limit is for pages of a report."""
    out = findings
    for column, value in equal.items():
        out = out.where(F.col(column) == value)
    if actionable_only:
        out = out.where(actionable(F.col("finding_class")))
    if limit is None and not offset:
        return out.withColumn("rank", severity_rank(F.col("severity")))
    out = out.orderBy(severity_rank(F.col("severity")), F.desc("affected_count"), "check_id", "entity_id")
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def search(findings: DataFrame, text: str) -> DataFrame:
    """Findings with the text in their title or check id, whatever its case."""
    q = text.lower()
    return findings.where(F.lower("title").contains(q) | F.lower("check_id").contains(q))


def picker(findings: DataFrame, column: str) -> DataFrame:
    return findings.select(column).distinct()


def counts(findings: DataFrame, column: str) -> DataFrame:
    return findings.groupBy(column).agg(F.count("*").alias("findings"), F.sum("affected_count").alias("affected"))


def scorecard(findings: DataFrame) -> DataFrame:
    """Per entity: findings, affected, critical, high, actionable."""
    s, act = F.col("severity"), actionable(F.col("finding_class"))
    return findings.where("entity_id IS NOT NULL").groupBy("entity_id").agg(F.count("*").alias("findings"), F.sum("affected_count").alias("affected"), count_if(s == "critical").alias("critical"), count_if(s == "high").alias("high"), count_if(act).alias("actionable"))


def top_scorecard(findings: DataFrame, limit: int) -> DataFrame:
    return scorecard(findings).orderBy(F.desc("actionable"), F.desc("findings"), "entity_id").limit(limit)


def _identity(df: DataFrame, with_class: bool) -> list[Column]:
    return [F.col("check_id"), F.coalesce("entity_id", F.lit("")).alias("entity"), *([F.col("finding_class")] if with_class else [])]


def previous_run(runs: DataFrame, run_id: str) -> DataFrame:
    """The latest completed run other than this: at most one row."""
    return runs.where((F.col("status") == "completed") & (F.col("run_id") != run_id)).orderBy(F.desc("started_at"), F.desc("run_id")).limit(1)


def lifecycle(current: DataFrame, previous: DataFrame, previous_run_id: str, with_class: bool = False) -> DataFrame:
    """``current`` with lifecycle (new, recurring) and first_seen; the earlier side is made unique first, so nothing fans out."""
    keys = ["check_id", "entity", *(["finding_class"] if with_class else [])]
    then = previous.select(*_identity(previous, with_class), F.col("first_seen") if "first_seen" in previous.columns else F.lit(None).cast("string").alias("first_seen"))
    then = then.groupBy(*keys).agg(F.min(F.coalesce("first_seen", F.lit(previous_run_id))).alias("__first"))
    now = current.withColumn("entity", F.coalesce("entity_id", F.lit("")))
    out = now.join(then, keys, "left")
    seen = F.col("__first").isNotNull()
    return out.withColumns({"lifecycle": F.when(seen, "recurring").otherwise("new"), "first_seen": F.col("__first")}).drop("__first", "entity")


def resolved(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Earlier findings with no counterpart now."""
    now = current.select(*_identity(current, False)).distinct()
    then = previous.withColumn("entity", F.coalesce("entity_id", F.lit("")))
    return then.join(now, ["check_id", "entity"], "left_anti").select(*previous.columns)


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def roll_up(results: DataFrame) -> DataFrame:
    """checks_run, checks_passed, checks_failed, checks_skipped, checks_error, rows_scanned, violations."""
    s = F.col("status")
    return results.agg(count_if(s != "skipped").alias("checks_run"), *[count_if(s == x).alias(f"checks_{y}") for x, y in (("pass", "passed"), ("fail", "failed"), ("skipped", "skipped"), ("error", "error"))], F.coalesce(F.sum("rows_scanned"), F.lit(0)).alias("rows_scanned"), F.coalesce(F.sum("violations"), F.lit(0)).alias("violations"))


def catalogue(results: DataFrame) -> DataFrame:
    return results.orderBy("family", "check_id")


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("checks"))


def not_passing(results: DataFrame) -> DataFrame:
    return results.where("status <> 'pass'")


def rule_references(refs: DataFrame, sections: DataFrame, ref: str = "rule_ref") -> DataFrame:
    """Every cited section: the columns of ``refs``, token, section (number, null if none), label (number and title, else the token)."""
    cut = refs.withColumn("token", F.explode(F.split(F.col(ref), "[,/]"))).withColumn("token", F.trim("token")).where("token <> ''")
    cut = cut.withColumn("section", F.regexp_extract("token", r"(\d+)", 1).try_cast("int"))
    known = sections.select(F.col("section"), F.col("title").alias("section_title"))
    out = cut.join(known, "section", "left")
    label = F.when(F.col("section_title").isNotNull(), F.concat(F.lit("§"), F.col("section").cast("string"), F.lit(" "), F.col("section_title"))).otherwise(F.col("token"))
    return out.withColumn("label", label).drop("section_title")


def describe(refs: DataFrame, sections: DataFrame, key: str, ref: str = "rule_ref") -> DataFrame:
    """(key, described): labels in order of their section, each once."""
    each = rule_references(refs, sections, ref).select(key, F.struct(F.coalesce("section", F.lit(1 << 30)).alias("s"), "label").alias("x"))
    out = each.groupBy(key).agg(F.array_sort(F.collect_set("x")).alias("xs"))
    return out.select(key, F.array_join(F.transform("xs", lambda x: x.label), "; ").alias("described"))


def compliance(refs: DataFrame, sections: DataFrame, ref: str = "rule_ref", check: str = "check_id") -> DataFrame:
    """(section, checks): the distinct checks that cite each section."""
    each = rule_references(refs, sections, ref).where("section IS NOT NULL")
    return each.groupBy("section").agg(F.array_join(F.array_sort(F.collect_set(check)), ",").alias("checks"))


def incident_severity(incidents: DataFrame, findings: DataFrame) -> DataFrame:
    """(incident_id, severity): the worst of the members, medium if none is known."""
    members = incidents.select("incident_id", F.explode_outer("finding_ids").alias("finding_id"))
    ranks = members.join(findings.select("finding_id", severity_rank(F.col("severity")).alias("rank")), "finding_id", "left")
    worst = ranks.groupBy("incident_id").agg(F.min("rank").alias("rank"))
    return worst.select("incident_id", severity_name(F.col("rank")).alias("severity"))


def unknown_references(incidents: DataFrame, findings: DataFrame) -> DataFrame:
    """(incident_id, finding_id) of members that the run does not hold."""
    members = incidents.select("incident_id", F.explode("finding_ids").alias("finding_id"))
    return members.join(findings.select("finding_id"), "finding_id", "left_anti").select("incident_id", "finding_id")


def newest_per(df: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("__rn = 1").drop("__rn")


# Labels of action kinds in reports.
ACTION_LABELS = {"blank": "Blank text set to null", "sentinel": "Status text set to null", "placeholder": "Placeholder date set to null", "dedup": "Duplicate rows removed", "pin": "Older snapshots set aside", "phantom": "Junk keys"}


def labelled_actions(actions: DataFrame) -> DataFrame:
    label = F.col("kind")
    for kind, text in ACTION_LABELS.items():
        label = F.when(F.col("kind") == kind, text).otherwise(label)
    return actions.withColumn("label", label)


#: What a finding must pass, in the order in which reasons are given.
GATES = ("grain", "baseline", "materiality", "counter-query")


def verified(findings: DataFrame, counters: DataFrame, *, keys: list[str], least: int = 1, tolerance: float = 0.0) -> DataFrame:
    """``findings`` with counter_query_count, verified_by (gates passed), rejected_for and severity as it then stands.

    A finding must state its grain and an enabled baseline, affect at least
    ``least`` rows, and agree with an independent count of the same thing in
    ``counters`` (keys, counter_query_count) to a share of ``tolerance``. The
    first gate it fails is the reason to drop it (``rejected_for``); one that
    has no counter-query stays, a step less severe, as it is not verified.
    """
    known = counters.select(*keys, F.col("counter_query_count").cast("bigint").alias("counter_query_count"))
    out = findings.join(known, keys, "left")
    counted, n = F.col("counter_query_count"), F.col("affected_count")
    stated = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    passed = {
        "grain": stated("grain"), "baseline": F.coalesce(F.upper("baseline").isin(*[b for b in BASELINES if b not in DISABLED_BASELINES]), F.lit(False)),
        "materiality": F.coalesce(n >= least, F.lit(False)), "counter-query": F.coalesce(F.abs(n - counted) <= tolerance * F.greatest(n, counted), F.lit(False)),
    }
    failed = {g: ~passed[g] & counted.isNotNull() if g == "counter-query" else ~passed[g] for g in GATES}
    reason = F.coalesce(*[F.when(failed[g], g) for g in GATES])
    milder = severity_name(F.least(severity_rank(F.col("severity")) + 1, F.lit(SEVERITIES.index("low"))))
    lowered = counted.isNull() & (severity_rank(F.col("severity")) < SEVERITIES.index("low"))
    return out.withColumns({"verified_by": F.filter(F.array(*[F.when(passed[g], g) for g in GATES]), lambda x: x.isNotNull()), "rejected_for": reason, "severity": F.when(lowered, milder).otherwise(F.col("severity"))})


def kept(checked: DataFrame) -> DataFrame:
    """Verified findings that stay."""
    return checked.where("rejected_for IS NULL").drop("rejected_for")


def rejections(checked: DataFrame) -> DataFrame:
    """(check_id, rejected_for, findings): why findings were dropped, for the run's record."""
    return checked.where("rejected_for IS NOT NULL").groupBy("check_id", "rejected_for").agg(F.count("*").alias("findings"))


# The register's columns in order, with the finding's column that each shows.
REGISTER = {
    "check_id": "check_id", "family": "family", "severity": "severity", "class": "finding_class", "title": "title", "affected_count": "affected_count", "business_rule_ref": "business_rule_ref", "owner": "owner", "grain": "grain", "baseline": "baseline", "status": "status",
    "why_it_matters": "why_it_matters", "llm_explanation": "llm_explanation", "llm_root_cause": "llm_root_cause", "llm_remediation": "llm_remediation", "entity_id": "entity_id", "well_id": "well_id",
}


def register_sheet(findings: DataFrame, narration: DataFrame | None = None, rules: DataFrame | None = None, by: str = "finding_id") -> DataFrame:
    """The report's register: one row a finding, its columns in order, absent ones as null, with its ``rank``.

    ``narration`` (``by``, llm_explanation, llm_root_cause, llm_remediation) and
    ``rules`` (check_id, business_rule_ref, owner, why_it_matters) are looked
    up; a finding's own value goes before a looked-up one. Sort by rank, then
    by falling affected_count.
    """
    out = findings
    for other, key in ((narration, by), (rules, "check_id")):
        if other is not None:
            told = [c for c in other.columns if c != key]
            out = out.join(other.select(key, *[F.col(c).alias(f"__{c}") for c in told]), key, "left")
            out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) if c in findings.columns else F.col(f"__{c}") for c in told}).drop(*[f"__{c}" for c in told])
    cells = [F.col(own).alias(name) if own in out.columns else F.lit(None).cast("bigint" if name in ("affected_count", "well_id") else "string").alias(name) for name, own in REGISTER.items()]
    return out.select(*cells, severity_rank(F.col("severity")).alias("rank"))
