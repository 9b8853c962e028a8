"""Names, orders and schemas of the result tables, and the rules a user declares."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Severities from worst to least, finding classes, those that ask for action, baselines.
SEVERITIES = ("critical", "high", "medium", "low", "cleared", "info")
CLASSES = ("violation", "defect", "gap", "pending", "risk", "design", "anomaly")
ACTIONABLE = ("violation", "defect", "gap")
BASELINES = ("TARGET", "P6", "MASTER_DATE", "ACTUAL", "NONE")
DISABLED_BASELINES = ("COMMITTED",)
STATUSES = ("pass", "fail", "skipped", "error")

KINDS = {"string": T.StringType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType())}


def schema(text: str) -> T.StructType:
    """``name kind, …`` as a schema; unlike DDL it needs no running session."""
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in (part.split() for part in text.split(","))])


FINDING = schema(
    "check_id string, family string, severity string, finding_class string, title string, entity_type string, entity_id string, "
    "affected_count bigint, grain string, baseline string, sampled boolean, evidence string"
)
CHECK_RESULT = schema("check_id string, family string, status string, rows_scanned bigint, violations bigint, detail string")
ACTION = schema("kind string, target string, rows_affected bigint, rows_total bigint, pct double, detail string")
METRIC = schema("run_id string, table_name string, column_name string, metric string, value string")
RUN = schema("run_id string, started_at timestamp, finished_at timestamp, as_of_date date, status string, findings_total bigint")
INCIDENT = schema("run_id string, incident_id string, title string, finding_ids array<string>")


def severity_rank(severity: Column) -> Column:
    """0 for the worst; an unknown severity ranks after all others."""
    out = F.lit(len(SEVERITIES))
    for k, name in enumerate(SEVERITIES):
        out = F.when(severity == name, k).otherwise(out)
    return out


def severity_name(rank: Column, default: str = "medium") -> Column:
    out = F.lit(default)
    for k, name in enumerate(SEVERITIES):
        out = F.when(rank == k, name).otherwise(out)
    return out


def actionable(finding_class: Column) -> Column:
    return F.coalesce(finding_class.isin(*ACTIONABLE), F.lit(False))


@dataclass(frozen=True)
class Grain:
    """What one row of a table stands for when a check reads it."""

    kind: str
    keys: tuple[str, ...] = ()
    order_by: tuple[str, ...] = ()  # column names, " desc" after those that fall

    def __post_init__(self):
        if self.kind not in ("row", "latest_per", "snapshot_pinned", "aggregate"):
            raise ValueError(f"unknown grain {self.kind!r}")
        if self.kind == "latest_per" and not (self.keys and self.order_by):
            raise ValueError("latest_per needs keys and an order")

    def __str__(self) -> str:
        if not self.keys:
            return self.kind
        return f"{self.kind}({', '.join(self.keys)}" + (f" ORDER BY {', '.join(self.order_by)})" if self.order_by else ")")


ROW, AGGREGATE = Grain("row"), Grain("aggregate")


def latest_per(keys: list[str], order_by: list[str]) -> Grain:
    return Grain("latest_per", tuple(keys), tuple(order_by))


def snapshot_pinned(keys: list[str], order_by: list[str]) -> Grain:
    return Grain("snapshot_pinned", tuple(keys), tuple(order_by))


@dataclass(frozen=True)
class SnapshotRule:
    timestamp: str
    partition_by: tuple[str, ...] = ()


@dataclass(frozen=True)
class DedupRule:
    keys: tuple[str, ...]
    order_by: tuple[str, ...] = ()
    mode: str = "keep_latest"
    compare: tuple[str, ...] = ()

    def __post_init__(self):
        if self.mode not in ("keep_latest", "exact_only", "collapse_identical"):
            raise ValueError(f"unknown dedup mode {self.mode!r}")
        if self.mode == "keep_latest" and not self.order_by:
            raise ValueError("keep_latest needs an order")


@dataclass(frozen=True)
class PhantomKeyRule:
    column: str
    values: tuple = ()
    mode: str = "flag_only"

    def __post_init__(self):
        if self.mode not in ("flag_only", "exclude"):
            raise ValueError(f"unknown phantom mode {self.mode!r}")


@dataclass(frozen=True)
class CleanupRule:
    """``kind``: blank, sentinel or placeholder; ``values`` for the latter two."""

    kind: str
    columns: tuple[str, ...]
    values: tuple = ()

    def __post_init__(self):
        if self.kind not in ("blank", "sentinel", "placeholder"):
            raise ValueError(f"unknown clean-up {self.kind!r}")


@dataclass(frozen=True)
class TableRules:
    """All that is declared for one table."""

    name: str
    grain: Grain = ROW
    snapshot: SnapshotRule | None = None
    dedup: DedupRule | None = None
    phantom: tuple[PhantomKeyRule, ...] = ()
    cleanups: tuple[CleanupRule, ...] = ()


@dataclass(frozen=True)
class ColumnRule:
    """Meaning of one column; ``role`` actual makes a future date a finding, ``low``/``high`` a range check."""

    name: str
    role: str = "measure"
    low: float | None = None
    high: float | None = None
    all_null: bool = False
    authoritative: bool = True
    allowed: tuple = ()
    pii: bool = False


@dataclass(frozen=True)
class DateOrderRule:
    check_id: str
    before: str
    after: str
    severity: str = "high"


@dataclass(frozen=True)
class Check:
    """A registered check: its function takes a context and returns a finding table."""

    check_id: str
    run: object
    grain: Grain
    baseline: str
    family: str = field(default="")
