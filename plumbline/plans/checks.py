"""Checks a user writes: registered with a grain and a baseline, run one by one, an error in one stays its own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.normalise import Normalised
from plumbline.plans.model import BASELINES, CHECK_RESULT, DISABLED_BASELINES, FINDING, Check, Grain
from plumbline.sources import scratch


@dataclass
class Context:
    """What a check sees: normalised tables by name and the as-of date of the run."""

    spark: SparkSession
    tables: dict[str, Normalised]
    as_of: str

    def table(self, name: str) -> DataFrame | None:
        """The table at its grain; None if it was not built."""
        return self.tables[name].at_grain() if name in self.tables else None

    def history(self, name: str) -> DataFrame | None:
        return self.tables[name].df if name in self.tables else None


@dataclass
class Registry:
    checks: dict[str, Check] = field(default_factory=dict)

    def add(self, check_id: str, run: Callable[[Context], DataFrame | None], *, grain: Grain | None, baseline: str | None) -> Check:
        """Refuses a check without grain or baseline, with a disabled baseline, or with an id in use."""
        if grain is None or not baseline:
            raise ValueError(f"{check_id}: a check declares its grain and its baseline")
        if baseline in DISABLED_BASELINES or baseline not in BASELINES:
            raise ValueError(f"{check_id}: baseline {baseline} is not enabled")
        if check_id in self.checks:
            raise ValueError(f"{check_id} is registered already")
        self.checks[check_id] = Check(check_id, run, grain, baseline, check_id.split("-")[0])
        return self.checks[check_id]

    def check(self, check_id: str, *, grain: Grain | None, baseline: str | None):
        def wrap(run):
            self.add(check_id, run, grain=grain, baseline=baseline)
            return run

        return wrap

    def run(self, context: Context) -> tuple[DataFrame, DataFrame]:
        """(findings, check results).

        A check returns None to be skipped, or rows: of figures (``violations``,
        with rows_scanned, severity, title and other finding columns if it has
        them), where each row with violations is a finding, or of findings as
        they are (``affected_count``). A result without either is an error of
        the check, never a pass.
        """
        found, results = [context.spark.createDataFrame([], FINDING)], []
        for check_id in sorted(self.checks):
            check = self.checks[check_id]
            try:
                out = check.run(context)
                if out is None:
                    results.append((check_id, check.family, "skipped", None, None, "table not available"))
                    continue
                # Written once: the figures and the findings read the small result, not the tables again.
                out = scratch.written(out.withColumns({c: F.col(f"`{c}`").cast("string") for c, kind in out.dtypes if kind == "void"}), "check")
                own = self._findings(check, out)
                scanned = F.sum("rows_scanned").cast("bigint") if "rows_scanned" in out.columns else F.lit(None).cast("bigint")
                bad = "violations" if "violations" in out.columns else "affected_count"
                # One row a check: sums of what it measured.
                figures = out.agg(scanned.alias("scanned"), F.coalesce(F.sum(bad), F.lit(0)).cast("bigint").alias("bad")).first()
            except Exception as error:
                results.append((check_id, check.family, "error", None, None, f"{type(error).__name__}: {error}"[:200] if isinstance(error, ValueError) else type(error).__name__))
                continue
            results.append((check_id, check.family, "fail" if figures.bad else "pass", figures.scanned, figures.bad, None))
            found.append(own)
        return union(found), context.spark.createDataFrame(results, CHECK_RESULT)

    @staticmethod
    def _findings(check: Check, out: DataFrame) -> DataFrame:
        bad = next((c for c in ("violations", "affected_count") if c in out.columns), None)
        if bad is None:
            raise ValueError(f"{check.check_id}: neither violations nor affected_count among {', '.join(out.columns)}")
        given = {"severity": "medium", "finding_class": "violation", "title": check.check_id, "grain": str(check.grain), "baseline": check.baseline}
        cells = {name: F.coalesce(F.col(name).cast("string"), F.lit(value)) if name in out.columns else F.lit(value) for name, value in given.items()}
        cells |= {"check_id": F.lit(check.check_id), "family": F.lit(check.family), "affected_count": F.col(bad), "sampled": F.coalesce("sampled", F.lit(False)) if "sampled" in out.columns else F.lit(False)}
        cells |= {c: F.col(c) if c in out.columns else F.lit(None) for c in ("entity_type", "entity_id", "evidence")}
        return out.where(F.col(bad) > 0).select(*[cells[f.name].cast(f.dataType).alias(f.name) for f in FINDING])


def invariant_findings(measured: DataFrame, *, severity: str, grain: Grain, baseline: str, sampled: bool = False) -> DataFrame:
    """Measured invariants with violations as findings; text that is no number is a finding of its own."""
    own = measured.where("violations - non_numeric > 0").select("check_id", (F.col("violations") - F.col("non_numeric")).alias("affected_count"), F.lit("violation").alias("finding_class"), "lowest", "highest")
    text = measured.where("non_numeric > 0").select(F.concat("check_id", F.lit("-NONNUMERIC")).alias("check_id"), F.col("non_numeric").alias("affected_count"), F.lit("defect").alias("finding_class"), "lowest", "highest")
    out = own.union(text).select(
        "check_id", F.substring_index("check_id", "-", 1).alias("family"), F.lit(severity).alias("severity"), "finding_class", F.concat(F.col("check_id"), F.lit(": "), F.col("affected_count").cast("string"), F.lit(" rows")).alias("title"),
        F.lit("table").alias("entity_type"), F.lit(None).cast("string").alias("entity_id"), "affected_count", F.lit(str(grain)).alias("grain"), F.lit(baseline).alias("baseline"), F.lit(sampled).alias("sampled"), F.to_json(F.struct("lowest", "highest")).alias("evidence"),
    )
    return out.select(*[F.col(f.name).cast(f.dataType) for f in FINDING])


def invariant_results(measured: DataFrame) -> DataFrame:
    """Measured invariants as check results, passes too."""
    status = F.when(F.col("violations") > 0, "fail").otherwise("pass")
    return measured.select("check_id", F.substring_index("check_id", "-", 1).alias("family"), status.alias("status"), "rows_scanned", "violations", F.lit(None).cast("string").alias("detail"))


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
