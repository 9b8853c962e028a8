"""Row rules on streams. They keep no state, so the batch expressions serve unchanged; counts go by event-time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expressions import count_if
from plumbline.operators.normalise import apply_phantom, clean
from plumbline.plans.model import CleanupRule, PhantomKeyRule


def clean_stream(stream: DataFrame, cleanups: list[CleanupRule], phantom: list[PhantomKeyRule] = ()) -> DataFrame:
    """Junk keys excluded, then values cleaned, row by row."""
    for rule in phantom:
        stream = apply_phantom(stream, rule)
    return clean(stream, cleanups)


def windowed_violations(stream: DataFrame, time: str, broken: Column, *, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window_start, rows_scanned, violations); rows later than the watermark are dropped, as state must end."""
    marked = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = marked.groupBy(F.window(time, window)).agg(F.count("*").alias("rows_scanned"), count_if(broken).alias("violations"))
    return out.select(F.col("window.start").alias("window_start"), "rows_scanned", "violations")
