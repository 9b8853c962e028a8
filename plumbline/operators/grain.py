"""What one row stands for: history collapsed to the latest row of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.expressions import order
from plumbline.plans.model import Grain


def latest(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """The first row of each key in ``order_by`` (Spark limits each group before the shuffle)."""
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(*order(order_by)))
    return df.withColumn("__rn", row).where("__rn = 1").drop("__rn")


def at_grain(df: DataFrame, grain: Grain) -> DataFrame:
    return latest(df, list(grain.keys), list(grain.order_by)) if grain.keys and grain.order_by else df


def latest_state(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """As ``latest``, without rows whose first sort key is null."""
    return latest(df.where(F.col(order_by[0].split(" ")[0]).isNotNull()), keys, order_by)
