"""Running sums over a numbered table without a single task (W-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sums(rows: DataFrame, order: str, cols: list[str], group: int = 65_536) -> DataFrame:
    """Adds run_<c> for each column: its sum over all rows up to this one by `order`, whole numbers from 0.

    Rows are grouped by `group` numbers; a window runs in each group, another over the groups' totals."""
    rows = rows.withColumn("_group", F.floor(F.col(order) / group))
    totals = rows.groupBy("_group").agg(*(F.sum(c).alias(f"_t_{c}") for c in cols))
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_group", *(F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in cols))
    within = Window.partitionBy("_group").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *(F.sum(c).over(within).alias(f"run_{c}") for c in cols))
    joined = local.join(totals, "_group")
    return joined.select(*(c for c in rows.columns if c != "_group"), *((F.col(f"run_{c}") + F.col(f"_b_{c}")).alias(f"run_{c}") for c in cols))
