"""Positions within groups, also for groups too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ravelin.session import cut


def has_hot_group(df: DataFrame, group: Sequence[str], rows: int) -> bool:
    """Whether any group holds more than ``rows`` rows (counted with map-side combine)."""
    return bool(df.groupBy(*group).count().filter(F.col("count") > rows).limit(1).count())


def spread_row_number(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """``row_number()`` over ``group`` ordered by ``order`` (ascending) without a task per group.

    Rows are range-partitioned by group and order, numbered inside each partition, and shifted by
    the counts of the partitions before. A group of any size is spread over many tasks; one value
    of ``group`` and ``order`` together stays in one partition, so ``order`` should end in a
    unique column. Nulls sort first. An empty table gives an empty table.
    """
    placed = cut(df.repartitionByRange(*group, *order).withColumn("_pid", F.spark_partition_id()))
    local = placed.withColumn("_local", F.row_number().over(W.partitionBy("_pid", *group).orderBy(*order)))
    before = W.partitionBy(*group).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    shift = placed.groupBy(*group, "_pid").count().select(
        *[F.col(g).alias(f"_g_{g}") for g in group], F.col("_pid").alias("_g_pid"),
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"),
    )
    same = F.col("_pid") == F.col("_g_pid")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return local.join(shift, same).withColumn(out, (F.col("_local") + F.col("_shift")).cast("long")).select(*df.columns, out)
