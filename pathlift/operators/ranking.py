"""Exact positions over any number of rows: ranges of the order, each shifted by the rows before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pathlift.session import cut_lineage

#: A row's number within its partition: the lower bits of monotonically_increasing_id.
WITHIN = (1 << 33) - 1


def numbered(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), into: str = "position",
             size_into: str | None = None) -> DataFrame:
    """All rows with their place from 0 in ``order``, among all rows or within each value of ``by``.

    Rows are dealt to ranges of (by, order) and sorted there; a place is the row's number in its range plus the
    rows of the same group in the ranges before. So no group is ever in one task, however large. ``size_into`` adds
    the size of the group. Rows equal in the whole order get successive places, which of them first is open. A null
    in ``by`` is a group. The table between has one row per range and group.
    """
    keys = [F.col(c).asc_nulls_first() for c in by]
    # Written first: the bounds of the ranges come from a sample, which would compute everything before it again.
    rows = cut_lineage(df)
    ranged = cut_lineage(
        rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftrightunsigned("_at", 33)
    parts = ranged.groupBy(part.alias("_part"), *[F.col(c).alias(f"_by_{c}") for c in by]).agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    group = [f"_by_{c}" for c in by]
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = parts.select(
        "_part", *group, (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(W.partitionBy(*group)).alias("_size"))
    same = F.shiftrightunsigned(F.col("_at"), 33) == F.col("_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    found = ranged.join(shifts, same).withColumn(into, F.col("_at") + F.col("_shift"))
    if size_into:
        found = found.withColumn(size_into, F.col("_size"))
    return found.drop("_at", "_part", "_shift", "_size", *group)
