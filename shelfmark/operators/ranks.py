"""Exact ranks over whole tables without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import stored


def ranked(rows: DataFrame, *order: str | Column, name: str = "nth") -> DataFrame:
    """rows with their place, from 0, in this order; equal rows in any order, nulls as the order says.

    Rows are dealt by sampled ranges of the order and sorted in each; a place is the count of the ranges before (one number for each
    partition, which is all that the driver sees) and the place in the range. Stored, as both steps must see one layout.
    """
    kept = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    shifts, before = [], 0
    for p, n in sorted(tuple(r) for r in kept.groupBy(part.alias("p")).count().collect()):
        shifts.append((p, before))
        before += n
    table = rows.sparkSession.createDataFrame(shifts, "__part long, __before long")
    out = kept.withColumn("__part", part).join(F.broadcast(table), "__part")  # a row for each partition
    return out.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__before")
