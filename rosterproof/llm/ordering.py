"""Positions of rows in a total order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterproof.llm.common import staged

_WITHIN = 33


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``position``: their place from 0 in the total order ``order``.

    Rows are dealt by ranges of the order and sorted there; a row's place is its index in
    its range plus the sizes of the ranges before. Only those sizes, one per task, meet in a
    window and are broadcast. ``rows`` are read twice (the ranges are sampled), so they
    should be a written table, and ``order`` should end in a column that tells equal rows
    apart: then no range can be larger than others for a value that many rows have.
    """
    index = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows = staged(dealt.withColumn("__at", index), name)
    part = F.shiftrightunsigned("__at", _WITHIN)
    sizes = sorted_rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("__part").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    within = F.col("__at").bitwiseAND(F.lit((1 << _WITHIN) - 1))
    return (
        sorted_rows.join(F.broadcast(offsets), part == F.col("__of"))
        .withColumn("position", F.col("__before") + within)
        .drop("__at", "__of", "__before")
    )
