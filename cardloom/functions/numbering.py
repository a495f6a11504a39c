"""Dense numbers over all rows without one task that sees them all."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.lineage import cut

_PLACE = 33  # bits of a row's place in its partition, as monotonically_increasing_id lays them out


def numbered(df: DataFrame, order: Sequence[str | Column], name: str, written: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """Adds ``name``, the numbers 0, 1, 2 ... in the given order (rows that are equal in it: any order among them).

    Rows are dealt by ranges of the order and sorted there; each range numbers its own rows, and the sums of the counts of
    the ranges before it, one row a range, are carried over.  ``written`` stores the sorted rows once, so that counts and
    numbers speak of the same ranges.
    """
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _PLACE)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    counts = counts.select("_part", before.alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE) - 1))
    out = rows.withColumn("_part", part).join(F.broadcast(counts), "_part")
    return out.withColumn(name, F.col("_before") + place).select(*df.columns, name)
