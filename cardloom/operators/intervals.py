"""Days joined to the intervals that hold them by equal keys: no range condition, no nested loop.

An interval of n days is the union of at most 2 log n aligned blocks of 1, 2, 4 ... days.  A day lies in one block of each
length, so it asks for that many blocks, and the intervals that hold it are those that own one of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an interval without a first or a last day begins or ends with.
FIRST_DAY, LAST_DAY = "0001-01-01", "9999-12-31"


def _blocks(first: Column, end: Column, levels: int) -> Column:
    """Blocks (level and number) of the days from ``first`` to before ``end``, both as day numbers.

    At each level the blocks that fit between the rounded ends are odd at the left or end odd at the right; what lies
    between them is left to the higher levels.
    """

    def level(k: Column) -> Column:
        low, high = -F.call_function("shiftright", -first, k), F.call_function("shiftright", end, k)
        left = F.when((low < high) & (F.pmod(low, F.lit(2)) == 1), low)
        right = F.when((low < high) & (F.pmod(high, F.lit(2)) == 1), high - 1)
        return F.filter(F.array(*(F.when(b.isNotNull(), F.struct(k.alias("level"), b.alias("block"))) for b in (left, right))), lambda b: b.isNotNull())

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), level))


def join_days(rows: DataFrame, intervals: DataFrame, keys: Sequence[str], day: str, first: str, last: str) -> DataFrame:
    """Inner join of rows with the intervals of equal keys that hold their day; both ends count, null ends are open.

    The number of levels follows from the longest interval, by one aggregate over the intervals; rows without a day and
    intervals that end before they begin meet nothing.
    """
    start = F.unix_date(F.coalesce(first, F.lit(FIRST_DAY).cast("date")))
    end = F.unix_date(F.coalesce(last, F.lit(LAST_DAY).cast("date"))) + 1
    longest = intervals.agg(F.coalesce(F.max(end - start), F.lit(0))).first()[0]
    levels = max(1, int(longest).bit_length())
    owned = intervals.withColumn("_owned", F.explode(_blocks(start, end, levels)))
    owned = owned.withColumns({"_level": F.col("_owned.level"), "_block": F.col("_owned.block")}).drop("_owned")
    number = F.unix_date(day)
    asked = F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", number, k).alias("block")))
    asking = rows.where(F.col(day).isNotNull()).withColumn("_asked", F.explode(asked))
    asking = asking.withColumns({"_level": F.col("_asked.level"), "_block": F.col("_asked.block")}).drop("_asked")
    return asking.join(owned, [*keys, "_level", "_block"]).drop("_level", "_block")


def days_near(intervals: DataFrame, first: str, last: str, days: int) -> DataFrame:
    """The intervals with every day that lies within ``days`` of one of their ends (``near_day``) and how far (``apart``)."""
    around = F.sequence(F.lit(-days), F.lit(days))

    def near(end: str) -> Column:
        return F.transform(around, lambda d: F.struct(F.date_add(F.col(end), d).alias("near_day"), F.abs(d).alias("apart")))

    out = intervals.withColumn("_near", F.explode(F.concat(near(first), near(last))))
    return out.withColumns({"near_day": F.col("_near.near_day"), "apart": F.col("_near.apart")}).drop("_near")
