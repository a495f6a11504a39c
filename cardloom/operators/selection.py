"""Exact quantiles of many groups at once, without one task that holds a group.

Equal values are counted first.  A histogram over buckets of nearly equal ratio then tells in which bucket each wanted place
lies; only the values of these buckets are sorted, within their bucket.  A bucket spans a thousandth of its value, so a task
sorts what a group has there, and a group of any size is spread over thousands of buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets for each factor of e.
FINENESS = 1_000


def bucket(value: Column) -> Column:
    """A whole number that never falls as the value rises."""
    size = F.floor(F.log(F.abs(value) + 1) * FINENESS)
    return F.when(value < 0, -size).otherwise(size).cast("long")


def counted(df: DataFrame, keys: Sequence[str], value: Column, *more: Column) -> DataFrame:
    """``x`` and ``n``: how often each group holds each value (null is none); ``more`` are further aggregates.

    Rows that stand for several, ``n`` of them, count as often.
    """
    times = F.sum("n") if "n" in df.columns else F.count(F.lit(1))
    return df.where(value.isNotNull()).groupBy(*keys, value.cast("double").alias("x")).agg(times.alias("n"), *more)


def quantiles(counts: DataFrame, keys: Sequence[str], shares: Sequence[float], names: Sequence[str]) -> DataFrame:
    """The quantiles of each group of ``counts`` (``x``, ``n``), interpolated between neighbours as percentiles are.

    ``counts`` is read twice; its rows, one a value, are few or written.
    """
    keys, of = list(keys), [F.col(k) for k in keys]
    rows = counts.withColumn("_bucket", bucket(F.col("x")))
    bars = rows.groupBy(*keys, "_bucket").agg(F.sum("n").alias("_in"))
    group, ordered = Window.partitionBy(*of), Window.partitionBy(*of).orderBy("_bucket")
    bars = bars.withColumns({"_all": F.sum("_in").over(group), "_end": F.sum("_in").over(ordered)}).withColumn("_start", F.col("_end") - F.col("_in"))
    place = lambda p: (F.col("_all") - 1) * F.lit(p)
    low, high = ({p: f(place(p)).cast("long") for p in shares} for f in (F.floor, F.ceil))
    holds = lambda at: (F.col("_start") <= at) & (at < F.col("_end"))
    wanted = F.lit(False)
    for p in shares:
        wanted = wanted | holds(low[p]) | holds(high[p])
    kept = bars.where(wanted).select(*keys, "_bucket", "_all", F.col("_start").alias("_base"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, "_bucket")]
    near = rows.alias("a").join(kept.alias("b"), same).select(*(F.col(f"a.{k}") for k in (*keys, "_bucket")), "a.x", "a.n", "b._all", "b._base")
    end = F.sum("n").over(Window.partitionBy(*of, "_bucket").orderBy("x"))
    near = near.withColumn("_end", F.col("_base") + end).withColumn("_start", F.col("_end") - F.col("n"))
    picks = []
    for k, p in enumerate(shares):
        picks += [F.max(F.when(holds(low[p]), F.col("x"))).alias(f"_low{k}"), F.max(F.when(holds(high[p]), F.col("x"))).alias(f"_high{k}")]
    found = near.groupBy(*keys).agg(F.max("_all").alias("_all"), *picks)
    between = lambda k, p: F.col(f"_low{k}") + (F.col(f"_high{k}") - F.col(f"_low{k}")) * (place(p) - F.floor(place(p)))
    return found.select(*keys, *(between(k, p).alias(name) for k, (p, name) in enumerate(zip(shares, names, strict=True))))


def medians(df: DataFrame, weighted: bool = False, **values: Column) -> DataFrame:
    """One row with the median of each named value over all rows; null and values left out by a condition are none.

    If ``weighted``, a row counts ``n`` times.
    """
    pairs = F.array(*(F.struct(F.lit(n).alias("_name"), v.cast("double").alias("_v")) for n, v in values.items()))
    long = df.select(F.explode(pairs).alias("_p"), *(["n"] if weighted else [])).select("_p.*", *(["n"] if weighted else []))
    found = quantiles(counted(long, ["_name"], F.col("_v")), ["_name"], [0.5], ["_median"])
    return found.agg(*(F.max(F.when(F.col("_name") == n, F.col("_median"))).alias(n) for n in values))
