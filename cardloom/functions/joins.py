"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that hold more than one in so many rows are sent to every task; there can be no more than this many of them.
FREQUENT = 5_000


def join_counted(rows: DataFrame, table: DataFrame, keys: Sequence[str], count: str, frequent: int = FREQUENT) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row a key and in ``count`` how many of the rows have that key.

    Fewer than ``frequent`` keys can hold more than one in ``frequent`` rows each: they are broadcast.  All other keys,
    none of which fills a task, meet their rows by a shuffle.  Both inputs are read twice and should be written tables;
    null keys join nothing.
    """
    keys = list(keys)
    total = table.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    often = F.col(count).cast("double") * frequent > total
    seldom = rows.join(F.broadcast(table.where(often).select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(table.where(often)), keys).unionByName(seldom.join(table.where(~often), keys))
