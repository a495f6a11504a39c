"""The reward run: from the Gold table to the audit report, and from the report to the mart."""

from __future__ import annotations

import datetime
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions import columns as C
from cardloom.functions.lineage import cut
from cardloom.operators import refine, rewards, sinks, summaries

#: Types that earn nothing and take nothing back; refunds stay.
NO_REWARD = (C.REPAYMENT, C.POINTS, C.FEE)
NO_MONTH = "未知月份"  # fixed value: the month of rows without a day


@dataclass
class RewardTables:
    """What a run looks things up in; ``selections`` and ``history`` may be missing."""

    programs: DataFrame
    links: DataFrame
    pools: DataFrame
    selections: DataFrame | None = None
    history: DataFrame | None = None


@dataclass
class RewardRun:
    """Transactions with their statement months and locked programs, their applied programs, and the full report."""

    transactions: DataFrame
    applied: DataFrame
    report: DataFrame


def reward_transactions(
    gold: DataFrame,
    bank_no: str | None = None,
    bank_name: str | None = None,
    card_id: str | None = None,
    card_type: str | None = None,
    first: datetime.date | None = None,
    last: datetime.date | None = None,
    excluded: Iterable[str] = NO_REWARD,
) -> DataFrame:
    """Rows of the Gold table that rewards are calculated on, under the names that the calculation uses.

    Rows of an excluded type or of none go.  A bank and a card are asked for by number, else by name.  A merchant without a
    shown name is shown as it is, one without a normal name goes by the shown one.
    """
    held = lambda *names: F.coalesce(*(F.col(n) for n in names if n in gold.columns), F.lit(None).cast("string"))
    rows = gold.where(~F.col("transaction_type").isin(*excluded))
    for one, other in ((("bank_no", bank_no), ("bank_name", bank_name)), (("card_id", card_id), ("card_type", card_type))):
        name, value = one if one[1] is not None else other
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if first is not None:
        rows = rows.where(F.col("transaction_date") >= F.lit(first))
    if last is not None:
        rows = rows.where(F.col("transaction_date") <= F.lit(last))
    raw = held("merchant", "merchant_name")
    shown = held("merchant_display", "display_name")
    text = {n: held(n) for n in ("bank_no", "bank_name", "card_id", "card_type", "card_no", "vpc_no", "vpc_type", "ec_platform")}
    return rows.select(
        F.coalesce(held("transaction_id"), F.lit("")).alias("transaction_id"), "transaction_date", "posting_date", *(c.alias(n) for n, c in text.items()),
        F.coalesce(held("payment_amount", "amount").cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)")).alias("amount"), "transaction_type", held("payment_process", "mobile_payment").alias("payment_process"),
        F.coalesce(shown, raw).alias("merchant_display"), F.coalesce(held("normalized_merchant"), shown, raw).alias("normalized_merchant"), held("merchant_location", "location").alias("merchant_location"),
    )


def run_rewards(gold: DataFrame, tables: RewardTables, **which: object) -> RewardRun:
    """Rewards of the Gold table's transactions: statement months, locked programs, waterfall and caps, and the report.

    ``which`` are the filters of :func:`reward_transactions`.  The rows are written as taken from Gold, where the lookups
    read them, and with their programs; the report is made of these and joins nothing.
    """
    txns = cut(reward_transactions(gold, **which))
    if tables.history is None:
        txns = txns.withColumn("statement_month", F.date_format("posting_date", "yyyy-MM"))
    else:
        txns = refine.statement_of(txns, refine.billing_intervals(tables.history))
    if tables.selections is not None:
        txns = rewards.active_selection(txns, tables.selections)
    rows = rewards.everything(txns, tables.programs, tables.links, tables.pools)
    return RewardRun(txns, rewards.applied_of(rows), rewards.report_of(rows))


def mart_tables(report: DataFrame) -> dict[str, DataFrame]:
    """The two tables of the mart: months by bank and card with their rate, and pools by month with their use; both with units.

    Rows without a bank or card belong to neither; amounts have two digits.  The report's rows are written once, with the
    columns that are summed up.
    """
    rows = report.where(~C.blank(F.col("bank_name")) & ~C.blank(F.col("card_type")))
    rows = rows.withColumns({"month": F.coalesce(F.date_format("transaction_date", "yyyy-MM"), F.lit(NO_MONTH)), "reward": F.col("calculated_reward")})
    rows = cut(rows.select(*summaries.POOL_KEYS, "transaction_id", "transaction_date", "payment_amount", "reward", "reward_type", "is_capped", "cap_amount", "priority", "load_ord"))
    months = summaries.reward_month_summary(rows, rows)
    cards = summaries.predominant_units(rows, "bank_name", "card_type").withColumnRenamed("reward_unit", "_card_unit")
    months = months.join(C.small(cards), ["bank_name", "card_type"], "left")
    months = months.select("month", "bank_name", "card_type", F.bround("spending", 2).alias("total_spending"), F.bround("reward", 2).alias("total_reward"), F.bround("rate_percent", 2).alias("effective_rate"), F.coalesce("_card_unit", F.lit(summaries.MONEY_UNIT)).alias("reward_unit"))
    own = summaries.predominant_units(rows, "bank_name", "card_type", "pool_name", paid_first=False)
    pools = summaries.pool_use(rows).join(C.small(own), ["bank_name", "card_type", "pool_name"], "left").join(C.small(cards), ["bank_name", "card_type"], "left")
    unit = F.coalesce("reward_unit", "_card_unit", F.lit(summaries.MONEY_UNIT)).alias("reward_unit")
    pools = pools.select(*summaries.POOL_KEYS, F.bround("reward", 2).alias("total_reward"), "is_capped", "cap_amount", unit)
    return {"rewards_monthly_summary": months, "rewards_pool_utilization": pools}


def sync_mart(report: DataFrame, schema: str = "default") -> dict[str, bool]:
    """Writes both tables; says which had rows."""
    return sinks.overwrite_mart(mart_tables(report), schema)


def read_summary(spark: SparkSession, schema: str = "default") -> dict[str, DataFrame]:
    """Both tables read back, latest month first; a table that is not there is left out."""
    names = [n for n in ("rewards_monthly_summary", "rewards_pool_utilization") if spark.catalog.tableExists(f"{schema}.{n}")]
    return {n: sinks.read_mart(spark, n, schema).orderBy(F.desc("month"), "bank_name", "card_type") for n in names}
