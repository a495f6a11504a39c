"""How often queries read their transactions, and how these are joined."""

from __future__ import annotations

import pytest

from cardloom.functions.lineage import cut
from cardloom.plans import registry

ONCE = ["statement_months", "upsert", "sankey_links", "volatility_view_payment_only", "volatility_view_card_category", "reward_totals", "reward_monthly_summary", "reward_audit"]


@pytest.mark.parametrize("name", ONCE)
def test_transactions_are_read_once(spark, sf_dir, monkeypatch, name):
    """Every row of the joined tables goes through one pass, whatever the query takes from it."""
    seen, joined = spark.sparkContext.accumulator(0), registry.tx

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def watched(*args, **more):
        rows = joined(*args, **more)
        return rows.mapInArrow(counted, rows.schema)

    monkeypatch.setattr(registry, "tx", watched)
    registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    assert seen.value == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()


def test_line_items_are_shuffled_by_part_and_order(spark, sf_dir):
    """The joins are the same at all sizes: two shuffled ones, shops are broadcast, and rows come out dealt by order."""
    rows = registry.star_tables.transactions(spark, sf_dir, keys=True)
    plan = rows.groupBy("l_orderkey", "l_linenumber").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_partkey") == 1 and plan.count("Exchange hashpartitioning(l_orderkey") == 1
    assert "hashpartitioning(l_suppkey" not in plan


def test_cut_tables_are_columns(spark):
    """What is cut can be read by column, and keeps rows, names and types."""
    rows = spark.range(1000).selectExpr("id", "cast(id as decimal(18,2)) `two words`", "array(struct(id as a, cast(null as string) as b)) list", "cast('2025-01-01' as date) day")
    out = cut(rows)
    assert out.schema.simpleString() == rows.schema.simpleString() and out.exceptAll(rows).isEmpty() and out.count() == 1000
    assert "parquet" in out.select("id")._jdf.queryExecution().executedPlan().toString().lower()


def test_rewards_sort_no_candidates(spark, sf_dir):
    """The waterfall works on each transaction's own array: nothing is shuffled by transaction before caps are counted."""
    _, applied = registry._rewards(spark, sf_dir)
    assert "hashpartitioning(transaction_id" not in applied._jdf.queryExecution().executedPlan().toString()


def test_totals_of_a_report_that_nobody_reads(spark, sf_dir):
    """The mart takes neither totals nor traces of the report, so its rows meet no window and no join by transaction."""
    found = registry._run(spark, sf_dir).report.select("transaction_id", "calculated_reward", "pool_name")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(transaction_id" not in plan and "stage_trace" not in plan
