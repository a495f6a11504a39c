"""Few programs are conditions of the plan; what these give is what the programs' arrays give."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from cardloom.operators import rewards
from cardloom.plans import registry
from cardloom.sources import reward_tables

PROGRAM = "reward_id string, bank_no string, card_id string, reward_program string, source string, reward_cycle string, reward_type string, calc_method string, round_strategy string, priority int, reward_cal_break boolean, reward_rate string, cap_amount string, start_date date, end_date date, load_ord long"


def _tables(spark, seed: int):
    pick = random.Random(seed).choice
    day = lambda: datetime.date(2025, pick(range(1, 13)), pick(range(1, 28)))
    text = lambda: pick([None, "", "A", "b", "NONE", "CARD", "all", "Long b name"])
    txns = [(f"t{k}", pick([day(), None]), pick([None, "1", "A", "all"]), text(), text(), text(), text(), text(), text(), text(), pick([None, [], ["One"], ["two", "x"]])) for k in range(400)]
    txns = spark.createDataFrame(txns, "transaction_id string, transaction_date date, bank_no string, card_id string, payment_process string, ec_platform string, vpc_type string, merchant_location string, normalized_merchant string, merchant_display string, locked array<string>")
    programs = [
        (f"R{k}", pick(["1", "a", "ALL", None]), pick([None, "", "ALL", "B", "a"]), pick(["one", "two", None]), pick(["base", "campaign", None]), "NONE", "point", "PER_ITEM", None, pick([1, 2, None]), pick([True, False, False, None]), pick(["1.5", None]), None, pick([None, day()]), pick([None, day()]), k)
        for k in range(12)
    ]
    programs = spark.createDataFrame(programs, PROGRAM).withColumns({"reward_rate": F.col("reward_rate").cast("decimal(9,4)"), "cap_amount": F.col("cap_amount").cast("decimal(18,2)")})
    values = lambda: pick([None, None, [], ["a"], ["B", "none"], ["ALL"], ["CARD", None], ["b", "A"]])
    rule = lambda: (*(values() if pick(range(3)) == 0 else None for _ in reward_tables.LISTS), None, pick([None, None, day()]), None, None)
    pools = [(f"p{k}", f"pool {k}", pick([None, [], [rule()]]), pick([None, [], [rule()], [rule(), rule()]])) for k in range(9)]
    pools = spark.createDataFrame(pools, f"pool_id string, pool_name string, pass_rules array<{reward_tables.RULE}>, rules array<{reward_tables.RULE}>")
    pools = pools.withColumn("rules", F.transform("rules", lambda r: r.withField("merchant_rate", F.when(F.size(r["card_id"]) > 0, F.lit(2.5)).cast("decimal(9,4)"))))
    links = spark.createDataFrame([(f"r{k % 10}", f"P{pick(range(9))} ", k) for k in range(14)], "reward_id string, pool_id string, link_ord int")
    return txns, programs, links, pools


def test_conditions_give_what_arrays_give(spark):
    """Holders, days, selections, pools with pass rules, missing values and programs that end the calculation."""
    several = 0
    for seed in range(3):
        txns, programs, links, pools = _tables(spark, seed)
        numbered = rewards._numbered(programs)
        known = rewards._known_programs(numbered, links, pools, 12)
        names = [*(c for c in txns.columns if c != "locked"), "program_no", "pool_id", "pool_name", "rule_merchant", "rule_payment", F.when(F.col("program_no").isNotNull(), F.col("rate")).alias("rate")]
        written = rewards._programs_written_out(txns, known).select(*names)
        listed = rewards._programs_by_holder(txns, numbered, links, pools).select(*names)
        order = lambda df: sorted(map(str, df.collect()))
        got = order(written)
        assert got == order(listed) and len(got) > 400
        several += written.where("pool_id is not null").count()
    assert several > 0


def test_long_lists_are_no_conditions(spark):
    """Programs whose pools list more than can be written out go by their arrays, with the same result."""
    txns, programs, links, _ = _tables(spark, 1)
    pools = spark.createDataFrame([(f"p{k}", "pool", "[]", '[{"normalized_merchant":["b",' + ",".join(f'"m{n}"' for n in range(rewards.WRITTEN_OUT)) + "]}]") for k in range(9)], "pool_id string, pool_name string, pass_rules string, rules string")
    assert rewards._known_programs(rewards._numbered(programs), links, reward_tables.pools(pools), 12) is None
    assert rewards._known_programs(rewards._numbered(programs), links, reward_tables.pools(pools), rewards.WRITTEN_OUT + 1) is None


def test_rules_are_conditions_of_the_plan(spark, sf_dir):
    """The waterfall of few programs holds no array functions, which are worked out row by row without compiled code."""
    txns, programs, links, pools = registry._reward_config(spark, sf_dir)
    numbered = rewards._numbered(programs)
    plan = rewards._applied(txns, numbered, links, pools, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "_list0" not in plan


def test_caps_are_counted_for_what_is_asked(spark, sf_dir):
    """A query on one program's rewards counts no other caps; the waterfall before it is the whole one."""
    _, all_rows = registry._rewards(spark, sf_dir)
    _, some = registry._rewards(spark, sf_dir, only=F.col("reward_id") == "p3")
    names = ["transaction_id", "reward", "is_capped"]
    assert sorted(some.select(*names).collect()) == sorted(all_rows.where("reward_id = 'p3'").select(*names).collect()) and some.count() > 0
    plan = registry.reward_waterfall(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [sum" not in plan and "cycle_key" not in plan
