"""Intervals by day blocks, pool fields, and a run from Gold to the mart."""

from __future__ import annotations

import datetime
import random
from decimal import Decimal

from pyspark.sql import functions as F

from cardloom.functions import columns as C
from cardloom.operators import intervals, refine, rewards
from cardloom.plans import reward_run
from cardloom.sources import reward_tables

D = datetime.date
DAY = datetime.timedelta(days=1)


def test_days_meet_their_intervals(spark):
    """Random intervals, open ends, single days, ends in the wrong order, days before 1970, and null days and keys."""
    rng = random.Random(1)
    start = D(1965, 1, 1)
    spans = [(rng.choice("ab"), start + DAY * (a := rng.randrange(4000)), start + DAY * (a + rng.randrange(-3, 900)), k) for k in range(150)]
    spans += [("a", None, D(1966, 1, 1), 1000), ("b", D(1970, 1, 1), None, 1001), ("a", None, None, 1002), ("b", D(1970, 5, 5), D(1970, 5, 5), 1003), (None, None, None, 1004)]
    days = [(rng.choice("ab"), start + DAY * rng.randrange(4500), k) for k in range(200)] + [("a", None, 900), (None, D(1970, 1, 1), 901), ("b", D(1970, 5, 5), 902)]
    left = spark.createDataFrame(days, "key string, day date, id int")
    for held in (spans, spans[:150]):
        right = spark.createDataFrame(held, "key string, first date, last date, no int")
        out = {(r.id, r.no) for r in intervals.join_days(left, right, ["key"], "day", "first", "last").collect()}
        assert out == {(i, n) for k, d, i in days for q, a, b, n in held if d and k == q and k and (a is None or a <= d) and (b is None or d <= b)}
    near = {(r.no, r.near_day, r.apart) for r in intervals.days_near(right.where("no < 3"), "first", "last", 1).collect()}
    assert near == {(n, e + DAY * k, abs(k)) for _, a, b, n in spans[:3] for e in (a, b) for k in (-1, 0, 1)}


def test_many_intervals_need_no_nested_loop(spark):
    """A hundred thousand intervals of one bank: every row meets its own by equal keys."""
    n = 100_000
    days = spark.range(n).select((F.col("id") % 50).alias("bank"), F.date_add(F.lit("1900-01-01").cast("date"), (F.col("id") / 50 * 7).cast("int")).alias("first"))
    held = days.withColumn("last", F.date_add("first", 6))
    rows = spark.range(2000).select((F.col("id") % 50).alias("bank"), F.date_add(F.lit("1910-01-01").cast("date"), (F.col("id") * 3).cast("int")).alias("day"))
    out = intervals.join_days(rows, held, ["bank"], "day", "first", "last")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert out.where("day between first and last").count() == out.count() >= 2000


def test_statements_by_number_or_name(spark):
    """The card's own interval first, by id or type, then the bank's; statements follow each other by their month."""
    history = spark.createDataFrame(
        [("013", None, "2025-01", D(2025, 2, 7), None), ("013", None, "2025-02", D(2025, 3, 7), D(2025, 3, 8)), ("013", " Gold ", "2025-02", D(2025, 2, 20), None), ("013", None, "2025-03", None, None)],
        "bank_name string, card_type string, statement_month string, closing_date date, actual_closing_date date",
    )
    rows = spark.createDataFrame([(1, "013", "gold", D(2025, 2, 10)), (2, "013", "gold", D(2025, 3, 8)), (3, "013", "x", D(2025, 2, 7)), (4, "013", None, D(2025, 3, 9)), (5, None, None, None)], "id int, bank_no string, card_id string, posting_date date")
    out = refine.statement_of(rows, refine.billing_intervals(history))
    assert {r.id: r.statement_month for r in out.collect()} == {1: "2025-02", 2: "2025-02", 3: "2025-01", 4: "2025-03", 5: None}


def test_pool_rules_by_every_field(spark):
    """Each field alone lets a transaction through or not; NONE, ALL, CARD and missing values."""
    fields = ("bank_no", "card_id", "payment_process", "ec_platform", "vpc_type", "merchant_location", "normalized_merchant", "merchant_display")
    given = {
        "a": ("013", "C1", "LINE", None, "CARD", "TW", "ShopA", "Shop A 信義"), "b": ("812", "", None, "momo", "Apple Pay", None, None, "NONE"), "c": ("013", "c2", " ", "NONE", None, "JP", "ShopB", None),
    }
    rules = {
        '"bank_no":"013"': "ac", '"card_id":["c1"]': "a", '"card_id":"ALL"': "abc", '"bank_no":[]': "abc", '"payment_process":"NONE"': "bc", '"payment_process":["ALL"]': "a", '"ec_platform":["NONE","MOMO"]': "abc",
        '"vpc_type":"NONE"': "ac", '"vpc_type":"CARD"': "a", '"vpc_type":["all"]': "b", '"merchant_location":["TW","jp"]': "ac", '"normalized_merchant":"shop"': "ac", '"merchant_display":"信義"': "a", '"normalized_merchant":["NONE"]': "b",
        '"normalized_merchant":["ALL"]': "ac", '"normalized_merchant":[],"merchant_display":["zzz"]': "abc", '"note":"n"': "abc",
    }
    txns = spark.createDataFrame([(k, *v, D(2025, 5, 1)) for k, v in given.items()], ", ".join(["id string", *(f"{f} string" for f in fields), "transaction_date date"]))
    pools = reward_tables.pools(spark.createDataFrame([(r, "n", None, f"[{{{r}}}]") for r in rules], "pool_id string, pool_name string, pass_rules string, rules string"))
    txn = {f: F.col(f) for f in (*fields, "transaction_date")}
    hits = txns.join(pools, F.lit(True)).where(rewards.rule_holds(F.col("rules")[0], txn)).groupBy("pool_id").agg(F.array_join(F.array_sort(F.collect_set("id")), "").alias("ids"))
    assert {r.pool_id: r.ids for r in hits.collect()} == rules


PROGRAM = "reward_id string, bank_no string, card_id string, reward_program string, source string, reward_cycle string, reward_type string, calc_method string, round_strategy string, priority int, reward_cal_break boolean, reward_rate decimal(9,4), cap_amount decimal(18,2), start_date date, end_date date, load_ord int"


def tables(spark):
    programs = [
        ("R1", "013", "", "Alpha", "base", "BILLING_CYCLE", "tree_points", "PER_ITEM", "round", 10, False, Decimal(3), Decimal(40), None, None, 0),
        ("r2", "ALL", "ALL", "beta", "base", "TRANSACTION_DATE", "cashback", "PER_ITEM", None, 20, False, Decimal(1), None, None, None, 1),
        ("r3", "ALL", "ALL", "gamma", "campaign", "CALENDAR_MONTH", "openpoint", "PER_ITEM", "floor", 5, True, Decimal(10), None, None, None, 2),
    ]
    pools = reward_tables.pools(spark.createDataFrame([("P", "shops", None, '[{"normalized_merchant":"ShopX","card_id":"c"}]')], "pool_id string, pool_name string, pass_rules string, rules string"))
    chosen = spark.createDataFrame([("013", "C", D(2025, 1, 1), D(2025, 1, 31), "ALPHA", 0)], "bank_no string, card_id string, start_date date, end_date date, base_reward_program string, strategy_ord int")
    history = spark.createDataFrame([("013", None, "2025-01", D(2025, 1, 15), None), ("013", None, "2025-02", D(2025, 2, 15), None)], "bank_no string, card_id string, statement_month string, closing_date date, actual_closing_date date")
    links = spark.createDataFrame([("R3", "p", 0)], "reward_id string, pool_id string, link_ord int")
    return reward_run.RewardTables(spark.createDataFrame(programs, PROGRAM), links, pools, chosen, history)


def test_run_from_gold_to_mart(spark):
    """Excluded types go, locked programs whatever their case, caps by statement month, placeholders, units, and reading back."""
    day = D(2025, 1, 10)
    data = [
        ("t1", day, day, "013", "Bank", "c", "Card", "1000", C.PURCHASE, None, "shop"), ("t2", day, D(2025, 1, 16), "013", "Bank", "c", "Card", "1000", C.PURCHASE, None, "shop"),
        ("t3", D(2025, 1, 11), D(2025, 1, 12), "013", "Bank", "c", "Card", "1000", C.FOREIGN, None, "shop"), ("t4", day, day, "013", "Bank", "c", "Card", "500", C.PURCHASE, None, "my shopx"),
        ("t5", day, day, "013", "Bank", "c", "Card", "-100", C.REFUND, "LINE", "shop"), ("t6", day, day, "013", "Bank", "c", "Card", "9000", C.REPAYMENT, None, "pay"), ("t7", day, day, "812", "Other", "z", "Gold", "150", C.PURCHASE, None, "shop"),
        ("t8", D(2025, 3, 1), D(2025, 3, 2), "013", "Bank", "c", "Card", "200", None, None, "shop"),
    ]
    gold = spark.createDataFrame(data, "transaction_id string, transaction_date date, posting_date date, bank_no string, bank_name string, card_id string, card_type string, a string, transaction_type string, payment_process string, merchant string")
    gold = gold.withColumn("payment_amount", F.col("a").cast("decimal(18,2)"))
    run = reward_run.run_rewards(gold, tables(spark))
    out = {(r.transaction_id, r.reward_program): (float(r.calculated_reward), r.is_capped, r.pool_id) for r in run.report.collect()}
    assert out == {
        ("t1", "Alpha"): (30.0, False, "BASE_PROGRAM"), ("t3", "Alpha"): (13.0, True, "BASE_PROGRAM"), ("t2", "Alpha"): (30.0, False, "BASE_PROGRAM"),
        ("t4", "gamma"): (50.0, False, "P"), ("t5", "Alpha"): (-3.0, False, "BASE_PROGRAM"), ("t7", "beta"): (2.0, False, "BASE_PROGRAM"),
    }
    assert reward_run.run_rewards(gold, tables(spark), bank_no="812").report.select("transaction_id").collect()[0][0] == "t7"
    spark.sql("create database if not exists reward_test")
    assert reward_run.sync_mart(run.report, "reward_test") == {"rewards_monthly_summary": True, "rewards_pool_utilization": True}
    months, pools = reward_run.read_summary(spark, "reward_test").values()
    rows = {(r.month, r.bank_name): (r.total_spending, r.total_reward, r.effective_rate, r.reward_unit) for r in months.collect()}
    assert rows == {("2025-01", "Bank"): (3400.0, 120.0, 3.53, "小樹點"), ("2025-01", "Other"): (150.0, 2.0, 1.33, "元")}
    use = {(r.bank_name, r.pool_name): (r.total_reward, r.is_capped, r.cap_amount, r.reward_unit) for r in pools.collect()}
    assert use == {("Bank", "全通路基礎方案"): (70.0, True, 40.0, "小樹點"), ("Bank", "shops"): (50.0, False, 0.0, "OPENPOINT"), ("Other", "全通路基礎方案"): (2.0, False, 0.0, "元")}
    assert not reward_run.sync_mart(run.report.limit(0), "reward_test")["rewards_monthly_summary"] and spark.table("reward_test.rewards_monthly_summary").count() == 2
