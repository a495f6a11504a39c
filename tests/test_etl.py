"""Statements of four banks through to the mart, and the rules on the way."""

from __future__ import annotations

import datetime
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cardloom.functions import columns as C
from cardloom.operators import bronze, cards, filters, refine, rewards, segments, sinks, summaries
from cardloom.plans import etl
from cardloom.sources import bank_rules, bills, reward_tables

D = datetime.date


def rows(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()]


def test_card_headers(spark):
    data = [("f", 0, "王卡 卡號末四碼 1234"), ("f", 1, "shop"), ("f", 2, "信用卡繳款"), ("f", 3, "金卡(卡號 9876)"), ("f", 4, "other"), ("g", 0, "none")]
    df = spark.createDataFrame([(*r, "old") for r in data], "file string, line_no int, merchant string, card_no string")
    out = {r.merchant: (r.card_no, r.card_type) for r in bank_rules.fill_card_headers(df).collect()}
    assert out == {"shop": ("1234", "王卡"), "信用卡繳款": (None, None), "other": ("9876", "金卡"), "none": ("old", None)}
    kept = bank_rules.fill_card_headers(df, only=F.lit(False))
    assert kept.count() == 6 and set(rows(kept, "card_no")) == {"old"}


def test_joined_fields_points_wallets(spark):
    df = spark.createDataFrame([("SHOP  TOKYO 12/31", "x"), ("A B\tJP", None), ("plain", "玉山 Wallet"), ("玉山 e point 折抵現金 1,200 元", "Apple Pay"), (None, "掃碼 wallet 掃碼")], "merchant string, vpc_type string")
    df = df.withColumns({"payment_amount": F.lit("5"), "merchant_location": F.lit("TW"), "conversion_date": F.lit(None).cast("string")})
    assert rows(bank_rules.split_joined_merchant(df), "merchant", "merchant_location", "conversion_date")[:3] == [("SHOP", "TOKYO", "12/31"), ("A B", "JP", None), ("plain", "TW", None)]
    assert rows(bank_rules.e_points(df), "payment_amount", "transaction_type")[2:4] == [(Decimal(5), ""), (Decimal(-1200), C.POINTS)]
    assert rows(bank_rules.wallet_payment(df), "payment_process", "vpc_type") == [(None, "x"), (None, None), ("玉山Wallet", None), (None, "Apple Pay"), ("玉山Wallet", None)]


def test_card_numbers_dashes_redeemed(spark):
    df = spark.createDataFrame([("8888 / 0123", "點數折抵＿店"), ("7.0", "a"), ("nan", " － "), (None, None), ("12345/", "x - y")], "card_no string, merchant string")
    assert rows(bank_rules.split_card_numbers(df), "card_no", "vpc_no") == [("8888", "0123"), ("0007", ""), ("", ""), ("", ""), ("12345", "")]
    assert rows(bank_rules.tree_points(df), "merchant", "transaction_type")[:2] == [("小樹點折抵", C.POINTS), ("a", "")]
    assert rows(bank_rules.dashes_to_null(df), "merchant") == ["點數折抵＿店", "a", None, None, "x - y"]


def test_contract(spark):
    df = spark.createDataFrame(
        [("1", "7.0", "卡 12", "2025-01-02", "m", None, " 1,234.5 ", ""), ("2", "0013", "no digits", "bad", "<NA>", "USD", "nan", "-3"), ("3", None, "1234567", None, None, None, None, None)],
        "transaction_id string, bank_no string, card_no string, transaction_date string, merchant string, currency_type string, currency_amount string, payment_amount string",
    )
    out = bronze.contract(df)
    assert out.columns == list(bronze.CONTRACT)
    assert rows(out, "bank_no", "card_no", "raw_currency") == [("007", "0012", "TWD"), ("013", "no d", "USD"), (None, "4567", "TWD")]
    assert rows(out, "raw_amount", "payment_amount") == [(Decimal("1234.50"), Decimal("1234.50")), (Decimal(-3), Decimal(-3)), (Decimal(0), Decimal(0))]
    assert rows(out, "transaction_date", "raw_merchant") == [(D(2025, 1, 2), "m"), (None, None), (None, None)]


def test_extra_fields_come_back(spark):
    df = spark.createDataFrame([("a", "LINE", None), ("b", "nan", " ")], "merchant string, vpc_type string, note string")
    packed = bronze.pack_extra(df, ["merchant"])
    assert rows(packed, "raw_extra") == [{"vpc_type": "LINE"}, None] and packed.columns == ["merchant", "raw_extra"]
    assert rows(bronze.unpack_extra(packed, ["vpc_type"]), "vpc_type") == ["LINE", None]
    assert rows(bronze.unpack_extra(packed.withColumn("vpc_type", F.lit("own")), ["vpc_type"]), "vpc_type") == ["own", "own"]
    gold = bronze.enforced(spark.createDataFrame([("13.0", "x" * 20, "1,5", "None")], "bank_no string, merchant_location string, payment_amount string, merchant string"))
    assert rows(gold, "bank_no", "merchant_location", "payment_amount", "merchant") == [("013", "x" * 10, Decimal(15), None)]


def test_types_and_what_they_put_right(spark):
    columns = "merchant string, transaction_type string, payment_amount decimal(18,2), currency_amount decimal(18,2), payment_currency string, currency_type string, merchant_location string, card_no string, card_type string"
    data = [
        ("自動繳款 x", "", None, Decimal(5), "TWD", "USD", "US", "1", "t"), ("points", None, None, Decimal(2), None, "JPY", "JP", "1", "t"), ("年費", " ", Decimal(9), None, "TWD", "JPY", "JP", "1", "t"),
        ("shop", "", Decimal(-1), None, "TWD", "TWD", "JP", "1", "t"), ("shop", "", Decimal(1), None, "TWD", "USD", "US", "1", "t"), ("shop", "", Decimal(1), None, "TWD", "TWD", "US", "1", "t"),
        ("shop", "", Decimal(1), None, "USD", "USD", "US", "1", "t"), ("shop", "", Decimal(1), None, "USD", "USD", None, "1", "t"), ("繳款", "手動", Decimal(1), None, "TWD", "TWD", "TW", "1", "t"),
    ]
    out = refine.classify(spark.createDataFrame(data, columns), {"payment": ["自動.*款", "^繳款"], "credit": ["POINTS"], "fee": ["年費"]}).collect()
    assert [r.transaction_type for r in out] == [C.REPAYMENT, C.POINTS, C.FEE, C.REFUND, C.FOREIGN, C.FOREIGN_TWD, C.FOREIGN_DUAL, C.PURCHASE, "手動"]
    assert [(r.merchant_location, r.payment_currency, r.currency_type, r.card_no) for r in out[:3]] == [("TW", "USD", "USD", None), ("TW", "JPY", "JPY", "1"), ("TW", "TWD", "TWD", "1")]
    assert [r.payment_amount for r in out[:3]] == [5, 2, 9] and out[8].card_no == "1"


CARDS = [
    '{"card_id":"A","bank_no":"013","card_type":"gold","card_history":[{"card_no":"8888","card_network":"VISA","status":"cancelled","vpc_pay":[{"vpc_no":"0123","vpc_type":"LINE Pay"}]},{"card_no":"7777","card_network":"VISA","status":"Active","vpc_pay":[]}]}',
    '{"card_id":"B","bank_no":"812","card_type":"blue","card_history":[{"card_no":"5678","card_network":"VISA","status":"cancelled","vpc_pay":[]}]}',
    '{"card_id":"C","bank_no":"812","card_type":" ","card_history":[]}',
]


@pytest.fixture(scope="module")
def nested(spark):
    return spark.read.json(spark.sparkContext.parallelize(CARDS))


def test_cards(spark, nested):
    outer, history, virtual = cards.card_tables(nested)
    assert (outer.count(), history.count(), rows(virtual, "card_no", "vpc_no", "vpc_type")) == (3, 3, [("8888", "0123", "LINE Pay")])
    status = cards.card_status(nested)
    assert dict(rows(status, "card_type", "status")) == {"gold": "active", "blue": "cancelled"}
    df = spark.createDataFrame([("gold",), ("blue ",), ("new",), (None,)], "card_type string")
    assert sorted(rows(cards.with_status(df, status), "status")) == ["active", "active", "active", "cancelled"]
    ways = [{"payment_process_pattern": "line.*pay", "payment_process": "Linepay", "process_prefix": "LINE"}, {"payment_process_pattern": " "}]
    df = spark.createDataFrame([("LINE Pay", None), ("LINE pay", "own"), ("CARD", None), ("x", None), (None, None)], "vpc_type string, payment_process string")
    assert rows(cards.vpc_to_payment(df, ways), "payment_process", "prefix", "vpc_type") == [("Linepay", "LINE", ""), ("own", "LINE", ""), (None, None, "CARD"), (None, None, "x"), (None, None, None)]


def test_units_and_counts(spark):
    kinds = {"TREEPOINTS": "小樹點", "line_points": "LINE POINTS", "openpoint": "OPENPOINT", "ESUNPOINT_FLOOR": "玉山 e point", "e_points": "玉山 e point", "hami": "Hami Point", "紅利": "紅利點數", "cashback": "元", None: "元", "": "元"}
    df = spark.createDataFrame([(k,) for k in kinds], "k string")
    assert {r.k: r.u for r in df.select("k", summaries.reward_unit(F.col("k")).alias("u")).collect()} == kinds
    paid = spark.createDataFrame([("c", "line_points", 1), ("c", "hami", 2), ("c", "hami", 0), ("d", "openpoint", 0), ("c", None, 9)], "card string, reward_type string, reward int")
    assert rows(summaries.predominant_units(paid, "card"), "card", "reward_unit") == [("c", "Hami Point")]
    assert dict(rows(summaries.predominant_units(paid.where("reward = 0"), "card"), "card", "reward_unit")) == {"c": "Hami Point", "d": "OPENPOINT"}
    assert sorted(rows(segments.value_counts(paid, "reward_type"), "reward_type", "n")) == [("hami", 2), ("line_points", 1), ("openpoint", 1)]
    old = spark.createDataFrame([("潛力新星 (Rising)",), (None,), ("x",)], "s string")
    assert rows(old.select(segments.repaired_segment(F.col("s")).alias("s")), "s") == ["潛力商家 (Rising)", "一般活躍 (Active)", "x"]


def test_largest_outliers(spark):
    data = [("LINE", "food", "g", f"m{k}", D(2025, 1, 1), Decimal(10 + k % 5)) for k in range(200)] + [("LINE", "food", "g", None, D(2025, 2, k + 1), Decimal(1000 + k)) for k in range(28)]
    data += [(None, " ", None, "m", D(2024, 1, 1), Decimal(3)), ("LINE", "food", "g", "m", D(2025, 1, 1), Decimal(-5))]
    df = spark.createDataFrame(data, "payment_process string, category string, card_type string, normalized_merchant string, transaction_date date, payment_amount decimal(18,2)")
    out = {r.category: r for r in segments.volatility_view(df).collect()}
    assert set(out) == {"food", "未分類"} and out["food"].n == 228 and out["food"].n_outliers == 28
    assert [o.amount for o in out["food"].outliers] == [1027.0 - k for k in range(25)] and out["food"].outliers[0].merchant == "未知商家"
    assert out["未分類"].outliers == [] and out["未分類"].rfm_segment == "沉睡 (Dormant)" and out["food"].rfm_segment == "核心 (Core)"
    assert segments.volatility_view(df, "card_payment", card="g").count() == 1 and segments.volatility_view(df, "no such mode").columns[0] == "category"


def test_reward_tables(spark):
    base = spark.createDataFrame([("b1", "013", "nan", "cube", "x", "TRUE", "1.5", "2025-01-01", 0)], "base_reward_id string, bank_no string, card_id string, base_reward_program string, base_priority string, reward_cal_break string, base_reward_rate string, start_date string, load_ord int")
    more = spark.createDataFrame([("c1", "ALL", "gold", "5", "100", 0)], "campaigns_reward_id string, bank_no string, campaign_reward_program string, campaign_priority string, cap_amount string, load_ord int")
    out = reward_tables.programs(base, more).orderBy("load_ord").collect()
    assert [(r.reward_id, r.source, r.priority, r.reward_cal_break, r.card_id) for r in out] == [("b1", "base", 999, True, None), ("c1", "campaign", 5, False, None)]
    assert out[0].start_date == D(2025, 1, 1) and out[1].cap_amount == 100 and out[1].reward_rate is None and out[1].reward_program == "gold"
    linked = spark.createDataFrame([("b1", "p1", 0), (" ", "p2", 1), ("c1", None, 2)], "reward_id string, merchant_reward_pools_id string, load_ord int")
    assert rows(reward_tables.links(linked), "reward_id", "pool_id") == [("b1", "p1")]
    text = '[{"normalized_merchant":["x","y"],"card_id":"C1","bank_no":["013"],"merchant_rate":2.5,"start_date":"2025-01-01","note":"n"},{"merchant_display":"z","payment_process":null}]'
    pools = spark.createDataFrame([("p1", "a", None, text), ("p2", "b", "no list", "[]")], "merchant_reward_pools_id string, pool_name string, pass_rules string, rules string")
    pool, other = reward_tables.pools(pools).orderBy("pool_id").collect()
    first, second = pool.rules
    assert pool.pass_rules == [] and first.normalized_merchant == ["x", "y"] and first.card_id == ["C1"] and first.bank_no == ["013"] and float(first.merchant_rate) == 2.5 and first.start_date == D(2025, 1, 1) and first.note == "n"
    assert second.merchant_display == ["z"] and second.payment_process is None and second.normalized_merchant is None and second.merchant_rate is None and (other.pass_rules, other.rules) == ([], [])
    flat = spark.createDataFrame([("p", "a, b,", "3", "false", 1), ("p", "c", None, "1", 0), ("p", "", "1", None, 0)], "pool_id string, card_id string, merchant_rate string, is_pass string, rule_ord int")
    (pool,) = reward_tables.pools_from_rows(flat).collect()
    assert [r.card_id for r in pool.rules] == [None, ["a", "b"]] and [r.card_id for r in pool.pass_rules] == [["c"]]
    back = reward_tables.pools_from_rows(reward_tables.pools_to_rows(reward_tables.pools_from_rows(flat)))
    assert back.collect() == reward_tables.pools_from_rows(flat).collect()
    days = spark.createDataFrame([("a", "2025-01-01", "2025-02-01", "n"), ("b", "no", None, None)], "reward_program string, start_date string, end_date string, remark string")
    assert rows(reward_tables.selections(days), "base_reward_program", "note") == [("a", "n")] and reward_tables.missing_tables(spark, ["no_such_table"]) == ["no_such_table"]


def test_selected_programs(spark):
    days = [("013", None, D(2025, 1, 1), D(2025, 1, 31), "A", 0), ("013", None, D(2025, 2, 1), D(2025, 2, 28), "B", 0), ("", "C9", D(2025, 1, 1), D(2025, 12, 31), "R", 1)]
    chosen = spark.createDataFrame(days, "bank_no string, card_id string, start_date date, end_date date, base_reward_program string, strategy_ord int")
    data = [
        (1, "013", "c", D(2025, 1, 15), C.PURCHASE, None), (2, "013", "c", D(2025, 1, 30), C.PURCHASE, "LINE"), (3, "013", "c", D(2025, 1, 30), C.FOREIGN, ""), (4, "013", "c", D(2025, 2, 1), C.FOREIGN_DUAL, None),
        (5, "812", "c9", D(2025, 6, 1), C.PURCHASE, None), (6, "812", "x", D(2025, 6, 1), C.PURCHASE, "LINE"), (7, "013", "C9", D(2025, 3, 1), None, "LINE"), (8, None, None, None, None, None),
    ]
    txns = spark.createDataFrame(data, "id int, bank_no string, card_id string, transaction_date date, transaction_type string, payment_process string")
    out = {r.id: (r.locked, r.verify) for r in rewards.active_selection(txns, chosen).collect()}
    assert out == {1: (["A"], False), 2: (["A"], True), 3: (["A"], True), 4: (["B"], True), 5: (["R"], False), 6: (None, False), 7: ([], True), 8: (None, False)}


def test_category_order_and_pivots(spark):
    df = spark.createDataFrame([("x保險", 1), ("便利商店", 2), ("百貨量販", 3), ("其他類", 4), ("保險費用", 5)], "c string, payment_amount int")
    assert rows(df.orderBy(summaries.category_place(F.col("c"))), "c") == ["百貨量販", "便利商店", "其他類", "保險費用", "x保險"]
    more = df.unionByName(df.limit(2))
    for how, value in (("sum", 4.0), ("count", 2.0), ("mean", 2.0)):
        assert summaries.pivot(more.where("c = '便利商店'"), F.lit(1).alias("r"), "c", ["便利商店", "none"], how=how).collect()[0][1:] == (value, 0.0)


def write(folder, name, text, encoding):
    (folder / name).write_bytes(text.encode(encoding))


def test_statements_to_mart(spark, tmp_path, nested):
    """Files of all four banks, one refused, one unknown, then the same folder again with one file more."""
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder, "202510國泰世華.csv", "x\n消費日,入帳起息日,交易說明,消費國家/幣別,消費金額,新臺幣金額,卡號/行動末四碼,折算日\n10/01,10/03,\"SHOP, A\",JP/JPY,5000,\"1,050\",8888 / 0123,10/02\n10/05,10/06,點數折抵＿B,TW/TWD,－,-20,8888,－\n正卡消費\n", "utf-8-sig")
    write(folder, "中國信託_20260108.csv", "消費日,入帳起息日,摘要,幣別,消費地金額,新臺幣金額,末四碼,外幣折算日,消費地\n114/12/30,115/01/02,連加*店,TWD,50,50,5678,,TWN\n", "cp950")
    write(folder, "玉山銀行_202511.csv", "消費日,入帳日,消費明細,交易類別,幣別,金額,繳款幣別,金額.1,行動支付,卡號末四碼\n,,王卡 卡號末四碼 1234,,,,,,,\n11/02,11/03,CAFE  TOKYO 11/03,,JPY,900,TWD,200,玉山Wallet,\n11/04,11/05,信用卡繳款,,TWD,,TWD,-900,,\n", "utf-8")
    html = "<table><tr><th>消費日</th><th>入帳日</th><th>消費明細</th><th>國別</th><th>幣別</th><th>外幣金額</th><th>新臺幣金額</th></tr><tr><td></td><td></td><td>金卡(卡號 9876)</td></tr><tr><td>11/02</td><td>11/03</td><td>店</td><td>TW</td><td>TWD</td><td></td><td>200</td></tr></table>"
    write(folder, "華南銀行_202511.xls", html, "big5")
    write(folder, "華南銀行_202512.xls", html.replace("店", "x; DROP TABLE t"), "big5")
    write(folder, "other.csv", "消費日,交易說明\n1/1,x\n", "utf-8")
    rules = etl.Rules(
        gateways=[{"payment_process_pattern": "連加|line", "payment_process": "Linepay", "process_prefix": "LINE"}],
        platforms=[{"platform_pattern": "momo", "ec_platform": "momo", "ec_category": "購物", "ec_sub_category": ""}],
        merchants=[{"merchant_pattern": "shop", "normalized_merchant": "Shop", "category": "購物", "sub_category": "s"}],
        words={"payment": ["繳款"]}, bank_names={"013": "國泰世華", "822": "中國信託", "808": "玉山銀行", "008": "華南銀行"}, cards=bills.card_table(nested),
    )
    gold, status = etl.run_etl(spark, str(folder), rules)
    by_name = {r.merchant: r for r in gold.collect()}
    assert set(by_name) == {"SHOP, A", "小樹點折抵", "連加*店", "CAFE", "信用卡繳款", "店"}
    a = by_name["SHOP, A"]
    assert (a.card_id, a.card_no, a.payment_process, a.normalized_merchant, a.transaction_type, a.payment_amount) == ("A", "8888", "Linepay", "Shop", C.FOREIGN, Decimal("1050.00"))
    assert by_name["小樹點折抵"].transaction_type == C.POINTS and by_name["連加*店"].display_name == "LINE－連加*店" and by_name["連加*店"].bank_no == "822"
    assert (by_name["CAFE"].card_no, by_name["CAFE"].payment_process, by_name["CAFE"].merchant_location, by_name["CAFE"].conversion_date) == ("1234", "玉山Wallet", "TOKYO", D(2025, 11, 3))
    assert by_name["信用卡繳款"].transaction_type == C.REPAYMENT and by_name["信用卡繳款"].card_no is None and by_name["店"].card_no == "9876"
    assert dict(rows(status, "file", "status")) == {"202510國泰世華.csv": "SUCCESS", "中國信託_20260108.csv": "SUCCESS", "玉山銀行_202511.csv": "SUCCESS", "華南銀行_202511.xls": "SUCCESS", "華南銀行_202512.xls": "FAILED", "other.csv": "SKIPPED"}
    spark.sql("create database if not exists etl_test")
    written = etl.run(spark, str(folder), rules, "etl_test")
    assert written["rfm_merchants"] and written["volatility_card_payment"] and spark.table("etl_test.transactions").count() == 6
    write(folder, "華南銀行_202601.xls", html.replace("店", "新"), "big5")
    again = etl.run(spark, str(folder), rules, "etl_test")
    assert again["trend"] and sorted(rows(spark.table("etl_test.transactions"), "merchant")) == sorted([*by_name, "新"])
    assert not sinks.overwrite_mart({"rfm_merchants": spark.table("etl_test.rfm_merchants").limit(0)}, "etl_test")["rfm_merchants"] and spark.table("etl_test.rfm_merchants").count() > 0
    sinks.export_csv(spark.table("etl_test.volatility_category_only"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == spark.table("etl_test.volatility_category_only").count()
    assert sinks.read_mart(spark, "rfm_merchants", "etl_test").count() == spark.table("etl_test.rfm_merchants").count()
    assert json.loads(sinks.payload(spark.table("etl_test.files")).first().payload).keys() == {"file", "file_hash", "status"}
    odd = spark.createDataFrame([("未分類", False), ("交易", True), ("交易", False)], "transaction_type string, fx_missing boolean")
    assert rows(sinks.anomalies(odd), "reason") == ["uncategorized", "fx_missing"]


def test_gold_ids_follow_the_keys_or_stay(spark):
    """Given ids stay if every row has one; else equal rows differ by their number and others by day, merchant, card, amount, type."""
    data = [("a", D(2025, 1, 1), "shop", "1234", Decimal(5), "x", "1"), ("b", D(2025, 1, 1), "shop", "1234", Decimal(5), "x", "2"), ("c", D(2025, 1, 1), "shop", "1234", Decimal(6), "x", "3")]
    df = spark.createDataFrame(data, "transaction_id string, transaction_date date, merchant string, card_no string, payment_amount decimal(18,2), transaction_type string, raw_merchant string")
    assert [r.transaction_id for r in etl.with_gold_ids(df, ["raw_merchant"]).orderBy("raw_merchant").collect()] == ["a", "b", "c"]
    lacking = df.withColumn("transaction_id", F.when(F.col("transaction_id") != "b", F.col("transaction_id")).otherwise(" "))
    ids = [r.transaction_id for r in etl.with_gold_ids(lacking, ["raw_merchant"]).orderBy("raw_merchant").collect()]
    expected = df.select(*(C.hashed_id(*(F.col(k) for k in etl.ID_KEYS), F.lit(n)).alias(f"i{n}") for n in (0, 1))).orderBy("i0").distinct().collect()
    assert len(set(ids)) == 3 and {ids[0], ids[1]} <= {x for r in expected for x in r} and all(len(i) == 32 for i in ids)
    assert len({r.transaction_id for r in etl.with_gold_ids(df.drop("transaction_id"), ["raw_merchant"]).collect()}) == 3


def test_payload_numbers_at_any_depth(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, [nan, 1.5], {"k": inf, "l": 2.0}, (nan, [(inf, "t")]), None)], "id int, a array<double>, m map<string,double>, s struct<x:double,y:array<struct<z:float,t:string>>>, n double")
    assert json.loads(sinks.payload(df).first().payload) == {"id": 1, "a": [None, 1.5], "m": {"k": None, "l": 2.0}, "s": {"x": None, "y": [{"z": None, "t": "t"}]}, "n": None}


def test_menu_of_cards_and_payments(spark):
    cards_ = spark.createDataFrame([("gold",), (" gold",), (None,), ("",), ("blue",)], "card_type string")
    ways = spark.createDataFrame([("LINE", "3"), ("LINE", "1"), ("late", "25"), (" ", "2"), ("x", "no")], "payment_process string, priority string")
    assert sorted(rows(filters.menu_names(cards_, ways), "kind", "name", "place")) == [("card", "blue", 0), ("card", "gold", 0), ("payment", "LINE", 1)]
    some = spark.createDataFrame([(None, None, "Shown", None), (Decimal(5), "Norm", "x", "y")], "payment_amount decimal(18,2), normalized_merchant string, merchant_display string, category string")
    assert rows(filters.prepared(some.withColumn("transaction_type", F.lit(C.PURCHASE)), ["未分類", "y"]), "normalized_merchant", "category", "sub_category") == [("Shown", "未分類", ""), ("Norm", "y", "")]
