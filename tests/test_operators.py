"""Expected values of single operators on small literal tables."""

from __future__ import annotations

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cardloom.functions import columns as C
from cardloom.operators import filters, refine, rewards, segments, summaries
from cardloom.sources import bills
from cardloom.streaming import ingest

D = datetime.date


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("payments", "direct", "expected"),
    [(["A"], True, {1, 3, 4}), (["A"], False, {1}), ([], True, {3, 4}), ([], False, set()), (None, True, {1, 2, 3, 4}), (None, False, {1, 2})],
)
def test_payment_filter(spark, payments, direct, expected):
    df = spark.createDataFrame([(1, "A"), (2, "B"), (3, None), (4, " ")], "id int, payment_process string")
    assert {r.id for r in df.where(filters.payment_is(payments, direct)).collect()} == expected


@pytest.mark.parametrize(("place", "expected"), [("國內", {1, 2, 3}), ("國外", {4}), (None, {1, 2, 3, 4}), (["JP"], {4}), ("both", {1, 2, 3, 4}), (["國內"], {1, 2, 3}), (["國外", "JP"], {4}), (["國內", "國外"], {1, 2, 3, 4}), ([], {1, 2, 3, 4})])
def test_place_filter(spark, place, expected):
    df = spark.createDataFrame([(1, "TW"), (2, "臺灣"), (3, None), (4, "JP")], "id int, merchant_location string")
    assert {r.id for r in df.where(filters.place_is(place)).collect()} == expected


def test_windows():
    day = D(2026, 6, 10)
    back = {30: ("30d", "1M", "last_month", "近一個月"), 90: ("90D", "3m", "LAST_QUARTER", "近一季"), 180: ("6M", "近半年"), 365: ("1y", "last_year", "近一年"), 730: ("2Y", "近兩年")}
    for days, names in back.items():
        assert {filters.resolve_window(n, day) for n in names} == {(day - datetime.timedelta(days=days), day)}
    assert filters.resolve_window("YTD", day) == filters.resolve_window("今年", day) == (D(2026, 1, 1), day)
    assert {filters.resolve_window(n, day) for n in ("prev_year", "LAST_CALENDAR_YEAR", "去年")} == {(D(2025, 1, 1), D(2025, 12, 31))}
    assert {filters.resolve_window(n, day) for n in ("lifetime", "", None, "全歷史", "no such window")} == {(None, None)}


def test_banks_by_any_name():
    banks = [{"bank_id": "cathay", "bank_no": "013", "bank_name": "國泰世華", "keywords": ["CUBE"]}]
    assert filters.bank_names(["cube", "013", "other"], banks) == ["013", "CUBE", "cathay", "other", "國泰世華"]


@pytest.mark.parametrize("ranges", [2, 200])
def test_rank_shares_ties(spark, monkeypatch, ranges):
    monkeypatch.setattr(C, "RANGES", ranges)
    df = spark.createDataFrame([(k, v) for k, v in enumerate((5, 1, 1, 9, 5, 5, None))], "k int, v int")
    out = C.rank_shares(df, ["k"], {"up": (F.col("v"), False), "down": (F.col("v"), True), "none": (F.lit(None), False)}).collect()
    assert {r.v: r.up for r in out} == {1: 0.25, 5: pytest.approx(2 / 3), 9: 1.0, None: None}
    assert {r.v: r.down for r in out} == {1: pytest.approx(5.5 / 6), 5: 0.5, 9: pytest.approx(1 / 6), None: None}
    assert len(out) == 7 and {r.none for r in out} == {None}


def test_rank_shares_equal_a_sort(spark):
    rng = random.Random(4)
    values = [rng.choice((rng.randrange(40), rng.random() * 1000)) for _ in range(3000)]
    out = C.rank_shares(spark.createDataFrame(list(enumerate(map(float, values))), "k int, v double"), ["k"], {"p": (F.col("v"), False)}).collect()
    place = sorted(values)
    assert all(r.p == pytest.approx((place.index(r.v) + 1 + (place.count(r.v) - 1) / 2) / 3000) for r in out)


def test_rfm_values(spark):
    rows = [(D(2026, 6, 5), "t1", "100", "ShopA"), (D(2026, 6, 4), "t2", "200", "ShopA"), (D(2026, 6, 9), "t3", "300", "ShopB"), (D(2025, 1, 1), "t4", "50", "Old"), (D(2026, 6, 9), "t3", "1", None)]
    df = spark.createDataFrame(rows, "transaction_date date, transaction_id string, a string, m string").withColumn("payment_amount", F.col("a").cast("decimal(18,2)"))
    out = {r.m: r for r in segments.rfm(df, ["m"], {"d30": 30, "life": None}).collect()}
    assert (out["ShopA"].life_recency, out["ShopA"].life_frequency, out["ShopA"].life_monetary) == (5, 2, 300.0)
    assert out["ShopA"].life_r_rank == pytest.approx(2 / 3) and out["ShopB"].life_r_rank == 1.0 and out["ShopB"].d30_m_rank == 0.75
    assert (out["Old"].d30_recency, out["Old"].d30_frequency, out["Old"].d30_monetary, out["Old"].d30_m_rank) == (9999, 0, 0.0, 0.0) and None not in out
    assert segments.rfm(df.limit(0), ["m"]).collect() == []


def test_dates_amounts_codes(spark):
    date = lambda text, y=2026, m=1: one(spark, C.smart_date(F.lit(text), F.lit(y), F.lit(m).cast("int")))
    assert date("2025/10/05") == D(2025, 10, 5) and date("115/05/07") == D(2026, 5, 7) and date("12/31") == D(2025, 12, 31)
    assert date("01/02", 2025, 12) == D(2026, 1, 2) and date("13/45") is None and date("no") is None and date("01/02", 2025, None) is None
    months = spark.createDataFrame([(bill, m) for bill in range(1, 13) for m in range(1, 13)], "bill int, m int")
    found = months.select("bill", "m", F.year(C.smart_date(F.concat_ws("/", "m", F.lit(5)), F.lit(2025), F.col("bill"))).alias("y")).collect()
    assert all(r.y == 2025 - (r.m - r.bill > 6) + ((r.bill, r.m) == (12, 1)) for r in found)
    amount = lambda text: float(one(spark, C.clean_amount(F.lit(text))))
    assert [amount(t) for t in ("1,234.50", "(20)", "$-200", "30-", "－5", "x", "")] == [1234.5, -20, -200, -30, -5, 0, 0]
    assert one(spark, C.code(F.lit("7.0"), 3)) == "007" and one(spark, C.code(F.lit("12345"), 4)) == "2345"
    assert one(spark, C.location(F.lit("jpn"))) == "JP" and one(spark, C.currency(F.lit(None).cast("string"))) == "TWD"
    assert one(spark, C.month_key(F.lit(None).cast("date"))) == "UNKNOWN"


@pytest.mark.parametrize(("how", "value", "expected"), [("floor", "10.8", 10), ("round", "10.5", 11), ("ceil", "10.1", 11), ("round", "-2.5", -3), ("up", "10.2", 11), (" Down", "10.8", 10), ("ceiling", "10.2", 11), ("other", "10.5", 11), (None, "10.5", 11)])
def test_rounding(spark, how, value, expected):
    assert float(one(spark, C.rounded(F.lit(Decimal(value)).cast("decimal(18,4)"), F.lit(how), F.lit(0)))) == expected


def test_currency_conversion(spark):
    rows = [(1, "2025-10-01", "JPY", "JPY", "10000"), (2, "2025-10-01", "TWD", "TWD", "50"), (3, "2025-10-01", "EUR", "EUR", "7"), (4, None, "JPY", "JPY", "9"), (5, "2025-10-01", "X", "JPY", "100")]
    df = spark.createDataFrame(rows, "id int, conversion_date string, payment_currency string, currency_type string, payment_amount string")
    df = df.withColumn("payment_amount", F.col("payment_amount").cast("decimal(18,2)"))
    rates = spark.createDataFrame([("2025-10-01", "jpy", 0.1, 0), ("2025-10-01", "jpy", 0.2185, 1)], "conversion_date string, currency_type string, fx_rate double, load_ord int")
    out = {r.id: (float(r.payment_amount), r.payment_currency, r.fx_missing) for r in refine.convert_currency(df, rates).collect()}
    assert out == {1: (2185.0, "TWD", False), 2: (50.0, "TWD", False), 3: (7.0, "EUR", True), 4: (9.0, "JPY", False), 5: (22.0, "TWD", False)}


def test_rules_and_names(spark):
    rules = [{"p": "pay", "a": "late", "priority": 9}, {"p": "ＬＩＮＥ", "a": None, "b": "x", "priority": 1}, {"p": "line|pay", "a": "first", "b": "y", "priority": 1}]
    df = spark.createDataFrame([("ｌｉｎｅ line pay",), ("Pay",), (None,), ("none",)], "m string")
    whole = {r.m: (r.rule_no, r.a, r.b) for r in refine.tag(df, "m", rules, "p", ["a", "b"]).collect()}
    assert whole == {"ｌｉｎｅ line pay": (0, None, "x"), "Pay": (1, "first", "y"), None: (None, None, None), "none": (None, None, None)}
    each = {r.m: (r.a, r.b) for r in refine.tag_each(df, "m", rules, "p", ["a", "b"]).collect()}
    assert each["ｌｉｎｅ line pay"] == ("first", "x")
    assert one(spark, refine.display_name(F.lit("LINE－ "), F.lit("momo"), F.lit("momo"))) == "LINE－momo"
    kinds = [("繳款 auto", 5, "TW", "TWD", None), ("a", -5, "TW", "TWD", None), ("a", 5, "JP", "JPY", None), ("a", 5, "JP", "TWD", ""), ("a", 5, None, "USD", None), ("a", -5, "TW", "TWD", "手動")]
    df = spark.createDataFrame(kinds, "m string, a int, p string, c string, g string")
    kind = refine.transaction_type(F.col("m"), F.col("a"), F.col("p"), F.col("c"), F.col("g"), {"payment": ["繳.*auto"]})
    assert [r.k for r in df.select(kind.alias("k")).collect()] == [C.REPAYMENT, C.REFUND, C.FOREIGN, C.FOREIGN_TWD, C.PURCHASE, "手動"]


def test_equal_rows_get_different_ids(spark):
    df = spark.createDataFrame([("a", 1, k) for k in range(2)] + [("b", None, 0)], "m string, x int, line int")
    out = refine.with_ids(df, ["m", "x"], ["line"]).collect()
    assert len({r.transaction_id for r in out}) == 3 and sorted(r.seq for r in out) == [0, 0, 1] and all(len(r.transaction_id) == 32 for r in out)


def test_forward_fill_and_intervals(spark):
    df = spark.createDataFrame([("f", 0, "card 1234"), ("f", 1, "x"), ("f", 2, "card 9"), ("f", 3, "y"), ("g", 0, "z")], "file string, line int, t string")
    out = refine.forward_fill(df, F.col("t").startswith("card"), F.regexp_extract("t", r"(\d+)", 1), "file", "line", "card_no")
    assert {(r.t, r.card_no) for r in out.collect()} == {("x", "1234"), ("y", "9"), ("z", None)}
    history = spark.createDataFrame([("013", None, "2025-01", D(2025, 2, 7), None), ("013", None, "2025-02", D(2025, 3, 8), D(2025, 3, 9))], "bank_no string, card_id string, statement_month string, closing_date date, actual_closing_date date")
    intervals = refine.billing_intervals(history)
    assert {(r.first_day, r.last_day) for r in intervals.collect()} == {(D(2025, 1, 8), D(2025, 2, 7)), (D(2025, 2, 8), D(2025, 3, 9))}
    rows = spark.createDataFrame([(1, "013", "c", D(2025, 2, 7)), (2, "013", "c", D(2025, 2, 8)), (3, "999", None, D(2025, 2, 8))], "id int, bank_no string, card_id string, posting_date date")
    assert {r.id: r.statement_month for r in refine.statement_of(rows, intervals).collect()} == {1: "2025-01", 2: "2025-02", 3: "2025-02"}


def test_card_lookup_order(spark):
    cards = spark.createDataFrame(
        [("1111", "9001", "A", "ta", "013", "LINE", 0), ("1111", "1111", "B", "tb", "013", "CARD", 1), ("2222", "7", "C", "tc", "812", "X", 2)],
        "card_no string, vpc_no string, card_id string, card_type string, bank_no string, vpc_type string, load_ord int",
    )
    df = spark.createDataFrame([(1, "1111", "9001"), (2, "1111", None), (3, "2222", "8"), (4, "0", None)], "id int, card_no string, vpc_no string").withColumns({"bank_no": F.lit(""), "vpc_type": F.lit(None).cast("string")})
    assert {r.id: r.card_id for r in refine.match_cards(df, cards).collect()} == {1: "A", 2: "B", 3: "C", 4: None}


def test_upsert(spark):
    old, new = (spark.createDataFrame(rows, "k int, v string") for rows in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert {tuple(r) for r in refine.merge_by_key(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert [r.k for r in refine.only_new(new, old, ["k"]).collect()] == [3]


def test_tiers(spark):
    df = spark.createDataFrame([(None,), ("",), ("實體卡/其他",), ("LINE Pay",), ("連加*x",), ("icash pay",), ("悠遊付 x",), ("taiwan 台灣Pay",), ("cash",)], "p string")
    found = [r.t for r in df.select(summaries.tier(F.col("p")).alias("t")).collect()]
    assert found == ["實體卡/虛擬卡"] * 3 + ["Linepay", "Linepay", "icash Pay", "悠遊付", "台灣pay", "其他"]
    given = spark.createDataFrame([("街口支付", "2"), ("line pay", "1"), ("PXPay", "16"), ("x", "17"), (None, "3"), ("y", "no")], "payment_process string, priority string")
    assert summaries.payment_tiers(given) == (["Linepay", "街口支付"], ["PXPay"])
    assert summaries.payment_tiers(given.limit(0)) == (list(summaries.TIER_1), list(summaries.TIER_2))


def test_default_rounding_and_keys(spark):
    """Rounding by reward type where a program gives none; null parts of a key stay apart."""
    rows = spark.createDataFrame([("CASHBACK_FLOOR", None, "1.9"), ("point", None, "1.5"), ("ESUNPOINT_FLOOR", "up", "1.1"), ("openpoint", "", "1.005")], "reward_type string, round_strategy string, a string")
    rows = rows.withColumns({"amount": F.col("a").cast("decimal(18,3)"), "rate": F.lit(100).cast("decimal(9,4)")})
    assert [float(r.p) for r in rows.select(rewards.base_reward(rows).alias("p")).collect()] == [1, 2, 2, 1.01]
    assert [float(rewards._round(Decimal(r.a), r.round_strategy, r.reward_type)) for r in rows.collect()] == [1, 2, 2, 1.01]
    cards = spark.createDataFrame([(None, None, "013"), ("", "gold", "013"), ("DEFAULT|013", None, None), ("a", None, "013"), (None, "a", "013")], "card_id string, card_type string, bank_no string")
    cards = cards.withColumns({"reward_cycle": F.lit("BILLING_CYCLE"), "reward_program": F.lit("p"), "statement_month": F.lit("2025-01"), "posting_date": F.lit(None).cast("date"), "transaction_date": F.lit(None).cast("date"), "transaction_id": F.lit("t")})
    cards = cards.withColumns({"program_start": F.lit(None).cast("date"), "program_end": F.lit(None).cast("date")})
    keys = [r.k for r in cards.select(rewards.cycle_key(cards).alias("k")).collect()]
    assert keys[0].split("|") == ["billing", "p", "013", "default", "2025-01"] and keys[1].split("|")[3] == "gold" and keys[3] == keys[4] and len(set(keys)) == 4


def test_field_rules(spark):
    df = spark.createDataFrame([(None, "x", True), ([], None, True), (["NONE"], " ", True), (["none"], "a", False), (["ALL"], "a", True), (["ALL"], None, False), (["A", "b"], "B", True), (["a"], "c", False), (["a"], None, False)], "w array<string>, v string, e boolean")
    assert all(r.m == r.e for r in df.select(rewards.matches(F.col("w"), F.col("v")).alias("m"), "e").collect())


PROGRAM = """reward_id string, reward_program string, reward_cycle string, reward_type string, calc_method string, round_strategy string, priority int, load_ord int,
 cap_amount decimal(18,2), rate decimal(9,4), program_start date, program_end date, bank_no string, card_id string, statement_month string, transaction_id string, transaction_date date, posting_date date, amount decimal(18,2)"""


def txn(k, amount, day=D(2025, 1, 1), cap=None, method="PER_ITEM", cycle="CALENDAR_MONTH", how="floor", rate="10", program="p"):
    return ("r", program, cycle, "point", method, how, 1, 0, None if cap is None else Decimal(cap), Decimal(rate), None, None, "013", "c", None, f"t{k:05d}", day, day, Decimal(amount))


def paid(spark, rows):
    df = rewards.with_mixed(spark.createDataFrame(rows, PROGRAM))
    return [(float(r.reward), r.is_capped) for r in rewards.capped(df, not df.where("_mixed").isEmpty()).orderBy("transaction_date", "transaction_id").collect()]


def test_caps(spark):
    month = [txn(1, 800, D(2025, 1, 1), 100), txn(2, 800, D(2025, 1, 2), 100), txn(3, 500, D(2025, 2, 1), 100)]
    assert paid(spark, month) == [(80, False), (20, True), (50, False)]
    assert paid(spark, [txn(1, 1000, cap=150), txn(2, 1000, cap=150), txn(3, 1000, cap=150)]) == [(100, False), (50, True), (0, True)]
    assert paid(spark, [txn(k, 150, method="AGGREGATE", rate="3") for k in (1, 2)]) == [(4, False), (5, False)]
    assert paid(spark, [txn(k, 150, method="AGGREGATE", rate="3", cap=c) for k, c in ((1, 10), (2, 10))] + [txn(3, 150, method="AGGREGATE", rate="3", cap=10)]) == [(4, False), (5, False), (1, True)]
    assert paid(spark, [txn(1, 1000, cap=0)]) == [(100, False)]


@pytest.mark.parametrize("mixed", [False, True])
def test_caps_equal_a_sequential_run(spark, mixed):
    rng = random.Random(5)
    rows = []
    for key in range(60):
        method, cap = rng.choice(("PER_ITEM", "AGGREGATE")), rng.choice((None, 0, 50, 300))
        for k in range(rng.randrange(1, 15)):
            if mixed:
                method, cap = rng.choice(("PER_ITEM", "AGGREGATE")), rng.choice((None, 50, 300))
            rows.append(txn(100 * key + k, rng.randrange(-500, 2000), cap=cap, method=method, how=rng.choice(("floor", "round", "ceil")), rate=rng.choice(("1", "2.5", "3")), program=f"p{key}"))
    held: dict = {}
    expected = []
    for r in sorted(rows, key=lambda r: r[15]):
        paid_before, spent = held.get(r[1], (Decimal(0), Decimal(0)))
        cap = r[8] if r[8] else None
        if r[4] == "AGGREGATE":
            spent += r[18]
            worth = max(Decimal(0), rewards._round(spent * r[9] / 100, r[5], None) - paid_before)
        else:
            worth = rewards._round(r[18] * r[9] / 100, r[5], None)
        if cap is not None and paid_before >= cap:
            given, capped = Decimal(0), True
        elif cap is not None and paid_before + worth > cap:
            given, capped = cap - paid_before, True
        else:
            given, capped = worth, False
        if r[4] == "AGGREGATE" or cap is not None:
            paid_before += given
        held[r[1]] = (paid_before, spent)
        expected.append((float(given), capped))
    assert paid(spark, rows) == expected


@pytest.mark.parametrize("method", ["PER_ITEM", "AGGREGATE"])
def test_campaign_caps_over_ranges(spark, method):
    """One key over all ranges gives the rows of a sequential run, and no range holds more than twice the mean."""
    rng = random.Random(6)
    rows = [txn(k, rng.randrange(-900, 2000), D(2025, 1, 1) + datetime.timedelta(days=k % 90), 20_000, method, "CAMPAIGN_CYCLE", rng.choice(("floor", "round", "ceil")), rng.choice(("1", "2.5", "3"))) for k in range(3000)]
    wide = paid(spark, rows)
    df = rewards.with_mixed(spark.createDataFrame(rows, PROGRAM)).withColumn("_mixed", F.lit(True))
    assert wide == [(float(r.reward), r.is_capped) for r in rewards.capped(df).orderBy("transaction_date", "transaction_id").collect()] and sum(c for _, c in wide) > 100
    few = paid(spark, [r[:8] + (None,) + r[9:] for r in rows[:400]] + [txn(9000 + k, 10, cap=5, cycle="CAMPAIGN_CYCLE", program=f"q{k}") for k in range(50)])
    assert len(few) == 450 and sum(c for _, c in few) == 0
    keyed = df.withColumns({"cycle_key": F.lit("k"), "_p": F.lit(1).cast("decimal(18,2)"), "_cap": F.lit(None).cast("decimal(18,2)"), "_agg": F.lit(False)})
    sizes = [r["count"] for r in rewards._by_ranges(keyed).groupBy("_range").count().collect()]
    assert len(sizes) > 8 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def bill(folder, name, text, encoding):
    (folder / name).write_bytes(text.encode(encoding))


def test_statements(spark, tmp_path):
    bill(tmp_path, "202510國泰世華信用卡對帳單.csv", "preamble\n\n消費日,入帳起息日,交易說明,消費國家/幣別,消費金額,新臺幣金額,卡號/行動末四碼,折算日\n10/01,10/03,\"SHOP, A\",JP/JPY,5000,\"1,050\",1234,10/02\n2025/10/05,10/06,B,TW/TWD,100,100,8888 / 0123,\n正卡消費,,,,,,,\n10/09,10/09,no,,1,1,1,\n", "utf-8-sig")
    bill(tmp_path, "中國信託帳單明細查詢_20260108.csv", "消費日,入帳起息日,摘要,幣別,消費地金額,新臺幣金額,末四碼,外幣折算日,消費地\n114/12/30,115/01/02,連加*店,TWD,50,50,5678,,TWN\n", "cp950")
    html = "<html><table><tr><td>x</td></tr><tr><th>消費日</th><th>入帳日</th><th>消費 明細</th><th>國別</th><th>幣別</th><th>外幣金額</th><th>新臺幣金額</th></tr><tr><td>11/02</td><td>11/03</td><td><b>店</b>&nbsp;一</td><td>TW</td><td>TWD</td><td></td><td>$-200</td></tr><tr><td>立即繳費</td></tr></table></html>"
    bill(tmp_path, "華南銀行信用卡對帳單_202511.xls", html, "big5")
    bill(tmp_path, "unknown.csv", "消費日,交易說明\n1/1,x\n", "utf-8")
    rows = {(r.bank, r.merchant): r for r in bills.standard_rows(spark, str(tmp_path)).collect()}
    assert set(rows) == {("國泰世華", "SHOP, A"), ("國泰世華", "B"), ("中國信託", "連加*店"), ("華南銀行", "店 一")}
    a = rows["國泰世華", "SHOP, A"]
    assert (a.transaction_date, a.conversion_date, a.merchant_location, a.currency_type, float(a.payment_amount), a.statement_month) == (D(2025, 10, 1), D(2025, 10, 2), "JP", "JPY", 1050.0, D(2025, 10, 1))
    assert rows["中國信託", "連加*店"].transaction_date == D(2025, 12, 30) and float(rows["華南銀行", "店 一"].payment_amount) == -200
    listed = bills.files(spark, str(tmp_path))
    assert {r.file for r in listed.where("bank is null").collect()} == {"unknown.csv"}
    done = listed.withColumn("status", F.lit("SUCCESS")).select("file_hash", "status")
    assert bills.files(spark, str(tmp_path), done).count() == 0


def test_sanitiser_texts(spark):
    safe = {"+50": "+50", "-120.5": "-120.5", "LINE@官方店家": "LINE@官方店家", "+1 Google": "+1 Google", "@cmd|' /C calc'!A0": "'@cmd|' /C calc'!A0", "=1": "'=1", "-sum(http://x)": "'-sum(http://x)", "a" * 300: "a" * 255, "run `ls` $(x)": "run `ls` $(x)"}
    df = spark.createDataFrame([(k,) for k in safe], "t string")
    assert {r.t: r.s for r in df.select("t", bills.safe_text(F.col("t")).alias("s")).collect()} == safe
    lethal = ["xp_cmdshell x", "1; UPDATE t SET a=1", "waitfor  delay '0'", "a; drop table x", "UNION ALL SELECT 1", "eval (x)", "<SCRIPT>"]
    rows = spark.createDataFrame([(f"h{k}", f"f{k}", t, None) for k, t in enumerate(lethal)] + [("ok", "ok", "drop table", "select"), ("h9", "f9", "fine", "javascript :x")], "file_hash string, file string, merchant string, wallet string")
    good, bad = bills.sanitised(rows)
    assert {r.file for r in good.collect()} == {"ok"} and good.columns == rows.columns and bad.count() == 8


def test_sanitiser(spark):
    rows = spark.createDataFrame([("h1", "f1", "=cmd()"), ("h1", "f1", "-120"), ("h1", "f1", "Disney+\x00"), ("h2", "f2", "ok"), ("h2", "f2", "a <script>x")], "file_hash string, file string, merchant string")
    good, bad = bills.sanitised(rows)
    assert {r.merchant for r in good.collect()} == {"'=cmd()", "-120", "Disney+"} and [r.file for r in bad.collect()] == ["f2"]


def test_cards_flattened(spark):
    rows = spark.read.json(spark.sparkContext.parallelize(['{"card_id":"A","bank_no":"013","card_type":"t","card_history":[{"card_no":"1111","card_network":"VISA","vpc_pay":[{"vpc_no":"9","vpc_type":"LINE"}]},{"card_no":"2222","card_network":"JCB","vpc_pay":[]}]}', '{"card_id":"B","bank_no":"812","card_type":"u","card_history":[]}']))
    assert {(r.card_id, r.card_no, r.vpc_no, r.vpc_type) for r in bills.card_table(rows).collect()} == {("A", "1111", "9", "LINE"), ("A", "2222", "2222", "CARD"), ("B", "", "", "CARD")}


def test_stream_loads_once(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    for ids in ((1, 2, 2), (2, 3)):
        spark.createDataFrame([(f"t{k}", k) for k in ids], "transaction_id string, v long").write.mode("append").parquet(source)
        stream = spark.readStream.schema("transaction_id string, v long").parquet(source)
        ingest.load_once(stream, table, str(tmp_path / "state")).awaitTermination(120)
    assert sorted(r.transaction_id for r in spark.read.parquet(table).collect()) == ["t1", "t2", "t3"]


def test_flow_and_trend(spark):
    rows = [("b", "c", "LINE", "food", "m1", "100"), ("b", "c", None, "food", "m2", "50"), ("b", "d", "LINE", "toys", "m1", "-120")]
    df = spark.createDataFrame(rows, "bank_name string, card_type string, payment_process string, category string, normalized_merchant string, a string").withColumn("payment_amount", F.col("a").cast("decimal(18,2)"))
    links = {(r.layer, r.source, r.target): r.value for r in summaries.flow_links(df, top_merchants=1).collect()}
    assert links == {(0, "b", "c"): 150.0, (1, "c", "LINE"): 100.0, (1, "c", "一般實體刷卡"): 50.0, (2, "LINE", "food"): 100.0, (2, "一般實體刷卡", "food"): 50.0, (3, "food", "m2"): 50.0}
    days = spark.createDataFrame([(D(2025, 1, 5), Decimal(3)), (D(2025, 3, 1), Decimal(4))], "transaction_date date, payment_amount decimal(18,2)")
    months = {r.month: r.total_amount for r in summaries.trend(days).collect()}
    assert len(months) == 12 and months["2025-02"] == 0.0 and months["2025-03"] == 4.0 and min(months) == "2024-04"
