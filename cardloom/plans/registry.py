"""Queries by name with the SQL that gives the same rows."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.functions import columns as C
from cardloom.functions.lineage import cut
from cardloom.operators import bronze, cards, filters, refine, rewards, segments, sinks, summaries
from cardloom.plans import etl, reward_run
from cardloom.sources import bank_rules, reward_tables, star_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

TX = star_tables.SQL
SPENT = f"{TX}, sp AS (SELECT * FROM tx WHERE transaction_type <> '退刷')"
AMOUNT = "CAST(coalesce(sum(payment_amount), 0) AS DOUBLE)"
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def tx(spark: SparkSession, sf_dir: str, keys: bool = False) -> DataFrame:
    return star_tables.transactions(spark, sf_dir, keys)


def spent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.consumption(tx(spark, sf_dir))


def _monthly(keys: str, average: bool = True) -> str:
    more = f", {AMOUNT} / count(*) AS avg_amount" if average else ""
    some = " AND ".join(f"{k} IS NOT NULL" for k in keys.split(", "))
    return f"WITH {SPENT} SELECT strftime(transaction_date, '%Y-%m') AS month, {keys}, {AMOUNT} AS total_amount, count(*) AS n_transactions{more} FROM sp WHERE {some} GROUP BY ALL"


@query(_monthly("category"))
def monthly_by_category(spark, sf_dir):
    return summaries.monthly(spent(spark, sf_dir), "category")


@query(_monthly("bank_name, card_type"))
def monthly_by_card(spark, sf_dir):
    return summaries.monthly(spent(spark, sf_dir), "bank_name", "card_type")


@query(_monthly("payment_process"))
def monthly_by_payment(spark, sf_dir):
    return summaries.monthly(spent(spark, sf_dir), "payment_process")


@query(_monthly("card_type, category", average=False))
def monthly_card_category(spark, sf_dir):
    return summaries.monthly(spent(spark, sf_dir), "card_type", "category", average=False)


def _cells(column: str, values: tuple[str, ...]) -> str:
    return ", ".join(f"""CAST(coalesce(sum(payment_amount) FILTER (WHERE {column} = '{v}'), 0) AS DOUBLE) AS "{v}" """ for v in values)


@query(f"WITH {SPENT} SELECT strftime(transaction_date, '%Y-%m') AS month, {_cells('category', TYPES)} FROM sp GROUP BY ALL")
def pivot_month_category(spark, sf_dir):
    return summaries.pivot(spent(spark, sf_dir), C.month_key(F.col("transaction_date")).alias("month"), "category", TYPES)


@query(f"WITH {SPENT} SELECT card_type, {_cells('payment_process', PRIORITIES)} FROM sp GROUP BY ALL")
def cross_pivot(spark, sf_dir):
    return summaries.pivot(spent(spark, sf_dir), F.col("card_type"), "payment_process", PRIORITIES)


@query(
    f"""WITH {SPENT}, c AS (SELECT strftime(transaction_date, '%Y-%m') AS month, category, sum(payment_amount) AS a FROM sp GROUP BY ALL),
    w AS (SELECT month, category, CAST(a AS DOUBLE) AS a, CAST(sum(a) OVER (PARTITION BY month) AS DOUBLE) AS t FROM c)
    SELECT month, category, a * 100 / CASE WHEN t = 0 THEN 1 ELSE t END AS percent FROM w"""
)
def pivot_percent(spark, sf_dir):
    return summaries.percentages(spent(spark, sf_dir).withColumn("month", C.month_key(F.col("transaction_date"))), "month", "category")


@query(
    f"""WITH {TX}, m AS (SELECT date_trunc('month', transaction_date) AS s, {AMOUNT} AS a FROM tx WHERE category = 'PROMO' AND payment_process = '2-HIGH' AND bank_name = 'NATION_1' AND month(transaction_date) <> 5 GROUP BY ALL),
    e AS (SELECT min(s) AS lo, max(s) AS hi FROM m), r AS (SELECT unnest(generate_series(least(lo, hi - INTERVAL 11 MONTH), hi, INTERVAL 1 MONTH)) AS s FROM e)
    SELECT strftime(r.s, '%Y-%m') AS month, coalesce(m.a, 0) AS total_amount FROM r LEFT JOIN m ON r.s = m.s"""
)
def trend_gapfill(spark, sf_dir):
    rows = tx(spark, sf_dir).where("category = 'PROMO' and payment_process = '2-HIGH' and bank_name = 'NATION_1' and month(transaction_date) <> 5")
    return summaries.trend(rows)


@query(
    f"""WITH {SPENT} SELECT {AMOUNT} AS total_amount, count(*) AS n_transactions, median(CAST(payment_amount AS DOUBLE)) AS median_amount,
    count(DISTINCT strftime(transaction_date, '%Y-%m')) AS active_months, count(DISTINCT card_type) AS n_cards, count(DISTINCT payment_process) AS n_payments,
    {AMOUNT} / greatest(count(DISTINCT strftime(transaction_date, '%Y-%m')), 1) AS monthly_average FROM sp"""
)
def dashboard_summary(spark, sf_dir):
    return summaries.dashboard(spent(spark, sf_dir))


def _rank(value: str, order: str, out: str) -> str:
    w = f"PARTITION BY ({value} IS NOT NULL)"
    rank = f"(rank() OVER ({w} ORDER BY {value} {order}) + (count(*) OVER ({w}, {value}) - 1) / 2.0) / count({value}) OVER ({w})"
    return f"CASE WHEN {value} IS NULL THEN 0 ELSE CAST({rank} AS DOUBLE) END AS {out}"


def _labels(names, *conditions: str) -> str:
    """A CASE of the labels in order, the last one for all other rows."""
    return "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for c, n in zip(conditions, names, strict=False)) + f" ELSE '{names[-1]}' END"


def _rfm(key: str, windows: dict[str, int | None], more: str = "", name: str | None = None) -> str:
    aggs, cols = [], []
    for n, d in windows.items():
        cond = "TRUE" if d is None else f"transaction_date >= anchor - {d}"
        aggs += [f"datediff('day', max(transaction_date) FILTER (WHERE {cond}), max(anchor)) AS {n}_r", f"nullif(count(DISTINCT transaction_id) FILTER (WHERE {cond}), 0) AS {n}_f", f"CAST(sum(payment_amount) FILTER (WHERE {cond}) AS DOUBLE) AS {n}_m"]
        cols += [f"coalesce({n}_r, 9999) AS {n}_recency", f"coalesce({n}_f, 0) AS {n}_frequency", f"coalesce({n}_m, 0) AS {n}_monetary"]
        cols += [_rank(f"{n}_r", "DESC", f"{n}_r_rank"), _rank(f"{n}_f", "ASC", f"{n}_f_rank"), _rank(f"{n}_m", "ASC", f"{n}_m_rank")]
    rows = f"(SELECT * REPLACE (coalesce({key}, '{name}') AS {key}) FROM sp)" if name else "sp"
    some = " AND ".join(f"{k} IS NOT NULL" for k in key.split(", "))
    return f"""WITH {SPENT}, a AS (SELECT CAST(max(transaction_date) AS DATE) + 1 AS anchor FROM sp), g AS (SELECT {key}, {', '.join(aggs)} FROM {rows}, a WHERE {some} GROUP BY ALL),
    r AS (SELECT {key}, {', '.join(cols)} FROM g) SELECT *{more} FROM r"""


_SHORT = {"d30": 30, "d180": 180, "life": None}
_SEGMENTS = ("life_m_rank >= 0.8 AND d180_frequency > 0", "life_m_rank >= 0.8", "d180_frequency > 0 AND d180_m_rank >= 0.8", "d180_frequency > 0")


@query(_rfm("normalized_merchant", segments.WINDOWS, f", {_labels(segments.MERCHANT_LABELS, *_SEGMENTS)} AS segment"))
def rfm_merchant(spark, sf_dir):
    return segments.rfm(spent(spark, sf_dir), ["normalized_merchant"]).withColumn("segment", segments.merchant_segment())


@query(_rfm("category", _SHORT, f", {_labels(segments.CATEGORY_LABELS, *_SEGMENTS)} AS segment", segments.NO_CATEGORY))
def rfm_category(spark, sf_dir):
    out = segments.rfm(spent(spark, sf_dir), ["category"], _SHORT, {"category": segments.NO_CATEGORY})
    return out.withColumn("segment", segments.merchant_segment(labels=segments.CATEGORY_LABELS))


@query(
    _rfm(
        "payment_process",
        _SHORT,
        f", {_labels(segments.PAYMENT_LABELS, 'life_f_rank >= 0.7 AND d30_frequency > 0', 'life_f_rank >= 0.7', 'd30_frequency > 0')} AS segment",
        segments.NO_PAYMENT,
    )
)
def rfm_payment(spark, sf_dir):
    out = segments.rfm(spent(spark, sf_dir), ["payment_process"], _SHORT, {"payment_process": segments.NO_PAYMENT})
    return out.withColumn("segment", segments.payment_segment("d30"))


@query(
    _rfm(
        "bank_name, card_type",
        _SHORT,
        f""", {_labels(segments.CARD_LABELS, 'life_recency > 180', 'life_f_rank >= 0.5 AND life_m_rank >= 0.5', 'life_m_rank >= 0.5', 'life_f_rank >= 0.5')} AS segment,
        CASE WHEN life_frequency = 0 THEN 0 ELSE CAST(trunc(life_monetary / life_frequency) AS BIGINT) END AS avg_ticket""",
    )
)
def rfm_card(spark, sf_dir):
    out = segments.rfm(spent(spark, sf_dir), ["bank_name", "card_type"], _SHORT)
    return out.withColumn("segment", segments.card_segment()).withColumn("avg_ticket", segments.average_ticket())


@query(
    f"""WITH {SPENT}, n AS (SELECT normalized_merchant, category, count(*) AS n FROM sp GROUP BY ALL)
    SELECT normalized_merchant, category FROM n QUALIFY row_number() OVER (PARTITION BY normalized_merchant ORDER BY n DESC, category) = 1"""
)
def merchant_common_category(spark, sf_dir):
    return segments.common_category(spent(spark, sf_dir))


def _two(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 4) for n in names})


@query(
    f"""WITH {SPENT}, s AS (SELECT normalized_merchant, avg(CAST(payment_amount AS DOUBLE)) AS a, coalesce(stddev_samp(CAST(payment_amount AS DOUBLE)), 0) AS s, count(*) AS n FROM sp GROUP BY ALL)
    SELECT normalized_merchant, round(a, 4) AS avg, round(s, 4) AS std, n, round(CASE WHEN a > 0 THEN s / a ELSE 0 END, 4) AS cv FROM s"""
)
def merchant_ticket_stats(spark, sf_dir):
    return _two(segments.ticket_stats(spent(spark, sf_dir), "normalized_merchant"), "avg", "std", "cv")


@query(
    f"""WITH {SPENT}, x AS (SELECT payment_process, category, CAST(payment_amount AS DOUBLE) AS x, payment_amount FROM sp WHERE payment_amount > 0 AND payment_process IS NOT NULL AND category IS NOT NULL),
    s AS (SELECT payment_process, category, count(*) AS n, {AMOUNT} AS total_amount, coalesce(stddev_samp(x), 0) AS std, min(x) AS low, max(x) AS high, {AMOUNT} / count(*) AS avg,
      quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM x GROUP BY ALL),
    w AS (SELECT *, greatest(low, q1 - (q3 - q1) * 1.5) AS whisker_low, least(high, q3 + (q3 - q1) * 1.5) AS whisker_high FROM s),
    o AS (SELECT x.payment_process, x.category, count(*) AS n_outliers FROM x JOIN w USING (payment_process, category) WHERE x < whisker_low OR x > whisker_high GROUP BY ALL),
    m AS (SELECT median(avg) FILTER (WHERE avg > 0) AS ma, median(std) FILTER (WHERE std > 0) AS ms FROM s)
    SELECT payment_process, category, n, total_amount, round(std, 4) AS std, low, high, avg, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(whisker_low, 4) AS whisker_low,
      round(whisker_high, 4) AS whisker_high, coalesce(n_outliers, 0) AS n_outliers, CASE WHEN n = 1 THEN 'single' WHEN q1 = q3 OR low = high THEN 'fixed_amount' ELSE 'regular' END AS kind,
      {_labels(segments.QUADRANT_LABELS, 'avg >= ma AND std < ms', 'avg >= ma', 'std < ms')} AS quadrant
    FROM w LEFT JOIN o USING (payment_process, category), m"""
)
def volatility_payment_category(spark, sf_dir):
    return _two(segments.volatility(spent(spark, sf_dir), "payment_process", "category"), "std", "q1", "median", "q3", "whisker_low", "whisker_high")


@query(
    f"""WITH {SPENT}, s AS (SELECT category, normalized_merchant, {AMOUNT} AS total_amount FROM sp GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY category ORDER BY total_amount DESC, normalized_merchant) AS place FROM s QUALIFY place <= 3"""
)
def top3_by_category(spark, sf_dir):
    return segments.top_per_group(spent(spark, sf_dir), "category", "normalized_merchant")


# Flows name ends without a value.
_ENDS = """f AS (SELECT payment_amount, coalesce(nullif(bank_name, ''), '其他發卡行') AS bank_name, coalesce(nullif(card_type, ''), '其他卡片') AS card_type, coalesce(nullif(payment_process, ''), '一般實體刷卡') AS payment_process,
    coalesce(nullif(category, ''), '未分類') AS category, coalesce(nullif(normalized_merchant, ''), '其他商家') AS normalized_merchant FROM tx)"""


@query(
    f"""WITH {TX}, {_ENDS}, t AS (SELECT normalized_merchant FROM f GROUP BY ALL ORDER BY sum(payment_amount) DESC, normalized_merchant LIMIT 10), l AS (
    SELECT 0 AS layer, bank_name AS source, card_type AS target, {AMOUNT} AS value FROM f GROUP BY ALL UNION ALL
    SELECT 1, card_type, payment_process, {AMOUNT} FROM f GROUP BY ALL UNION ALL SELECT 2, payment_process, category, {AMOUNT} FROM f GROUP BY ALL UNION ALL
    SELECT 3, category, normalized_merchant, {AMOUNT} FROM f SEMI JOIN t USING (normalized_merchant) GROUP BY ALL)
    SELECT * FROM l WHERE value > 1000"""
)
def sankey_links(spark, sf_dir):
    return summaries.flow_links(tx(spark, sf_dir), 1000.0, top_merchants=10)


@query(
    f"""WITH {TX}, {_ENDS}, l AS (SELECT bank_name AS a, card_type AS b, sum(payment_amount) AS v FROM f GROUP BY ALL UNION ALL SELECT card_type, payment_process, sum(payment_amount) FROM f GROUP BY ALL
    UNION ALL SELECT payment_process, category, sum(payment_amount) FROM f GROUP BY ALL), k AS (SELECT * FROM l WHERE v > 0) SELECT a AS name FROM k UNION SELECT b FROM k"""
)
def sankey_nodes(spark, sf_dir):
    return summaries.flow_nodes(summaries.flow_links(tx(spark, sf_dir)))


_MATRIX = ("1-URGENT", "2-HIGH", "實體卡/虛擬卡", "其他")
_TIERED = "CASE WHEN payment_process IS NULL THEN '實體卡/虛擬卡' WHEN payment_process IN ('1-URGENT', '2-HIGH') THEN payment_process ELSE '其他' END"


@query(
    f"""WITH {SPENT}, p AS (SELECT category, payment_amount, {_TIERED} AS pay FROM sp), g AS (SELECT category, {AMOUNT} AS total_amount, {_cells('pay', _MATRIX)} FROM p GROUP BY ALL)
    SELECT category, total_amount, {', '.join(f'"{v}" * 100 / CASE WHEN total_amount = 0 THEN 1 ELSE total_amount END AS "{v}"' for v in _MATRIX)} FROM g"""
)
def spending_matrix(spark, sf_dir):
    return summaries.spending_matrix(spent(spark, sf_dir), summaries.tier(F.col("payment_process"), _MATRIX[:2], ()), _MATRIX)


@query(
    f"""WITH {SPENT}, a AS (SELECT max(transaction_date) AS d FROM sp), w AS (SELECT * FROM (VALUES ('d90', 90), ('d365', 365), ('life', NULL)) v(w, days)),
    p AS (SELECT w.w AS "window", category, payment_amount, {_TIERED} AS pay FROM sp, a, w WHERE days IS NULL OR transaction_date >= d - days),
    g AS (SELECT "window", category, {AMOUNT} AS total_amount, {_cells('pay', _MATRIX)} FROM p GROUP BY ALL)
    SELECT "window", category, total_amount, {', '.join(f'"{v}" * 100 / CASE WHEN total_amount = 0 THEN 1 ELSE total_amount END AS "{v}"' for v in _MATRIX)} FROM g"""
)
def matrix_by_window(spark, sf_dir):
    pay = summaries.tier(F.col("payment_process"), _MATRIX[:2], ())
    return summaries.matrix_by_window(spent(spark, sf_dir), pay, _MATRIX, {"d90": 90, "d365": 365, "life": None})


_TEN = "transaction_id, transaction_date, bank_name, card_type, normalized_merchant, merchant_location, payment_process, category, transaction_type, CAST(payment_amount AS DOUBLE) AS payment_amount"


def _ten(df: DataFrame) -> DataFrame:
    return df.selectExpr(*(_TEN.replace(" AS DOUBLE) AS", "@").split(", ")[:-1]), "cast(payment_amount as double) payment_amount")


@query(f"WITH {SPENT} SELECT {_TEN} FROM sp WHERE payment_process IN ('1-URGENT') OR payment_process IS NULL OR trim(payment_process) = ''")
def query_payment_filter(spark, sf_dir):
    return _ten(filters.query_transactions(tx(spark, sf_dir), payments=["1-URGENT"]))


@query(f"WITH {SPENT} SELECT {_TEN} FROM sp WHERE merchant_location NOT IN ('ASIA') AND bank_name IN ('NATION_1', 'NATION_2') AND card_type = 'BUILDING' AND payment_process IS NOT NULL")
def query_location_filter(spark, sf_dir):
    return _ten(
        filters.query_transactions(tx(spark, sf_dir), banks=["NATION_1", "NATION_2"], cards=["BUILDING"], include_direct_payment=False, location="國外", domestic=["ASIA"])
    )


@query(f"WITH {SPENT}, a AS (SELECT max(transaction_date) AS d FROM tx) SELECT {_TEN} FROM sp, a WHERE transaction_date BETWEEN d - 90 AND d")
def query_time_window(spark, sf_dir):
    return _ten(filters.query_transactions(tx(spark, sf_dir), time_window="90d"))


_BRANDS = "sub_category IN ('Brand#1', 'Brand#2')"


@query(f"WITH {SPENT}, a AS (SELECT max(transaction_date) AS d FROM tx) SELECT {_TEN} FROM sp, a WHERE transaction_date BETWEEN d - 365 AND d AND {_BRANDS}")
def query_last_year(spark, sf_dir):
    rows = filters.query_transactions(tx(spark, sf_dir), time_window="last_year")
    return _ten(filters.prepared(rows, sub_categories=["Brand#1", "Brand#2"]))


@query(f"WITH {SPENT}, a AS (SELECT max(transaction_date) AS d FROM tx) SELECT {_TEN} FROM sp, a WHERE year(transaction_date) = year(d) - 1 AND {_BRANDS}")
def query_previous_year(spark, sf_dir):
    rows = filters.query_transactions(tx(spark, sf_dir), time_window="去年")
    return _ten(filters.prepared(rows, sub_categories=["Brand#1", "Brand#2"]))


@query(f"WITH {SPENT} SELECT {_TEN} FROM sp WHERE transaction_date BETWEEN DATE '1997-01-15' AND DATE '1997-03-01'")
def query_between_days(spark, sf_dir):
    return _ten(filters.query_transactions(tx(spark, sf_dir), start_date=datetime.date(1997, 1, 15), end_date=datetime.date(1997, 3, 1)))


@query(f"WITH {TX} SELECT category, string_agg(DISTINCT sub_category, ',' ORDER BY sub_category) AS sub_categories FROM tx GROUP BY ALL")
def filter_menu(spark, sf_dir):
    return filters.menu(tx(spark, sf_dir))


_KEYS = ["transaction_date", "normalized_merchant", "payment_amount", "transaction_type"]


@query(
    f"""WITH {TX}, n AS (SELECT *, row_number() OVER (PARTITION BY transaction_date, normalized_merchant, payment_amount, transaction_type ORDER BY transaction_id, category, sub_category, card_type, bank_no, payment_process, posting_date) - 1 AS seq FROM tx)
    SELECT seq, substr(sha256(concat(transaction_date, normalized_merchant, payment_amount, transaction_type, seq)), 1, 32) AS transaction_id, transaction_type FROM n"""
)
def transaction_ids(spark, sf_dir):
    order = ["transaction_id", "category", "sub_category", "card_type", "bank_no", "payment_process", "posting_date"]
    return refine.with_ids(tx(spark, sf_dir), _KEYS, order).select("seq", "transaction_id", "transaction_type")


@query(
    f"""WITH {TX} SELECT transaction_id, CAST(arg_min(payment_amount, (payment_amount, posting_date)) AS DOUBLE) AS payment_amount, arg_min(posting_date, (payment_amount, posting_date)) AS posting_date FROM tx GROUP BY ALL"""
)
def dedup_first(spark, sf_dir):
    rows = tx(spark, sf_dir).select("transaction_id", "payment_amount", "posting_date")
    return refine.first_of_each(rows, ["transaction_id"], ["payment_amount", "posting_date"]).withColumn("payment_amount", F.col("payment_amount").cast("double"))


_FX = [("ASIA", "JPY", "0.2185"), ("EUROPE", "EUR", "35.125"), ("AMERICA", "USD", "31.5")]


@query(
    f"""WITH {TX}, c AS (SELECT transaction_id, posting_date, payment_amount, CASE merchant_location WHEN 'ASIA' THEN 'JPY' WHEN 'EUROPE' THEN 'EUR' WHEN 'AMERICA' THEN 'USD' WHEN 'AFRICA' THEN 'ZAR' ELSE 'TWD' END AS cur FROM tx),
    r AS (SELECT *, CASE cur WHEN 'JPY' THEN CAST(0.2185 AS DECIMAL(18,6)) WHEN 'EUR' THEN CAST(35.125 AS DECIMAL(18,6)) WHEN 'USD' THEN CAST(31.5 AS DECIMAL(18,6)) END AS rate FROM c),
    x AS (SELECT *, CAST(payment_amount AS DECIMAL(18,2)) * rate AS v FROM r)
    SELECT transaction_id, CASE WHEN v IS NULL THEN cur ELSE 'TWD' END AS payment_currency,
    CASE WHEN v IS NULL THEN CAST(payment_amount AS DOUBLE) WHEN abs(v - trunc(v)) = 0.5 THEN CAST(2 * round(CAST(v AS DOUBLE) / 2) AS DOUBLE) ELSE CAST(round(v) AS DOUBLE) END AS payment_amount, cur = 'ZAR' AS fx_missing FROM x"""
)
def fx_convert(spark, sf_dir):
    rows = tx(spark, sf_dir)
    cur = F.lit("TWD")
    for region, code, _ in [*_FX, ("AFRICA", "ZAR", "")]:
        cur = F.when(F.col("merchant_location") == region, code).otherwise(cur)
    day = F.to_date(F.lit("2000-01-01"))
    rows = rows.select("transaction_id", "payment_amount", cur.alias("payment_currency"), cur.alias("currency_type"), day.alias("conversion_date"))
    rates = spark.createDataFrame([(c, r, k) for k, (_, c, r) in enumerate(_FX)], "currency_type string, r string, load_ord int")
    rates = rates.select(day.alias("conversion_date"), "currency_type", F.col("r").cast("decimal(18,6)").alias("fx_rate"), "load_ord")
    out = refine.convert_currency(rows, rates)
    return out.select("transaction_id", "payment_currency", F.col("payment_amount").cast("double").alias("payment_amount"), "fx_missing")


_RULES = [
    {"p": r"#0000000[0-2]\d", "name": "early", "group": None, "priority": 5},
    {"p": r"SUPPLIER.*[05]$", "name": "round", "group": "tens", "priority": 1},
    {"p": r"#\d*7$", "name": "seven", "group": "odd", "priority": None},
    {"p": r"#\d*[2468]$", "name": None, "group": "even", "priority": 7},
]


@query(
    f"""WITH {TX}, d AS (SELECT DISTINCT normalized_merchant AS m FROM tx), r AS (SELECT m, CASE WHEN regexp_matches(m, 'SUPPLIER.*[05]$', 'i') THEN 0 WHEN regexp_matches(m, '#0000000[0-2]\\d', 'i') THEN 1
    WHEN regexp_matches(m, '#\\d*[2468]$', 'i') THEN 2 WHEN regexp_matches(m, '#\\d*7$', 'i') THEN 3 END AS k FROM d)
    SELECT m AS normalized_merchant, k AS rule_no, CASE k WHEN 0 THEN 'round' WHEN 1 THEN 'early' WHEN 3 THEN 'seven' END AS "name", CASE k WHEN 0 THEN 'tens' WHEN 2 THEN 'even' WHEN 3 THEN 'odd' END AS "group", count(*) AS n
    FROM tx JOIN r ON normalized_merchant = m GROUP BY ALL"""
)
def rule_first_match(spark, sf_dir):
    out = refine.tag(tx(spark, sf_dir).select("normalized_merchant"), "normalized_merchant", _RULES, "p", ["name", "group"])
    return out.groupBy("normalized_merchant", "rule_no", "name", "group").agg(F.count("*").alias("n"))


_WORDS = {"payment": ["#000000001"], "credit": ["#000000002"], "fee": ["000000003", "000000004"]}


@query(
    f"""WITH {TX}, t AS (SELECT transaction_id, coalesce(payment_process, 'USD') = 'USD' AS usd, CASE WHEN regexp_matches(normalized_merchant, '#00000000[1]', 'i') THEN '繳款' WHEN contains(normalized_merchant, '#000000002') THEN '紅利折抵'
    WHEN contains(normalized_merchant, '000000003') OR contains(normalized_merchant, '000000004') THEN '各項費用' WHEN payment_amount < 0 THEN '退刷' WHEN merchant_location = 'ASIA' THEN '交易'
    WHEN (card_type = 'BUILDING') <> usd THEN '一般國外交易' WHEN card_type <> 'BUILDING' THEN '台幣跨境交易' ELSE '一般雙幣交易' END AS kind FROM tx)
    SELECT kind, count(*) AS n FROM t GROUP BY ALL"""
)
def type_cascade(spark, sf_dir):
    place = F.when(F.col("merchant_location") == "ASIA", "TW").otherwise(F.col("merchant_location"))
    current = F.when(F.col("card_type") == "BUILDING", "USD").otherwise("TWD")
    paid = F.when(F.col("payment_process").isNull(), "USD").otherwise("TWD")
    kind = refine.transaction_type(F.col("normalized_merchant"), F.col("payment_amount"), place, current, F.lit(None).cast("string"), _WORDS, paid)
    return tx(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {TX}, t AS (SELECT *, CASE WHEN contains(normalized_merchant, '#000000001') THEN 1 WHEN contains(normalized_merchant, '#000000002') THEN 2 WHEN contains(normalized_merchant, '00000003') THEN 3 ELSE 0 END AS k,
      CASE WHEN card_type = 'BUILDING' THEN 'USD' ELSE 'TWD' END AS cur, CASE WHEN payment_process IS NOT NULL THEN 'TWD' END AS paid FROM tx),
    f AS (SELECT k, CASE WHEN k > 0 THEN 'TW' ELSE merchant_location END AS merchant_location, CASE WHEN k = 1 OR (k > 1 AND paid IS NULL) THEN cur ELSE paid END AS payment_currency,
      CASE WHEN k = 3 THEN coalesce(paid, cur) ELSE cur END AS currency_type, CASE WHEN k <> 1 THEN card_type END AS card_type, payment_amount FROM t)
    SELECT CASE WHEN k = 1 THEN '繳款' WHEN k = 2 THEN '紅利折抵' WHEN k = 3 THEN '各項費用' WHEN payment_amount < 0 THEN '退刷' WHEN merchant_location = 'TW' THEN '交易' WHEN currency_type IS DISTINCT FROM payment_currency THEN '一般國外交易'
      WHEN currency_type = 'TWD' THEN '台幣跨境交易' ELSE '一般雙幣交易' END AS transaction_type, merchant_location, payment_currency, currency_type, card_type, count(*) AS n, {AMOUNT} AS total_amount FROM f GROUP BY ALL"""
)
def classified_rows(spark, sf_dir):
    """Types with what they put right of place, currency and card."""
    rows = tx(spark, sf_dir).withColumns(
        {
            "merchant": F.col("normalized_merchant"),
            "transaction_type": F.lit(""),
            "currency_amount": F.col("payment_amount"),
            "currency_type": F.when(F.col("card_type") == "BUILDING", "USD").otherwise("TWD"),
            "payment_currency": F.when(F.col("payment_process").isNotNull(), "TWD"),
        }
    )
    out = refine.classify(rows, {"payment": ["#000000001"], "credit": ["#00000000[2]"], "fee": ["00000003"]})
    return out.groupBy("transaction_type", "merchant_location", "payment_currency", "currency_type", "card_type").agg(F.count("*").alias("n"), summaries.total().alias("total_amount"))


@query(
    f"""WITH {TX} SELECT concat_ws('－', payment_process, category, CASE WHEN normalized_merchant <> category THEN normalized_merchant END) AS display_name, count(*) AS n FROM tx GROUP BY ALL"""
)
def display_names(spark, sf_dir):
    name = refine.display_name(F.concat(F.col("payment_process"), F.lit("－ ")), F.col("category"), F.col("normalized_merchant"))
    return tx(spark, sf_dir).groupBy(name.alias("display_name")).agg(F.count("*").alias("n"))


def _closes(rows: DataFrame) -> DataFrame:
    days = rows.select("bank_no", F.trunc("posting_date", "month").alias("m")).distinct()
    return days.select("bank_no", F.lit(None).cast("string").alias("card_id"), F.date_format("m", "yyyy-MM").alias("statement_month"), F.date_add("m", F.col("bank_no").cast("int") % 20 + 4).alias("closing_date"), F.lit(None).cast("date").alias("actual_closing_date"))


_CLOSES = f"""{TX}, c AS (SELECT DISTINCT bank_no, strftime(posting_date, '%Y-%m') AS statement_month, CAST(date_trunc('month', posting_date) AS DATE) + CAST(CAST(bank_no AS INT) % 20 + 4 AS INT) AS last_day FROM tx),
    b AS (SELECT bank_no, statement_month, CAST(coalesce(lag(last_day) OVER (PARTITION BY bank_no ORDER BY last_day), last_day - INTERVAL 1 MONTH) AS DATE) + 1 AS first_day, last_day FROM c)"""


@query(f"WITH {_CLOSES} SELECT * FROM b")
def billing_intervals(spark, sf_dir):
    return refine.billing_intervals(_closes(tx(spark, sf_dir))).drop("card_id")


@query(
    f"""WITH {_CLOSES} SELECT tx.bank_no, coalesce(b.statement_month, strftime(posting_date, '%Y-%m')) AS statement_month, count(*) AS n, {AMOUNT} AS total_amount
    FROM tx LEFT JOIN b ON tx.bank_no = b.bank_no AND posting_date BETWEEN first_day AND last_day GROUP BY ALL"""
)
def statement_months(spark, sf_dir):
    """Statements of all transactions, which are summed up by bank, card and posting day first: one read of them."""
    days = tx(spark, sf_dir).groupBy("bank_no", F.col("card_type").alias("card_id"), "posting_date").agg(F.count("*").alias("n"), F.sum("payment_amount").alias("payment_amount"))
    days = cut(days)
    out = refine.statement_of(days, refine.billing_intervals(cut(_closes(days))))
    return out.groupBy("bank_no", "statement_month").agg(F.sum("n").alias("n"), summaries.total().alias("total_amount"))


# Reward configuration over the star tables: two base programs and three campaigns, one of which ends the calculation.
_PROGRAMS = """reward_id string, bank_no string, card_id string, reward_program string, source string, reward_cycle string, reward_type string, calc_method string, round_strategy string,
    priority int, reward_cal_break boolean, reward_rate decimal(9,4), cap_amount decimal(18,2), start_date date, end_date date, load_ord int"""
_PROGRAM_ROWS = """('p1','ALL','ALL','excluded','campaign','NONE','point','PER_ITEM','floor',1,true,0,NULL,NULL,NULL,0),
 ('p2','ALL','BUILDING','building','campaign','CALENDAR_MONTH','point','PER_ITEM','round',10,false,3,20000,NULL,NULL,1),
 ('p3','ALL','ALL','high','campaign','CAMPAIGN_CYCLE','openpoint','AGGREGATE','round',20,false,0.5,300000,DATE'1996-01-01',DATE'2000-12-31',2),
 ('p4','3','ALL','bank3','base','BILLING_CYCLE','point','AGGREGATE','floor',30,true,1.5,NULL,NULL,NULL,3),
 ('p5','ALL','','base','base','TRANSACTION_DATE','point','PER_ITEM','floor',40,false,1,500,NULL,NULL,4)"""


def _firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each transaction; the rows of one lie together, as they are dealt by order."""
    first = Window.partitionBy(*star_tables.KEYS).orderBy("transaction_date", "posting_date", "bank_no", "card_type", "normalized_merchant", "payment_amount", "category")
    return tx(spark, sf_dir, keys=True).withColumn("_place", F.row_number().over(first)).where("_place = 1").drop("_place", *star_tables.KEYS)


def _reward_config(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Transactions, programs, their pools' ids and the pools."""
    none = F.lit(None).cast("string")
    txns = _firsts(spark, sf_dir).select(
        "transaction_id", "transaction_date", "posting_date", "bank_no", F.col("card_type").alias("card_id"), "payment_process", "merchant_location", "normalized_merchant",
        F.col("category").alias("merchant_display"), none.alias("ec_platform"), none.alias("vpc_type"), none.alias("statement_month"), F.col("payment_amount").alias("amount"),
    )
    programs = spark.sql(f"SELECT * FROM VALUES {_PROGRAM_ROWS} AS t({', '.join(c.split()[0] for c in _PROGRAMS.replace('decimal(9,4)', 'd').replace('decimal(18,2)', 'd').split(','))})")
    programs = programs.select(*(F.col(c.split()[0]).cast(c.split()[1].replace(";", ",")).alias(c.split()[0]) for c in _PROGRAMS.replace("(9,4)", "(9;4)").replace("(18,2)", "(18;2)").split(",")))
    links = spark.createDataFrame([("p1", "gone", 0), ("p3", "high", 0), ("p3", "asia", 1)], "reward_id string, pool_id string, link_ord int")
    shops = '[{"normalized_merchant":["00000007","000000031"]}]'
    pools = spark.createDataFrame(
        [
            ("gone", "gone", "[]", shops),
            ("high", "high payments", '[{"merchant_location":["AFRICA"]}]', '[{"payment_process":["1-urgent","2-HIGH"],"merchant_rate":2.5},{"payment_process":["NONE"]}]'),
            ("asia", "asia", "[]", '[{"merchant_location":"Asia","merchant_display":"PROMO","merchant_rate":4}]'),
        ],
        "pool_id string, pool_name string, pass_rules string, rules string",
    )
    return txns, programs, links, reward_tables.pools(pools)


def _reward_rows(spark: SparkSession, sf_dir: str, **which: object) -> tuple[DataFrame, DataFrame]:
    """Transactions, and each with its applied programs, if any; of pools their ids and names."""
    txns, *config = _reward_config(spark, sf_dir)
    return txns, rewards.everything(txns, *config, keep=("pool_id", "pool_name"), **which)


def _rewards(spark: SparkSession, sf_dir: str, **which: object) -> tuple[DataFrame, DataFrame]:
    txns, rows = _reward_rows(spark, sf_dir, **which)
    return txns, rewards.applied_of(rows)


_RW = f"""{TX}, u AS (SELECT * FROM tx QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY transaction_date, posting_date, bank_no, card_type, normalized_merchant, payment_amount, category) = 1),
 pr AS (SELECT * FROM (VALUES {_PROGRAM_ROWS}) v(reward_id, p_bank, p_card, reward_program, source, cycle, rtype, method, strat, priority, brk, rate0, cap, s, e, load_ord)),
 c AS (SELECT u.*, pr.* FROM u JOIN pr ON (s IS NULL OR transaction_date >= s) AND (e IS NULL OR transaction_date <= e) AND p_bank IN ('ALL', bank_no) AND p_card IN ('ALL', '', card_type)),
 h AS (SELECT *, CASE reward_id WHEN 'p1' THEN CASE WHEN contains(normalized_merchant, '00000007') OR contains(normalized_merchant, '000000031') THEN 'gone' END
   WHEN 'p3' THEN CASE WHEN merchant_location <> 'AFRICA' AND (payment_process IN ('1-URGENT', '2-HIGH') OR payment_process IS NULL) THEN 'high' WHEN merchant_location = 'ASIA' AND contains(category, 'PROMO') THEN 'asia' END END AS pool_id FROM c),
 f AS (SELECT *, CAST(CASE WHEN pool_id = 'high' AND payment_process IS NOT NULL THEN 2.5 WHEN pool_id = 'asia' THEN 4 ELSE rate0 END AS DECIMAL(9,4)) AS rate FROM h WHERE reward_id NOT IN ('p1', 'p3') OR pool_id IS NOT NULL),
 wf AS (SELECT * FROM f QUALIFY coalesce(max(CAST(brk AS INT)) OVER (PARTITION BY transaction_id ORDER BY priority, load_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0)"""


@query(f"WITH {_RW} SELECT reward_program, pool_id, CAST(rate AS DOUBLE) AS rate, count(*) AS n, CAST(sum(payment_amount) AS DOUBLE) AS amount FROM wf GROUP BY ALL")
def reward_waterfall(spark, sf_dir):
    out = rewards.applied_programs(*_reward_config(spark, sf_dir))
    return out.groupBy("reward_program", "pool_id", F.col("rate").cast("double").alias("rate")).agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount"))


_W = "PARTITION BY {k} ORDER BY transaction_date, transaction_id, priority, load_ord ROWS BETWEEN UNBOUNDED PRECEDING AND {b}"
_NOW, _HAD = _W.format(k="k", b="CURRENT ROW"), _W.format(k="k", b="1 PRECEDING")
_KEEP = "transaction_id, transaction_date, bank_no, card_type, reward_id, reward_program, pool_id, source, cap"
# The rewards of each program by its own cap and rounding.
_APPLIED = f"""{_RW}, a2 AS (SELECT *, concat(card_type, bank_no, strftime(transaction_date, '%Y-%m')) AS k, CAST(round(payment_amount * rate / 100) AS DECIMAL(18,2)) AS p FROM wf WHERE reward_id = 'p2'),
 b2 AS (SELECT *, sum(p) OVER ({_NOW}) AS cs FROM a2), c2 AS (SELECT *, max(cs) OVER ({_HAD}) AS cm FROM b2),
 a3 AS (SELECT *, 1 AS k FROM wf WHERE reward_id = 'p3'), b3 AS (SELECT *, CAST(round(sum(payment_amount) OVER ({_NOW}) * rate / 100, 2) AS DECIMAL(18,2)) AS earned FROM a3),
 c3 AS (SELECT *, greatest(0, coalesce(max(earned) OVER ({_HAD}), 0)) AS had FROM b3),
 a4 AS (SELECT *, concat(card_type, strftime(posting_date, '%Y-%m')) AS k FROM wf WHERE reward_id = 'p4'), b4 AS (SELECT *, CAST(floor(sum(payment_amount) OVER ({_NOW}) * rate / 100) AS DECIMAL(18,2)) AS earned FROM a4),
 c4 AS (SELECT *, greatest(0, coalesce(max(earned) OVER ({_HAD}), 0)) AS had FROM b4),
 a5 AS (SELECT *, CAST(floor(payment_amount * rate / 100) AS DECIMAL(18,2)) AS p FROM wf WHERE reward_id = 'p5'),
 applied AS (SELECT {_KEEP}, CAST(0 AS DECIMAL(18,2)) AS reward, FALSE AS is_capped FROM wf WHERE reward_id = 'p1'
  UNION ALL SELECT {_KEEP}, CASE WHEN coalesce(cm >= cap, FALSE) THEN 0 ELSE least(p, cap - (cs - p)) END, coalesce(cm >= cap, FALSE) OR cs > cap FROM c2
  UNION ALL SELECT {_KEEP}, least(cap, greatest(had, earned)) - least(cap, had), had >= cap OR greatest(had, earned) > cap FROM c3
  UNION ALL SELECT {_KEEP}, greatest(had, earned) - had, FALSE FROM c4
  UNION ALL SELECT {_KEEP}, least(p, cap), p > cap FROM a5)"""


@query(f"WITH {_APPLIED} SELECT transaction_id, CAST(reward AS DOUBLE) AS reward, is_capped FROM applied WHERE reward_id = 'p2'")
def reward_cap_per_item(spark, sf_dir):
    _, out = _rewards(spark, sf_dir, only=F.col("reward_id") == "p2")
    return out.select("transaction_id", F.col("reward").cast("double").alias("reward"), "is_capped")


@query(f"WITH {_APPLIED} SELECT transaction_id, CAST(reward AS DOUBLE) AS reward FROM applied WHERE reward_id = 'p4'")
def reward_cap_aggregate(spark, sf_dir):
    _, out = _rewards(spark, sf_dir, only=F.col("reward_id") == "p4")
    return out.select("transaction_id", F.col("reward").cast("double").alias("reward"))


@query(
    f"""WITH {_APPLIED} SELECT u.transaction_id, coalesce(a.reward_program, '未匹配方案') AS reward_program,
    CASE WHEN a.reward_program IS NULL THEN 'N/A' ELSE coalesce(a.pool_id, 'BASE_PROGRAM') END AS pool_id,
    CAST(coalesce(a.reward, 0) AS DOUBLE) AS reward, coalesce(a.is_capped, FALSE) AS is_capped FROM u LEFT JOIN applied a USING (transaction_id)"""
)
def reward_audit(spark, sf_dir):
    """All programs of all transactions, placeholders included."""
    found = rewards.audit_of(_reward_rows(spark, sf_dir)[1])
    return found.withColumn("reward", F.col("reward").cast("double"))


@query(
    f"""WITH {_APPLIED} SELECT transaction_id, CAST(sum(reward) AS DOUBLE) AS reward, string_agg(reward_program, ' > ' ORDER BY priority, load_ord) AS programs
    FROM applied JOIN pr USING (reward_id, reward_program) GROUP BY ALL"""
)
def reward_totals(spark, sf_dir):
    """Reward and trace of every transaction that has any program."""
    _, out = _rewards(spark, sf_dir)
    return rewards.totals(out).withColumn("reward", F.col("reward").cast("double"))


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = _reward_rows(spark, sf_dir)
    month = C.month_key(F.col("transaction_date"))
    names = lambda df: df.withColumns({"month": month, "bank_name": F.col("bank_no"), "card_type": F.col("card_id"), "payment_amount": F.col("amount")})
    return summaries.reward_month_summary(names(rows), names(rows))


_SUMMARY = f"""WITH {_APPLIED}, r AS (SELECT strftime(transaction_date, '%Y-%m') AS month, bank_no AS bank_name, card_type, CAST(sum(reward) AS DOUBLE) AS reward FROM applied GROUP BY ALL),
    s AS (SELECT strftime(transaction_date, '%Y-%m') AS month, bank_no AS bank_name, card_type, {AMOUNT} AS spending FROM u GROUP BY ALL)
    SELECT month, bank_name, card_type, coalesce(spending, 0) AS spending, coalesce(reward, 0) AS reward, CASE WHEN spending > 0 THEN coalesce(reward, 0) * 100 / spending ELSE 0 END AS rate_percent
    FROM s FULL JOIN r USING (month, bank_name, card_type)"""


@query(_SUMMARY)
def reward_monthly_summary(spark, sf_dir):
    """Spending and the rewards of all programs and amounts."""
    return _summary(spark, sf_dir)


@query(_SUMMARY)
def reward_monthly_summary_all(spark, sf_dir):
    """The same under its earlier name."""
    return _summary(spark, sf_dir)


@query(
    f"""WITH {_APPLIED}, a AS (SELECT applied.*, priority, load_ord FROM applied JOIN pr USING (reward_id))
    SELECT strftime(transaction_date, '%Y-%m') AS month, bank_no AS bank_name, card_type, pool_id, CASE pool_id WHEN 'high' THEN 'high payments' ELSE pool_id END AS pool_name, CAST(sum(reward) AS DOUBLE) AS reward, bool_or(is_capped) AS is_capped,
    coalesce(CAST(arg_min(cap, (transaction_date, transaction_id, priority, load_ord)) FILTER (WHERE cap IS NOT NULL) AS DOUBLE), 0) AS cap_amount FROM a WHERE pool_id IS NOT NULL GROUP BY ALL"""
)
def pool_utilization(spark, sf_dir):
    """Use of each pool by month, bank and card."""
    _, out = _rewards(spark, sf_dir)
    rows = out.withColumns({"month": C.month_key(F.col("transaction_date")), "bank_name": F.col("bank_no"), "card_type": F.col("card_id")}).where("pool_id is not null")
    return summaries.pool_use(rows)


# A whole run: excluded types, statement months by bank and card, locked base programs, pool rules with banks and cards.
_RUN_ROWS = """('q1','ALL','ALL','stop','campaign','NONE','point','PER_ITEM','floor',1,true,0,NULL,NULL,NULL,0),
 ('q2','3','','pick','campaign','BILLING_CYCLE','tree_points','PER_ITEM','round',10,false,2,1500,NULL,NULL,1),
 ('q3','ALL','building','Alpha','base','BILLING_CYCLE','point','AGGREGATE','floor',20,false,1,NULL,NULL,NULL,2),
 ('q4','ALL','BUILDING','beta','base','CALENDAR_MONTH','openpoint','PER_ITEM','',30,false,1.5,2000,NULL,NULL,3),
 ('q5','ALL','','gamma','base','TRANSACTION_DATE','cashback_floor','PER_ITEM','',40,false,0.5,NULL,NULL,NULL,4)"""
_SELECTED = "('', 'building', 'ALPHA', DATE'1996-01-01', DATE'1996-06-30', 0), ('', 'Building', 'BETA', DATE'1996-06-15', DATE'1996-12-31', 0), ('3', NULL, 'Gamma', DATE'1997-01-01', DATE'1997-03-31', 1)"


def _run(spark: SparkSession, sf_dir: str) -> reward_run.RewardRun:
    shop = F.col("normalized_merchant")
    kind = F.when(shop.endswith("1"), C.REPAYMENT).when(shop.endswith("2"), C.POINTS).otherwise(F.col("transaction_type"))
    rows = _firsts(spark, sf_dir).withColumn("transaction_type", kind)
    gold = rows.withColumns({"card_id": F.col("card_type"), "merchant_display": F.col("category")})
    days = cut(tx(spark, sf_dir).select("bank_no", F.trunc("posting_date", "month").alias("m")).distinct())
    closes = days.select("bank_no", F.lit(None).cast("string").alias("card_type"), F.date_format("m", "yyyy-MM").alias("statement_month"), F.date_add("m", F.col("bank_no").cast("int") % 20 + 4).alias("closing_date"), F.lit(None).cast("date").alias("actual_closing_date"))
    own = days.where("bank_no = '3'").select("bank_no", F.lit(" building ").alias("card_type"), F.date_format("m", "yyyy-MM").alias("statement_month"), F.col("m").alias("closing_date"), F.last_day("m").alias("actual_closing_date"))
    names = [c.split()[0] for c in _PROGRAMS.replace("(9,4)", "").replace("(18,2)", "").split(",")]
    types = [c.split()[1].replace(";", ",") for c in _PROGRAMS.replace("(9,4)", "(9;4)").replace("(18,2)", "(18;2)").split(",")]
    programs = spark.sql(f"SELECT * FROM VALUES {_RUN_ROWS} AS t({', '.join(names)})").select(*(F.col(n).cast(k).alias(n) for n, k in zip(names, types, strict=True)))
    links = spark.createDataFrame([("Q1", "gone", 0), ("q2", "CARDS", 1), ("q9", "cards", 2)], "reward_id string, pool_id string, link_ord int")
    pools = spark.createDataFrame(
        [("gone", "gone", None, '[{"normalized_merchant":"#00000009"}]'), ("cards", "two cards", '[{"merchant_location":"europe"}]', '[{"bank_no":"3","card_id":["BUILDING","machinery"],"payment_process":["ALL"],"merchant_rate":3},{"bank_no":["ALL"],"card_id":"automobile","merchant_display":["BRASS","PROMO"]}]')],
        "pool_id string, pool_name string, pass_rules string, rules string",
    )
    chosen = spark.sql(f"SELECT * FROM VALUES {_SELECTED} AS t(bank_no, card_id, base_reward_program, start_date, end_date, strategy_ord)")
    return reward_run.run_rewards(gold, reward_run.RewardTables(programs, links, reward_tables.pools(pools), chosen, closes.unionByName(own)))


_FOREIGN_DAY, _PHONE_DAY = (" OR ".join(f"abs(datediff('day', DATE'{d}', transaction_date)) <= {n}" for d in ("1996-01-01", "1996-06-30", "1996-06-15", "1996-12-31")) for n in (1, 2))
_IN = "transaction_date BETWEEN DATE'{}' AND DATE'{}'"
_RUN = f"""{TX}, u AS (SELECT * FROM tx QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY transaction_date, posting_date, bank_no, card_type, normalized_merchant, payment_amount, category) = 1),
 t AS (SELECT * FROM u WHERE normalized_merchant NOT LIKE '%1' AND normalized_merchant NOT LIKE '%2'),
 m AS (SELECT DISTINCT bank_no AS b, CAST(date_trunc('month', posting_date) AS DATE) AS m FROM tx), cl AS (SELECT b, '' AS c, strftime(m, '%Y-%m') AS sm, m + CAST(CAST(b AS INT) % 20 + 4 AS INT) AS e FROM m UNION ALL SELECT b, 'BUILDING', strftime(m, '%Y-%m'), CAST(last_day(m) AS DATE) FROM m WHERE b = '3'),
 iv AS (SELECT *, CAST(coalesce(lag(e) OVER (PARTITION BY b, c ORDER BY sm), e - INTERVAL 1 MONTH) AS DATE) + 1 AS f FROM cl),
 sm AS (SELECT t.*, coalesce(o.sm, d.sm, strftime(posting_date, '%Y-%m')) AS sm FROM t LEFT JOIN iv o ON o.b = bank_no AND o.c = card_type AND posting_date BETWEEN o.f AND o.e LEFT JOIN iv d ON d.b = bank_no AND d.c = '' AND posting_date BETWEEN d.f AND d.e),
 lk AS (SELECT *, CASE WHEN card_type = 'BUILDING' AND ({_IN.format("1996-01-01", "1996-12-31")} OR (transaction_type = '一般國外交易' AND ({_FOREIGN_DAY})) OR (payment_process IS NOT NULL AND ({_PHONE_DAY}))) THEN
     CASE WHEN {_IN.format("1996-01-01", "1996-06-14")} THEN ['alpha'] WHEN {_IN.format("1996-06-15", "1996-06-30")} THEN ['alpha', 'beta'] WHEN {_IN.format("1996-07-01", "1996-12-31")} THEN ['beta'] ELSE [] END
   WHEN bank_no = '3' AND {_IN.format("1997-01-01", "1997-03-31")} THEN ['gamma'] ELSE [] END AS locked FROM sm),
 pr AS (SELECT * FROM (VALUES {_RUN_ROWS}) v(reward_id, p_bank, p_card, reward_program, source, cycle, rtype, method, strat, priority, brk, rate0, cap, s, e, load_ord)),
 c AS (SELECT lk.*, pr.* FROM lk JOIN pr ON p_bank IN ('ALL', bank_no) AND upper(p_card) IN ('ALL', '', card_type) AND (source <> 'base' OR len(locked) = 0 OR list_contains(locked, lower(reward_program)))),
 h AS (SELECT *, CASE WHEN reward_id = 'q1' AND contains(normalized_merchant, '#00000009') THEN 'gone' WHEN reward_id = 'q2' AND merchant_location <> 'EUROPE' AND ((card_type IN ('BUILDING', 'MACHINERY') AND payment_process IS NOT NULL) OR (card_type = 'AUTOMOBILE' AND (contains(category, 'BRASS') OR contains(category, 'PROMO')))) THEN 'cards' END AS pool_id FROM c),
 g AS (SELECT *, CAST(CASE WHEN pool_id = 'cards' AND card_type <> 'AUTOMOBILE' THEN 3 ELSE rate0 END AS DECIMAL(9,4)) AS rate FROM h WHERE reward_id NOT IN ('q1', 'q2') OR pool_id IS NOT NULL),
 wf AS (SELECT * FROM g QUALIFY coalesce(max(CAST(brk AS INT)) OVER (PARTITION BY transaction_id ORDER BY priority, load_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0),
 a2 AS (SELECT *, concat_ws('|', bank_no, card_type, sm) AS k, CAST(round(payment_amount * rate / 100) AS DECIMAL(18,2)) AS p FROM wf WHERE reward_id = 'q2' UNION ALL
   SELECT *, concat_ws('|', 'm', bank_no, card_type, strftime(transaction_date, '%Y-%m')), CAST(round(payment_amount * rate / 100, 2) AS DECIMAL(18,2)) FROM wf WHERE reward_id = 'q4'),
 b2 AS (SELECT *, sum(p) OVER ({_NOW}) AS cs FROM a2), c2 AS (SELECT *, max(cs) OVER ({_HAD}) AS cm FROM b2),
 a3 AS (SELECT *, concat_ws('|', bank_no, card_type, sm) AS k FROM wf WHERE reward_id = 'q3'), b3 AS (SELECT *, CAST(floor(sum(payment_amount) OVER ({_NOW}) * rate / 100) AS DECIMAL(18,2)) AS earned FROM a3), c3 AS (SELECT *, greatest(0, coalesce(max(earned) OVER ({_HAD}), 0)) AS had FROM b3),
 ap AS (SELECT transaction_id, reward_id, pool_id, rate, CAST(0 AS DECIMAL(18,2)) AS reward, FALSE AS is_capped FROM wf WHERE reward_id = 'q1' UNION ALL SELECT transaction_id, reward_id, pool_id, rate, CAST(floor(payment_amount * rate / 100) AS DECIMAL(18,2)), FALSE FROM wf WHERE reward_id = 'q5'
   UNION ALL SELECT transaction_id, reward_id, pool_id, rate, CASE WHEN coalesce(cm >= cap, FALSE) THEN 0 ELSE least(p, cap - (cs - p)) END, coalesce(cm >= cap, FALSE) OR cs > cap FROM c2 UNION ALL SELECT transaction_id, reward_id, pool_id, rate, greatest(had, earned) - had, FALSE FROM c3),
 rep AS (SELECT t.transaction_id, t.transaction_date, t.bank_name, t.card_type, t.payment_amount, coalesce(reward_program, '未匹配方案') AS reward_program, coalesce(rtype, '') AS reward_type, CASE WHEN ap.reward_id IS NULL THEN 'N/A' ELSE coalesce(pool_id, 'BASE_PROGRAM') END AS pool_id,
   CASE WHEN ap.reward_id IS NULL THEN '無回饋池' WHEN pool_id IS NULL THEN '全通路基礎方案' WHEN pool_id = 'cards' THEN 'two cards' ELSE pool_id END AS pool_name, CAST(coalesce(rate, 0) AS DOUBLE) AS effective_rate, coalesce(reward, 0) AS reward, coalesce(is_capped, FALSE) AS is_capped, cap, priority, load_ord,
   CASE pool_id WHEN 'gone' THEN '#00000009' WHEN 'cards' THEN CASE WHEN t.card_type = 'AUTOMOBILE' THEN 'BRASS;PROMO' ELSE '' END ELSE '' END AS matched_rule_merchant FROM t LEFT JOIN ap USING (transaction_id) LEFT JOIN pr ON pr.reward_id = ap.reward_id)"""


@query(
    f"""WITH {_RUN} SELECT transaction_id, bank_name, card_type, reward_program, pool_id, pool_name, matched_rule_merchant, effective_rate, CAST(reward AS DOUBLE) AS calculated_reward,
    CAST(sum(reward) OVER (PARTITION BY transaction_id) AS DOUBLE) AS total_txn_reward, is_capped, CAST(cap AS DOUBLE) AS cap_amount FROM rep"""
)
def reward_run_report(spark, sf_dir):
    """The report of a whole run."""
    money = {c: F.col(c).cast("double") for c in ("effective_rate", "calculated_reward", "total_txn_reward", "cap_amount")}
    names = ["transaction_id", "bank_name", "card_type", "reward_program", "pool_id", "pool_name", "matched_rule_merchant", "effective_rate", "calculated_reward", "total_txn_reward", "is_capped", "cap_amount"]
    return _run(spark, sf_dir).report.select(*(money.get(n, F.col(n)).alias(n) for n in names))


_UNITS = "CASE {} WHEN 'tree_points' THEN '小樹點' WHEN 'openpoint' THEN 'OPENPOINT' ELSE '元' END"
_MARTS = f"""{_RUN}, n AS (SELECT bank_name, card_type, reward_type, count(*) AS n FROM rep WHERE reward > 0 AND reward_type <> '' GROUP BY ALL),
    cu AS (SELECT bank_name, card_type, {_UNITS.format("reward_type")} AS unit FROM n QUALIFY row_number() OVER (PARTITION BY bank_name, card_type ORDER BY n DESC, reward_type) = 1)"""


@query(
    f"""WITH {_MARTS}, s AS (SELECT strftime(transaction_date, '%Y-%m') AS month, bank_name, card_type, sum(a) AS a FROM (SELECT DISTINCT transaction_id, transaction_date, bank_name, card_type, payment_amount AS a FROM rep) GROUP BY ALL),
    r AS (SELECT strftime(transaction_date, '%Y-%m') AS month, bank_name, card_type, sum(reward) AS r FROM rep GROUP BY ALL)
    SELECT month, bank_name, card_type, CAST(a AS DOUBLE) AS total_spending, CAST(r AS DOUBLE) AS total_reward, CASE WHEN a > 0 THEN round_even(CAST(r AS DOUBLE) * 100 / CAST(a AS DOUBLE), 2) + 0 ELSE 0 END AS effective_rate, coalesce(unit, '元') AS reward_unit
    FROM s JOIN r USING (month, bank_name, card_type) LEFT JOIN cu USING (bank_name, card_type)"""
)
def reward_run_months(spark, sf_dir):
    """The mart's months of a whole run."""
    return reward_run.mart_tables(_run(spark, sf_dir).report)["rewards_monthly_summary"]


@query(
    f"""WITH {_MARTS}, pn AS (SELECT bank_name, card_type, pool_name, reward_type, count(*) AS n FROM rep WHERE reward_type <> '' GROUP BY ALL),
    pu AS (SELECT bank_name, card_type, pool_name, {_UNITS.format("reward_type")} AS own FROM pn QUALIFY row_number() OVER (PARTITION BY bank_name, card_type, pool_name ORDER BY n DESC, reward_type) = 1)
    SELECT strftime(transaction_date, '%Y-%m') AS month, bank_name, card_type, pool_id, pool_name, CAST(sum(reward) AS DOUBLE) AS total_reward, bool_or(is_capped) AS is_capped,
    coalesce(CAST(arg_min(cap, (transaction_date, transaction_id, priority, load_ord)) FILTER (WHERE cap IS NOT NULL) AS DOUBLE), 0) AS cap_amount, coalesce(any_value(own), any_value(unit), '元') AS reward_unit
    FROM rep LEFT JOIN pu USING (bank_name, card_type, pool_name) LEFT JOIN cu USING (bank_name, card_type) GROUP BY month, bank_name, card_type, pool_id, pool_name"""
)
def reward_run_pools(spark, sf_dir):
    """The mart's pools of a whole run."""
    return reward_run.mart_tables(_run(spark, sf_dir).report)["rewards_pool_utilization"]


@query(
    f"""WITH {TX}, s AS (SELECT * FROM (VALUES ('alpha', DATE'1996-01-01', DATE'1996-06-30'), ('beta', DATE'1996-06-15', DATE'1996-12-31')) v(p, s, e)),
    d AS (SELECT DISTINCT transaction_date AS d FROM tx), j AS (SELECT d, string_agg(p, ',' ORDER BY p) FILTER (WHERE d BETWEEN s AND e) AS locked, bool_or(abs(datediff('day', s, d)) <= 2 OR abs(datediff('day', e, d)) <= 2) AS near_change
    FROM d JOIN s ON d BETWEEN s - 2 AND e + 2 GROUP BY ALL) SELECT transaction_date, coalesce(locked, '') AS locked, coalesce(near_change, FALSE) AS near_change, count(*) AS n FROM tx LEFT JOIN j ON transaction_date = d GROUP BY ALL"""
)
def day_selection(spark, sf_dir):
    rows = spark.sql("SELECT * FROM VALUES ('alpha', DATE'1996-01-01', DATE'1996-06-30'), ('beta', DATE'1996-06-15', DATE'1996-12-31') AS t(base_reward_program, start_date, end_date)")
    out = rewards.day_selection(tx(spark, sf_dir), rows, 2)
    locked = F.coalesce(F.array_join("locked", ","), F.lit(""))
    return out.groupBy("transaction_date", locked.alias("locked"), F.coalesce("near_change", F.lit(False)).alias("near_change")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {TX}, p AS (SELECT *, CASE WHEN payment_process IS NULL THEN '實體卡/虛擬卡' WHEN contains(payment_process, 'HIGH') THEN 'Linepay' WHEN payment_process IN ('1-URGENT', '3-MEDIUM') THEN payment_process ELSE '其他' END AS tier FROM tx)
    SELECT tier, count(*) AS n, {AMOUNT} AS total_amount FROM p GROUP BY ALL"""
)
def payment_tier(spark, sf_dir):
    """Payments by tier, the tiers from a table of priorities."""
    given = spark.createDataFrame([("1-URGENT", "3"), ("3-MEDIUM", "9"), ("5-LOW", "17")], "payment_process string, priority string")
    first, second = summaries.payment_tiers(given)
    pay = F.when(F.col("payment_process") == "2-HIGH", "LINE 2-HIGH Pay").otherwise(F.col("payment_process"))
    return tx(spark, sf_dir).groupBy(summaries.tier(pay, first, second).alias("tier")).agg(F.count("*").alias("n"), summaries.total().alias("total_amount"))


@query(
    """WITH t AS (SELECT CAST(o_orderdate AS DATE) AS d, o_orderkey % 12 + 1 AS b FROM orders), m AS (SELECT month(d) AS m, day(d) AS dd, b FROM t)
    SELECT b AS bill_month, CAST(coalesce(try_cast(concat(CASE WHEN m - b > 6 THEN 1995 WHEN b = 12 AND m = 1 THEN 1997 ELSE 1996 END, '-', lpad(CAST(m AS VARCHAR), 2, '0'), '-', lpad(CAST(dd AS VARCHAR), 2, '0')) AS DATE), NULL) AS DATE) AS day, count(*) AS n FROM m GROUP BY ALL"""
)
def smart_dates(spark, sf_dir):
    """Days without a year on bills of every month of 1996."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.date_format(F.col("o_orderdate").cast("date"), "M/d").alias("text"), (F.col("o_orderkey") % 12 + 1).alias("bill_month"))
    return rows.groupBy("bill_month", C.smart_date(F.col("text"), F.lit(1996), F.col("bill_month").cast("int")).alias("day")).agg(F.count("*").alias("n"))


@query(
    """WITH p AS (SELECT CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS v, l_linenumber % 5 AS k FROM lineitem)
    SELECT k AS way, CAST(sum(CASE WHEN k IN (0, 3) THEN floor(v) WHEN k = 1 THEN ceil(v) ELSE round(v) END) AS DOUBLE) AS total, CAST(sum(CASE WHEN k IN (0, 3) THEN floor(v * 100) WHEN k = 1 THEN ceil(v * 100) ELSE round(v * 100) END) / 100 AS DOUBLE) AS total_2 FROM p GROUP BY ALL"""
)
def reward_rounding(spark, sf_dir):
    """Sums under each way of rounding, to whole numbers and to two digits."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    v = F.col("l_extendedprice").cast("decimal(18,2)") * F.col("l_discount").cast("decimal(4,2)")
    way = (F.col("l_linenumber") % 5).cast("long")
    how = F.element_at(F.array(*(F.lit(x) for x in ("floor", "up", "round", "down", "other"))), (way + 1).cast("int"))
    sums = [F.sum(C.rounded(v, how, F.lit(d))).cast("double").alias(n) for d, n in ((0, "total"), (2, "total_2"))]
    return line.groupBy(way.alias("way")).agg(*sums)


@query(
    """WITH t AS (SELECT CASE WHEN l_linenumber % 3 = 0 THEN '' WHEN l_linenumber % 3 = 1 THEN 'nan' ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS raw,
      CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) END AS paid, CAST(l_suppkey AS VARCHAR) AS bank, CAST(l_partkey AS VARCHAR) AS card, l_returnflag AS flag FROM lineitem),
    c AS (SELECT right('000' || bank, 3) AS bank_no, right('0000' || card, 4) AS card_no, CASE WHEN flag = 'A' THEN 'TWD' ELSE flag END AS raw_currency, TRY_CAST(raw AS DECIMAL(18,2)) AS r, TRY_CAST(paid AS DECIMAL(18,2)) AS p FROM t)
    SELECT bank_no, card_no, raw_currency, CAST(sum(coalesce(r, p, 0)) AS DOUBLE) AS raw_amount, CAST(sum(coalesce(p, r, 0)) AS DOUBLE) AS payment_amount, count(*) AS n FROM c GROUP BY ALL"""
)
def bronze_contract(spark, sf_dir):
    """Texts of a statement under the contract: numbers of their width, amounts that stand in for each other."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    part = F.col("l_linenumber") % 3
    rows = line.select(
        F.when(part == 0, "").when(part == 1, "nan").otherwise(F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("currency_amount"),
        F.when(F.col("l_linenumber") % 2 != 0, F.col("l_quantity").cast("decimal(18,2)").cast("string")).alias("payment_amount"),
        F.concat(F.col("l_suppkey").cast("string"), F.lit(".0")).alias("bank_no"),
        F.concat(F.lit("no "), F.col("l_partkey").cast("string")).alias("card_no"),
        F.when(F.col("l_returnflag") == "A", "<NA>").otherwise(F.col("l_returnflag")).alias("currency_type"),
    )
    out = bronze.contract(rows)
    sums = [F.sum(c).cast("double").alias(c) for c in ("raw_amount", "payment_amount")]
    return out.groupBy("bank_no", "card_no", "raw_currency").agg(*sums, F.count("*").alias("n"))


@query(
    f"""WITH {TX}, k AS (SELECT transaction_date, row_number() OVER (PARTITION BY bank_no ORDER BY transaction_id) AS line_no, bank_no AS file, transaction_id, CASE WHEN hash_no % 7 = 0 THEN card_type END AS head FROM (SELECT *, CAST(split_part(transaction_id, '-', 1) AS BIGINT) AS hash_no FROM tx)),
    f AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS card FROM k)
    SELECT file, card AS card_type, count(*) AS n FROM f WHERE head IS NULL GROUP BY ALL"""
)
def card_header_fill(spark, sf_dir):
    """Lines of a file that name a card hand it to the lines below."""
    rows = tx(spark, sf_dir).select(F.col("bank_no").alias("file"), "transaction_id", "card_type")
    line = F.row_number().over(Window.partitionBy("file").orderBy("transaction_id"))
    head = F.split("transaction_id", "-")[0].cast("long") % 7 == 0
    rows = rows.select("file", line.alias("line_no"), F.when(head, F.concat_ws(" ", "card_type", F.lit("卡號 1234"))).otherwise(F.col("transaction_id")).alias("merchant"))
    return bank_rules.fill_card_headers(rows).groupBy("file", "card_type").agg(F.count("*").alias("n"))


def _view(mode: str) -> str:
    keys = ", ".join(segments.MODES[mode])
    using = f"USING ({keys})"
    named = "SELECT * REPLACE (coalesce(payment_process, '實體卡/其他') AS payment_process) FROM sp WHERE payment_amount > 0"
    rank = lambda v: f"CAST((rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0) / count(*) OVER () AS DOUBLE)"
    return f"""WITH {SPENT}, x AS (SELECT *, CAST(payment_amount AS DOUBLE) AS x FROM ({named})), d AS (SELECT max(transaction_date) - 180 AS since FROM x),
    s AS (SELECT {keys}, count(*) AS n, {AMOUNT} AS total_amount, coalesce(stddev_samp(x), 0) AS std, {AMOUNT} / count(*) AS avg, min(x) AS low, max(x) AS high, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3,
      coalesce(CAST(sum(payment_amount) FILTER (WHERE transaction_date >= since) AS DOUBLE), 0) AS recent, count(*) FILTER (WHERE transaction_date >= since) AS n_recent FROM x, d GROUP BY {keys}),
    w AS (SELECT *, greatest(low, q1 - (q3 - q1) * 1.5) AS whisker_low, least(high, q3 + (q3 - q1) * 1.5) AS whisker_high, {rank('total_amount')} AS mr, {rank('recent')} AS rr FROM s),
    o AS (SELECT {keys}, count(*) AS n_outliers, max(x) AS largest FROM x JOIN w {using} WHERE x < whisker_low OR x > whisker_high GROUP BY {keys})
    SELECT {keys}, n, total_amount, round(std / avg, 3) AS cv, n_recent, {_labels(segments.GROUP_LABELS, 'mr >= 0.8 AND n_recent > 0', 'mr >= 0.8', 'n_recent > 0 AND rr >= 0.8', 'n_recent > 0')} AS rfm_segment,
      coalesce(n_outliers, 0) AS n_outliers, least(coalesce(n_outliers, 0), 25) AS n_listed, round(largest, 2) AS largest_outlier FROM w LEFT JOIN o {using}"""


def _volatility(mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = segments.volatility_view(spent(spark, sf_dir), mode)
        listed = [F.size("outliers").cast("long").alias("n_listed"), F.get("outliers", F.lit(0))["amount"].alias("largest_outlier")]
        return out.select(*segments.MODES[mode], "n", "total_amount", "cv", "n_recent", "rfm_segment", "n_outliers", *listed)

    run.__name__ = f"volatility_view_{mode}"
    return run


for _mode in segments.MODES:
    query(_view(_mode))(_volatility(_mode))


_BY_SEGMENT = _rfm("normalized_merchant", _SHORT, f", {_labels(segments.MERCHANT_LABELS, *_SEGMENTS)} AS segment")


@query(f"SELECT segment, count(*) AS n FROM ({_BY_SEGMENT}) GROUP BY ALL")
def segment_counts(spark, sf_dir):
    """How many merchants each segment has."""
    out = segments.rfm(spent(spark, sf_dir), ["normalized_merchant"], _SHORT).withColumn("segment", segments.merchant_segment())
    return segments.value_counts(out, "segment")


@query(
    f"""WITH {_APPLIED}, k AS (SELECT bank_no, card_type, rtype, count(*) AS n FROM applied JOIN pr USING (reward_id, reward_program) WHERE reward > 0 GROUP BY ALL),
    m AS (SELECT *, row_number() OVER (PARTITION BY bank_no, card_type ORDER BY n DESC, rtype) AS place FROM k)
    SELECT bank_no, card_type, CASE rtype WHEN 'openpoint' THEN 'OPENPOINT' ELSE '元' END AS reward_unit FROM m WHERE place = 1"""
)
def reward_units(spark, sf_dir):
    """The unit of each card's most frequent reward."""
    _, out = _rewards(spark, sf_dir)
    return summaries.predominant_units(out, "bank_no", "card_id").withColumnsRenamed({"card_id": "card_type"})


@query(
    """WITH h AS (SELECT CAST(c_custkey AS VARCHAR) AS card_id, c_mktsegment AS card_type, c_nationkey % 5 = 0 AS active FROM customer)
    SELECT card_type, CASE WHEN bool_or(active) THEN 'active' ELSE 'cancelled' END AS status FROM h WHERE card_type <> 'BUILDING' GROUP BY ALL UNION ALL SELECT 'BUILDING', 'cancelled'"""
)
def card_status(spark, sf_dir):
    """Status of each card type from the histories of its cards."""
    history = F.array(F.struct(F.when((F.col("c_nationkey") % 5 == 0) & (F.col("c_mktsegment") != "BUILDING"), "Active").otherwise("cancelled").alias("status")))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("card_id"), F.col("c_mktsegment").alias("card_type"), history.alias("card_history"))
    return cards.card_status(rows)


@query(
    f"""WITH {TX}, a AS (SELECT transaction_id, payment_amount AS x FROM tx WHERE posting_date < DATE '1997-01-01'), b AS (SELECT transaction_id, payment_amount * 2 AS x FROM tx WHERE posting_date >= DATE '1996-01-01'),
    m AS (SELECT * FROM a WHERE transaction_id NOT IN (SELECT transaction_id FROM b) UNION ALL SELECT * FROM b) SELECT transaction_id, CAST(sum(x) AS DOUBLE) AS x, count(*) AS n FROM m GROUP BY ALL"""
)
def upsert(spark, sf_dir):
    """Later rows replace earlier ones of the same id."""
    rows = cut(tx(spark, sf_dir).select("transaction_id", "posting_date", "payment_amount"))  # read for both
    old = rows.where("posting_date < '1997-01-01'").select("transaction_id", F.col("payment_amount").cast("decimal(20,2)").alias("x"))
    new = rows.where("posting_date >= '1996-01-01'").select("transaction_id", (F.col("payment_amount") * 2).cast("decimal(20,2)").alias("x"))
    return refine.merge_by_key(old, new, ["transaction_id"]).groupBy("transaction_id").agg(F.sum("x").cast("double").alias("x"), F.count("*").alias("n"))


@query(f"WITH {TX}, a AS (SELECT DISTINCT transaction_id FROM tx WHERE posting_date < DATE '1997-01-01') SELECT DISTINCT transaction_id FROM tx WHERE transaction_id NOT IN (SELECT transaction_id FROM a)")
def idempotent_rows(spark, sf_dir):
    """Rows that an idempotent load still appends."""
    rows = tx(spark, sf_dir).select("transaction_id", "posting_date")
    return refine.only_new(rows.select("transaction_id").distinct(), rows.where("posting_date < '1997-01-01'").select("transaction_id"), ["transaction_id"])


@query(
    """WITH e AS (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value, CAST(ts AS DATE) AS day FROM events)
    SELECT event_type, day, count(*) AS n, count(DISTINCT k) AS n_keys, round(sum(CAST(value AS DECIMAL(18,2))), 2)::DOUBLE AS total FROM e GROUP BY ALL"""
)
def events_by_day(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return rows.groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("k").alias("n_keys"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


# The mart of a filtered run: one read of the transactions for all its results.
_WHICH = {"banks": ["nation 1", "NATION_2", "5"], "cards": ["BUILDING", "MACHINERY"], "payments": ["1-URGENT", "2-HIGH"], "time_window": "2Y", "location": ["國外"]}
_BANKS = [{"bank_id": "one", "bank_no": "1", "bank_name": "NATION_1", "bills_mapping_name": None, "keywords": ["Nation 1"]}, {"bank_id": "five", "bank_no": "5", "bank_name": "NATION_5", "keywords": []}]
_CHOSEN = f"""{SPENT}, a AS (SELECT max(transaction_date) AS d FROM tx), ch AS (SELECT sp.* REPLACE (coalesce(category, '未分類') AS category) FROM sp, a WHERE bank_name IN ('NATION_1', 'NATION_2', 'NATION_5') AND card_type IN ('BUILDING', 'MACHINERY')
    AND (payment_process IN ('1-URGENT', '2-HIGH') OR payment_process IS NULL) AND transaction_date BETWEEN d - 730 AND d AND category IN ('PROMO', 'LARGE'))"""


def _mart(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return etl.run_analytics(tx(spark, sf_dir), categories=["PROMO", "LARGE"], bank_table=_BANKS, wanted=[name], **_WHICH)[name]


@query(f"WITH {_CHOSEN} SELECT strftime(transaction_date, '%Y-%m') AS month, bank_name, card_type, {AMOUNT} AS total_amount, count(*) AS n_transactions, {AMOUNT} / count(*) AS avg_amount FROM ch GROUP BY ALL")
def mart_monthly_card(spark, sf_dir):
    """Months by bank and card of a filtered run."""
    return _mart(spark, sf_dir, "matrix_monthly_card")


@query(
    f"""WITH {_CHOSEN}, {_ENDS.replace("FROM tx)", "FROM ch)")},
    l AS (SELECT 0 AS layer, bank_name AS source, card_type AS target, {AMOUNT} AS value FROM f GROUP BY ALL UNION ALL SELECT 1, card_type, payment_process, {AMOUNT} FROM f GROUP BY ALL UNION ALL SELECT 2, payment_process, category, {AMOUNT} FROM f GROUP BY ALL)
    SELECT * FROM l WHERE value > 0"""
)
def mart_flows(spark, sf_dir):
    """Flows of a filtered run."""
    return _mart(spark, sf_dir, "sankey_flow_links")


@query(
    f"""WITH {TX}, t AS (SELECT normalized_merchant AS name, avg(CAST(payment_amount AS DOUBLE)) AS a, coalesce(stddev_samp(CAST(payment_amount AS DOUBLE)), 0) AS s, count(*) AS frequency, {AMOUNT} AS monetary
      FROM tx WHERE transaction_type <> '退刷' GROUP BY ALL), x AS (SELECT *, round_even(a, 2) AS avg_ticket, round_even(s, 2) AS std_ticket FROM t),
    n AS (SELECT normalized_merchant AS name, category, count(*) AS n FROM tx WHERE transaction_type <> '退刷' GROUP BY ALL), c AS (SELECT name, category FROM n QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, category) = 1),
    m AS (SELECT median(avg_ticket) FILTER (WHERE avg_ticket > 0) AS ma, median(std_ticket) FILTER (WHERE std_ticket > 0) AS ms FROM x)
    SELECT name, frequency, monetary, category, {_labels(segments.QUADRANT_LABELS, 'avg_ticket >= ma AND std_ticket < ms', 'avg_ticket >= ma', 'std_ticket < ms')} AS volatility_segment FROM x JOIN c USING (name), m ORDER BY monetary DESC, name LIMIT 200"""
)
def mart_dashboard(spark, sf_dir):
    """The dashboard's merchants of a run over all transactions: the 200 with the most money."""
    return etl.run_analytics(tx(spark, sf_dir), wanted=["dashboard_merchants"])["dashboard_merchants"].select("name", "frequency", "monetary", "category", "volatility_segment")


@query(
    f"""WITH {SPENT}, p AS (SELECT category, payment_amount, CASE WHEN payment_process IS NULL THEN '實體卡/虛擬卡' WHEN payment_process IN ('1-URGENT', '3-MEDIUM') THEN payment_process ELSE '其他' END AS pay FROM sp WHERE payment_process IS NULL OR payment_process <> '5-LOW' OR payment_amount < 0),
    g AS (SELECT category, {AMOUNT} AS total_amount, {_cells('pay', ("none at all", "1-URGENT", "實體卡/虛擬卡", "3-MEDIUM", "其他"))} FROM p GROUP BY ALL)
    SELECT category, total_amount, {', '.join(f'"{v}" * 100 / CASE WHEN total_amount = 0 THEN 1 ELSE total_amount END AS "{v}"' for v in ("none at all", "1-URGENT", "實體卡/虛擬卡", "3-MEDIUM", "其他"))} FROM g"""
)
def matrix_pruned(spark, sf_dir):
    """The matrix with an empty column of the first tier, which stays, and one of the second, which goes."""
    rows = spent(spark, sf_dir).where("payment_process is null or payment_process <> '5-LOW' or payment_amount < 0")
    pay = F.col("payment_process")
    kind = F.when(pay.isNull(), summaries.CARD).when(pay.isin("1-URGENT", "3-MEDIUM"), pay).otherwise(summaries.OTHER)
    return summaries.pruned_matrix(rows, kind, ["none at all", "1-URGENT"], ["3-MEDIUM", "nobody"]).drop("place")


@query(
    """WITH e AS (SELECT event_type, CAST(ts AS DATE) AS day, value FROM events), g AS (SELECT event_type, day, sum(CAST(value AS DECIMAL(18,2))) AS v, count(*) AS n FROM e GROUP BY ALL)
    SELECT event_type, day, CASE WHEN n % 2 = 0 THEN NULL ELSE CAST(v AS DOUBLE) END AS inner_value, n FROM g"""
)
def payload_numbers(spark, sf_dir):
    """Numbers that are none or infinite, inside arrays of structs, come out of payloads as null."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("v"), F.count("*").alias("n"))
    odd = F.when(F.col("n") % 4 == 0, F.lit(float("nan"))).when(F.col("n") % 2 == 0, F.lit(float("inf"))).otherwise(F.col("v"))
    out = sinks.payload(rows.select("event_type", "day", "n", F.array(F.struct(odd.alias("value"), F.lit("x").alias("kept"))).alias("items")))
    back = out.select(F.from_json("payload", "event_type string, day date, n long, items array<struct<value:double,kept:string>>").alias("p")).where("p.items[0].kept = 'x'")
    return back.select("p.event_type", "p.day", F.col("p.items")[0]["value"].alias("inner_value"), "p.n")


@query(
    """WITH c AS (SELECT c_mktsegment AS card_id, c_custkey AS k, row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS n FROM customer)
    SELECT card_id, k, printf('HIST_%04d', n) AS history_id FROM c"""
)
def card_history_ids(spark, sf_dir):
    """Ids of history rows, dense over all cards."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_mktsegment").alias("card_id"), F.col("c_custkey").alias("k"))
    return cards.with_numbers(rows, ["card_id", "k"], "history_id", "HIST_%04d")
