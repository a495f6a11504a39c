"""Monthly tables, pivots, trend, flow links, and the spending matrix."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions import columns as C
from cardloom.functions.lineage import cut
from cardloom.operators import selection

# Payment tiers where no table of payments gives priorities (1 to 7 and 8 to 16), and names of plain cards.
TIER_1 = ("Linepay", "街口支付", "悠遊付", "icash Pay", "一卡通", "全盈+PAY", "全支付")
TIER_2 = ("橘子支付", "台灣pay", "玉山Wallet", "OPEN錢包", "Famipay", "PXPay")
CARD = "實體卡/虛擬卡"
CARD_NAMES = ("實體卡/其他", "實體卡", "虛擬卡", "實體卡/虛擬卡")
LINE_PAY = "Linepay"
OTHER = "其他"
# Order of categories where no list gives one; those that hold the last word come last.
CATEGORY_ORDER = ("百貨量販", "便利商店", "連鎖飲食", "商圈", "生活服務", "電子商務", "保險費用")
LAST_CATEGORY = "保險"
# Units of rewards by what their type holds, the first that fits.
UNITS = (("tree|小樹", "小樹點"), ("line", "LINE POINTS"), ("openpoint", "OPENPOINT"), ("esun|e point|^e_points?$", "玉山 e point"), ("hami", "Hami Point"), ("紅利", "紅利點數"))
MONEY_UNIT = "元"


def total(name: str = "payment_amount") -> Column:
    """Sum as a double, 0 over nothing."""
    return F.coalesce(F.sum(name).cast("double"), F.lit(0.0))


def n_rows(df: DataFrame) -> Column:
    """How many transactions: rows, or the sum of ``n`` where rows are sums of several."""
    return F.sum("n") if "n" in df.columns else F.count("*")


def monthly(df: DataFrame, *keys: str, average: bool = True) -> DataFrame:
    """Total, count and average per month and key; rows without a key are left out."""
    rows = df.dropna(subset=list(keys)).withColumn("month", C.month_key(F.col("transaction_date")))
    out = rows.groupBy("month", *keys).agg(total().alias("total_amount"), n_rows(df).alias("n_transactions"))
    return out.withColumn("avg_amount", F.col("total_amount") / F.col("n_transactions")) if average else out


def pivot(df: DataFrame, row: Column, column: str, values: Sequence[str], fill: float = 0.0, how: str = "sum") -> DataFrame:
    """Amounts by row and the given column values: their sum, count or mean, in one pass."""
    of = {"sum": F.sum, "count": F.count, "mean": F.avg}[how]
    cells = [F.coalesce(of(F.when(F.col(column) == v, F.col("payment_amount"))).cast("double"), F.lit(fill)).alias(v) for v in values]
    return df.groupBy(row).agg(*cells)


def percentages(df: DataFrame, row: str, column: str) -> DataFrame:
    """Share in percent of each column value in its row's total, long form; a total of zero divides by one."""
    cells = df.dropna(subset=[row, column]).groupBy(row, column).agg(total().alias("amount"))
    whole = F.sum(F.col("amount").cast("decimal(28,2)")).over(Window.partitionBy(row)).cast("double")
    return cells.select(row, column, (F.col("amount") * 100 / F.when(whole == 0, 1.0).otherwise(whole)).alias("percent"))


def trend(df: DataFrame, least_months: int = 12) -> DataFrame:
    """Amount of every month from the first to the last, at least ``least_months`` of them, empty ones with zero."""
    months = df.where("transaction_date is not null").groupBy(F.trunc("transaction_date", "month").alias("start")).agg(total().alias("total_amount"))
    ends = months.agg(F.min("start").alias("low"), F.max("start").alias("high"))
    low = F.least("low", F.add_months("high", 1 - least_months))
    series = ends.where("high is not null").select(F.explode(F.sequence(low, F.col("high"), F.expr("interval 1 month"))).alias("start"))
    filled = series.join(months, "start", "left")
    return filled.select(F.date_format("start", "yyyy-MM").alias("month"), F.coalesce("total_amount", F.lit(0.0)).alias("total_amount"))


def dashboard(df: DataFrame) -> DataFrame:
    """One row: total, count, median, active months, cards, payments and monthly average.

    Rows may stand for ``n`` equal tickets each.  The median comes from counts of equal amounts, so no task holds all of them; the different months, cards and payments
    are few and counted from rows that are brought together first.
    """
    month = C.month_key(F.col("transaction_date"))
    each = F.col("payment_amount") * F.col("n") if "n" in df.columns else F.col("payment_amount")
    few = df.groupBy(month.alias("_month"), "card_type", "payment_process").agg(F.sum(each.cast("decimal(38,2)")).alias("_sum"), n_rows(df).alias("_n"))
    out = few.agg(
        F.coalesce(F.sum("_sum").cast("double"), F.lit(0.0)).alias("total_amount"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_transactions"),
        F.countDistinct("_month").alias("active_months"),
        F.countDistinct("card_type").alias("n_cards"),
        F.countDistinct("payment_process").alias("n_payments"),
    )
    middle = selection.medians(df, weighted="n" in df.columns, median_amount=F.col("payment_amount"))
    out = out.join(F.broadcast(middle)).withColumn("monthly_average", F.col("total_amount") / F.greatest("active_months", F.lit(1)))
    return out.select("total_amount", "n_transactions", "median_amount", "active_months", "n_cards", "n_payments", "monthly_average")


FLOW = (("bank_name", "card_type"), ("card_type", "payment_process"), ("payment_process", "category"))
# Names of ends without a value.
END_NAMES = {"bank_name": "其他發卡行", "card_type": "其他卡片", "payment_process": "一般實體刷卡", "category": "未分類", "normalized_merchant": "其他商家"}


def named_ends(df: DataFrame) -> DataFrame:
    """Null and empty ends of flows get their names."""
    return df.withColumns({c: F.when(F.col(c).isNull() | (F.col(c) == ""), n).otherwise(F.col(c)) for c, n in END_NAMES.items() if c in df.columns})


def flow_links(df: DataFrame, threshold: float = 0.0, layers: Sequence[tuple[str, str]] = FLOW, top_merchants: int = 0) -> DataFrame:
    """Weighted edges of each pair of layers above a threshold, in one pass over the rows (grouping sets).

    Ends without a value go under a name; values are rounded to two digits before they are compared.  With
    ``top_merchants`` a last layer leads from categories to the merchants with the largest amounts; its pairs come from the
    same pass, whose sums are written once.
    """
    pairs = [*layers, ("category", "normalized_merchant")] if top_merchants else list(layers)
    names = list(dict.fromkeys(n for pair in pairs for n in pair))
    sets = [[F.col(a), F.col(b)] for a, b in pairs]
    grouped = named_ends(df).groupingSets(sets, *names).agg(F.sum("payment_amount").alias("value"), F.grouping_id().alias("gid"))
    grouped = cut(grouped) if top_merchants else grouped
    out = None
    for k, (a, b) in enumerate(pairs):
        bits = sum(1 << (len(names) - 1 - n) for n, name in enumerate(names) if name not in (a, b))
        part = grouped.where(F.col("gid") == bits)
        if k == len(layers):
            top = part.groupBy("normalized_merchant").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("m")).orderBy(F.desc("m"), "normalized_merchant").limit(top_merchants)
            part = part.join(F.broadcast(top.select("normalized_merchant")), "normalized_merchant", "left_semi")
        part = part.select(F.lit(k).alias("layer"), F.col(a).alias("source"), F.col(b).alias("target"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("value", F.bround("value", 2)).where(F.col("value") > threshold)


def flow_nodes(links: DataFrame) -> DataFrame:
    """Distinct ends of the links."""
    return links.select(F.explode(F.array("source", "target")).alias("name")).distinct()


def payment_tiers(payments: DataFrame) -> tuple[list[str], list[str]]:
    """The payments of the two tiers, by priority, from a table of ``payment_process`` and ``priority``.

    At most the rows of priority 1 to 16 are read, one for each name.
    """
    rank = F.col("priority").try_cast("int")
    rows = payments.where(rank.between(1, 16) & F.col("payment_process").isNotNull()).groupBy(F.trim("payment_process").alias("name")).agg(F.min(rank).alias("rank"))
    tiers: tuple[list[str], list[str]] = ([], [])
    for r in rows.orderBy("rank", "name").collect():
        name = LINE_PAY if r.rank <= 7 and re.search("(?i)line.*pay", r.name) else r.name
        if name not in tiers[r.rank > 7]:
            tiers[r.rank > 7].append(name)
    return tiers if any(tiers) else (list(TIER_1), list(TIER_2))


def tier(c: Column, first: Iterable[str] = TIER_1, second: Iterable[str] = TIER_2) -> Column:
    """Payment tier: blank and card names are a card, LINE Pay under any spelling, then the first listed name found in the value."""
    value = F.trim(c)
    out = F.when(C.blank(c) | value.isin(*CARD_NAMES), CARD).when(c.rlike("(?iu)line.*pay|連加"), LINE_PAY)
    for name in (*first, *second):
        out = out.when(F.lower(value).contains(name.lower()), name)
    return out.otherwise(OTHER)


def spending_matrix(df: DataFrame, payment: Column, columns: Sequence[str]) -> DataFrame:
    """Category rows with their total and the share in percent of each payment column."""
    rows = df.dropna(subset=["category"]).withColumn("_payment", payment)
    cells = [F.coalesce(F.sum(F.when(F.col("_payment") == v, F.col("payment_amount"))).cast("double"), F.lit(0.0)).alias(v) for v in columns]
    out = rows.groupBy("category").agg(total().alias("total_amount"), *cells)
    whole = F.when(F.col("total_amount") == 0, 1.0).otherwise(F.col("total_amount"))
    return out.select("category", "total_amount", *((F.col(f"`{v}`") * 100 / whole).alias(v) for v in columns))


def pruned_matrix(df: DataFrame, payment: Column, first: Sequence[str], second: Sequence[str], order: Sequence[str] = CATEGORY_ORDER) -> DataFrame:
    """The matrix with the columns that hold anything: the card and the first tier always, the second tier and others if used.

    In two phases: categories and payments are summed up into a short table, written once; the columns are chosen from its
    sums, and it is pivoted, not the rows.  ``place`` sorts the categories.
    """
    cells = cut(df.dropna(subset=["category"]).groupBy("category", payment.alias("_payment")).agg(F.sum("payment_amount").alias("payment_amount")))
    kept = [*first, CARD]
    sums = {r["_payment"]: r["s"] for r in cells.where(~F.col("_payment").isin(kept)).groupBy("_payment").agg(total().alias("s")).collect()}
    columns = [*first, CARD, *(c for c in (*second, OTHER) if sums.get(c, 0) > 0)]
    out = spending_matrix(cells, F.col("_payment"), columns)
    return out.withColumn("place", category_place(F.col("category"), order))


def matrix_by_window(df: DataFrame, payment: Column, columns: Sequence[str], windows: dict[str, int | None]) -> DataFrame:
    """The matrix of each look-back window that ends at the last transaction date, from one scan; empty windows have no rows."""
    last = F.broadcast(df.agg(F.max("transaction_date").alias("_last")))
    spans = F.array(*(F.struct(F.lit(n).alias("window"), F.lit(d).cast("int").alias("days")) for n, d in windows.items()))
    rows = df.dropna(subset=["category"]).withColumn("_payment", payment).withColumn("_w", F.explode(spans)).join(last)
    rows = rows.where(F.col("_w.days").isNull() | (F.col("transaction_date") >= F.date_sub("_last", F.col("_w.days"))))
    cells = [F.coalesce(F.sum(F.when(F.col("_payment") == v, F.col("payment_amount"))).cast("double"), F.lit(0.0)).alias(v) for v in columns]
    out = rows.groupBy(F.col("_w.window").alias("window"), "category").agg(total().alias("total_amount"), *cells)
    whole = F.when(F.col("total_amount") == 0, 1.0).otherwise(F.col("total_amount"))
    return out.select("window", "category", "total_amount", *((F.col(f"`{v}`") * 100 / whole).alias(v) for v in columns))


def reward_month_summary(spending: DataFrame, rewards: DataFrame) -> DataFrame:
    """Spending (each transaction once) and rewards by month, bank and card, and the effective rate in percent.

    Without spending above zero the rate is 0.
    """
    keys = ["month", "bank_name", "card_type"]
    once = spending.groupBy(*keys, "transaction_id").agg(F.min("payment_amount").alias("payment_amount"))
    spent = once.groupBy(*keys).agg(total().alias("spending"))
    earned = rewards.groupBy(*keys).agg(total("reward").alias("reward"))
    out = spent.join(earned, keys, "full").fillna(0.0, ["spending", "reward"])
    return out.withColumn("rate_percent", F.when(F.col("spending") > 0, F.col("reward") * 100 / F.col("spending")).otherwise(0.0))


POOL_KEYS = ("month", "bank_name", "card_type", "pool_id", "pool_name")


def pool_use(rewards: DataFrame, order: Sequence[str] = ("transaction_date", "transaction_id", "priority", "load_ord")) -> DataFrame:
    """Reward of each pool by month, bank and card, whether any row met its cap, and the first cap in order (0 if none)."""
    first = F.min_by("cap_amount", F.when(F.col("cap_amount").isNotNull(), F.struct(*order)))
    return rewards.groupBy(*POOL_KEYS).agg(total("reward").alias("reward"), F.max("is_capped").alias("is_capped"), F.coalesce(first.cast("double"), F.lit(0.0)).alias("cap_amount"))


def reward_unit(kind: Column) -> Column:
    """Unit of a reward type; money if nothing else fits."""
    out = F.when(C.blank(kind), MONEY_UNIT)
    for pattern, unit in UNITS:
        out = out.when(F.trim(kind).rlike(f"(?iu){pattern}"), unit)
    return out.otherwise(MONEY_UNIT)


def predominant_units(rewards: DataFrame, *keys: str, paid_first: bool = True) -> DataFrame:
    """Unit of each key's most frequent reward type, the smallest of equally frequent ones.

    With ``paid_first`` only rows with a reward count, if there are any at all.
    """
    rows = rewards.where(~C.blank(F.col("reward_type")) & (F.lower("reward_type") != "nan"))
    if paid_first:
        any_paid = rows.select(F.coalesce(F.max(F.col("reward") > 0), F.lit(False)).alias("_any"))
        rows = rows.join(F.broadcast(any_paid)).where(~F.col("_any") | (F.col("reward") > 0))
    n = rows.groupBy(*keys, "reward_type").agg(F.count("*").alias("_n"))
    first = F.min_by("reward_type", F.struct(-F.col("_n"), F.col("reward_type")))
    return n.groupBy(*keys).agg(reward_unit(first).alias("reward_unit"))


def category_place(c: Column, order: Sequence[str] = CATEGORY_ORDER) -> Column:
    """Sort key of categories: the listed ones in order, others by name, insurance last."""
    place = F.lit(len(order))
    for k, name in reversed(list(enumerate(order))):
        place = F.when(c == name, k).otherwise(place)
    return F.struct(F.coalesce(F.contains(c, F.lit(LAST_CATEGORY)), F.lit(False)).alias("last"), place.alias("place"), c.alias("name"))
