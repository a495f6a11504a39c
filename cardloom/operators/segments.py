"""Recency, frequency and monetary value over several windows, segments, ticket statistics and volatility."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions import columns as C
from cardloom.functions.lineage import cut
from cardloom.operators import selection
from cardloom.operators.summaries import total

WINDOWS = {"d30": 30, "d90": 90, "d180": 180, "d365": 365, "d730": 730, "life": None}
NO_RECENCY = 9999
# Names of groups without a value, and the labels of segments.
NO_CATEGORY, NO_PAYMENT = "未分類", "實體卡/其他"
MERCHANT_LABELS = ("核心商家 (Core)", "流失高價值 (Churned)", "潛力商家 (Rising)", "一般活躍 (Active)", "沉睡 (Dormant)")
CATEGORY_LABELS = ("核心類別 (Core)", "流失高價值類別 (Churned)", "潛力新興類別 (Rising)", "一般活躍類別 (Active)", "沉睡類別 (Dormant)")
PAYMENT_LABELS = ("主力支付 (Main)", "已棄用 (Abandoned)", "輔助支付 (Backup)", "冷門支付 (Rare)")
CARD_LABELS = ("❄️ 冷凍/沉睡", "👑 主要使用卡片", "🎯 特定用途使用卡片", "🔄 備用卡片", "📉 不常用卡片")
GROUP_LABELS = ("核心 (Core)", "流失高價值 (Churned)", "潛力 (Rising)", "一般活躍 (Active)", "沉睡 (Dormant)")
RENAMED = {"潛力新星 (Rising)": "潛力商家 (Rising)", "流失商家 (Churned)": "流失高價值 (Churned)"}
NO_CARD, NO_MERCHANT = "其他卡別", "未知商家"
QUADRANT_LABELS = ("固定大額型 (Fixed High-Value)", "大額偶發型 (Spike Big-Ticket)", "微額日常型 (Micro-Routine)", "長尾混合型 (Elastic Long-Tail)")


def rfm(df: DataFrame, keys: Sequence[str], windows: Mapping[str, int | None] = WINDOWS, names: Mapping[str, str] | None = None) -> DataFrame:
    """Recency, frequency (different transactions), money and their ranks per key and look-back window.

    Rows are first brought to one per key and transaction, so the windows' distinct counts are plain counts.  The anchor
    is the day after the last transaction.  Ranks cover the keys that a window holds; a key that it does not hold gets
    recency 9999 and zeros.  ``names`` gives null keys a name; other null keys are left out.
    """
    last = F.broadcast(df.agg(F.max("transaction_date").alias("_last")))
    rows = df.fillna(dict(names or {})).dropna(subset=list(keys)).join(last).withColumn("_anchor", F.date_add("_last", 1))
    inside = {n: F.lit(True) if d is None else F.col("transaction_date") >= F.date_sub("_anchor", d) for n, d in windows.items()}
    # Per transaction: its last day and its amount in each window; rows of one id may have different days.  Rows of a cube
    # stand for n transactions of one day each.
    cube = "n" in df.columns
    sums = {f"_{n}": F.when(c, F.col("payment_amount")) for n, c in inside.items()}
    if cube:
        per_id = rows.withColumns({"_day": F.col("transaction_date"), **sums})
    else:
        per_id = rows.groupBy(*keys, "transaction_id").agg(F.max("transaction_date").alias("_day"), F.first("_anchor").alias("_anchor"), *(F.sum(c).alias(n) for n, c in sums.items()))
    aggs = [F.max("_anchor").alias("_anchor")]
    for name, days in windows.items():
        held = F.col("_day").isNotNull() if days is None else F.col("_day") >= F.date_sub("_anchor", days)
        aggs += [
            F.max(F.when(held, F.col("_day"))).alias(f"{name}_day"),
            (F.coalesce(F.sum(F.when(held, F.col("n"))), F.lit(0)) if cube else F.count(F.when(held, F.col("transaction_id")))).alias(f"{name}_frequency"),
            F.sum(f"_{name}").cast("double").alias(f"{name}_monetary"),
        ]
    out = per_id.groupBy(*keys).agg(*aggs)
    ranks: dict[str, tuple[Column, bool]] = {}
    cols: list[Column] = [F.col(k) for k in keys]
    for name in windows:
        here = F.col(f"{name}_frequency") > 0
        recency = F.when(here, F.datediff("_anchor", f"{name}_day"))
        frequency, money = F.when(here, F.col(f"{name}_frequency")), F.when(here, F.coalesce(f"{name}_monetary", F.lit(0.0)))
        ranks |= {f"{name}_r_rank": (recency, True), f"{name}_f_rank": (frequency, False), f"{name}_m_rank": (money, False)}
        cols += [
            F.coalesce(recency, F.lit(NO_RECENCY)).alias(f"{name}_recency"),
            F.coalesce(frequency, F.lit(0)).alias(f"{name}_frequency"),
            F.coalesce(money, F.lit(0.0)).alias(f"{name}_monetary"),
            *(F.coalesce(f"{name}_{x}_rank", F.lit(0.0)).alias(f"{name}_{x}_rank") for x in "rfm"),
        ]
    return C.rank_shares(out, keys, ranks).select(*cols)


def merchant_segment(middle: str = "d180", labels: Sequence[str] = MERCHANT_LABELS) -> Column:
    """Segment by lifetime money and activity in the middle window."""
    core, churned, rising, active, dormant = labels
    high, seen = F.col("life_m_rank") >= 0.8, F.col(f"{middle}_frequency") > 0
    rises = F.col(f"{middle}_m_rank") >= 0.8
    return F.when(high & seen, core).when(high, churned).when(seen & rises, rising).when(seen, active).otherwise(dormant)


def payment_segment(short: str = "life") -> Column:
    """Segment by lifetime frequency and activity in the short window."""
    high, seen = F.col("life_f_rank") >= 0.7, F.col(f"{short}_frequency") > 0
    return F.when(high & seen, PAYMENT_LABELS[0]).when(high, PAYMENT_LABELS[1]).when(seen, PAYMENT_LABELS[2]).otherwise(PAYMENT_LABELS[3])


def card_segment(window: str = "life") -> Column:
    """The first label after 180 days without use, else by frequency and money above or below the middle."""
    f, m = F.col(f"{window}_f_rank") >= 0.5, F.col(f"{window}_m_rank") >= 0.5
    idle, main, special, spare, rare = CARD_LABELS
    return F.when(F.col(f"{window}_recency") > 180, idle).when(f & m, main).when(m, special).when(f, spare).otherwise(rare)


def average_ticket(window: str = "life") -> Column:
    """Money per transaction, cut to a whole number; 0 without transactions."""
    return F.coalesce(F.try_divide(F.col(f"{window}_monetary"), F.col(f"{window}_frequency")).cast("long"), F.lit(0).cast("long"))


def common_category(df: DataFrame) -> DataFrame:
    """Each merchant's most frequent category, the smallest of equally frequent ones."""
    n = df.dropna(subset=["normalized_merchant", "category"]).groupBy("normalized_merchant", "category").agg((F.sum("n") if "n" in df.columns else F.count("*")).alias("count"))
    return n.groupBy("normalized_merchant").agg(F.min_by("category", F.struct(-F.col("count"), F.col("category"))).alias("category"))


def ticket_stats(df: DataFrame, *keys: str) -> DataFrame:
    """Mean, sample deviation, their ratio and count per key; the ratio is 0 for means up to 0."""
    x, n = F.col("payment_amount").cast("double"), F.col("n") if "n" in df.columns else F.lit(1)
    rows = df.dropna(subset=list(keys))
    if "n" not in df.columns:
        out = rows.groupBy(*keys).agg(F.avg(x).alias("avg"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"), F.count("*").alias("n"))
    else:  # equal tickets come as one row; deviations are taken from the mean
        means = rows.groupBy(*keys).agg((F.sum(x * n) / F.sum(n)).alias("avg"), F.sum(n).alias("_n"))
        out = rows.join(C.small(means), list(keys)).groupBy(*keys).agg(F.first("avg").alias("avg"), F.sum(n * (x - F.col("avg")) * (x - F.col("avg"))).alias("_s"), F.first("_n").alias("_n"))
        out = out.select(*keys, "avg", F.when(F.col("_n") > 1, F.sqrt(F.col("_s") / (F.col("_n") - 1))).otherwise(0.0).alias("std"), F.col("_n").alias("n"))
    return out.withColumn("cv", F.when(F.col("avg") > 0, F.col("std") / F.col("avg")).otherwise(0.0))


def quadrant(avg: Column, std: Column, middle_avg: Column, middle_std: Column) -> Column:
    """One of four labels by size and spread against the medians."""
    big, wide = avg >= middle_avg, std >= middle_std
    fixed, spike, routine, mixed = QUADRANT_LABELS
    return F.when(big & wide, spike).when(big, fixed).when(wide, mixed).otherwise(routine)


def volatility(df: DataFrame, *keys: str, since: Column | None = None) -> DataFrame:
    """Positive tickets per key: count, money, quartiles, whiskers, outliers beyond them, kind of distribution, quadrant.

    The rows are read once, for the counts of equal tickets, which are written; all figures come from these.  With
    ``since`` tickets from that day on are counted (``n_recent``) and summed up (``recent_money``), too.
    """
    keys = list(keys)
    rows = df.dropna(subset=keys).where("payment_amount > 0")
    times = F.col("n") if "n" in df.columns else F.lit(1)
    more = [] if since is None else [F.coalesce(F.sum(F.when(F.col("transaction_date") >= since, times)), F.lit(0)).alias("n_new")]
    counts = cut(selection.counted(rows, keys, F.col("payment_amount"), *more))
    money = lambda n: F.coalesce(F.sum((F.col("x").cast("decimal(18,2)") * F.col(n)).cast("decimal(38,2)")), F.lit(0)).cast("double")
    recent = {} if since is None else {"recent_money": money("n_new"), "n_recent": F.sum("n_new")}
    figures = {"n_": F.sum("n"), "total_amount": money("n"), "low": F.min("x"), "high": F.max("x"), **recent}
    sums = counts.groupBy(*keys).agg(*(c.alias(name) for name, c in figures.items())).withColumnRenamed("n_", "n")
    spread = (F.col("q3") - F.col("q1")) * 1.5
    stats = sums.join(selection.quantiles(counts, keys, (0.25, 0.5, 0.75), ("q1", "median", "q3")), keys)
    stats = stats.withColumns({"avg": F.col("total_amount") / F.col("n"), "whisker_low": F.greatest(F.col("low"), F.col("q1") - spread), "whisker_high": F.least(F.col("high"), F.col("q3") + spread)})
    stats = cut(stats)
    # Each group's figures meet its counts again: squares are taken from the mean, and tickets beyond the whiskers counted.
    beside = counts.join(C.small(stats.select(*keys, "avg", "whisker_low", "whisker_high")), keys)
    beyond = (F.col("x") < F.col("whisker_low")) | (F.col("x") > F.col("whisker_high"))
    square = F.sum(F.col("n") * (F.col("x") - F.col("avg")) * (F.col("x") - F.col("avg")))
    beside = beside.groupBy(*keys).agg(square.alias("_square"), F.sum(F.when(beyond, F.col("n")).otherwise(0)).alias("n_outliers"))
    out = cut(stats.join(beside, keys).withColumn("std", F.when(F.col("n") > 1, F.sqrt(F.col("_square") / (F.col("n") - 1))).otherwise(0.0)).drop("_square"))
    kind = F.when(F.col("n") == 1, "single").when((F.col("q1") == F.col("q3")) | (F.col("low") == F.col("high")), "fixed_amount").otherwise("regular")
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    out = out.withColumn("kind", kind).join(F.broadcast(selection.medians(out, _a=positive("avg"), _s=positive("std"))))
    out = out.withColumn("quadrant", quadrant(F.col("avg"), F.col("std"), F.coalesce("_a", F.lit(0.0)), F.coalesce("_s", F.lit(0.0))))
    names = ["n", "total_amount", "std", "low", "high", "avg", "q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers", "kind", "quadrant"]
    return out.select(*keys, *names, *recent)


def top_per_group(df: DataFrame, group: str, item: str, n: int = 3) -> DataFrame:
    """The ``n`` items of each group with the most money, with their place; equal ones by name."""
    sums = df.dropna(subset=[group, item]).groupBy(group, item).agg(total().alias("total_amount"))
    order = Window.partitionBy(group).orderBy(F.desc("total_amount"), item)
    return sums.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def pinned_first(df: DataFrame, name: str, pinned: Sequence[str], money: str) -> DataFrame:
    """Adds ``is_pinned`` and ``sort_key``, by which rows sort: those that hold a pinned word in the given order, then by money."""
    place = F.lit(len(pinned))
    for k, word in reversed(list(enumerate(pinned))):
        place = F.when(F.lower(F.col(name)).contains(word.lower()), k).otherwise(place)
    key = F.struct(place.alias("place"), (-F.col(money)).alias("money"), F.col(name).alias("name"))
    return df.withColumn("is_pinned", place < len(pinned)).withColumn("sort_key", key)


#: Groupings of the volatility view.
MODES = {
    "category_only": ("category",),
    "card_only": ("card_type",),
    "payment_only": ("payment_process",),
    "payment_category": ("payment_process", "category"),
    "card_category": ("card_type", "category"),
    "card_payment": ("card_type", "payment_process"),
}


def named_groups(df: DataFrame) -> DataFrame:
    """Payments, categories and cards without a value get a name."""
    names = {"payment_process": NO_PAYMENT, "category": NO_CATEGORY, "card_type": NO_CARD}
    return df.withColumns({c: F.coalesce(C.text_or_null(F.col(c)), F.lit(n)) for c, n in names.items()})


def group_segment(sums: DataFrame, *keys: str) -> DataFrame:
    """Segment of each group by the rank of its money (``total_amount``), and of its money in the last 180 days."""
    out = C.rank_shares(sums.select(*keys, "total_amount", "recent_money", "n_recent"), keys, {"_m": (F.col("total_amount"), False), "_r": (F.col("recent_money"), False)})
    high, seen = F.col("_m") >= 0.8, F.col("n_recent") > 0
    core, churned, rising, active, dormant = GROUP_LABELS
    label = F.when(high & seen, core).when(high, churned).when(seen & (F.col("_r") >= 0.8), rising).when(seen, active).otherwise(dormant)
    return out.select(*keys, label.alias("rfm_segment"))


def top_outliers(df: DataFrame, beyond: DataFrame, *keys: str, n: int = 25) -> DataFrame:
    """The ``n`` largest tickets of each group outside its whiskers, as an array; only so many rows of a group are kept."""
    rows = df.where("payment_amount > 0").join(C.small(beyond.select(*keys, "whisker_low", "whisker_high")), list(keys))
    amount = F.col("payment_amount").cast("double")
    rows = rows.where((amount < F.col("whisker_low")) | (amount > F.col("whisker_high")))
    shop = F.coalesce(C.text_or_null(F.col("normalized_merchant")), F.lit(NO_MERCHANT))
    if "n" in df.columns:  # rows that stand for several, of which no more than n are listed
        rows = rows.withColumn("_each", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(n)))))
    rows = rows.select(*keys, F.struct((-F.round(amount, 2)).alias("below"), shop.alias("merchant"), F.col("transaction_date").cast("string").alias("date")).alias("_o"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_o"))
    kept = rows.withColumn("_place", place).where(F.col("_place") <= n).groupBy(*keys).agg(F.array_sort(F.collect_list("_o")).alias("_o"))
    return kept.select(*keys, F.transform("_o", lambda o: F.struct((-o["below"]).alias("amount"), o["merchant"], o["date"])).alias("outliers"))


def volatility_view(df: DataFrame, mode: str = "category_only", payment: str | None = None, category: str | None = None, card: str | None = None) -> DataFrame:
    """Volatility, segment and largest outliers of the groups of one mode, after the filters; ``all`` filters nothing.

    The rows are read once.
    """
    keys = MODES.get(mode, MODES["category_only"])
    rows = named_groups(df.where("payment_amount > 0"))
    for column, value in (("payment_process", payment), ("category", category), ("card_type", card)):
        if value and value != "all":
            rows = rows.where(F.col(column) == value)
    # Written once, as narrow rows: the last day, the counts and the outliers are all taken from them.
    kept = dict.fromkeys([*keys, "payment_amount", "transaction_date", "normalized_merchant", *(["n"] if "n" in df.columns else [])])
    rows = cut(rows.select(*kept))
    last = rows.agg(F.max("transaction_date").alias("_last"))
    stats = cut(volatility(rows.join(F.broadcast(last)), *keys, since=F.date_sub("_last", 180)))
    cv = F.round(F.when(F.col("avg") > 0, F.col("std") / F.col("avg")).otherwise(0.0), 3)
    out = stats.withColumn("cv", cv).join(group_segment(stats, *keys), list(keys)).join(top_outliers(rows, stats, *keys), list(keys), "left")
    return out.withColumn("outliers", F.coalesce("outliers", F.array().cast(out.schema["outliers"].dataType)))


def repaired_segment(c: Column) -> Column:
    """Segments under their present names; none is an active merchant."""
    out = c
    for old, new in RENAMED.items():
        out = F.when(c == old, new).otherwise(out)
    return F.coalesce(out, F.lit(MERCHANT_LABELS[3]))


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """How often each value occurs; null is no value."""
    return df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))


PINNED = ("cube", "uniopen", "unicard")


def rfm_dashboard(merchants: DataFrame, cards: DataFrame, tickets: DataFrame, window: str = "life", category: str | None = None, limit: int = 200) -> dict[str, DataFrame]:
    """The parts of the dashboard, from the mart's merchants and cards and the tickets of the window.

    ``merchants`` have a row with category, segment and figures each; ``tickets`` are transactions, or rows that stand for n
    equal ones.  Medians are those of tickets' means and deviations above zero: of all merchants, and of the category's.
    Merchants come by money, at most ``limit`` of them (a top-k report), each with its quadrant against the category's medians.
    """
    stats = ticket_stats(tickets.where(F.col("normalized_merchant") != ""), "normalized_merchant")
    two = lambda c: F.bround(c, 2)
    stats = stats.select("normalized_merchant", two("avg").alias("avg_ticket"), two("std").alias("std_ticket"), F.bround("cv", 3).alias("cv"))
    money, often, last = (F.col(f"{window}_{x}") for x in ("monetary", "frequency", "recency"))
    rows = merchants.join(C.small(stats), "normalized_merchant", "left")
    fallback = F.when(often > 0, two(money / often)).otherwise(0.0)
    rows = cut(
        rows.select(
            F.col("normalized_merchant").alias("name"), last.alias("recency"), often.alias("frequency"), money.alias("monetary"), F.coalesce("avg_ticket", fallback).alias("avg_ticket"),
            F.coalesce("std_ticket", F.lit(0.0)).alias("std_ticket"), F.coalesce("cv", F.lit(0.0)).alias("cv"), repaired_segment(F.col("segment")).alias("segment"), "category",
        )
    )
    chosen = rows.where(F.col("category") == category) if category and category != "all" else rows
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    medians = lambda df, a, s: selection.medians(df, **{a: positive("avg_ticket"), s: positive("std_ticket")})
    both = medians(rows, "_ga", "_gs").join(F.broadcast(medians(chosen, "_a", "_s")))
    every = {c: F.coalesce(c, F.lit(0.0)) for c in ("_ga", "_gs")}
    both = both.select(F.coalesce("_a", every["_ga"]).alias("_a"), F.coalesce("_s", every["_gs"]).alias("_s"), *(c.alias(n) for n, c in every.items()))
    top = chosen.orderBy(F.desc("monetary"), "name").limit(limit).join(F.broadcast(both))
    label = quadrant(F.col("avg_ticket"), F.col("std_ticket"), F.col("_a"), F.col("_s"))
    sorted_out = chosen.where(~C.blank(F.col("category")) & (F.col("category") != NO_CATEGORY) & (F.col("monetary") > 0))
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("monetary"), "name"))
    shown = cards.select("bank_name", "card_type", *(["status"] if "status" in cards.columns else [F.lit("active").alias("status")]), "segment", last.alias("recency"), often.alias("frequency"), money.alias("monetary"), *(["avg_ticket"] if "avg_ticket" in cards.columns else []))
    return {
        "merchants": top.select(*rows.columns, label.alias("volatility_segment")),
        "segment_counts": value_counts(chosen, "segment"),
        "categories": rows.where(~C.blank(F.col("category"))).select("category").distinct(),
        "top_by_category": sorted_out.withColumn("rank", place).where("rank <= 3").select("category", "rank", "name", "monetary", "frequency", "recency", "segment"),
        "cards": pinned_first(shown, "card_type", PINNED, "monetary").withColumnRenamed("is_pinned", "is_demo_pinned"),
        "medians": both.select(*(two(a).alias(n) for a, n in (("_a", "current_median_avg_ticket"), ("_s", "current_median_std_ticket"), ("_ga", "global_median_avg_ticket"), ("_gs", "global_median_std_ticket")))),
    }
