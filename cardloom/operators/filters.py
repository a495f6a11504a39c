"""Filters of the transaction query: windows, banks, payments, places, categories.

Every filter is a Column predicate, so the scan gets what it can push down; the look-back anchor is a one-row aggregate.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions import columns as C

# Look-back windows in days, and the names that each window goes by; case does not matter.
DAYS = {"LAST_MONTH": 30, "LAST_QUARTER": 90, "LAST_HALF_YEAR": 180, "LAST_YEAR": 365, "LAST_2_YEARS": 730}
NAMES = {
    "LAST_MONTH": ("1M", "30D", "近一個月", "LAST_30_DAYS"),
    "LAST_QUARTER": ("3M", "90D", "近一季", "LAST_90_DAYS"),
    "LAST_HALF_YEAR": ("6M", "180D", "近半年", "LAST_180_DAYS"),
    "LAST_YEAR": ("1Y", "365D", "近一年", "LAST_365_DAYS"),
    "LAST_2_YEARS": ("2Y", "730D", "近兩年", "LAST_730_DAYS"),
    "THIS_YEAR": ("THIS_CALENDAR_YEAR", "今年", "YTD"),
    "LAST_CALENDAR_YEAR": ("PREV_YEAR", "PREVIOUS_YEAR", "去年", "去年(曆年)", "LAST_YEAR_CALENDAR"),
    "LIFETIME": ("LIFE", "ALL", "全歷史", "全時段", "NONE", "NULL", ""),
}
DOMESTIC = ("TW", "TWN", "台灣", "臺灣", "國內")
HOME, ABROAD = "國內", "國外"
UNSORTED, BANK_FEES, NO_SUB = "未分類", "銀行費用", "無次分類"


def consumption(df: DataFrame) -> DataFrame:
    """Without repayments, fees, refunds and redeemed points; rows of no type go too, as in SQL."""
    return df.where(~F.col("transaction_type").isin(*C.NOT_CONSUMPTION))


def window_name(name: str | None) -> str:
    """The window that a name stands for; no name and unknown ones are the whole history."""
    key = (name or "").strip().upper()
    return next((window for window, others in NAMES.items() if key == window or key in others), "LIFETIME")


def resolve_window(name: str | None, anchor: datetime.date) -> tuple[datetime.date | None, datetime.date | None]:
    """First and last day of a named window that ends at the anchor; (None, None) is unbounded."""
    key = window_name(name)
    if key in DAYS:
        return anchor - datetime.timedelta(days=DAYS[key]), anchor
    if key == "THIS_YEAR":
        return datetime.date(anchor.year, 1, 1), anchor
    if key == "LAST_CALENDAR_YEAR":
        return datetime.date(anchor.year - 1, 1, 1), datetime.date(anchor.year - 1, 12, 31)
    return None, None


def between_days(first: datetime.date | None, last: datetime.date | None) -> Column:
    """Transaction date within both days, either open."""
    day = F.col("transaction_date")
    cond = F.lit(True)
    if first:
        cond = cond & (day >= F.lit(first))
    return cond & (day <= F.lit(last)) if last else cond


def within(rows: DataFrame, of: DataFrame, name: str | None) -> DataFrame:
    """Rows in a named window that ends at the last transaction date of the table ``of``, a one-row aggregate joined in."""
    key = window_name(name)
    if key not in DAYS and key not in ("THIS_YEAR", "LAST_CALENDAR_YEAR"):
        return rows
    last = F.broadcast(of.agg(F.max("transaction_date").alias("_anchor")))
    day, anchor = F.col("transaction_date"), F.col("_anchor")
    this_year = F.trunc(anchor, "year")
    cond = {"THIS_YEAR": day.between(this_year, anchor), "LAST_CALENDAR_YEAR": day.between(F.add_months(this_year, -12), F.date_sub(this_year, 1))}
    return rows.join(last, cond.get(key) if key in cond else day.between(F.date_sub(anchor, DAYS.get(key, 0)), anchor)).drop("_anchor")


def in_window(df: DataFrame, name: str | None = "LAST_YEAR") -> DataFrame:
    """Rows in a named window that ends at the table's last transaction date; the last year if none is named."""
    return within(df, df, name)


def payment_is(payments: Iterable[str] | None, direct: bool) -> Column:
    """Payment filter: the listed ones, and rows without a payment process if ``direct``.

    None with ``direct`` passes all, without it all that have one; an empty list passes only direct rows, or nothing.
    """
    c = F.col("payment_process")
    if payments is None:
        return F.lit(True) if direct else ~C.blank(c)
    listed = c.isin(*payments) if (payments := list(payments)) else F.lit(False)
    return F.coalesce(listed, F.lit(False)) | C.blank(c) if direct else F.coalesce(listed, F.lit(False))


def place_is(place: str | Iterable[str] | None, domestic: Iterable[str] = DOMESTIC) -> Column:
    """A list with 國內 passes the domestic names and blanks, one with 國外 the others; None, both and all pass everything.

    Any other list is one of names.
    """
    c = F.col("merchant_location")
    if place is None or place in ("both", "all", "全部"):
        return F.lit(True)
    wanted = [place] if isinstance(place, str) else list(place)
    if not wanted or (HOME in wanted and ABROAD in wanted):
        return F.lit(True)
    if HOME in wanted:
        return C.blank(c) | c.isin(*domestic)
    if ABROAD in wanted:
        return ~C.blank(c) & ~c.isin(*domestic)
    return c.isin(*wanted)


def category_is(categories: Iterable[str] | None) -> Column:
    """The listed categories; without a list all but unsorted rows and bank fees."""
    c = F.col("category")
    return c.isin(*categories) if categories else ~c.isin(UNSORTED, BANK_FEES)


def sub_category_is(names: Iterable[str] | None) -> Column:
    """The listed sub-categories; 無次分類 or an empty name also passes blank ones."""
    names = list(names or ())
    if not names:
        return F.lit(True)
    c = F.col("sub_category")
    return c.isin(*names) | C.blank(c) if NO_SUB in names or "" in names else c.isin(*names)


def bank_names(wanted: Iterable[str], banks: Iterable[Mapping]) -> list[str]:
    """All names of the wanted banks: id, number, name, name on statements, keywords; a bank goes by any of them, whatever the case.

    Unknown names stay as they are.
    """
    known: dict[str, set[str]] = {}
    for bank in banks:
        names = {str(bank.get("bank_id") or "").strip().lower(), *(str(bank.get(c) or "").strip() for c in ("bank_no", "bank_name", "bills_mapping_name")), *(bank.get("keywords") or ())}
        names = {n for n in names if n and n.lower() not in ("none", "nan")}
        known |= {n.lower(): names for n in names}
    return sorted({n for name in wanted for n in known.get(name.lower(), {name}) if n})


def query_transactions(
    df: DataFrame,
    banks: Iterable[str] | None = None,
    cards: Iterable[str] | None = None,
    payments: Iterable[str] | None = None,
    include_direct_payment: bool = True,
    time_window: str | None = None,
    start_date: datetime.date | None = None,
    end_date: datetime.date | None = None,
    location: str | list[str] | None = None,
    domestic: Iterable[str] = DOMESTIC,
    bank_table: Iterable[Mapping] = (),
) -> DataFrame:
    """The filtered transactions; dates count only without a named window.  Sort at the sink, by date descending.

    ``bank_table`` holds the names that banks go by.
    """
    out = consumption(df)
    if banks:
        out = out.where(F.col("bank_name").isin(*bank_names(banks, bank_table)))
    if cards:
        out = out.where(F.col("card_type").isin(*cards))
    out = out.where(payment_is(payments, include_direct_payment)).where(place_is(location, domestic))
    if time_window:
        return within(out, df, time_window)
    return out.where(between_days(start_date, end_date))


def prepared(df: DataFrame, categories: Iterable[str] | None = None, sub_categories: Iterable[str] | None = None) -> DataFrame:
    """Analytics input: amounts, merchants and labels filled, then the category filters.

    A merchant without a normal name goes by its shown name, or else by its own where there is no column of shown ones.
    """
    text = lambda n, other: F.coalesce(*(F.col(c) for c in (n,) if c in df.columns), other)
    shown = next((F.col(c) for c in ("merchant_display", "display_name", "merchant_name", "merchant") if c in df.columns), F.lit(""))
    out = df.withColumns(
        {
            "payment_amount": F.coalesce("payment_amount", F.lit(0).cast("decimal(18,2)")),
            "normalized_merchant": text("normalized_merchant", shown),
            "category": text("category", F.lit(UNSORTED)),
            "sub_category": text("sub_category", F.lit("")),
        }
    )
    return out.where(category_is(categories)).where(sub_category_is(sub_categories))


def dataset(df: DataFrame, categories: Iterable[str] | None = None, sub_categories: Iterable[str] | None = None, **which: object) -> DataFrame:
    """The rows that analytics work on: the filtered query (``which`` are its filters), prepared."""
    return prepared(query_transactions(df, **which), categories, sub_categories)


def menu(df: DataFrame) -> DataFrame:
    """Categories with their sub-categories, the blank one last as 無次分類."""
    subs = F.collect_set(F.when(~C.blank(F.col("sub_category")), F.col("sub_category")))
    empty = F.max(C.blank(F.col("sub_category")).cast("int")) == 1
    subs = F.concat(F.array_sort(subs), F.when(empty, F.array(F.lit(NO_SUB))).otherwise(F.array().cast("array<string>")))
    return df.where(~C.blank(F.col("category"))).groupBy("category").agg(F.array_join(subs, ",").alias("sub_categories"))


def menu_names(df: DataFrame, payments: DataFrame) -> DataFrame:
    """What can be chosen besides categories: ``kind`` (card or payment), ``name`` and its ``place``.

    Cards are the different ones of the rows, by name; payments those of the rules with a priority below 25, by priority.
    """
    cards = df.where(~C.blank(F.col("card_type"))).select(F.lit("card").alias("kind"), F.trim("card_type").alias("name"), F.lit(0).alias("place")).distinct()
    rank = F.col("priority").try_cast("int")
    ways = payments.where((rank < 25) & ~C.blank(F.col("payment_process"))).groupBy(F.trim("payment_process").alias("name")).agg(F.min(rank).alias("place"))
    return cards.unionByName(ways.select(F.lit("payment").alias("kind"), "name", "place"))
