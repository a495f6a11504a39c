"""The Bronze contract of raw transactions, the bank's own fields beside it, types and widths of the Gold table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions import columns as C

MONEY = "decimal(18,2)"
# Columns of the contract; types and widths of the final table, and numbers that are filled with zeros.
CONTRACT = (
    "transaction_id", "bank_no", "card_no", "statement_month", "transaction_date", "posting_date", "conversion_date",
    "raw_merchant", "raw_location", "raw_currency", "raw_amount", "payment_currency", "payment_amount", "raw_extra",
)
WIDTHS = {"bank_no": 3, "card_no": 4, "vpc_no": 4, "merchant_location": 10, "currency_type": 3, "payment_currency": 3}
ZERO_FILLED = ("bank_no", "card_no", "vpc_no")


def _or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None)


def no_value(c: Column) -> Column:
    """Text as it is, null for blanks and for what other tools write for nothing."""
    t = F.trim(c.cast("string"))
    return F.when(~F.lower(t).isin("", "<na>", "nan", "none", "nat", "null", "none.0"), t)


def last_digits(c: Column) -> Column:
    """The last four digits of a card number, with zeros in front; a text without digits is cut after four characters."""
    t = F.regexp_replace(no_value(c), r"\.0$", "")
    digits = F.regexp_replace(t, r"\D", "")
    return F.when(digits != "", C.code(digits, 4)).otherwise(F.substring(t, 1, 4))


def contract(df: DataFrame) -> DataFrame:
    """Rows of the contract: one amount and currency stands in for the other, numbers have their width, dates are dates.

    Each text is trimmed once and each amount read once, in steps that the plan keeps apart; texts that are numbers as
    they stand meet no pattern.
    """
    given = lambda *names: F.coalesce(*(no_value(_or_null(df, n)) for n in names))
    day = lambda n: _or_null(df, n).cast("string").try_cast("date")
    rows = df.select(
        no_value(_or_null(df, "transaction_id")).alias("transaction_id"), no_value(_or_null(df, "bank_no")).alias("bank_no"), no_value(_or_null(df, "card_no")).alias("card_no"),
        *(day(n).alias(n) for n in ("statement_month", "transaction_date", "posting_date", "conversion_date")),
        given("raw_merchant", "merchant").alias("raw_merchant"), given("raw_location", "merchant_location").alias("raw_location"), F.coalesce(given("raw_currency", "currency_type"), F.lit("TWD")).alias("raw_currency"),
        F.coalesce(given("payment_currency"), F.lit("TWD")).alias("payment_currency"), given("raw_amount", "currency_amount").alias("_raw"), given("payment_amount").alias("_paid"), _or_null(df, "raw_extra").cast("map<string,string>").alias("raw_extra"),
    )
    value = lambda n: F.when(F.col(n).isNotNull(), F.coalesce(F.col(n).try_cast(MONEY), C.clean_amount(F.col(n))))
    rows = rows.withColumns({"_raw": value("_raw"), "_paid": value("_paid"), "bank_no": C.code(F.col("bank_no"), 3), "card_no": last_digits(F.col("card_no"))})
    zero = F.lit(0).cast(MONEY)
    return rows.withColumns({"raw_amount": F.coalesce("_raw", "_paid", zero), "payment_amount": F.coalesce("_paid", "_raw", zero)}).select(*CONTRACT)


def pack_extra(df: DataFrame, keep: Iterable[str]) -> DataFrame:
    """Columns outside ``keep`` go into the map ``raw_extra``; those without a value are left out, no map if none is left."""
    keep = [c for c in keep if c in df.columns]
    pairs = [F.struct(F.lit(c).alias("key"), no_value(F.col(c)).alias("value")) for c in df.columns if c not in keep and c != "raw_extra"]
    if not pairs:
        return df.select(*keep, F.lit(None).cast("map<string,string>").alias("raw_extra"))
    filled = F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())
    return df.select(*keep, F.when(F.size(filled) > 0, F.map_from_entries(filled)).alias("raw_extra"))


def unpack_extra(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The named fields from ``raw_extra``, where their own column has no value."""
    return df.withColumns({n: F.coalesce(_or_null(df, n).cast("string"), F.try_element_at("raw_extra", F.lit(n))) for n in names})


def aligned(df: DataFrame, bank_names: Mapping[str, str] | None = None) -> DataFrame:
    """Bronze rows under the names of refinement, with the bank's own fields and defaults."""
    out = unpack_extra(df, ["vpc_no", "vpc_type", "payment_process", "transaction_type"])
    names = F.create_map(*(F.lit(x) for pair in (bank_names or {"": ""}).items() for x in pair))
    return out.withColumns(
        {
            "merchant": F.coalesce(_or_null(out, "merchant"), F.col("raw_merchant")),
            "merchant_location": F.coalesce(_or_null(out, "merchant_location"), F.col("raw_location"), F.lit("TW")),
            "currency_type": F.coalesce(_or_null(out, "currency_type"), F.col("raw_currency"), F.lit("TWD")),
            "payment_currency": F.coalesce("payment_currency", F.lit("TWD")),
            "currency_amount": F.coalesce("raw_amount", "payment_amount"),
            "payment_amount": F.coalesce("payment_amount", "raw_amount"),
            "transaction_type": F.coalesce("transaction_type", F.lit("")),
            "bank_name": F.coalesce(_or_null(out, "bank_name"), F.try_element_at(names, F.col("bank_no")), F.lit("")),
        }
    )


def enforced(df: DataFrame, money: Iterable[str] = ("payment_amount", "currency_amount"), widths: Mapping[str, int] = WIDTHS) -> DataFrame:
    """Amounts as decimals, texts without leftovers of other tools, cut to their width; numbers are filled with zeros."""

    def text(name: str) -> Column:
        t = no_value(F.regexp_replace(F.col(name), r"\.0$", ""))
        size = widths.get(name)
        if size is None:
            return t
        return C.code(t, size) if name in ZERO_FILLED else F.substring(t, 1, size)

    money = tuple(money)
    kinds = dict(df.dtypes)
    amount = lambda n: F.regexp_replace(F.col(n), ",", "").try_cast(MONEY) if kinds[n] == "string" else F.col(n).cast(MONEY)
    changed: dict[str, Callable[[str], Column] | Column] = {n: amount(n) for n in money if n in kinds}
    return df.withColumns(changed | {n: text(n) for n, kind in df.dtypes if kind == "string" and n not in money})
