"""What each bank's statement rows need before they are standard: card headers, joined fields, points, wallets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions import columns as C

# Patterns of rows and fields in the statements.
REPAYMENT = "繳款|轉帳"
CARD_HEADER = {"trigger": r"卡號", "card_no": r"(\d{4})(?!.*\d{4})", "card_type": r"^(.*?)[\s(（]*卡號"}
WALLET = r"(?i)(?:玉山.*(?:wallet|電子支付|掃碼)|wallet.*掃碼)"
WALLET_NAME = "玉山Wallet"
JOINED = r"^(.*?)(?:\s{2,}|\t)(.*?)(?:\s+(\d{2}/\d{2}))?$"
E_POINT, E_POINT_VALUE = r"(?i)e\s*point", r"折.*?現金\s*([0-9,]+)\s*元"
TREE_POINTS, TREE_NAME = r"^點數折抵[＿_]?\s*", "小樹點折抵"
DASH = r"^\s*[-−－—]\s*$"


def fill_card_headers(df: DataFrame, group: str = "file", line: str = "line_no", header: dict[str, str] | None = None, only: Column | None = None) -> DataFrame:
    """Rows that only name a card hand its number and type to the rows below them, per file, and go.

    Repayments belong to no card.  Files without such rows, and rows outside ``only``, stay as they are.
    """
    rule = header or CARD_HEADER
    is_head = F.coalesce(F.col("merchant").rlike(rule["trigger"]) & (F.lit(True) if only is None else only), F.lit(False))
    above = Window.partitionBy(group).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(group)
    rows = df.withColumn("_head", is_head).withColumn("_named", F.last(F.when(F.col("_head"), F.col("merchant")), ignorenulls=True).over(above))
    rows = rows.withColumn("_any", F.max(F.col("_head")).over(whole))
    repaid = F.coalesce(F.col("merchant").rlike(REPAYMENT), F.lit(False))

    def from_head(name: str) -> Column:
        found = F.regexp_extract("_named", rule[name], 1)
        old = F.col(name) if name in df.columns else F.lit(None).cast("string")
        return F.when(~F.col("_any"), old).when(~repaid & (found != ""), F.trim(found))

    filled = rows.withColumns({name: from_head(name) for name in ("card_no", "card_type") if name in rule})
    return filled.where("not _head").drop("_head", "_named", "_any")


def split_joined_merchant(df: DataFrame) -> DataFrame:
    """``shop  place 12/31`` in one field: the shop, the place and the day of conversion; other texts stay."""
    text = F.coalesce("merchant", F.lit(""))
    fits = text.rlike(JOINED)
    part = lambda k: F.trim(F.regexp_extract(text, JOINED, k))
    day = F.when(part(3) != "", part(3))
    old_day = F.col("conversion_date") if "conversion_date" in df.columns else F.lit(None).cast("string")
    old_place = F.col("merchant_location") if "merchant_location" in df.columns else F.lit(None).cast("string")
    return df.withColumns(
        {
            "merchant": F.when(fits, part(1)).otherwise(F.col("merchant")),
            "merchant_location": F.when(fits, part(2)).otherwise(old_place),
            "conversion_date": F.when(fits, day).otherwise(old_day),
        }
    )


def e_points(df: DataFrame) -> DataFrame:
    """Points paid out as money, named in the text only: a negative amount, and the type of redeemed points."""
    worth = F.regexp_replace(F.regexp_extract("merchant", E_POINT_VALUE, 1), ",", "").try_cast("decimal(18,2)")
    found = F.col("merchant").rlike(E_POINT) & worth.isNotNull()
    return _redeemed(df, F.coalesce(found, F.lit(False))).withColumn("payment_amount", F.when(found, -worth).otherwise(C.clean_amount(F.col("payment_amount"))))


def tree_points(df: DataFrame) -> DataFrame:
    """Redeemed points under one name, whatever shop stands behind them."""
    found = F.coalesce(F.col("merchant").rlike(TREE_POINTS), F.lit(False))
    return _redeemed(df, found).withColumn("merchant", F.when(found, TREE_NAME).otherwise(F.col("merchant")))


def _redeemed(df: DataFrame, found: Column) -> DataFrame:
    kind = F.col("transaction_type") if "transaction_type" in df.columns else F.lit("")
    return df.withColumn("transaction_type", F.when(found, C.POINTS).otherwise(kind))


def wallet_payment(df: DataFrame) -> DataFrame:
    """A wallet in the card's column is a way of payment: it moves to ``payment_process``."""
    found = F.coalesce(F.col("vpc_type").rlike(WALLET), F.lit(False))
    old = F.col("payment_process") if "payment_process" in df.columns else F.lit(None).cast("string")
    return df.withColumns({"payment_process": F.when(found, WALLET_NAME).otherwise(old), "vpc_type": F.when(~found, F.col("vpc_type"))})


def split_card_numbers(df: DataFrame) -> DataFrame:
    """``8888 / 0123``: number of the card and of the virtual card, as text with its zeros."""
    parts = F.filter(F.transform(F.split(C.text_or_null(F.col("card_no")), "/"), lambda p: F.regexp_replace(F.trim(p), r"\.0", "")), lambda p: p != "")

    def number(k: int) -> Column:
        p = F.get(parts, F.lit(k))
        return F.coalesce(F.when(p.rlike(r"^\d{1,4}$"), F.lpad(p, 4, "0")).otherwise(p), F.lit(""))

    return df.withColumns({"card_no": number(0), "vpc_no": number(1)})


def dashes_to_null(df: DataFrame) -> DataFrame:
    """A lone dash in a text column is no value."""
    return df.withColumns({n: F.when(~F.col(n).rlike(DASH), F.col(n)) for n, kind in df.dtypes if kind == "string"})


#: The rules of each bank, in order, with the columns that they change.
RULES = {
    "玉山銀行": (
        (wallet_payment, ("payment_process", "vpc_type")),
        (split_joined_merchant, ("merchant", "merchant_location", "conversion_date")),
        (e_points, ("payment_amount", "transaction_type")),
    ),
    "國泰世華": (
        (dashes_to_null, ("merchant", "currency_amount", "payment_amount", "card_no", "conversion_date")),
        (split_card_numbers, ("card_no", "vpc_no")),
        (tree_points, ("merchant", "transaction_type")),
    ),
}
HEADED = ("玉山銀行", "華南銀行")


def by_bank(df: DataFrame) -> DataFrame:
    """Text rows of all banks (``bank``, ``file``, ``line_no``), each after the rules of its bank."""
    out = fill_card_headers(df, only=F.col("bank").isin(*HEADED))
    kinds = dict(out.dtypes)
    for bank, rules in RULES.items():
        for rule, changed in rules:
            held = out.withColumnsRenamed({c: f"_{c}" for c in changed})
            new = rule(held.withColumns({c: F.col(f"_{c}") for c in changed}))
            mine = F.col("bank") == bank
            out = new.withColumns({c: F.when(mine, F.col(c).cast(kinds[c])).otherwise(F.col(f"_{c}")) for c in changed}).select(*kinds)
    return out
