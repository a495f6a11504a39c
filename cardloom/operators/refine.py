"""Refinement of raw transactions: ids, ordered pattern rules, cards, currency conversion, transaction types.

Rules are ordered lists.  Short ones become one ``when`` chain, long ones a table joined by the literals of its patterns;
either way a distinct merchant text is looked at once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions import columns as C
from cardloom.functions.lineage import cut_small
from cardloom.operators import intervals
from cardloom.operators import rules as many


def with_ids(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: int = 0) -> DataFrame:
    """Adds ``seq``, the number of a row among those with equal keys (null keys are equal), and the id hashed from both."""
    seq = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1 + start
    return df.withColumn("seq", seq).withColumn("transaction_id", C.hashed_id(*(F.col(k) for k in keys), F.col("seq")))


def first_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key; only one row a key is carried between tasks."""
    rows = df.groupBy(*keys).agg(F.min_by(F.struct(*(F.col(c) for c in df.columns if c not in keys)), F.struct(*order)).alias("_row"))
    return rows.select(*keys, "_row.*").select(*df.columns)


def forward_fill(df: DataFrame, header: Column, value: Column, group: str, line: str, name: str) -> DataFrame:
    """Header rows hand their value to the rows below them, per file, and go themselves."""
    order = Window.partitionBy(group).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_h", header).withColumn(name, F.last(F.when(F.col("_h"), value), ignorenulls=True).over(order)).where(~F.col("_h")).drop("_h")


def convert_currency(df: DataFrame, rates: DataFrame, home: str = "TWD") -> DataFrame:
    """Foreign amounts to whole home currency at the day's rate, half to even; of repeated rates the last by ``load_ord`` counts.

    The payment currency is looked up first, then the transaction currency.  ``fx_missing`` marks rows that stay as they are.
    """
    table = rates.select("conversion_date", F.upper("currency_type").alias("_c"), "fx_rate", "load_ord").dropna(subset=["conversion_date", "_c", "fx_rate"])
    table = C.small(table.groupBy("conversion_date", "_c").agg(F.max_by("fx_rate", F.struct(F.col("load_ord").isNotNull(), "load_ord")).alias("_rate")))
    wanted = F.col("conversion_date").isNotNull() & (F.upper("payment_currency") != home)
    out = df.withColumn("_a", F.upper("payment_currency")).withColumn("_b", F.upper("currency_type"))
    for key, rate in (("_a", "_r1"), ("_b", "_r2")):
        side = table.select("conversion_date", F.col("_c").alias(key), F.col("_rate").alias(rate))
        out = out.join(side, ["conversion_date", key], "left")
    rate = F.coalesce("_r1", "_r2")
    amount = F.bround(F.col("payment_amount").cast("decimal(18,2)") * rate.cast("decimal(18,6)"), 0).cast("decimal(18,2)")
    done = F.coalesce(wanted & rate.isNotNull(), F.lit(False))
    out = out.withColumn("fx_missing", F.coalesce(wanted & rate.isNull(), F.lit(False))).withColumn("payment_amount", F.when(done, amount).otherwise(F.col("payment_amount").cast("decimal(18,2)")))
    return out.withColumn("payment_currency", F.when(done, home).otherwise(F.col("payment_currency"))).drop("_a", "_b", "_r1", "_r2").select(*df.columns, "fx_missing")


#: Up to so many rules become one chain of conditions; more are found by their literals.
CHAIN = 100


def tag(df: DataFrame, text: str, rules: Sequence[Mapping], pattern: str, fields: Sequence[str]) -> DataFrame:
    """The fields of the first rule whose pattern is found in the text, and the rule's number; found once per distinct text."""
    chosen = C.ordered(rules)
    if len(chosen) > CHAIN:
        table = many.as_table(df.sparkSession, chosen, pattern, fields)
        names = many.first_match(df, text, table, pattern, fields).withColumns({"rule": F.col("rule").cast("int")}).withColumnsRenamed({"rule": "rule_no", text: "_text"})
        return df.join(names, df[text] == names["_text"], "left").drop("_text")
    names = df.select(text).distinct().withColumn("rule_no", C.first_rule(F.col(text), chosen, pattern))
    for f in fields:
        values = F.array(*(F.lit(r.get(f)).cast("string") for r in chosen))
        names = names.withColumn(f, F.get(values, F.col("rule_no")))
    return df.join(names, df[text].eqNullSafe(names[text]), "left").drop(names[text])


def tag_all(df: DataFrame, text: str, tags: Sequence[tuple[Sequence[Mapping], str, Mapping[str, str]]]) -> DataFrame:
    """As :func:`tag` for several rule lists at once: each gives the values of its first matching rule under new names."""
    names = df.select(text).distinct()
    for rules, pattern, fields in tags:
        chosen = C.ordered(rules)
        if len(chosen) > CHAIN:
            table = many.as_table(df.sparkSession, chosen, pattern, list(fields))
            found = many.first_match(names, text, table, pattern, list(fields)).drop("rule").withColumnsRenamed({text: "_key", **fields})
            names = names.join(found, F.col(text) == F.col("_key"), "left").drop("_key")
            continue
        names = names.withColumn("_rule", C.first_rule(F.col(text), chosen, pattern))
        for field, name in fields.items():
            value = F.get(F.array(*(F.lit(r.get(field)).cast("string") for r in chosen)), F.col("_rule")) if chosen else F.lit(None).cast("string")
            names = names.withColumn(name, value)
    names = names.drop("_rule").withColumnsRenamed({text: "_text"})
    return df.join(names, F.col(text).eqNullSafe(F.col("_text")), "left").drop("_text")


def tag_each(df: DataFrame, text: str, rules: Sequence[Mapping], pattern: str, fields: Sequence[str]) -> DataFrame:
    """As :func:`tag`, but every field comes from the first matching rule that sets it."""
    chosen = C.ordered(rules)
    if len(chosen) > CHAIN:
        table = many.as_table(df.sparkSession, chosen, pattern, fields)
        names = many.first_match(df, text, table, pattern, fields, each=True).withColumnRenamed(text, "_text")
        return df.join(names, df[text] == names["_text"], "left").drop("_text")
    names = df.select(text).distinct()
    names = names.withColumns({f: C.first_match(F.col(text), chosen, f, pattern) for f in fields})
    return df.join(names, df[text].eqNullSafe(names[text]), "left").drop(names[text])


def merchant_fallback(df: DataFrame) -> DataFrame:
    """Platform name where no rule gave a merchant, else the raw text; the platform's categories where blank."""
    blank = lambda c: C.blank(F.col(c))
    name = F.when(blank("normalized_merchant"), F.when(blank("ec_platform"), F.col("merchant")).otherwise(F.col("ec_platform"))).otherwise(F.col("normalized_merchant"))
    out = df.withColumn("normalized_merchant", name)
    return out.withColumns({c: F.when(blank(c), F.col(f"ec_{c}")).otherwise(F.col(c)) for c in ("category", "sub_category")})


def display_name(prefix: Column, platform: Column, merchant: Column) -> Column:
    """prefix－platform－merchant without blank parts; a merchant equal to the platform is left out."""
    part = lambda c: F.when(~C.blank(c), c)
    shop = F.when(~C.blank(merchant) & ~F.coalesce(merchant == platform, F.lit(False)), merchant)
    return F.concat_ws("－", part(F.regexp_replace(prefix, r"[－\- ]+$", "")), part(platform), shop)


def match_cards(df: DataFrame, cards: DataFrame) -> DataFrame:
    """Card id, type, bank and virtual card kind: both numbers first, then the physical card, then any history row.

    Of equal matches the first row of the card table counts.
    """
    side = C.small(cards.select(*(F.col(c).alias(f"_{c}") for c in ("card_no", "vpc_no", "card_id", "card_type", "bank_no", "vpc_type", "load_ord"))))
    numbered = df.withColumn("_row", F.struct(*df.columns))
    physical = (F.col("_vpc_type") == "CARD") | (F.col("_vpc_no") == F.col("_card_no")) | C.blank(F.col("_vpc_no"))
    step = F.when(F.col("vpc_no") == F.col("_vpc_no"), 1).when(physical, 2).otherwise(3)
    pick = F.min_by(F.struct("_card_id", "_card_type", "_bank_no", "_vpc_type"), F.struct(step, "_load_ord"))
    keys = numbered.select("card_no", "vpc_no").distinct()
    best = keys.join(side, F.col("card_no") == F.col("_card_no")).groupBy("card_no", "vpc_no").agg(pick.alias("_p"))
    best = best.select(F.col("card_no").alias("_cn"), F.col("vpc_no").alias("_vn"), "_p.*")
    out = df.join(best, (F.col("card_no") == F.col("_cn")) & F.col("vpc_no").eqNullSafe(F.col("_vn")), "left")
    return out.select(
        *[c for c in df.columns if c not in ("bank_no", "vpc_type")],
        F.when(C.blank(F.col("bank_no")), F.col("_bank_no")).otherwise(F.col("bank_no")).alias("bank_no"),
        F.coalesce("_vpc_type", "vpc_type").alias("vpc_type"),
        F.col("_card_id").alias("card_id"),
        F.col("_card_type").alias("card_type"),
    )


def _names(text: Column, words: Mapping[str, Sequence[str]], kind: str) -> Column:
    patterns = words.get(kind) or ()
    return F.coalesce(text.rlike("(?iu)" + "|".join(patterns)), F.lit(False)) if patterns else F.lit(False)


def transaction_type(merchant: Column, amount: Column, place: Column, current: Column, given: Column, words: Mapping[str, Sequence[str]], paid: Column | None = None) -> Column:
    """Type label: one set before stays; then repayment, credit and fee patterns, refunds, the foreign kinds, and purchase.

    Abroad, a purchase in another currency than it is paid in is a foreign one; otherwise the home currency tells.
    """
    abroad, other = F.coalesce(place, F.lit("TW")) != "TW", ~current.eqNullSafe(F.lit("TWD") if paid is None else paid)
    found = F.when(_names(merchant, words, "payment"), C.REPAYMENT).when(_names(merchant, words, "credit"), C.POINTS).when(_names(merchant, words, "fee"), C.FEE)
    found = found.when(amount < 0, C.REFUND).when(abroad & other, C.FOREIGN).when(abroad & (current == "TWD"), C.FOREIGN_TWD).when(abroad, C.FOREIGN_DUAL)
    return F.when(C.blank(given), found.otherwise(C.PURCHASE)).otherwise(given)


def classify(df: DataFrame, words: Mapping[str, Sequence[str]]) -> DataFrame:
    """Adds the type to rows without one, and puts right what repayments, credits and fees say of place, currency and card.

    ``words`` holds patterns under payment, credit and fee.  These three happen at home; a missing paid amount or currency
    is the original one; a repayment is paid in the original currency and has no card; a fee's currency is the paid one.
    """
    fresh = C.blank(F.col("transaction_type"))
    repaid = fresh & _names(F.col("merchant"), words, "payment")
    credit = fresh & ~repaid & _names(F.col("merchant"), words, "credit")
    fee = fresh & ~repaid & ~credit & _names(F.col("merchant"), words, "fee")
    rows = df.withColumn("_kind", F.when(repaid, 1).when(credit, 2).when(fee, 3).otherwise(0))
    kind = F.col("_kind")
    paid = F.when((kind == 1) | ((kind > 1) & C.blank(F.col("payment_currency"))), F.col("currency_type")).otherwise(F.col("payment_currency"))
    fixed = rows.withColumns(
        {
            "merchant_location": F.when(kind > 0, "TW").otherwise(F.col("merchant_location")),
            "payment_amount": F.when(kind > 0, F.coalesce("payment_amount", "currency_amount")).otherwise(F.col("payment_amount")),
            "payment_currency": paid,
            "currency_type": F.when(kind == 3, paid).otherwise(F.col("currency_type")),
            **{c: F.when(kind != 1, F.col(c)) for c in ("card_type", "card_no") if c in df.columns},
        }
    )
    label = F.when(kind == 1, C.REPAYMENT).when(kind == 2, C.POINTS).when(kind == 3, C.FEE)
    amount = F.coalesce("payment_amount", "currency_amount")
    rest = transaction_type(F.col("merchant"), amount, F.col("merchant_location"), F.col("currency_type"), F.col("transaction_type"), {}, F.col("payment_currency"))
    return fixed.withColumn("transaction_type", F.coalesce(label, rest)).drop("_kind")


def billing_intervals(history: DataFrame) -> DataFrame:
    """First and last posting day of each statement: from the day after the previous close; the first from a month before.

    Statements of equal bank and card (number or else name, whatever the case) follow each other by their month.
    """
    name = lambda *cs: F.lower(F.trim(F.coalesce(*(F.col(c) for c in cs if c in history.columns), F.lit(""))))
    keys = [c for c in ("bank_no", "bank_name", "card_id", "card_type") if c in history.columns]
    closes = history.withColumn("last_day", F.coalesce("actual_closing_date", "closing_date")).where("last_day is not null")
    closes = closes.withColumns({"_bank": name("bank_no", "bank_name"), "_card": name("card_id", "card_type")})
    before = F.lag("last_day").over(Window.partitionBy("_bank", "_card").orderBy("statement_month", "last_day"))
    return closes.withColumn("first_day", F.coalesce(F.date_add(before, 1), F.date_add(F.add_months("last_day", -1), 1))).select(*keys, "statement_month", "first_day", "last_day")


def statement_of(df: DataFrame, history: DataFrame) -> DataFrame:
    """Statement month by posting date: the card's own interval, else its bank's, else the posting month.

    ``history`` are intervals; a transaction's bank and card are looked for among their numbers and names.  The different
    banks, cards and days ask, by equal keys, and not every row.
    """
    low = lambda c: F.lower(F.trim(c))
    held = lambda *cs: F.array_distinct(F.filter(F.array(*(low(F.col(c)) for c in cs if c in history.columns), F.lit(None).cast("string")), lambda x: x != ""))
    cards = held("card_id", "card_type")
    side = history.select(F.explode(held("bank_no", "bank_name")).alias("_bank"), F.when(F.size(cards) > 0, cards).otherwise(F.array(F.lit(""))).alias("_cards"), "statement_month", "first_day", "last_day")
    side = side.select("_bank", F.explode("_cards").alias("_card"), "statement_month", "first_day", "last_day")
    names = ["bank_no", "card_id", "posting_date"]
    keys = df.select(*names).distinct()
    asked = keys.withColumn("_bank", low(F.col("bank_no"))).withColumn("_card", F.explode(F.array_distinct(F.array(F.coalesce(low(F.col("card_id")), F.lit("")), F.lit("")))))
    found = intervals.join_days(asked, side, ["_bank", "_card"], "posting_date", "first_day", "last_day")
    best = cut_small(found.groupBy(*names).agg(F.min_by("statement_month", F.struct(F.col("_card") == "", "statement_month")).alias("_month")))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in names]
    out = df.alias("a").join(best.alias("b"), same, "left")
    return out.select(*(F.col(f"a.{c}") for c in df.columns if c != "statement_month"), F.coalesce("_month", F.date_format("a.posting_date", "yyyy-MM")).alias("statement_month"))


def merge_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert: new rows replace old ones with the same key."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def only_new(new: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the old table does not hold: what an idempotent load appends."""
    return new.join(old.select(*keys), list(keys), "left_anti")
