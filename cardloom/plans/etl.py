"""From statement files to the Gold table and the analytics on it; Bronze is written between the two steps."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cache, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions import columns as C
from cardloom.functions.lineage import cut
from cardloom.operators import bronze, cards, filters, refine, segments, sinks, summaries
from cardloom.sources import bills

ID_KEYS = ("transaction_date", "merchant", "card_no", "payment_amount", "transaction_type")


@dataclass
class Rules:
    """What refinement looks things up in; rule lists hold mappings with a pattern and values."""

    gateways: Sequence[Mapping] = ()
    platforms: Sequence[Mapping] = ()
    merchants: Sequence[Mapping] = ()
    words: Mapping[str, Sequence[str]] = field(default_factory=dict)
    bank_names: Mapping[str, str] = field(default_factory=dict)
    cards: DataFrame | None = None
    rates: DataFrame | None = None


def with_gold_ids(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Ids of Gold: those that are given, if every row has one, else hashed from day, merchant, card, amount, type and number.

    The number is that of a row among rows equal in all of these.
    """
    if "transaction_id" not in df.columns:
        return refine.with_ids(df, ID_KEYS, order)
    given = F.col("transaction_id")
    lacking = df.agg(F.coalesce(F.max(C.blank(given).cast("int")), F.lit(1)).alias("_lacking"))
    own = refine.with_ids(df.withColumnRenamed("transaction_id", "_given"), ID_KEYS, order).join(F.broadcast(lacking))
    return own.withColumn("transaction_id", F.when(F.col("_lacking") == 0, F.col("_given")).otherwise(F.col("transaction_id"))).drop("_given", "_lacking")


def refine_transactions(raw: DataFrame, rules: Rules) -> DataFrame:
    """Bronze rows as Gold: cards, payments, platforms, merchants, types, home currency, ids, types and widths."""
    out = bronze.aligned(raw, rules.bank_names)
    if rules.cards is not None:
        out = cards.enrich(out.drop("card_id", "card_type"), rules.cards)
    for name in ("card_id", "card_type"):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("string"))
    out = cards.vpc_to_payment(out, rules.gateways)
    tags = [
        (rules.gateways, "payment_process_pattern", {"payment_process": "_p", "process_prefix": "_x"}),
        (rules.platforms, "platform_pattern", {c: c for c in ("ec_platform", "ec_category", "ec_sub_category")}),
        (rules.merchants, "merchant_pattern", {c: c for c in ("normalized_merchant", "category", "sub_category")}),
    ]
    out = refine.tag_all(out, "merchant", tags)
    either = lambda a, b: F.when(C.blank(F.col(a)), F.col(b)).otherwise(F.col(a))
    out = out.withColumns({"payment_process": either("payment_process", "_p"), "prefix": either("prefix", "_x")}).drop("_p", "_x")
    out = refine.merchant_fallback(out)
    out = out.withColumn("display_name", refine.display_name(F.col("prefix"), F.col("ec_platform"), F.col("normalized_merchant")))
    out = refine.classify(out, rules.words)
    out = refine.convert_currency(out, rules.rates) if rules.rates is not None else out.withColumn("fx_missing", F.lit(False))
    out = with_gold_ids(out, [c for c in ("statement_month", "posting_date", "bank_no", "raw_merchant", "vpc_no", "currency_amount") if c in out.columns])
    return bronze.enforced(out.drop("raw_extra", "raw_merchant", "raw_location", "raw_currency", "raw_amount"))


def run_etl(spark: SparkSession, folder: str, rules: Rules, registry: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Gold rows of the statements in a folder, and the status of every file there.

    Files that the registry holds as SUCCESS are not read again; one lethal text refuses its file.
    """
    rows, refused = bills.sanitised(cut(bills.standard_rows(spark, folder, registry)))
    numbers = {name: number for number, name in rules.bank_names.items()}
    known = F.create_map(*(F.lit(x) for pair in (numbers or {"": ""}).items() for x in pair))
    rows = rows.withColumn("bank_no", F.try_element_at(known, F.col("bank"))).withColumnsRenamed({"bank": "bank_name"})
    own = ("vpc_no", "vpc_type", "card_type", "payment_process", "transaction_type")
    raw = cut(bronze.contract(bronze.pack_extra(rows, [c for c in rows.columns if c not in own])))
    return refine_transactions(raw, rules), bills.statuses(bills.files(spark, folder), refused, registry)


TICKET = ("transaction_date", "bank_name", "card_type", "payment_process", "category", "sub_category", "normalized_merchant", "payment_amount")


def tickets_of(rows: DataFrame) -> DataFrame:
    """Equal tickets of one day, bank, card, payment, category and merchant as one row, with their number ``n``; written."""
    return cut(rows.groupBy(*(c for c in TICKET if c in rows.columns)).agg(F.count("*").alias("n")))


def cube_of(tickets: DataFrame) -> DataFrame:
    """Days by bank, card, payment, category and merchant: sum and number of their tickets; written."""
    keys = [c for c in TICKET[:-1] if c in tickets.columns]
    money = (F.col("payment_amount") * F.col("n")).cast("decimal(38,2)")
    return cut(tickets.groupBy(*keys).agg(F.sum(money).alias("payment_amount"), F.sum("n").alias("n")))


def run_analytics(
    gold: DataFrame,
    categories: Iterable[str] | None = None,
    sub_categories: Iterable[str] | None = None,
    card_status: DataFrame | None = None,
    wanted: Iterable[str] | None = None,
    **which: object,
) -> dict[str, DataFrame]:
    """The mart: every summary of the chosen transactions by its name; :func:`cardloom.operators.sinks.overwrite_mart` writes it.

    ``which`` are the filters of :func:`cardloom.operators.filters.query_transactions`, ``wanted`` the results to make if not
    all.  Gold is read once (once more for the last day, if a window is asked for): equal tickets are brought together and
    written, days summed up from them, and every result comes from one of these two.  Gold holds each transaction id
    once, so transactions are counted as rows.
    """
    tickets = tickets_of(filters.dataset(gold, categories, sub_categories, **which))
    days = cube_of(tickets)
    named = {"category": segments.NO_CATEGORY, "payment_process": segments.NO_PAYMENT}

    @cache
    def merchants() -> DataFrame:
        found = segments.rfm(days.where("normalized_merchant != ''"), ["normalized_merchant"]).withColumn("segment", segments.merchant_segment())
        return cut(found.join(segments.common_category(days), "normalized_merchant", "left"))

    @cache
    def own_cards() -> DataFrame:
        found = segments.rfm(days.where(~C.blank(F.col("card_type"))), ["bank_name", "card_type"])
        found = cut(found.withColumns({"segment": segments.card_segment(), "avg_ticket": segments.average_ticket()}))
        return found.withColumn("status", F.lit("active")) if card_status is None else cards.with_status(found, card_status)

    @cache
    def board() -> dict[str, DataFrame]:
        return segments.rfm_dashboard(merchants(), own_cards(), tickets)

    results: dict[str, Callable[[], DataFrame]] = {
        "rfm_merchants": merchants,
        "rfm_categories": lambda: segments.rfm(days, ["category"], names=named).withColumn("segment", segments.merchant_segment(labels=segments.CATEGORY_LABELS)),
        "rfm_payments": lambda: segments.rfm(days, ["payment_process"], names=named).withColumn("segment", segments.payment_segment()),
        "rfm_cards": own_cards,
        "matrix_monthly_category": lambda: summaries.monthly(days, "category"),
        "matrix_monthly_card": lambda: summaries.monthly(days, "bank_name", "card_type"),
        "matrix_monthly_payment": lambda: summaries.monthly(days, "payment_process"),
        "matrix_monthly_detail": lambda: summaries.monthly(days, "card_type", "category", average=False),
        "sankey_flow_links": lambda: summaries.flow_links(days),
        "trend": lambda: summaries.trend(days),
        "summary": lambda: summaries.dashboard(tickets),
        "top_by_category": lambda: board()["top_by_category"],
        "segment_counts": lambda: board()["segment_counts"],
        "dashboard_merchants": lambda: board()["merchants"],
        "dashboard_medians": lambda: board()["medians"],
        "dashboard_cards": lambda: board()["cards"].drop("sort_key"),
        **{f"volatility_{mode}": partial(segments.volatility_view, tickets, mode) for mode in segments.MODES},
    }
    return {name: results[name]() for name in (results if wanted is None else wanted)}


def run(spark: SparkSession, folder: str, rules: Rules, schema: str = "default") -> dict[str, bool]:
    """Statements to mart: loads new Gold rows and writes the analytics of all of them."""
    registry = spark.table(f"{schema}.files") if spark.catalog.tableExists(f"{schema}.files") else None
    gold, status = run_etl(spark, folder, rules, registry)
    sinks.load(gold, f"{schema}.transactions", keys=["transaction_id"])
    sinks.load(status, f"{schema}.files", keys=["file_hash", "status"])
    return sinks.overwrite_mart(run_analytics(spark.table(f"{schema}.transactions")), schema)
