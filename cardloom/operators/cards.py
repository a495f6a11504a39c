"""Users' cards: tables, status, and what a row's card tells about it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.functions import columns as C
from cardloom.functions.numbering import numbered
from cardloom.operators import refine


def with_numbers(df: DataFrame, order: Sequence[str], name: str, pattern: str) -> DataFrame:
    """Adds ids written by the pattern, numbered from 1 in the given order, without one task that sees all rows."""
    rows = numbered(df, order, "_number")
    return rows.withColumn(name, F.format_string(pattern, F.col("_number") + 1)).drop("_number")


def card_tables(cards: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nested cards (``card_history`` of ``vpc_pay``) as three tables: cards, their numbers over time, virtual cards.

    The rows of the last two have ids, HIST_0001 and VPC_00001 on, by card and place; a virtual card knows its history row.
    """
    outer = cards.select("card_id", "bank_no", "card_type").dropDuplicates(["card_id"])
    held = cards.select("card_id", F.posexplode("card_history").alias("history_no", "h"))
    held = with_numbers(held, ["card_id", "history_no"], "history_id", "HIST_%04d")
    fields = [f.name for f in held.schema["h"].dataType.fields]
    flat = [c for c in fields if c != "vpc_pay"]
    history = held.select("history_id", "card_id", "history_no", *(f"h.{c}" for c in flat))
    virtual = held.select("history_id", "card_id", "history_no", F.col("h.card_no").alias("card_no"), F.posexplode("h.vpc_pay").alias("vpc_ord", "v"))
    virtual = with_numbers(virtual, ["card_id", "history_no", "vpc_ord"], "vpc_id", "VPC_%05d")
    return outer, history, virtual.select("vpc_id", "history_id", "card_id", "history_no", "card_no", "vpc_ord", "v.*")


def card_status(cards: DataFrame) -> DataFrame:
    """``card_type`` and ``status``: active if any card of the type has an active entry, else cancelled."""
    rows = cards.where(~C.blank(F.col("card_type"))).select(F.trim("card_type").alias("card_type"), F.explode_outer("card_history").alias("h"))
    active = F.max(F.coalesce(F.lower("h.status") == "active", F.lit(False)))
    return rows.groupBy("card_type").agg(F.when(active, "active").otherwise("cancelled").alias("status"))


def with_status(df: DataFrame, status: DataFrame) -> DataFrame:
    """Adds the status of each row's card type; unknown types count as active."""
    side = C.small(status.select(F.col("card_type").alias("_type"), "status"))
    return df.join(side, F.trim("card_type") == F.col("_type"), "left").drop("_type").withColumn("status", F.coalesce("status", F.lit("active")))


def vpc_to_payment(df: DataFrame, gateways: Sequence[Mapping]) -> DataFrame:
    """A virtual card that is a way of payment gives ``payment_process`` and ``prefix`` where there is none, and goes.

    ``gateways`` are rules of ``payment_process_pattern``, ``payment_process`` and ``process_prefix``; the first one that
    matches counts.  CARD is no way of payment.
    """
    rules = [dict(g) for g in gateways if (g.get("payment_process_pattern") or "").strip()]
    asked = ~C.blank(F.col("vpc_type")) & (F.trim("vpc_type") != "CARD")
    if not rules:
        return df.withColumn("prefix", F.lit(None).cast("string")) if "prefix" not in df.columns else df
    hit = F.when(asked, C.first_rule(F.trim("vpc_type"), rules, "payment_process_pattern"))
    pick = lambda field: F.get(F.array(*(F.lit(r.get(field)).cast("string") for r in rules)), hit)
    old = F.col("prefix") if "prefix" in df.columns else F.lit(None).cast("string")
    return df.withColumns(
        {
            "payment_process": F.when(hit.isNotNull() & C.blank(F.col("payment_process")), pick("payment_process")).otherwise(F.col("payment_process")),
            "prefix": F.when(hit.isNotNull(), F.coalesce(F.when(~C.blank(pick("process_prefix")), pick("process_prefix")), old)).otherwise(old),
            "vpc_type": F.when(hit.isNotNull(), "").otherwise(F.col("vpc_type")),
        }
    )


def enrich(df: DataFrame, cards: DataFrame) -> DataFrame:
    """Card, bank and virtual card of each row by its numbers, in one lookup."""
    return refine.match_cards(df, cards)
