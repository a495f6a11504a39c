"""Reward programs, pools and selections from their tables, under the names that the reward operators use."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions import columns as C

LISTS = ("normalized_merchant", "merchant_display", "merchant_location", "payment_process", "ec_platform", "vpc_type", "card_id", "bank_no")
RULE = f"struct<{','.join(f'{n}:array<string>' for n in LISTS)},merchant_rate:decimal(9,4),start_date:date,end_date:date,note:string>"
TRUE = ("true", "1", "t", "yes", "y")


def missing_tables(spark: SparkSession, names: Iterable[str]) -> list[str]:
    """The tables that are not there."""
    return [n for n in names if not spark.catalog.tableExists(n)]


def _first(df: DataFrame, *names: str) -> Column:
    held = [F.col(n).cast("string") for n in names if n in df.columns]
    return C.text_or_null(F.coalesce(*held, F.lit(None).cast("string")))


def _programs(df: DataFrame, source: str, prefixes: tuple[str, ...], first: int) -> DataFrame:
    names = lambda n: (*(f"{p}_{n}" for p in prefixes), n)
    text = lambda n: _first(df, *names(n))
    flag = F.coalesce(F.lower(_first(df, "reward_cal_break", *(f"{p}_reward_cal_break" for p in prefixes))).isin(*TRUE), F.lit(False))
    rank = F.coalesce(_first(df, "priority", *(f"{p}_priority" for p in prefixes)).try_cast("int"), F.lit(999))
    load = F.col("load_ord").cast("long") if "load_ord" in df.columns else F.monotonically_increasing_id()
    return df.select(
        F.coalesce(text("reward_id"), F.lit("")).alias("reward_id"), text("bank_no").alias("bank_no"), text("card_id").alias("card_id"),
        F.coalesce(text("reward_program"), F.lit("")).alias("reward_program"), F.lit(source).alias("source"), text("reward_cycle").alias("reward_cycle"),
        text("reward_type").alias("reward_type"), text("calc_method").alias("calc_method"), text("round_strategy").alias("round_strategy"), rank.alias("priority"),
        flag.alias("reward_cal_break"), text("reward_rate").try_cast("decimal(9,4)").alias("reward_rate"), text("cap_amount").try_cast("decimal(18,2)").alias("cap_amount"),
        text("start_date").try_cast("date").alias("start_date"), text("end_date").try_cast("date").alias("end_date"), (load + first).alias("load_ord"),
    )


def programs(base: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Base programs, then campaigns; each column under its own name or that with the kind before it."""
    return _programs(base, "base", ("base",), 0).unionByName(_programs(campaigns, "campaign", ("campaigns", "campaign"), 1 << 40))


def links(df: DataFrame) -> DataFrame:
    """Programs' pools, in the order of the table; rows without either id go."""
    load = F.col("load_ord").cast("long") if "load_ord" in df.columns else F.monotonically_increasing_id()
    out = df.select(_first(df, "reward_id").alias("reward_id"), _first(df, "merchant_reward_pools_id", "pool_id").alias("pool_id"), load.alias("link_ord"))
    return out.dropna(subset=["reward_id", "pool_id"])


def rules_from_json(json: Column) -> Column:
    """Rules of a parsed JSON list; a field holds a list of texts or one text.  What is no such list gives no rules."""
    found = F.try_variant_get(json, "$", "array<variant>")

    def rule(v: Column) -> Column:
        get = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
        lists = [F.coalesce(get(n, "array<string>"), F.when(get(n, "string").isNotNull(), F.array(get(n, "string")))).alias(n) for n in LISTS]
        return F.struct(*lists, get("merchant_rate", "decimal(9,4)").alias("merchant_rate"), *(get(n, "string").try_cast("date").alias(n) for n in ("start_date", "end_date")), get("note", "string").alias("note"))

    return F.coalesce(F.transform(found, rule), F.array()).cast(f"array<{RULE}>")


def pools(df: DataFrame) -> DataFrame:
    """Pools with their rules from JSON; none are empty lists."""
    out = df.select(_first(df, "merchant_reward_pools_id", "pool_id").alias("pool_id"), _first(df, "pool_name").alias("pool_name"), *(F.col(n).cast("string").alias(n) for n in ("pass_rules", "rules")))
    for name in ("pass_rules", "rules"):
        out = out.withColumn("_json", F.try_parse_json(name)).withColumn(name, rules_from_json(F.col("_json")))
    return out.drop("_json")


def pools_from_rows(df: DataFrame) -> DataFrame:
    """Pools from flat rows, one rule a row with comma lists in its fields; ``is_pass`` marks pass rules."""
    listed = lambda n: F.filter(F.transform(F.split(F.coalesce(F.col(n), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    held = [F.when(F.size(listed(n)) > 0, listed(n)).alias(n) if n in df.columns else F.lit(None).cast("array<string>").alias(n) for n in LISTS]
    rate = F.col("merchant_rate").try_cast("decimal(9,4)") if "merchant_rate" in df.columns else F.lit(None).cast("decimal(9,4)")
    days = [F.col(n).try_cast("date").alias(n) if n in df.columns else F.lit(None).cast("date").alias(n) for n in ("start_date", "end_date")]
    note = F.col("note").cast("string") if "note" in df.columns else F.lit(None).cast("string")
    rule = F.struct(*held, rate.alias("merchant_rate"), *days, note.alias("note"))
    name = F.first("pool_name", ignorenulls=True) if "pool_name" in df.columns else F.lit(None).cast("string")
    flag = F.coalesce(F.lower(F.col("is_pass").cast("string")).isin(*TRUE), F.lit(False))
    rows = df.withColumns({"_pass": flag, "_r": F.struct(F.col("rule_ord").alias("o"), rule.alias("r"))})
    kept = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.col("_r")))), lambda x: x["r"])
    return rows.groupBy("pool_id").agg(name.alias("pool_name"), kept(F.col("_pass")).alias("pass_rules"), kept(~F.col("_pass")).alias("rules"))


def pools_to_rows(pools: DataFrame) -> DataFrame:
    """The flat rows of pools, as :func:`pools_from_rows` reads them; pass rules come first."""
    rows = None
    for is_pass, name in ((True, "pass_rules"), (False, "rules")):
        part = pools.select("pool_id", "pool_name", F.lit(is_pass).alias("is_pass"), F.posexplode(name).alias("rule_ord", "r"))
        rows = part if rows is None else rows.unionByName(part)
    lists = [F.array_join(F.col(f"r.{n}"), ",").alias(n) for n in LISTS]
    return rows.select("pool_id", "pool_name", "is_pass", "rule_ord", *lists, "r.merchant_rate", "r.start_date", "r.end_date", "r.note")


def selections(df: DataFrame) -> DataFrame:
    """Programs selected for days; rows without both days go."""
    out = df.select(F.coalesce(_first(df, "base_reward_program", "reward_program"), F.lit("")).alias("base_reward_program"), *(_first(df, n).try_cast("date").alias(n) for n in ("start_date", "end_date")), _first(df, "remark", "note").alias("note"))
    return out.dropna(subset=["start_date", "end_date"])
