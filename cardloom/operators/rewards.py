"""Card rewards: candidate programs, pool rules, priority waterfall, capped accumulation per cycle.

The waterfall and the caps are window functions, those of campaigns a scan over ranges; only cycle keys that mix caps or
methods go through a per-key loop.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from datetime import date
from decimal import ROUND_CEILING, ROUND_FLOOR, ROUND_HALF_UP, Decimal
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from cardloom.functions import columns as C
from cardloom.functions.lineage import cut, cut_small
from cardloom.operators import intervals

MONEY = "decimal(18,2)"
# Reward types with two digits (others have none) and those that round down (others round half up).
TWO_DIGITS = ("openpoint",)
DOWN = ("cashback_floor", "esunpoint_floor", "esun_points_floor")
# Days around a change of selection in which a booked day may be another one than that of the purchase.
ABROAD_DAYS, PHONE_DAYS = 1, 2
FIELDS = ("payment_process", "ec_platform", "vpc_type", "merchant_location")
HOLDER = ("bank_no", "card_id")


def candidates(txns: DataFrame, programs: DataFrame) -> DataFrame:
    """Transactions with every program that is open on their day for their bank and card.

    A ``locked`` array, if the transactions have one and it is not empty, lets only its base programs through.  A program
    is for a bank or ALL and for a card or ALL (blank is ALL); a transaction asks for each of these combinations, so
    programs are found by equal keys.
    """
    names = {"bank_no": "_bank", "card_id": "_card", "start_date": "_start", "end_date": "_end"}
    wanted = programs.withColumnsRenamed(names).withColumns({"_bank": F.lower("_bank"), "_card": F.when(C.blank(F.col("_card")), "all").otherwise(F.lower("_card"))})
    every = F.lit("all")
    pairs = [F.struct(b.alias("_bank"), c.alias("_card")) for b in (F.lower("bank_no"), every) for c in (F.lower("card_id"), every)]
    asked = txns.withColumn("_asked", F.explode(F.array_distinct(F.array(*pairs)))).withColumns({"_bank": F.col("_asked._bank"), "_card": F.col("_asked._card")}).drop("_asked")
    day = F.col("transaction_date")
    cond = (F.coalesce(day >= F.col("_start"), F.lit(True))) & (F.coalesce(day <= F.col("_end"), F.lit(True)))
    if "locked" in txns.columns:
        open_to = (F.col("source") != "base") | F.coalesce(F.size("locked"), F.lit(0)).isin(0, -1) | F.exists("locked", lambda x: F.lower(x) == F.lower("reward_program"))
        cond = cond & F.coalesce(open_to, F.lit(True))
    return asked.join(C.small(wanted), ["_bank", "_card"]).where(cond).drop("_bank", "_card", "_start", "_end")


#: What a rule lists: an array column, or the values themselves where the rules are known.
Listed = Column | Sequence[str | None] | None


def _any(wanted: Listed, holds: Callable[[Column], Column]) -> Column:
    """Whether ``holds`` is true of a listed value."""
    if isinstance(wanted, Column):
        return F.exists(wanted, holds)
    return reduce(lambda a, b: a | b, (holds(F.lit(w).cast("string")) for w in wanted or ()), F.lit(False))


def _unset(wanted: Listed) -> Column:
    return wanted.isNull() | (F.size(wanted) == 0) if isinstance(wanted, Column) else F.lit(not wanted)


def _listed(wanted: Listed, value: Column) -> Column:
    return F.coalesce(_any(wanted, lambda w: F.lower(w) == F.lower(value)), F.lit(False))


def matches(wanted: Listed, value: Column, blanks: tuple[str, ...] = ()) -> Column:
    """Field rule: no list is any value; NONE is a blank one, ALL one that is not blank, else a member whatever its case.

    ``blanks`` are values that count as blank for NONE and ALL, but can be listed all the same.
    """
    none = C.blank(value) | (F.upper(value) == "NONE")
    blank = none | F.upper(value).isin(*blanks) if blanks else none
    member = _listed(wanted, value) & ~(C.blank(value) if blanks else none)
    hit = (_listed(wanted, F.lit("NONE")) & blank) | (_listed(wanted, F.lit("ALL")) & ~blank) | member
    return _unset(wanted) | F.coalesce(hit, F.lit(False))


def holder_matches(wanted: Listed, value: Column) -> Column:
    """Bank or card rule: no list and ALL are any; else a member, a blank value never."""
    return _unset(wanted) | _listed(wanted, F.lit("ALL")) | (_listed(wanted, value) & ~C.blank(value))


def merchant_matches(wanted: Listed, *names: Column) -> Column:
    """A listed merchant is equal to or part of either name; NONE and ALL speak of the first name that there is."""
    name = F.coalesce(*names)
    blank = C.blank(name) | (F.upper(name) == "NONE")
    inside = _any(wanted, lambda w: reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(n), F.lower(w)), F.lit(False)) for n in names)))
    hit = (_listed(wanted, F.lit("NONE")) & blank) | (~blank & (_listed(wanted, F.lit("ALL")) | inside))
    return _unset(wanted) | F.coalesce(hit, F.lit(False))


def rule_holds(rule: Column | Row, txn: dict[str, Column]) -> Column:
    """Whether one rule (a struct of arrays, rate and dates, or a known row of these) fits a transaction."""
    conds = [matches(rule[f], txn[f], ("CARD",) if f == "vpc_type" else ()) for f in FIELDS if _asks(rule[f])]
    conds += [holder_matches(rule[f], txn[f]) for f in HOLDER if _asks(rule[f])]
    shops = [rule["normalized_merchant"], rule["merchant_display"]]
    shops = F.coalesce(*shops) if isinstance(rule, Column) else _first_list(*shops)
    conds += [merchant_matches(shops, txn["normalized_merchant"], txn["merchant_display"])] if _asks(shops) else []
    day, first, last = txn["transaction_date"], rule["start_date"], rule["end_date"]
    return reduce(lambda a, b: a & b, conds, _in_days(day, first, last))


def _asks(wanted: Listed) -> bool:
    """Whether a list can ask for anything; of a column this is known for each row only."""
    return isinstance(wanted, Column) or bool(wanted)


def _first_list(*lists: Sequence[str | None] | None) -> Sequence[str | None] | None:
    return next((x for x in lists if x is not None), None)


def _in_days(day: Column, first: Column | date | None, last: Column | date | None) -> Column:
    """Whether the day lies between two others, of which either may be missing."""
    first, last = (x if isinstance(x, Column) else F.lit(x).cast("date") for x in (first, last))
    return F.coalesce(day >= first, F.lit(True)) & F.coalesce(day <= last, F.lit(True))


def _low(c: str) -> Column:
    return F.lower(F.trim(F.col(c)))


def _pools_of(links: DataFrame, pools: DataFrame) -> DataFrame:
    """Each program's pools in link order, as one array."""
    named = pools if "pool_name" in pools.columns else pools.withColumn("pool_name", F.lit(None).cast("string"))
    held = links.select(_low("reward_id").alias("_reward"), _low("pool_id").alias("_pool"), "link_ord").join(named.withColumn("_pool", _low("pool_id")), "_pool")
    return held.groupBy("_reward").agg(F.array_sort(F.collect_list(F.struct("link_ord", "pool_id", "pool_name", "pass_rules", "rules"))).alias("_pools"))


def _hit(pools: Column) -> Column:
    """The first pool whose pass rules don't fit and one of whose rules does, with what that rule says; each is tried once."""
    txn = {c: F.col(c) for c in (*FIELDS, *HOLDER, "normalized_merchant", "merchant_display", "transaction_date")}

    def look(p: Column) -> Column:
        passed = F.exists(p["pass_rules"], lambda r: rule_holds(r, txn))
        first = F.get(F.filter(p["rules"], lambda r: rule_holds(r, txn)), F.lit(0))
        return F.struct(p["pool_id"].alias("pool_id"), p["pool_name"].alias("pool_name"), F.when(F.coalesce(~passed, F.lit(True)), first).alias("rule"))

    def tell(x: Column) -> Column:
        rule = x["rule"]
        shown = F.array_join(F.coalesce(rule["merchant_display"], rule["normalized_merchant"]), ";")
        return F.struct(x["pool_id"].alias("pool_id"), x["pool_name"].alias("pool_name"), rule["merchant_rate"].alias("rate"), shown.alias("rule_merchant"), F.array_join(rule["payment_process"], ";").alias("rule_payment"))

    return F.get(F.transform(F.filter(F.transform(pools, look), lambda x: x["rule"].isNotNull()), tell), F.lit(0))


def _told(hit: Column, rate: Column) -> dict[str, Column]:
    """What a hit says of a row: the rate, the pool, and what its rule names."""
    return {"rate": F.coalesce(hit["rate"], rate, F.lit(0)).cast("decimal(9,4)"), **{c: hit[c] for c in ("pool_id", "pool_name", "rule_merchant", "rule_payment")}}


def with_rates(cands: DataFrame, links: DataFrame, pools: DataFrame) -> DataFrame:
    """The rate of each candidate: its program's, or that of the first fitting rule of its pools in link order.

    A program without pools fits everything; a pool one of whose pass rules fits is skipped; a program none of whose
    rules fits goes.  Each candidate sees its program's pools as one array, so nothing is multiplied.
    """
    rows = cands.withColumn("_reward", _low("reward_id")).join(C.small(_pools_of(links, pools)), "_reward", "left").drop("_reward")
    rows = rows.withColumn("_hit", _hit(F.col("_pools"))).where(F.col("_pools").isNull() | F.col("_hit").isNotNull())
    return rows.withColumns(_told(F.col("_hit"), F.col("reward_rate"))).drop("_hit", "_pools")


def waterfall(rows: DataFrame) -> DataFrame:
    """Programs of each transaction by priority, up to and with the first that ends the calculation."""
    order = Window.partitionBy("transaction_id").orderBy(F.coalesce("priority", F.lit(999)), "load_ord").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col("reward_cal_break").cast("int")).over(order), F.lit(0))
    return rows.withColumn("_ended", ended).where("_ended = 0").drop("_ended")


def cycle_key(rows: DataFrame) -> Column:
    """What a cap is counted over, in lower case; missing parts keep their place, so they never join two keys."""
    cycle = F.upper(F.trim("reward_cycle"))

    def key(kind: str, *parts: Column) -> Column:
        return F.concat_ws("|", F.lit(kind), F.coalesce("reward_program", F.lit("")), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))

    card = [F.when(~C.blank(F.col(c)), F.col(c)) for c in ("card_id", "card_type") if c in rows.columns]
    month = F.coalesce("statement_month", F.date_format("posting_date", "yyyy-MM"))
    out = F.when(cycle == "BILLING_CYCLE", key("billing", F.col("bank_no"), F.coalesce(*card, F.lit("DEFAULT")), month))
    out = out.when(cycle == "CALENDAR_MONTH", key("month", F.col("bank_no"), F.col("card_id"), F.date_format("transaction_date", "yyyy-MM")))
    out = out.when(cycle == "CAMPAIGN_CYCLE", key("campaign", F.col("program_start"), F.col("program_end")))
    return F.lower(out.otherwise(key("one", F.col("transaction_id"))))


def digits(kind: Column) -> Column:
    """Decimal digits of a reward type."""
    return F.when(F.lower(kind).isin(*TWO_DIGITS), 2).otherwise(0)


def rounding() -> Column:
    """The program's way of rounding, else that of its reward type."""
    given = F.when(~C.blank(F.col("round_strategy")), F.col("round_strategy"))
    return F.coalesce(given, F.when(F.lower("reward_type").isin(*DOWN), "floor").otherwise("round"))


def base_reward(rows: DataFrame) -> Column:
    """Rounded reward of one transaction alone."""
    return C.rounded(F.col("amount") * F.col("rate") / F.lit(100), rounding(), digits(F.col("reward_type")))


def _item(rows: DataFrame) -> Column:
    """The same for a row that is counted on its own, not by a running amount."""
    return F.when(~F.col("_agg"), base_reward(rows))


def with_mixed(programs: DataFrame) -> DataFrame:
    """Adds ``_mixed``: whether programs of one name and cycle, which can share a key, differ in cap or method.

    And ``_alone``: whether there is only one of them.
    """
    cap = F.when(F.col("cap_amount") > 0, F.col("cap_amount")).cast(MONEY)
    kind = F.struct(F.coalesce(cap, F.lit(-1)), F.coalesce(F.upper("calc_method") == "AGGREGATE", F.lit(False)))
    same = Window.partitionBy(F.lower("reward_program"), F.upper(F.trim("reward_cycle")))
    return programs.withColumns({"_mixed": F.min(kind).over(same) != F.max(kind).over(same), "_alone": F.count("*").over(same) == 1})


ORDER = ("transaction_date", "transaction_id", "priority", "load_ord")
LASTING = ("BILLING_CYCLE", "CALENDAR_MONTH", "CAMPAIGN_CYCLE")
#: Ranges of a campaign's rows for each task of a shuffle.
RANGES = 4


def _paid(amounts: DataFrame) -> dict[str, Column]:
    """Reward and whether the cap was met, from the running values of a row's key.

    ``_p`` is the row's own reward, ``_sum`` the sum of these up to it and ``_max`` the largest such sum before it;
    ``_earned`` is the rounded reward of the running amount and ``_before`` the largest such reward before it, 0 at least.
    """
    cap, zero = F.col("_cap"), F.lit(0).cast(MONEY)
    full = F.coalesce(F.col("_max") >= cap, F.lit(False))
    item = F.when(cap.isNull(), F.col("_p")).when(full, zero).otherwise(F.least(F.col("_p"), cap - (F.col("_sum") - F.col("_p"))))
    now = F.greatest("_before", "_earned")
    share = F.when(cap.isNull(), now - F.col("_before")).otherwise(F.least(cap, now) - F.least(cap, F.col("_before")))
    hit = F.coalesce(F.when(F.col("_agg"), (F.col("_before") >= cap) | (now > cap)).otherwise(full | (F.col("_sum") > cap)), F.lit(False))
    return {"reward": F.when(F.col("_agg"), share).otherwise(item).cast(MONEY), "is_capped": hit}


def _earned(rows: DataFrame) -> Column:
    how, places = (F.col("_how"), F.col("_digits")) if "_how" in rows.columns else (rounding(), digits(F.col("reward_type")))
    return F.when(F.col("_agg"), C.rounded(F.col("_amount") * F.col("rate") / F.lit(100), how, places))


def _alone(rows: DataFrame) -> DataFrame:
    """Rows that share their key with no other, or whose program neither has a cap nor adds up: no order is needed."""
    return rows.withColumns({"_sum": F.col("_p"), "_amount": F.col("amount"), "_max": F.lit(None).cast(MONEY), "_before": F.lit(0).cast(MONEY), "_earned": F.col("_p")})


def _in_one_go(rows: DataFrame) -> DataFrame:
    """Running values over one sort per key, for keys of one card's month."""
    order = Window.partitionBy("cycle_key").orderBy(*ORDER)
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_sum", F.sum("_p").over(upto)).withColumn("_amount", F.sum("amount").over(upto)).withColumn("_earned", _earned(rows))
    return out.withColumn("_max", F.max("_sum").over(before)).withColumn("_before", F.greatest(F.lit(0), F.coalesce(F.max("_earned").over(before), F.lit(0))))


def _by_ranges(rows: DataFrame, key: str = "cycle_key", finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Running values of keys that may hold any share of all rows, by a scan in two levels.

    Rows are dealt by ranges of key and order.  Each range sums its own rows, and these are written with their running
    sums; the ranges' sums and maxima, one row for a key and range, are scanned, and what came before is carried into the
    ranges.  Only keys that cross into another range carry anything, two a range at most.  The reward of a running amount
    is known after the first carry, so its maximum is scanned by a second one.  ``finish`` adds what the sums need to rows
    that have been dealt, so that it neither is worked out for the sample of the ranges nor goes through their shuffle.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) * RANGES
    dealt = rows.repartitionByRange(parts, key, *ORDER).withColumn("_range", F.spark_partition_id())
    order = Window.partitionBy("_range", key).orderBy(*ORDER)
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = [key, "_range"]
    # The place in the range comes first, from which a row's sums are worked out and, later, its maximum.
    local = dealt.withColumn("_place", F.row_number().over(order))
    local = local if finish is None else finish(local)
    local = local.withColumn("_s", F.sum("_p").over(upto)).withColumn("_a", F.sum("amount").over(upto))
    local = cut(local.withColumn("_s_before", F.max("_s").over(before)))
    before = Window.partitionBy("_range", key).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    sums = local.groupBy(*ends).agg(F.sum("_p").alias("_s1"), F.sum("amount").alias("_a1"), F.max("_s").alias("_m1"))
    sums = sums.withColumn("_s0", F.sum("_s1").over(earlier)).withColumn("_a0", F.sum("_a1").over(earlier))
    sums = sums.withColumn("_m0", F.max(F.coalesce("_s0", F.lit(0)) + F.col("_m1")).over(earlier)).where("_s0 is not null or _a0 is not null")
    local = local.join(F.broadcast(cut(sums.select(*ends, "_s0", "_a0", "_m0"))), ends, "left")
    so_far = F.coalesce("_s0", F.lit(0))
    local = local.withColumns({"_sum": F.col("_s") + so_far, "_amount": F.col("_a") + F.coalesce("_a0", F.lit(0)), "_max": F.greatest(F.col("_m0"), F.col("_s_before") + so_far)})
    local = local.drop("_s", "_a", "_s_before", "_s0", "_a0", "_m0").withColumn("_earned", _earned(local))
    most = local.groupBy(*ends).agg(F.max("_earned").alias("_e1"))
    most = most.withColumn("_e0", F.max("_e1").over(earlier)).where("_e0 is not null").select(*ends, "_e0")
    local = local.join(F.broadcast(most), ends, "left")
    return local.withColumn("_before", F.greatest(F.lit(0), F.coalesce("_e0", F.lit(0)), F.coalesce(F.max("_earned").over(before), F.lit(0))))


def capped(rows: DataFrame, any_mixed: bool = True, any_wide: bool = True, programs: DataFrame | None = None) -> DataFrame:
    """Adds ``reward`` and ``is_capped``: rewards of each cycle key in order, up to its cap (none if null or not positive).

    PER_ITEM rounds each row and pays up to what is left; once full, a key pays nothing more.  AGGREGATE rounds the
    running amount and pays the increments.  Both are running sums and maxima: over one sort per key for the keys of a
    card's month, over ranges for campaigns, whose key any number of rows can share, and not at all where nothing adds up.
    Rows with ``_mixed`` go through a loop per key instead.  ``any_mixed`` and ``any_wide`` say whether there can be rows
    with it, and campaigns with a cap or a running amount.  A transaction's id names one transaction.

    With ``programs`` the rows are a written table that has its programs' ``program_no`` only; their columns are looked
    up for the keys and at the end, and don't go through the sorts.
    """
    own = lambda df: df.withColumn("cycle_key", cycle_key(df))
    whole = cut(own(rows).withColumn("_p", base_reward(rows))) if programs is None else own(rows.join(programs, "program_no"))  # read once for each way
    cycle = F.coalesce(F.upper(F.trim("reward_cycle")), F.lit(""))
    agg, cap = F.coalesce(F.upper("calc_method") == "AGGREGATE", F.lit(False)), F.when(F.col("cap_amount") > 0, F.col("cap_amount")).cast(MONEY)
    free = (~agg & cap.isNull()) | (~cycle.isin(*LASTING) & F.col("_alone"))
    wide = cycle == "CAMPAIGN_CYCLE"
    columns = [c for c in whole.columns if not c.startswith("_")] if programs is None else rows.columns
    more = {"_cap": cap, "_agg": agg, "_how": rounding(), "_digits": digits(F.col("reward_type"))}
    given = whole.withColumns(more)
    given = given.where("not _mixed") if any_mixed else given
    needed = list(dict.fromkeys([*columns, *ORDER, "cycle_key", "_p", "_cap", "_agg", "_how", "_digits"]))
    # A key whose running amount is rounded doesn't ask for the rounded amounts of its rows.
    alone, summed = (given, given) if programs is None else (given.withColumn("_p", p) for p in (base_reward(given), _item(given)))
    ways = [_alone(alone.where(free).select(*needed)), _in_one_go(summed.where(~free & ~wide).select(*needed))]
    if any_wide and programs is None:
        ways.append(_by_ranges(given.where(~free & wide).select(*needed)))
    elif any_wide:
        kept = programs.where(~free & wide & ~F.col("_mixed"))
        dealt = rows.join(kept.select("program_no", "_campaign", "priority", "load_ord"), "program_no")
        beside = ["program_no", *(c for c in kept.columns if c not in dealt.columns)]
        finish = lambda df: (r := df.join(kept.select(*beside), "program_no")).withColumns(more).withColumn("_p", _item(r)).select(*df.columns, "_p", *more)
        ways.append(_by_ranges(dealt, "_campaign", finish))
    closed = reduce(DataFrame.unionByName, (w.select(*columns, *(c.alias(n) for n, c in _paid(w).items())) for w in ways))
    if programs is not None:
        closed = closed.join(programs, "program_no").drop("_mixed", "_alone", "_campaign")
        closed = closed.withColumn("cycle_key", cycle_key(closed))
    if not any_mixed:
        return closed
    mixed = whole.where("_mixed").select(*(c for c in closed.columns if c not in ("reward", "is_capped"))).repartition("cycle_key")
    return closed.unionByName(mixed.sortWithinPartitions("cycle_key", *ORDER).mapInPandas(_loop, closed.schema))


def _round(value: Decimal, how: str | None, kind: str | None) -> Decimal:
    kind = (kind or "").lower()
    unit = Decimal("0.01") if kind in TWO_DIGITS else Decimal(1)
    name = (how or "").strip().lower() or ("floor" if kind in DOWN else "round")
    rule = {"floor": ROUND_FLOOR, "down": ROUND_FLOOR, "ceil": ROUND_CEILING, "ceiling": ROUND_CEILING, "up": ROUND_CEILING}.get(name, ROUND_HALF_UP)
    return value.quantize(unit, rule)


def _loop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by cycle key and order, for keys that mix caps or methods; only a key's running sums are held."""
    key, paid, spent = None, Decimal(0), Decimal(0)
    for rows in batches:
        out = []
        for r in rows.itertuples():
            if r.cycle_key != key:
                key, paid, spent = r.cycle_key, Decimal(0), Decimal(0)
            aggregate = (r.calc_method or "").upper() == "AGGREGATE"
            if aggregate:
                spent += r.amount
                worth = max(Decimal(0), _round(spent * r.rate / 100, r.round_strategy, r.reward_type) - paid)
            else:
                worth = _round(r.amount * r.rate / 100, r.round_strategy, r.reward_type)
            cap = r.cap_amount if r.cap_amount is not None and r.cap_amount > 0 else None
            full = cap is not None and (paid >= cap or paid + worth > cap)
            given = worth if not full else max(cap - paid, Decimal(0))
            if aggregate or cap is not None:
                paid += given
            out.append((given, full))
        names = [c for c in rows.columns if not c.startswith("_")]
        yield rows[names].assign(reward=[o[0] for o in out], is_capped=[o[1] for o in out])


def _open_to(txns: DataFrame, first: Column | date | None, last: Column | date | None, source: Column, name: Column) -> Column:
    """Whether a program is open on the transaction's day and not locked out by a selection of others."""
    cond = _in_days(F.col("transaction_date"), first, last)
    if "locked" not in txns.columns:
        return cond
    let = (source != "base") | F.coalesce(F.size("locked"), F.lit(0)).isin(0, -1) | F.exists("locked", lambda x: F.lower(x) == F.lower(name))
    return cond & F.coalesce(let, F.lit(True))


#: Programs, pools, rules and the values that they list, up to so many of all are written out as conditions.
WRITTEN_OUT = 200


def _known_programs(programs: DataFrame, links: DataFrame, pools: DataFrame, n: int) -> list[Row] | None:
    """The ``n`` programs with their pools in the order of the waterfall, none if these are too many to be written out.

    What a program has is counted before it is taken, so no long list comes to the driver.
    """
    if n > WRITTEN_OUT:
        return None
    listed = lambda r: reduce(lambda a, b: a + b, (F.coalesce(F.greatest(F.size(r[f]), F.lit(0)), F.lit(0)) for f in (*FIELDS, *HOLDER, "normalized_merchant", "merchant_display")))
    rules = lambda p: F.concat(*(F.coalesce(p[x], F.array()) for x in ("pass_rules", "rules")))
    held = F.coalesce(F.aggregate(F.flatten(F.transform("_pools", rules)), F.size("_pools"), lambda a, r: a + 1 + listed(r)), F.lit(0))
    names = ("program_no", "source", "reward_program", "reward_rate", "program_start", "program_end", "load_ord")
    card = F.when(C.blank(F.col("card_id")), "all").otherwise(F.lower("card_id"))
    rows = programs.withColumn("_reward", _low("reward_id")).join(_pools_of(links, pools), "_reward", "left").withColumn("held", held)
    rows = rows.select(*names, F.lower("bank_no").alias("bank"), card.alias("card"), F.coalesce("reward_cal_break", F.lit(False)).alias("ends"), F.col("_pools").alias("pools"), F.coalesce("priority", F.lit(999)).alias("priority"), "held")
    rows = rows.where(F.col("held") <= WRITTEN_OUT).collect()
    lost = len(rows) < n or any(r is None for p in rows for pool in p.pools or () for r in (*(pool.pass_rules or ()), *(pool.rules or ())))
    if lost or n + sum(p.held for p in rows) > WRITTEN_OUT:
        return None
    return sorted(rows, key=lambda p: (p.priority, p.load_ord is not None, p.load_ord or 0, p.program_no))


def _known_hit(program: Row, txn: dict[str, Column]) -> Column:
    """What :func:`_told` tells of a known program, null if none of its pools fits: conditions that give constants."""

    def told(rate: Decimal | None, pool: Row | None = None, rule: Row | None = None) -> Column:
        joined = lambda x: None if x is None else ";".join(w for w in x if w is not None)
        said = (None,) * 4 if pool is None else (pool.pool_id, pool.pool_name, joined(_first_list(rule.merchant_display, rule.normalized_merchant)), joined(rule.payment_process))
        texts = (F.lit(x).cast("string").alias(n) for n, x in zip(("pool_id", "pool_name", "rule_merchant", "rule_payment"), said, strict=True))
        return F.struct(F.lit(program.program_no).cast("long").alias("program_no"), F.lit(rate if rate is not None else 0).cast("decimal(9,4)").alias("rate"), *texts)

    def look(pool: Row) -> Column:
        passed = reduce(lambda a, b: a | b, (rule_holds(r, txn) for r in pool.pass_rules or ()), F.lit(False))
        found = F.when(passed, F.lit(None))
        for rule in pool.rules or ():
            rate = rule.merchant_rate if rule.merchant_rate is not None else program.reward_rate
            found = found.when(rule_holds(rule, txn), told(rate, pool, rule))
        return found

    if program.pools is None:
        return told(program.reward_rate)
    return F.coalesce(*(look(pool) for pool in program.pools)) if program.pools else F.lit(None)


def _programs_written_out(txns: DataFrame, programs: list[Row]) -> DataFrame:
    """As :func:`_programs_by_holder`, for few programs: their rules are conditions of the plan, and compiled with it.

    The constants that a program says of a transaction stand in one column for each program; the first that ends the
    calculation sets the last place that counts.
    """
    txn = {c: F.col(c) for c in (*FIELDS, *HOLDER, "normalized_merchant", "merchant_display", "transaction_date")}
    of = lambda value, name: F.lit(True) if value == "all" else F.coalesce(F.lower(name) == F.lit(value).cast("string"), F.lit(False))
    given = {}
    for k, p in enumerate(programs):
        open_to = _open_to(txns, p.program_start, p.program_end, F.lit(p.source).cast("string"), F.lit(p.reward_program).cast("string"))
        given[f"_given{k}"] = F.when(of(p.bank, "bank_no") & of(p.card, "card_id") & open_to, _known_hit(p, txn))
    kinds = {"program_no": "bigint", "rate": "decimal(9,4)", "pool_id": "string", "pool_name": "string", "rule_merchant": "string", "rule_payment": "string"}
    struct = f"struct<{','.join(f'{n}:{t}' for n, t in kinds.items())}>"
    rows = txns.withColumns({n: c.cast(struct) for n, c in given.items()})
    end = F.coalesce(*(F.when(F.col(f"_given{k}").isNotNull(), k) for k, p in enumerate(programs) if p.ends), F.lit(len(programs)))
    rows = rows.withColumn("_end", end)
    none = F.struct(*(F.lit(None).cast(t).alias(n) for n, t in kinds.items()))
    steps = [F.when(F.col("_end") >= k, F.col(f"_given{k}")) for k in range(len(programs))]
    missing = F.when(reduce(lambda a, b: a & b, (F.col(n).isNull() for n in given), F.lit(True)), none)
    rows = rows.select(*txns.columns, F.explode(F.array(*steps, missing)).alias("_applied")).where("_applied is not null")
    return rows.select(*txns.columns, "_applied.*")


def _programs_by_holder(txns: DataFrame, programs: DataFrame, links: DataFrame, pools: DataFrame) -> DataFrame:
    """Transactions with their applied programs (``program_no`` and what the pool says), one row with nulls if there are none.

    The programs of a bank and card are one array, and a transaction's candidates, rates and waterfall are worked out on
    its own array: no row is shuffled or sorted.  For program tables that are small enough to be sent to every task.
    """
    listed = programs.withColumn("_reward", _low("reward_id")).join(_pools_of(links, pools), "_reward", "left")
    item = F.struct(F.coalesce("priority", F.lit(999)).alias("priority"), "load_ord", "program_no", "source", "reward_program", "reward_rate", "reward_cal_break", F.col("program_start").alias("first"), F.col("program_end").alias("last"), "_pools")
    card = F.when(C.blank(F.col("card_id")), "all").otherwise(F.lower("card_id"))
    lists = F.broadcast(cut(listed.groupBy(F.lower("bank_no").alias("_bank"), card.alias("_card")).agg(F.collect_list(item).alias("_programs"))))
    every, bank, own = F.lit("all"), F.lower("bank_no"), F.lower("card_id")
    one_bank, one_card = ~bank.eqNullSafe(every), ~own.eqNullSafe(every)
    rows = txns
    for k, (b, c, asks) in enumerate(((bank, own, F.lit(True)), (bank, every, one_card), (every, own, one_bank), (every, every, one_bank & one_card))):
        side = lists.select(F.col("_bank").alias("_b"), F.col("_card").alias("_c"), F.col("_programs").alias(f"_list{k}"))
        rows = rows.join(side, (F.when(asks, b) == F.col("_b")) & (c == F.col("_c")), "left").drop("_b", "_c")
    def is_open(p: Column) -> Column:
        return _open_to(txns, p["first"], p["last"], p["source"], p["reward_program"])

    def rated(p: Column) -> Column:
        names = ("priority", "load_ord", "program_no", "reward_rate", "reward_cal_break")
        return F.struct(*(p[n].alias(n) for n in names), p["_pools"].isNull().alias("free"), _hit(p["_pools"]).alias("hit"))

    def upto_end(x: Column) -> Column:
        end = F.array_position(F.transform(x, lambda p: F.coalesce(p["reward_cal_break"], F.lit(False))), F.lit(True))
        return F.slice(x, F.lit(1), F.when(end > 0, end).otherwise(F.size(x)).cast("int"))

    asked = F.flatten(F.filter(F.array(*(F.col(f"_list{k}") for k in range(4))), lambda x: x.isNotNull()))
    fits = F.sort_array(F.filter(F.transform(F.filter(asked, is_open), rated), lambda x: x["free"] | x["hit"].isNotNull()))
    applied = F.get(F.transform(F.array(fits), upto_end), F.lit(0))  # a lambda's argument is worked out once
    rows = rows.select(*txns.columns, F.explode_outer(applied).alias("_applied"))
    told = _told(F.col("_applied.hit"), F.col("_applied.reward_rate"))
    return rows.select(*txns.columns, "_applied.program_no", *(c.alias(n) for n, c in told.items()))


#: What the caps take from a transaction, if it has it.
COUNTED = ("transaction_id", "transaction_date", "posting_date", "bank_no", "card_id", "card_type", "statement_month", "amount")


def _numbered(programs: DataFrame) -> DataFrame:
    """The programs with a number each, and with one of those that share its key over campaigns (``_campaign``)."""
    out = with_mixed(programs).withColumns({"program_start": F.col("start_date"), "program_end": F.col("end_date"), "program_no": F.monotonically_increasing_id()})
    same = Window.partitionBy(F.lower(F.coalesce("reward_program", F.lit(""))), "program_start", "program_end")
    return cut(out.withColumn("_campaign", F.min("program_no").over(same)))


def _applied(txns: DataFrame, numbered: DataFrame, links: DataFrame, pools: DataFrame, n: int) -> DataFrame:
    """Transactions with the number of each applied program and what its pool says, one row with nulls if there are none."""
    known = _known_programs(numbered, links, pools, n)
    if known is not None:
        return _programs_written_out(txns, known)
    if n <= C.SMALL_ROWS:
        return _programs_by_holder(txns, numbered, links, pools)
    rows = waterfall(with_rates(candidates(txns, numbered), links, pools)).select(*txns.columns, "program_no", "rate", "pool_id", "pool_name", "rule_merchant", "rule_payment")
    return rows.unionByName(txns.join(rows.select("transaction_id"), "transaction_id", "left_anti"), allowMissingColumns=True)


def applied_programs(txns: DataFrame, programs: DataFrame, links: DataFrame, pools: DataFrame) -> DataFrame:
    """Every applied program of every transaction as the waterfall leaves them; no rewards, so nothing is counted by cycle."""
    numbered = _numbered(programs)
    n = numbered.count()
    rows = _applied(txns, numbered, links, pools, n).where("program_no is not null")
    own = numbered.drop("bank_no", "card_id", "start_date", "end_date", "_mixed", "_alone", "_campaign")
    return rows.join(F.broadcast(own) if n <= C.SMALL_ROWS else own, "program_no").drop("program_no")


def everything(txns: DataFrame, programs: DataFrame, links: DataFrame, pools: DataFrame, keep: Iterable[str] | None = None, only: Column | None = None) -> DataFrame:
    """Every transaction with each of its applied programs and their rewards; those without any once, ``is_capped`` null.

    ``keep`` names the columns of transactions and pools that the caller takes; others than these and those that caps are
    counted by don't go through the caps.  With ``only``, a condition on programs, these alone are asked for: all programs
    take part in the waterfall, caps are counted for the ones that can share a key with one asked for.
    """
    numbered = _numbered(programs)
    adds_up = (F.col("cap_amount") > 0) | (F.upper("calc_method") == "AGGREGATE")
    kinds = numbered.agg(F.count("*").alias("n"), F.max("_mixed").alias("mixed"), F.max((F.upper(F.trim("reward_cycle")) == "CAMPAIGN_CYCLE") & adds_up).alias("wide")).first()
    rows = _applied(txns, numbered, links, pools, kinds.n)
    if keep is not None:
        rows = rows.select(*(c for c in rows.columns if c in {*COUNTED, *keep, "program_no", "rate"}))
    own = numbered.drop("bank_no", "card_id", "start_date", "end_date")
    if only is not None:
        asked = own.where(only)
        same = [F.lower(F.coalesce("reward_program", F.lit(""))), F.coalesce(F.upper(F.trim("reward_cycle")), F.lit(""))]
        keys = asked.select(*(c.alias(n) for n, c in zip(("_name", "_cycle"), same, strict=True))).distinct()
        own = own.join(keys, (same[0] == F.col("_name")) & (same[1] == F.col("_cycle")), "left_semi")
        rows = rows.join(C.small(own.select("program_no")), "program_no", "left_semi")
    rows = cut(rows)  # read once for each way of counting caps
    wide = bool(kinds.wide) if only is None else not own.where((F.upper(F.trim("reward_cycle")) == "CAMPAIGN_CYCLE") & adds_up).isEmpty()
    out = capped(rows.where("program_no is not null"), bool(kinds.mixed), wide, F.broadcast(own) if kinds.n <= C.SMALL_ROWS else own)
    if only is not None:
        return out.where(only).drop("program_no")
    none = rows.where("program_no is null").withColumn("rate", F.lit(None).cast("decimal(9,4)"))
    return out.unionByName(none, allowMissingColumns=True).drop("program_no")


def applied_of(rows: DataFrame) -> DataFrame:
    """Of :func:`everything` the rows with a program."""
    return rows.where("is_capped is not null")


def calculate(txns: DataFrame, programs: DataFrame, links: DataFrame, pools: DataFrame) -> DataFrame:
    """Every applied program of every transaction with its reward."""
    return applied_of(everything(txns, programs, links, pools))


#: What stands in the report where no program or no pool applies (fixed values).
NO_PROGRAM, NO_POOL_ID, NO_POOL = "未匹配方案", "N/A", "無回饋池"
BASE_ID, BASE_POOL = "BASE_PROGRAM", "全通路基礎方案"


def audit(txns: DataFrame, applied: DataFrame) -> DataFrame:
    """All transactions with their applied programs; those without any get placeholders, programs without a pool its stand-in."""
    names = applied.select("transaction_id", "reward_program", "pool_id", "reward", "is_capped")
    return audit_of(txns.select("transaction_id").join(names, "transaction_id", "left"))


def audit_of(rows: DataFrame) -> DataFrame:
    """The same from :func:`everything`, without a join."""
    none = F.col("reward_program").isNull()
    pool = F.when(none, NO_POOL_ID).otherwise(F.coalesce("pool_id", F.lit(BASE_ID)))
    return rows.select("transaction_id", F.coalesce("reward_program", F.lit(NO_PROGRAM)).alias("reward_program"), pool.alias("pool_id"), F.coalesce("reward", F.lit(0).cast(MONEY)).alias("reward"), F.coalesce("is_capped", F.lit(False)).alias("is_capped"))


#: Columns of transactions that the report shows.
SHOWN = ("transaction_date", "posting_date", "bank_name", "card_type", "merchant_display", "normalized_merchant", "payment_process", "amount")


def report(txns: DataFrame, applied: DataFrame) -> DataFrame:
    """As :func:`report_of`, from transactions and their applied programs."""
    own = ["reward_program", "reward_type", "reward_cycle", "pool_id", "pool_name", "rule_merchant", "rule_payment", "rate", "reward", "is_capped", "cap_amount", "priority", "load_ord"]
    shown = [c for c in SHOWN if c in txns.columns]
    return report_of(txns.select("transaction_id", *shown).join(applied.select("transaction_id", *own), "transaction_id", "left"))


def report_of(rows: DataFrame) -> DataFrame:
    """The full audit: a row for each transaction and program, with the rule that gave the rate, the cap, and the trace.

    The trace lists the transaction's programs with their rewards in the order in which they were applied.  Totals and
    traces are those of a window, which a reader who takes neither does without.
    """
    step = F.struct("priority", "load_ord", F.concat_ws(" ", "reward_program", F.col("reward").cast("string"), F.when(F.col("is_capped"), "capped")).alias("said"))
    same = Window.partitionBy("transaction_id")
    trace = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("is_capped").isNotNull(), step)).over(same)), lambda x: x["said"]), " > ")
    shown = [c for c in SHOWN if c in rows.columns]
    out = rows.withColumns({"total": F.sum("reward").over(same).cast(MONEY), "stage_trace": trace})
    none = F.col("reward_program").isNull()
    or_blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return out.select(
        "transaction_id", *(F.col(c).alias({"payment_process": "mobile_payment", "amount": "payment_amount"}.get(c, c)) for c in shown),
        F.coalesce("reward_program", F.lit(NO_PROGRAM)).alias("reward_program"), or_blank("reward_type").alias("reward_type"), or_blank("reward_cycle").alias("reward_cycle"),
        F.when(none, NO_POOL_ID).otherwise(F.coalesce("pool_id", F.lit(BASE_ID))).alias("pool_id"), F.when(none, NO_POOL).when(F.col("pool_id").isNull(), BASE_POOL).otherwise(or_blank("pool_name")).alias("pool_name"),
        or_blank("rule_merchant").alias("matched_rule_merchant"), or_blank("rule_payment").alias("matched_rule_payment"), F.coalesce("rate", F.lit(0)).cast("decimal(9,4)").alias("effective_rate"),
        F.coalesce("reward", F.lit(0)).cast(MONEY).alias("calculated_reward"), F.coalesce("total", F.lit(0)).cast(MONEY).alias("total_txn_reward"), F.coalesce("is_capped", F.lit(False)).alias("is_capped"),
        F.col("cap_amount").cast(MONEY).alias("cap_amount"), or_blank("stage_trace").alias("stage_trace"), "priority", "load_ord",
    )


def day_selection(txns: DataFrame, selections: DataFrame, near_days: int = 1) -> DataFrame:
    """Programs selected for the transaction's day (``locked``) and whether a selection changes within ``near_days``."""
    side = selections.select("base_reward_program", F.col("start_date").alias("_s"), F.col("end_date").alias("_e"))
    days = txns.select("transaction_date").distinct()
    inside = intervals.join_days(days, side, [], "transaction_date", "_s", "_e").select("transaction_date", "base_reward_program", F.lit(False).alias("_near"))
    near = intervals.days_near(side, "_s", "_e", near_days).select(F.col("near_day").alias("transaction_date")).distinct()
    near = days.join(near, "transaction_date").select("transaction_date", F.lit(None).cast("string").alias("base_reward_program"), F.lit(True).alias("_near"))
    by_day = inside.unionByName(near).groupBy("transaction_date").agg(F.array_sort(F.collect_set("base_reward_program")).alias("locked"), F.max("_near").alias("near_change"))
    return txns.join(by_day, "transaction_date", "left")


def is_cross_border(kind: Column) -> Column:
    """Whether a transaction's type is one of those abroad."""
    return F.coalesce(kind.isin(C.FOREIGN, C.FOREIGN_TWD, C.FOREIGN_DUAL), F.lit(False))


def is_mobile(payment: Column) -> Column:
    """Whether a transaction was paid through a payment process."""
    return F.coalesce(payment != "", F.lit(False))


def active_selection(txns: DataFrame, selections: DataFrame) -> DataFrame:
    """Adds ``locked``, the programs selected for the transaction's day, and ``verify``, whether a person should look.

    ``selections`` hold a bank and card they are for (blank: any), their days, and ``strategy_ord``: of several strategies
    the first that says anything counts.  A change of selection near a transaction abroad (1 day) or by phone (2 days)
    makes it doubtful, as do several programs on its day.
    """
    names = ["bank_no", "card_id", "transaction_date"]
    flags = {"_abroad": is_cross_border(F.col("transaction_type")), "_phone": is_mobile(F.col("payment_process"))}
    rows = txns.withColumns(flags)
    keys = [*names, "_abroad", "_phone"]
    name = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit(""))
    side = selections.select(name("bank_no").alias("_bank"), name("card_id").alias("_card"), F.col("start_date").alias("_s"), F.col("end_date").alias("_e"), "base_reward_program", "strategy_ord")
    either = lambda c: F.explode(F.array_distinct(F.array(name(c), F.lit(""))))
    asked = rows.select(*keys).distinct().withColumn("_bank", either("bank_no")).withColumn("_card", either("card_id"))
    inside = intervals.join_days(asked, side, ["_bank", "_card"], "transaction_date", "_s", "_e")
    inside = inside.select(*keys, "strategy_ord", "base_reward_program", F.lit(False).alias("_near"))
    edges = intervals.days_near(side, "_s", "_e", PHONE_DAYS).groupBy("_bank", "_card", "strategy_ord", F.col("near_day").alias("transaction_date")).agg(F.min("apart").alias("apart"))
    doubt = (F.col("_abroad") & (F.col("apart") <= ABROAD_DAYS)) | (F.col("_phone") & (F.col("apart") <= PHONE_DAYS))
    near = asked.join(edges, ["_bank", "_card", "transaction_date"]).select(*keys, "strategy_ord", F.lit(None).cast("string").alias("base_reward_program"), doubt.alias("_near"))
    found = inside.unionByName(near).groupBy(*keys, "strategy_ord").agg(F.array_sort(F.collect_set("base_reward_program")).alias("locked"), F.max("_near").alias("_near"))
    found = found.withColumn("verify", F.col("_near") | (F.size("locked") > 1)).where((F.size("locked") > 0) | F.col("verify"))
    best = cut_small(found.groupBy(*keys).agg(F.min_by(F.struct("locked", "verify"), "strategy_ord").alias("_v")))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]
    out = rows.alias("a").join(best.alias("b"), same, "left")
    return out.select(*(F.col(f"a.{c}") for c in txns.columns), F.col("b._v.locked").alias("locked"), F.coalesce("b._v.verify", F.lit(False)).alias("verify"))


def totals(applied: DataFrame) -> DataFrame:
    """Reward of each transaction and the trace of its programs."""
    trace = F.array_sort(F.collect_list(F.struct("priority", "load_ord", "reward_program")))
    return applied.groupBy("transaction_id").agg(F.sum("reward").cast(MONEY).alias("reward"), F.array_join(F.transform(trace, lambda t: t["reward_program"]), " > ").alias("programs"))
