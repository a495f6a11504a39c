"""Column expressions shared by the operators: months, money, codes, ranks, labels.  All stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Transaction type labels.
PURCHASE, REPAYMENT, FEE, REFUND, POINTS = "交易", "繳款", "各項費用", "退刷", "紅利折抵"
FOREIGN, FOREIGN_TWD, FOREIGN_DUAL = "一般國外交易", "台幣跨境交易", "一般雙幣交易"
NOT_CONSUMPTION = (REPAYMENT, FEE, REFUND, POINTS)
# ISO country codes of locations, two and three letters, and currency names.
LOCATIONS = {
    "TWN": "TW", "JPN": "JP", "USA": "US", "KOR": "KR", "CHN": "CN", "HKG": "HK", "SGP": "SG", "THA": "TH", "GBR": "GB",
    "IRL": "IE", "DEU": "DE", "FRA": "FR", "AUS": "AU", "CAN": "CA", "MYS": "MY", "VNM": "VN", "台灣": "TW",
}
CURRENCIES = {"NTD": "TWD", "NT$": "TWD", "台幣": "TWD", "新臺幣": "TWD", "日圓": "JPY", "日幣": "JPY", "美金": "USD", "美元": "USD", "歐元": "EUR", "人民幣": "CNY", "RMB": "CNY"}
#: Rule and dimension tables up to so many rows are sent to every task.
SMALL_ROWS = 50_000
#: Ranges of values that ranks are summed up in.
RANGES = 200


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """The table marked for broadcast if it holds at most ``rows`` rows; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if len(df.limit(rows + 1).select(F.lit(1)).take(rows + 1)) <= rows else df


def blank(c: Column) -> Column:
    """Whether text is null, empty or only blanks."""
    return c.isNull() | (F.trim(c) == "")


def text_or_null(c: Column) -> Column:
    """Trimmed text; the tokens nan, None, NaT and blank become null."""
    t = F.trim(c.cast("string"))
    return F.when(~F.lower(t).isin("", "nan", "none", "nat", "null"), t)


def month_key(first: Column, *others: Column) -> Column:
    """``yyyy-MM`` of the first date that is not null, else UNKNOWN."""
    return F.coalesce(F.date_format(F.coalesce(first, *others), "yyyy-MM"), F.lit("UNKNOWN"))


def code(c: Column, size: int) -> Column:
    """Digits padded with zeros on the left to ``size``; of longer ones the last ``size``."""
    return F.substring(F.concat(F.lit("0" * size), F.regexp_replace(c.cast("string"), r"\.0$", "")), -size, size)


def clean_amount(c: Column) -> Column:
    """Amount from text: commas, currency signs, brackets and trailing or wide minus signs; what is no number is 0."""
    t = F.regexp_replace(F.regexp_replace(F.trim(c.cast("string")), "[－—–]", "-"), r"[,$\s]|NT", "")
    negative = t.rlike(r"^\(.*\)$") | t.rlike("-$") | t.startswith("-")
    value = F.regexp_replace(t, r"[()\-]", "").try_cast("decimal(18,2)")
    return F.coalesce(F.when(negative, -value).otherwise(value), F.lit(0).cast("decimal(18,2)"))


def mapped(c: Column, names: Mapping[str, str], default: str | None = None) -> Column:
    """Name looked up in capitals; unknown ones stay as they are, blank ones get the default."""
    key = F.upper(F.trim(c))
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    found = F.coalesce(F.try_element_at(table, key), key)
    return found if default is None else F.when(blank(c), F.lit(default)).otherwise(found)


def location(c: Column) -> Column:
    """Two-letter country code, TW if blank."""
    return mapped(c, LOCATIONS, "TW")


def currency(c: Column) -> Column:
    """Three-letter currency code, TWD if blank."""
    return mapped(c, CURRENCIES, "TWD")


def smart_date(c: Column, year: Column, month: Column) -> Column:
    """Date from ``Y/M/D`` (years below 1911 count from 1911) or ``M/D``, whose year follows from the bill's period.

    A month more than six after the bill's is of the year before; January on a December bill is of the year after.
    """
    t = F.regexp_replace(F.trim(c.cast("string")), "[.年月-]", "/")
    part = lambda pattern, k: F.regexp_extract(t, pattern, k).try_cast("int")
    full, short = r"^(\d{2,4})/(\d{1,2})/(\d{1,2})", r"^(\d{1,2})/(\d{1,2})"
    y = part(full, 1)
    own = F.when(y < 1911, y + 1911).otherwise(y)
    m = part(short, 1)
    near = F.when(m - month > 6, year - 1).when((month == 12) & (m == 1), year + 1).when(month.isNotNull(), year)
    made = lambda a, b, d: F.try_to_date(F.format_string("%04d-%02d-%02d", a, b, d), "yyyy-MM-dd")
    return F.when(t.rlike(full), made(own, part(full, 2), part(full, 3))).when(t.rlike(short), made(near, m, part(short, 2)))


def rank_shares(df: DataFrame, keys: Iterable[str], ranks: Mapping[str, tuple[Column, bool]]) -> DataFrame:
    """Adds each named rank as a share of the rows that have the value, ties at their average rank; null for null values.

    ``ranks`` gives the value and whether it ranks descending; ``keys`` identify a row.  Equal values are counted first
    (partial aggregates); the counts are summed up within ranges of values, and the ranges' sums, a few hundred rows a
    rank, are carried over.  No task sees more than the different values of one range.
    """
    keys = list(keys)
    values = F.array(*(F.struct(F.lit(n).alias("_rank"), v.cast("double").alias("_value")) for n, (v, _) in ranks.items()))
    long = df.select(*keys, F.explode(values).alias("_r")).select(*keys, "_r.*").where("_value is not null")
    counts = long.groupBy("_rank", "_value").agg(F.count("*").alias("_n"))
    splits = counts.groupBy("_rank").agg(F.percentile_approx("_value", [k / RANGES for k in range(1, RANGES)]).alias("_splits"))
    counts = counts.join(F.broadcast(splits), "_rank")
    counts = counts.withColumn("_range", F.size(F.filter("_splits", lambda x: x < F.col("_value")))).drop("_splits")
    sums = counts.groupBy("_rank", "_range").agg(F.sum("_n").alias("_in_range"))
    of_rank = Window.partitionBy("_rank")
    sums = sums.withColumns({"_all": F.sum("_in_range").over(of_rank), "_upto": F.sum("_in_range").over(of_rank.orderBy("_range"))})
    sums = sums.select("_rank", "_range", "_all", (F.col("_upto") - F.col("_in_range")).alias("_before"))
    upto = F.sum("_n").over(Window.partitionBy("_rank", "_range").orderBy("_value"))
    counts = counts.withColumn("_within", upto - F.col("_n")).join(F.broadcast(sums), ["_rank", "_range"])
    low = F.col("_before") + F.col("_within")
    place = F.when(F.col("_rank").isin([n for n, (_, down) in ranks.items() if down]), F.col("_all") - low - F.col("_n")).otherwise(low)
    share = (place + (F.col("_n") + 1) / 2) / F.col("_all")
    found = long.join(counts.select("_rank", "_value", share.alias("_share")), ["_rank", "_value"])
    found = found.groupBy(*keys).agg(*(F.max(F.when(F.col("_rank") == n, F.col("_share"))).alias(n) for n in ranks))
    return df.join(found, keys, "left")


def hashed_id(*parts: Column) -> Column:
    """First 32 hexadecimal digits of the SHA-256 of the trimmed parts in a row; null is empty."""
    return F.substring(F.sha2(F.concat(*(F.coalesce(F.trim(p.cast("string")), F.lit("")) for p in parts)), 256), 1, 32)


def rounded(value: Column, how: Column, digits: Column) -> Column:
    """Reward rounding by name: floor or down, ceil, ceiling or up, all others half away from zero; to 0 or 2 digits."""
    scaled = value * F.when(digits == 2, F.lit(100)).otherwise(F.lit(1)).cast("decimal(5,0)")
    name = F.lower(F.trim(how))
    whole = F.when(name.isin("floor", "down"), F.floor(scaled)).when(name.isin("ceil", "ceiling", "up"), F.ceil(scaled)).otherwise(F.round(scaled))
    return (whole.cast("decimal(20,0)") / F.when(digits == 2, F.lit(100)).otherwise(F.lit(1)).cast("decimal(5,0)")).cast("decimal(18,2)")


def first_match(text: Column, rules: list[dict], field: str, pattern: str) -> Column:
    """The field of the first rule whose regular expression is found in the text, case and width of letters aside."""
    cases = [F.when(text.rlike(f"(?iu){r[pattern]}"), F.lit(r.get(field))) for r in rules if r.get(field) is not None]
    return F.coalesce(*cases) if cases else F.lit(None).cast("string")


def first_rule(text: Column, rules: list[dict], pattern: str) -> Column:
    """Number of the first rule that matches, null if none does; rules without values match too."""
    cases = [F.when(text.rlike(f"(?iu){r[pattern]}"), F.lit(k)) for k, r in enumerate(rules)]
    return F.coalesce(*cases) if cases else F.lit(None).cast("int")


def ordered(rules: Iterable[Mapping]) -> list[dict]:
    """Rules by ascending priority (missing ones count 999), equal ones as given."""
    return sorted((dict(r) for r in rules), key=lambda r: 999 if r.get("priority") is None else int(r["priority"]))
