"""Bank statement files: CSV with preamble and footer, HTML tables saved as .xls, in several encodings.

Files are read whole as bytes (one statement is small) and cut with Column expressions; only decoding of the double-byte
encodings needs Python, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.functions import columns as C
from cardloom.sources import bank_rules

# Encoding, header word and stop word of each bank's files, and the standard names of their columns.
LAYOUTS: dict[str, dict] = {
    "國泰世華": {
        "encoding": "utf-8-sig", "header": "消費日", "stop": "正卡消費",
        "columns": {"消費日": "transaction_date", "入帳起息日": "posting_date", "交易說明": "merchant", "消費國家/幣別": "place_currency",
                    "消費金額": "currency_amount", "新臺幣金額": "payment_amount", "卡號/行動末四碼": "card_no", "折算日": "conversion_date"},
    },
    "中國信託": {
        "encoding": "cp950", "header": "消費日", "stop": None,
        "columns": {"消費日": "transaction_date", "入帳起息日": "posting_date", "摘要": "merchant", "幣別": "currency_type", "消費地金額": "currency_amount",
                    "新臺幣金額": "payment_amount", "末四碼": "card_no", "外幣折算日": "conversion_date", "消費地": "merchant_location"},
    },
    "玉山銀行": {
        "encoding": "utf-8", "header": "消費日", "stop": None,
        "columns": {"消費日": "transaction_date", "入帳日": "posting_date", "消費明細": "merchant", "交易類別": "kind", "幣別": "currency_type",
                    "金額": "currency_amount", "繳款幣別": "payment_currency", "金額.1": "payment_amount", "行動支付": "wallet", "卡號末四碼": "card_no"},
    },
    "華南銀行": {
        "encoding": "big5", "header": "消費日", "stop": "立即繳費",
        "columns": {"消費日": "transaction_date", "入帳日": "posting_date", "消費明細": "merchant", "國別": "merchant_location", "幣別": "currency_type",
                    "外幣金額": "currency_amount", "新臺幣金額": "payment_amount"},
    },
}
STANDARD = ("transaction_date", "posting_date", "merchant", "merchant_location", "currency_type", "currency_amount", "payment_currency", "payment_amount", "card_no", "conversion_date", "place_currency", "wallet", "kind")
# What refuses a file, and what a spreadsheet would run, as patterns without regard to case.
LETHAL = (
    r"__import__\s*\(",
    r"\beval\s*\(",
    r"\bexec\s*\(",
    r"<script[\s>]",
    r"javascript\s*:",
    r";\s*(?:DROP|ALTER|TRUNCATE)\s+(?:TABLE|DATABASE)\b|;\s*DELETE\s+FROM\b",
    r";\s*UPDATE\s+.*?\bSET\b",
    r"\bUNION\s+(?:ALL\s+)?SELECT\b",
    r"\bxp_cmdshell\b",
    r"\bWAITFOR\s+DELAY\b",
)
FORMULAS = (
    r"^[=@+\-]\s*(?:cmd(?:\.exe)?|powershell|calc(?:\.exe)?|certutil|mshta|cscript|wscript|bash|sh|curl|wget)\b",
    r"^[=@+\-]\s*['\"]?[a-zA-Z0-9_\\]+['\"]?\s*\|",
    r"^[=@+\-]\s*(?:SUM|AVERAGE|COUNT|IF|VLOOKUP|HYPERLINK|EXEC|DDE)\s*\(.*?(?:cmd|calc|powershell|http|\|)",
)
LONGEST = 255


def decoded(content: Column, encoding: Column) -> Column:
    """Text of a file's bytes; what does not decode is replaced."""

    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for data, names in parts:
            yield pd.Series([bytes(b).decode(n or "utf-8", "replace") for b, n in zip(data, names, strict=True)], index=data.index)

    return run(content, encoding)


def statuses(listed: DataFrame, refused: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """``file``, ``file_hash``, ``status`` of every file: FAILED if it is refused, SKIPPED without a bank or if done before, else SUCCESS."""
    out = listed.select("file", "file_hash", "bank").join(refused.select("file_hash", F.lit(True).alias("_bad")), "file_hash", "left")
    known = F.lit(False)
    if done is not None:
        out = out.join(done.where("status = 'SUCCESS'").select("file_hash", F.lit(True).alias("_done")).distinct(), "file_hash", "left")
        known = F.coalesce("_done", F.lit(False))
    status = F.when(F.coalesce("_bad", F.lit(False)), "FAILED").when(known | F.col("bank").isNull(), "SKIPPED").otherwise("SUCCESS")
    return out.select("file", "file_hash", status.alias("status"))


def files(spark: SparkSession, folder: str, registry: DataFrame | None = None) -> DataFrame:
    """One row per statement: name, SHA-256, bank, status and text; files the registry holds as SUCCESS are left out."""
    rows = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("file_hash"), "content")
    rows = rows.where(~F.startswith("file", F.lit("."))).withColumn("file", F.url_decode("file"))
    if registry is not None:
        rows = rows.join(registry.where("status = 'SUCCESS'").select("file_hash"), "file_hash", "left_anti")
    bank, encoding = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, layout in reversed(LAYOUTS.items()):
        bank = F.when(F.lower("file").contains(name.lower()), name).otherwise(bank)
        encoding = F.when(F.lower("file").contains(name.lower()), layout["encoding"]).otherwise(encoding)
    rows = rows.withColumn("bank", bank).withColumn("encoding", encoding)
    return rows.withColumn("text", F.when(F.col("bank").isNotNull(), F.regexp_replace(decoded(F.col("content"), F.col("encoding")), "^﻿", ""))).drop("content", "encoding")


def bill_period(file: Column) -> tuple[Column, Column]:
    """Year and month in a file name: ROC 年/月, then yyyymm, then ROC yyymm."""
    number = lambda p, k: F.regexp_extract(file, p, k).try_cast("int")
    roc, west, short = r"(\d{2,3})年(\d{1,2})月", r"(20\d{2})(\d{2})", r"(\d{3})(\d{2})"
    year = F.coalesce(number(roc, 1) + 1911, number(west, 1), number(short, 1) + 1911)
    month = F.coalesce(number(roc, 2), number(west, 2), number(short, 2))
    return year, month


def table_rows(rows: DataFrame) -> DataFrame:
    """Rows of each statement's table as a map from column name to text, with their line number."""
    header, stop = F.lit("消費日"), F.lit(None).cast("string")
    for name, layout in LAYOUTS.items():
        stop = F.when(F.col("bank") == name, F.lit(layout["stop"])).otherwise(stop)
    is_html = F.col("text").rlike("(?i)<t[rd][ >]")
    csv_lines = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")
    html_rows = F.regexp_extract_all("text", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    lines = F.when(is_html, html_rows).otherwise(csv_lines)
    out = rows.where("bank is not null").withColumn("is_html", is_html).withColumn("_stop", stop).select("file", "file_hash", "bank", "is_html", "_stop", F.posexplode(lines).alias("line_no", "line"))
    html_cells = F.transform(F.regexp_extract_all("line", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>|&nbsp;", " "), r"\s+", " ")))
    fields = F.regexp_extract_all(F.concat(F.lit(","), "line"), F.lit(r',(\s*"(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    unquoted = lambda c: F.when(F.startswith(c, F.lit('"')), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c)
    csv_cells = F.transform(fields, lambda c: F.trim(unquoted(F.trim(c))))
    out = out.withColumn("cells", F.when(F.col("is_html"), html_cells).otherwise(csv_cells)).withColumn("_plain", F.array_join("cells", ","))
    upto = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_head = F.contains("_plain", header)
    seen = F.sum(is_head.cast("int")).over(upto)
    ended = F.max(F.coalesce(F.contains("_plain", F.col("_stop")), F.lit(False)).cast("int")).over(upto)
    names = F.first(F.when(is_head, F.col("cells")), ignorenulls=True).over(upto)
    out = out.withColumns({"_seen": seen, "_ended": ended, "_names": names, "_head": is_head})
    clean = F.transform("_names", lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", ""))
    pairs = F.filter(F.arrays_zip(clean.alias("name"), F.col("cells").alias("value")), lambda p: (p["name"] != "") & p["name"].isNotNull())
    return out.where("_seen > 0 and _ended = 0 and not _head").select("file", "file_hash", "bank", "line_no", pairs.alias("pairs"))


def standard_rows(spark: SparkSession, folder: str, registry: DataFrame | None = None) -> DataFrame:
    """Statements as standard rows: dates completed from the bill's period, amounts as decimals, countries and currencies coded."""
    rows = table_rows(files(spark, folder, registry))
    names = {(b, raw): std for b, layout in LAYOUTS.items() for raw, std in layout["columns"].items()}

    def value(raw: str) -> Column:
        found = F.filter("pairs", lambda p: p["name"].startswith(raw) if raw == "消費明細" else p["name"] == raw)
        return F.get(found, F.lit(0))["value"]

    def cell(std: str) -> Column:
        out = F.lit(None).cast("string")
        for (bank, raw), target in names.items():
            if target == std:
                out = F.when(F.col("bank") == bank, value(raw)).otherwise(out)
        return C.text_or_null(out)

    year, month = bill_period(F.col("file"))
    flat = rows.select("file", "file_hash", "bank", "line_no", year.alias("_y"), month.alias("_m"), *(cell(s).alias(s) for s in STANDARD))
    none = F.lit(None).cast("string")
    flat = flat.withColumns({"vpc_no": none, "vpc_type": F.col("wallet"), "card_type": none, "payment_process": none, "transaction_type": F.lit("")})
    flat = bank_rules.by_bank(flat)
    place = F.split("place_currency", "/")
    day = lambda c: C.smart_date(F.col(c), F.col("_y"), F.col("_m"))
    out = flat.select(
        "file", "file_hash", "bank", "line_no", F.make_date("_y", "_m", F.lit(1)).alias("statement_month"),
        day("transaction_date").alias("transaction_date"), day("posting_date").alias("posting_date"), day("conversion_date").alias("conversion_date"),
        "merchant", C.location(F.coalesce("merchant_location", F.get(place, F.lit(0)))).alias("merchant_location"),
        C.currency(F.coalesce("currency_type", F.get(place, F.lit(1)))).alias("currency_type"), C.clean_amount(F.col("currency_amount")).alias("currency_amount"),
        C.currency(F.col("payment_currency")).alias("payment_currency"), C.clean_amount(F.col("payment_amount")).alias("payment_amount"),
        "card_no", "vpc_no", "vpc_type", "card_type", "payment_process", "transaction_type", "wallet",
    )
    return out.where("transaction_date is not null")


def safe_text(c: Column) -> Column:
    """Text without control characters, cut after ``LONGEST`` characters, with a quote before what a spreadsheet would run.

    Numbers with a sign stay; of texts with other signs only those that name a command, a pipe or a function call.
    """
    plain = F.substring(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), 1, LONGEST)
    bare = F.trim(plain)
    runs = bare.startswith("=") | bare.rlike("(?i)" + "|".join(FORMULAS))
    return F.when(runs & ~bare.rlike(r"^[+\-]?\d+(?:\.\d+)?$"), F.concat(F.lit("'"), plain)).otherwise(plain)


def sanitised(rows: DataFrame, *texts: str) -> tuple[DataFrame, DataFrame]:
    """Clean rows and the files that are refused: one lethal text in any of the columns (all strings) refuses its whole file."""
    texts = texts or tuple(n for n, kind in rows.dtypes if kind == "string" and n not in ("file", "file_hash"))
    plain = [F.substring(F.regexp_replace(F.col(t), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), 1, LONGEST) for t in texts]
    lethal = F.coalesce(*(F.when(t.rlike("(?i)" + "|".join(LETHAL)), F.lit(True)) for t in plain), F.lit(False))
    bad = rows.where(lethal).select("file_hash", "file").distinct()
    clean = rows.join(bad.select("file_hash"), "file_hash", "left_anti").withColumns({t: safe_text(F.col(t)) for t in texts})
    return clean.select(*rows.columns), bad


def card_table(cards: DataFrame) -> DataFrame:
    """Nested user cards (``card_history`` of ``vpc_pay``) as flat rows; a card without virtual cards stands for itself."""
    history = cards.select("card_id", "bank_no", "card_type", F.posexplode_outer("card_history").alias("_h", "h"))
    flat = history.select("card_id", "bank_no", "card_type", "_h", F.col("h.card_no").alias("card_no"), F.col("h.card_network").alias("card_network"), F.posexplode_outer("h.vpc_pay").alias("_v", "v"))
    return flat.select(
        "card_id", "bank_no", "card_type", F.coalesce("card_no", F.lit("")).alias("card_no"), "card_network",
        F.coalesce(F.col("v.vpc_no"), F.col("card_no"), F.lit("")).alias("vpc_no"), F.coalesce(F.col("v.vpc_type"), F.lit("CARD")).alias("vpc_type"),
        F.struct("card_id", F.coalesce("_h", F.lit(0)).alias("h"), F.coalesce("_v", F.lit(0)).alias("v")).alias("load_ord"),
    )


def layered(public: DataFrame, own: DataFrame | None, how: str = "append") -> DataFrame:
    """Public configuration with a profile's: appended, or replaced where the profile has rows."""
    if own is None:
        return public
    if how == "replace":
        return own if not own.isEmpty() else public
    return public.unionByName(own, allowMissingColumns=True)


def split_fields(row: Mapping[str, str]) -> dict[str, list[str]]:
    """Comma lists of a pool's row as arrays."""
    return {k: [x.strip() for x in v.split(",") if x.strip()] for k, v in row.items()}
