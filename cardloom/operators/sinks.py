"""Where results go: tables, files, payloads.  An empty result never replaces a table that has rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from cardloom.operators import bronze, refine

BOM = "\ufeff"


def load(df: DataFrame, table: str, mode: str = "append", keys: Sequence[str] = ()) -> None:
    """Loads rows into a table: replaced as a whole, or appended; with ``keys`` only rows that the table does not hold."""
    spark = df.sparkSession
    rows = bronze.enforced(df)
    if mode == "append" and keys and spark.catalog.tableExists(table):
        rows = refine.only_new(rows.dropDuplicates(list(keys)), spark.table(table), keys)
    elif keys:
        rows = rows.dropDuplicates(list(keys))
    rows.write.mode({"replace": "overwrite", "append": "append"}[mode]).saveAsTable(table)


def overwrite_mart(results: Mapping[str, DataFrame], schema: str = "default") -> dict[str, bool]:
    """Overwrites a table for each result that has rows; says which were written.

    A result is computed once, into a table beside the old one, and takes its place if rows were counted on the way.
    """
    written = {}
    for name, df in results.items():
        seen = Observation()
        fresh = f"{schema}._new_{name}"
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").saveAsTable(fresh)
        written[name] = seen.get["rows"] > 0
        if written[name]:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {schema}.{name}")
            df.sparkSession.sql(f"ALTER TABLE {fresh} RENAME TO {schema}.{name}")
        else:
            df.sparkSession.sql(f"DROP TABLE {fresh}")
    return written


def read_mart(spark: SparkSession, name: str, schema: str = "default") -> DataFrame:
    """A mart table with zeros for numbers that are none or infinite, false for missing truth values, and empty missing texts."""
    df = spark.table(f"{schema}.{name}")
    clean = {n: F.when(F.col(n).isNull() | F.isnan(n) | (F.abs(n) == float("inf")), 0.0).otherwise(F.col(n)) for n, kind in df.dtypes if kind in ("double", "float")}
    flags = {n: F.coalesce(n, F.lit(False)) for n, kind in df.dtypes if kind == "boolean"}
    texts = {n: F.coalesce(n, F.lit("")) for n, kind in df.dtypes if kind == "string"}
    return df.withColumns(clean | flags | texts)


def export_csv(df: DataFrame, path: str, digits: int | None = 2, marked: bool = False) -> None:
    """CSV files with a header; fractions rounded to ``digits``, half to even, nested values as JSON.

    ``marked`` puts a byte order mark before the header, for programs that tell UTF-8 by it.
    """
    fractions = {} if digits is None else {n: F.bround(n, digits) for n, kind in df.dtypes if kind in ("double", "float") or kind.startswith("decimal")}
    nested = {n: F.to_json(n) for n, kind in df.dtypes if kind.startswith(("array", "struct", "map"))}
    out = df.withColumns(fractions | nested)
    if marked:
        out = out.withColumnRenamed(out.columns[0], BOM + out.columns[0])
    out.write.mode("overwrite").option("header", True).csv(path)


def finite(c: Column, kind: DataType) -> Column:
    """The value with null in place of every number that is none or infinite, at any depth of arrays, structs and maps."""
    if isinstance(kind, DoubleType | FloatType):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: finite(x, kind.elementType)) if _holds_fractions(kind) else c
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda _, v: finite(v, kind.valueType)) if _holds_fractions(kind.valueType) else c
    if isinstance(kind, StructType) and _holds_fractions(kind):
        return F.when(c.isNotNull(), F.struct(*(finite(c.getField(f.name), f.dataType).alias(f.name) for f in kind)))
    return c


def _holds_fractions(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _holds_fractions(kind.elementType)
    if isinstance(kind, MapType):
        return _holds_fractions(kind.valueType)
    if isinstance(kind, StructType):
        return any(_holds_fractions(f.dataType) for f in kind)
    return isinstance(kind, DoubleType | FloatType)


def payload(df: DataFrame) -> DataFrame:
    """One JSON text a row, null fields included; numbers that are none or infinite are null at any depth."""
    fields = [finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("payload"))


def anomalies(df: DataFrame) -> DataFrame:
    """Rows that refinement could not settle: no type, or no rate for their currency."""
    kind = F.coalesce(F.trim("transaction_type"), F.lit("")).isin("", "未分類", "Unknown", "<NA>", "<na>")
    missing = F.coalesce(F.col("fx_missing"), F.lit(False)) if "fx_missing" in df.columns else F.lit(False)
    reason = F.when(kind, "uncategorized").when(missing, "fx_missing")
    return df.withColumn("reason", reason).where("reason is not null")
