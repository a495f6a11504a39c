"""The analytic transaction table from a star of order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions import columns as C

# The same mapping as SQL, for checks against another engine.
SQL = """tx AS (SELECT concat(l_orderkey,'-',l_linenumber) AS transaction_id, CAST(o_orderdate AS DATE) AS transaction_date,
 CAST(l_shipdate AS DATE) AS posting_date,
 CASE WHEN l_returnflag='R' THEN -1 ELSE 1 END * CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(18,2)) AS payment_amount,
 s_name AS normalized_merchant, p_type AS category, p_brand AS sub_category, cn.n_name AS bank_name,
 CAST(c_nationkey AS VARCHAR) AS bank_no, c_mktsegment AS card_type,
 CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END AS payment_process, r_name AS merchant_location,
 CASE l_returnflag WHEN 'N' THEN '交易' WHEN 'A' THEN '一般國外交易' ELSE '退刷' END AS transaction_type
 FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN nation cn ON c_nationkey=cn.n_nationkey
 JOIN part ON l_partkey=p_partkey JOIN supplier ON l_suppkey=s_suppkey JOIN nation sn ON s_nationkey=sn.n_nationkey
 JOIN region ON sn.n_regionkey=r_regionkey)"""


#: Up to so many shops are sent to every task; they are narrow rows.
SHOPS = 500_000
#: The key of a line item, for callers that want rows of one transaction where the joins have left them.
KEYS = ("l_orderkey", "l_linenumber")


def transactions(spark: SparkSession, sf_dir: str, keys: bool = False) -> DataFrame:
    """One row per line item, with ``keys`` under its own key, too; Catalyst prunes the columns that a query does not use.

    Line items are the one table that is many times the others.  They are shuffled twice whatever the size of the tables,
    by part and by order, as narrow rows: orders meet their holders before, shops are sent to every task at the end.  The
    rows come out dealt by order.
    """

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    nation = table("nation")
    shop = table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    shop = shop.select("s_suppkey", F.col("s_name").alias("normalized_merchant"), F.col("r_name").alias("merchant_location"))
    shop = F.broadcast(shop) if table("supplier").count() <= SHOPS else shop
    holder = table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    holder = holder.select("c_custkey", F.col("n_name").alias("bank_name"), F.col("c_nationkey").cast("string").alias("bank_no"), F.col("c_mktsegment").alias("card_type"))
    payment = F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("payment_process")
    order = table("orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("transaction_date"), payment)
    order = order.join(holder, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")
    part = table("part").select("p_partkey", F.col("p_type").alias("category"), F.col("p_brand").alias("sub_category"))
    amount = F.round(F.col("l_extendedprice").cast("decimal(18,2)") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)")), 2).cast("decimal(18,2)")
    kind = F.col("l_returnflag")
    line = table("lineitem").select(*KEYS, "l_partkey", "l_suppkey", "l_returnflag", F.col("l_shipdate").cast("date").alias("posting_date"), F.when(kind == "R", -amount).otherwise(amount).cast("decimal(18,2)").alias("payment_amount"))
    rows = line.join(part.hint("merge"), F.col("l_partkey") == F.col("p_partkey")).join(order.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.join(shop, F.col("l_suppkey") == F.col("s_suppkey")).select(
        *(KEYS if keys else ()),
        F.concat_ws("-", *KEYS).alias("transaction_id"),
        "transaction_date",
        "posting_date",
        "payment_amount",
        "normalized_merchant",
        "category",
        "sub_category",
        "bank_name",
        "bank_no",
        "card_type",
        "payment_process",
        "merchant_location",
        F.when(kind == "N", C.PURCHASE).when(kind == "A", C.FOREIGN).otherwise(C.REFUND).alias("transaction_type"),
    )
