"""Streams in several batches against the batch operators."""

from __future__ import annotations

import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from cardloom.streaming import caps, ingest


def test_caps_run_on_over_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "transaction_id string, transaction_date date, cycle_key string, worth decimal(18,2), cap_amount decimal(18,2)"
    day = lambda k: datetime.date(2025, 1, k)
    batches = [
        [("t2", day(2), "a", Decimal(80), Decimal(100)), ("t1", day(1), "a", Decimal(60), Decimal(100)), ("t3", day(1), "b", Decimal(70), None)],
        [("t4", day(3), "a", Decimal(10), Decimal(100)), ("t5", day(3), "b", Decimal(90), Decimal(0)), ("t6", day(4), "c", Decimal("0.50"), Decimal(1))],
        [("t7", day(5), "c", Decimal("0.75"), Decimal(1))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = caps.running_caps(spark.readStream.schema(schema).parquet(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    found = {r.transaction_id: (float(r.reward), r.is_capped) for r in spark.read.parquet(out).collect()}
    assert found == {"t1": (60, False), "t2": (40, True), "t3": (70, False), "t4": (0, True), "t5": (90, False), "t6": (0.5, False), "t7": (0.5, True)}


def test_windows_and_distinct_rows_of_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("e1", "2025-01-01 00:00:10", "k", 1.0), ("e1", "2025-01-01 00:00:10", "k", 1.0), ("e2", "2025-01-01 00:30:00", "k", 2.0)]
    df = spark.createDataFrame(rows, "transaction_id string, t string, card_type string, v double")
    df = df.select("transaction_id", F.to_timestamp("t").alias("ts"), "card_type", F.col("v").alias("payment_amount"))
    df.write.parquet(source)
    stream = ingest.distinct_rows(spark.readStream.schema(df.schema).parquet(source), "ts", ["transaction_id"])
    stream.writeStream.format("memory").queryName("distinct_events").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("distinct_events").count() == 2
    late = [("e3", "2025-02-01 00:00:10", "k", 4.0)]
    spark.createDataFrame(late, "transaction_id string, t string, card_type string, v double").select("transaction_id", F.to_timestamp("t").alias("ts"), "card_type", F.col("v").alias("payment_amount")).write.mode("append").parquet(source)
    spent = ingest.windowed_spend(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source), "ts", "card_type", "payment_amount")
    spent.writeStream.outputMode("complete").format("memory").queryName("spent").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.total_amount, r.n) for r in spark.table("spent").collect()) == [(4.0, 1), (4.0, 3)]
