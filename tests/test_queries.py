"""Every registered query against the same SQL in another engine."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb
import pytest

from cardloom.plans import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)) and not isinstance(value, bool):
        return f"{float(value):.9g}"
    if isinstance(value, datetime.datetime):
        value = value.date()
    return f"{float(value):.9g}" if type(value) is int else str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    other = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(other.columns) == columns
    places = [other.columns.index(c) for c in columns]
    assert found == sorted(tuple(plain(r[k]) for k in places) for r in other.fetchall())


def test_audit_has_every_transaction(spark, sf_dir):
    rows = registry.reward_audit(spark, sf_dir).collect()
    ids = {r.transaction_id for r in registry.tx(spark, sf_dir).select("transaction_id").distinct().collect()}
    assert {r.transaction_id for r in rows} == ids and all(r.reward is not None for r in rows)


def test_monthly_summary_has_every_reward(spark, sf_dir):
    """All programs and amounts, summed row by row."""
    earned = [r for r in registry._rewards(spark, sf_dir)[1].select("reward_id", "reward", "amount").collect() if r.reward]
    rows = registry.QUERIES["reward_monthly_summary_all"](spark, sf_dir).collect()
    assert {"p3", "p4", "p5"} <= {r.reward_id for r in earned} and any(r.amount > 50000 for r in earned)
    assert sum(float(r.reward) for r in rows) == pytest.approx(float(sum(r.reward for r in earned)))
    assert all(r.rate_percent == (pytest.approx(float(r.reward) * 100 / float(r.spending)) if r.spending > 0 else 0) for r in rows)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[0] == "normalized_merchant"
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
