"""Running caps on a stream of rewards: what a cycle key has paid so far is kept as state from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PAID = "transaction_id string, cycle_key string, reward decimal(18,2), is_capped boolean"


def running_caps(rewards: DataFrame) -> DataFrame:
    """Each reward (``transaction_id``, ``transaction_date``, ``cycle_key``, ``worth``, ``cap_amount``) as far as its cap lets it.

    Rows of a micro-batch count in the order of day and id; a cap that is null or not positive is none.  The state holds
    one sum a key; it equals the batch operator's PER_ITEM caps when the stream brings the rows in order.
    """

    def pay(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        paid = Decimal(state.get[0]) if state.exists else Decimal(0)
        out = []
        for r in pd.concat(list(parts)).sort_values(["transaction_date", "transaction_id"]).itertuples():
            cap = r.cap_amount if r.cap_amount is not None and r.cap_amount > 0 else None
            full = cap is not None and paid + r.worth > cap
            given = max(cap - paid, Decimal(0)) if full else (Decimal(0) if cap is not None and paid >= cap else r.worth)
            paid += given if cap is not None else Decimal(0)
            out.append((r.transaction_id, key[0], given, full or (cap is not None and given == 0 and r.worth > 0)))
        state.update((str(paid),))
        yield pd.DataFrame(out, columns=["transaction_id", "cycle_key", "reward", "is_capped"])

    rows = rewards.selectExpr("transaction_id", "transaction_date", "cycle_key", "cast(worth as decimal(18,2)) worth", "cast(cap_amount as decimal(18,2)) cap_amount")
    return rows.groupBy("cycle_key").applyInPandasWithState(pay, PAID, "paid string", "append", GroupStateTimeout.NoTimeout)
