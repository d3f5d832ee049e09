"""Paid calls under a budget, decided call by call in a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

#: What a call costs, in millionths of the currency: whole numbers add up alike in any order.
MICRO = 1_000_000
#: Accounts share state by buckets, as each key of a stream costs some milliseconds a batch. A checkpoint goes with this number.
BUCKETS = 1024
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "account string, event_id long, ts timestamp, kind string, cost long, spent long, admitted boolean"


def micro(cost: str = "cost_usd"):
    return F.round(F.col(cost) * MICRO).cast("long")


class _Admit(StatefulProcessor):
    """State: what each account of a bucket has spent. A call goes ahead while something is left, so the last one may overdraw."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", "accounts array<string>, spent array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        spent = dict(zip(*self.spent.get())) if self.spent.exists() else {}
        # a batch's calls in event order
        calls = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "event_id"], ignore_index=True)
        before, admitted = [], []
        for account, cost in zip(calls["account"].tolist(), calls["cost"].tolist()):
            account = account if isinstance(account, str) else None
            now = spent.get(account, 0)
            before.append(now)
            admitted.append(now < self.limit)
            spent[account] = now + (cost if admitted[-1] else 0)
        self.spent.update((list(spent), list(spent.values())))
        yield calls.assign(spent=before, admitted=admitted)[["account", "event_id", "ts", "kind", "cost", "spent", "admitted"]]

    def close(self) -> None:
        pass


def admitted(calls: DataFrame, limit_usd: float) -> DataFrame:
    """Decide each call of a stream ``account, event_id, ts, kind, cost`` (``cost`` in millionths, never negative): ``spent`` is what the
    account's admitted calls came to before it, ``admitted`` whether that was below the limit.

    Accounts are decided side by side, an account's calls in the order in which they arrive, within a micro-batch by ``ts`` and
    ``event_id``; so however a log in event order is cut into batches, each call gets the same answer. A refused call costs
    nothing. The state is one number an account, kept in the checkpoint by buckets of accounts; a restarted query goes on from it.
    Memory: a bucket's accounts and its calls of one micro-batch, which the source's limit per trigger bounds. Null costs count as 0; null accounts
    are one account."""
    spark = calls.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != _PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)  # typed state needs it
    rows = calls.select(F.col("account").cast("string").alias("account"), "event_id", "ts", "kind", F.coalesce(F.col("cost"), F.lit(0)).cast("long").alias("cost"))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("account"), F.lit(BUCKETS))).groupBy("bucket").transformWithStateInPandas(_Admit(round(limit_usd * MICRO)), OUT, "Append", "None")


def admitted_batch(calls: DataFrame, limit_usd: float) -> DataFrame:
    """The same decisions over a table. As costs aren't negative, what is admitted is a prefix of an account's calls, so a running
    sum tells it."""
    order = Window.partitionBy("account").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    limit, cost = round(limit_usd * MICRO), F.coalesce(F.col("cost"), F.lit(0)).cast("long")
    d = calls.select("account", "event_id", "ts", "kind", cost.alias("cost")).withColumn("_all", F.coalesce(F.sum("cost").over(order), F.lit(0)))
    reached = F.min(F.when(F.col("_all") >= limit, F.col("_all"))).over(Window.partitionBy("account"))
    return d.withColumn("spent", F.least("_all", F.coalesce(reached, F.col("_all")))).withColumn("admitted", F.col("_all") < limit).drop("_all")


def write(decisions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the decisions to a table, exactly once over restarts."""
    return decisions.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
