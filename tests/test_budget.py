"""Calls admitted under a budget: every cut into micro-batches gives what the running sum gives, over restarts too."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.streaming import budget

SCHEMA = "account string, event_id long, ts timestamp, kind string, cost long"


@pytest.fixture(scope="module")
def calls():
    rng = np.random.default_rng(2)
    t0 = dt.datetime(2024, 1, 1)
    return [(None if i % 11 == 0 else f"a{int(rng.integers(0, 4))}", i, t0 + dt.timedelta(seconds=i // 2), "read", int(rng.integers(0, 50_000)) if i % 7 else None) for i in range(240)]


def plain(calls, limit):
    spent, out = {}, {}
    for account, i, _, _, cost in calls:
        before = spent.get(account, 0)
        out[i] = (before, before < limit)
        spent[account] = before + (cost or 0 if before < limit else 0)
    return out


@pytest.mark.parametrize("cuts", [(240,), (1, 100, 240), (50, 51, 120, 200, 240)])
def test_every_cut(spark, tmp_path, calls, cuts):
    src, out, ck = (f"{tmp_path}/{x}" for x in ("src", "out", "ck"))
    at = 0
    for to in cuts:
        # each load is a run of its own, which goes on from the checkpoint
        spark.createDataFrame(calls[at:to], SCHEMA).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        budget.write(budget.admitted(stream, 0.5), out, ck).awaitTermination()
        at = to
    rows = spark.read.parquet(out).collect()
    assert len(rows) == len(calls)
    assert {r["event_id"]: (r["spent"], r["admitted"]) for r in rows} == plain(calls, 500_000)
    assert 0 < sum(r["admitted"] for r in rows) < len(rows)


def test_batch_form_and_limits(spark, calls):
    d = spark.createDataFrame(calls, SCHEMA)
    for limit in (0.5, 0.0, 100.0):
        got = {r["event_id"]: (r["spent"], r["admitted"]) for r in budget.admitted_batch(d, limit).collect()}
        assert got == plain(calls, round(limit * budget.MICRO))
    assert spark.createDataFrame([(0.0000015,)], "cost_usd double").select(budget.micro()).first()[0] == 2
    assert budget.admitted_batch(d.limit(0), 1.0).count() == 0 and F


def test_accounts_share_state_by_buckets(spark, tmp_path):
    """The stream's keys don't grow with the accounts, and each account keeps its own number."""
    src, out, ck = (f"{tmp_path}/{x}" for x in ("src", "out", "ck"))
    rows = spark.range(6000).select((F.col("id") % 3000).cast("string").alias("account"), F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), F.lit("read").alias("kind"), (F.col("id") % 3000).alias("cost"))
    rows.write.parquet(src)
    run = budget.write(budget.admitted(spark.readStream.schema(SCHEMA).parquet(src), 0.001), out, ck)
    run.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]) <= budget.BUCKETS
    got = {r["event_id"]: (r["spent"], r["admitted"]) for r in spark.read.parquet(out).collect()}
    assert got == {i: (i % 3000 if i >= 3000 else 0, i < 3000 or i % 3000 < 1000) for i in range(6000)}
