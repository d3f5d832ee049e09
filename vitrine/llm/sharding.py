"""Sharding: a uniform shuffle with exact shard sizes, drawn through a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import written

#: Rows of a block that one task permutes, on average, until MAX_BLOCKS blocks are reached.
BLOCK_ROWS = 50_000
#: Rows of the communication matrix; with 40 shards the driver draws 330,000 counts at most.
MAX_BLOCKS = 8192


def communication_matrix(block_sizes: list[int], shard_sizes: list[int], seed: int) -> np.ndarray:
    """Counts by (block, shard) with the law of a uniform permutation: row by row, a multivariate hypergeometric
    draw from the places that the shards still have."""
    rng = np.random.Generator(np.random.PCG64(seed))
    left, rows = np.array(shard_sizes, np.int64), []
    for n in block_sizes:
        row = np.zeros(len(left), np.int64)
        rest, pool = n, int(left.sum())
        for j, places in enumerate(left.tolist()):
            pool -= places
            row[j] = got = _hypergeometric(rng, places, pool, rest)
            rest -= got
        left -= row
        rows.append(row)
    return np.array(rows).reshape(len(block_sizes), len(shard_sizes))


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among n drawn without replacement."""
    if not n or not good:
        return 0
    if n >= good + bad:
        return good
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    return _large_hypergeometric(rng, good, bad, n)


def _factorials(a: int, x: int) -> float:
    """log((a + x)! / a!) - x log(max(a, 1)) + x, without the loss of digits that a difference of large logarithms has."""
    if min(a, a + x) < 1000:
        return math.lgamma(a + x + 1) - math.lgamma(a + 1) - x * math.log(max(a, 1)) + x
    b = a + x
    return (b + 0.5) * math.log1p(x / a) + (1 / b - 1 / a) / 12 - (1 / b**3 - 1 / a**3) / 360


def _large_hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """As numpy's, which takes populations below 1e9 only: exact rejection for a law whose logarithm is concave.

    With the mode m and q at most its chance, p(m + x) is at most p(m) min(1, exp(1 - q |x|)); a draw from that envelope is
    accepted with the ratio of the two."""
    mode = (n + 1) * (good + 1) // (good + bad + 2)
    a = (mode, good - mode, n - mode, bad - n + mode)
    lean = math.log(max(a[1], 1) / max(a[0], 1)) + math.log(max(a[2], 1) / max(a[3], 1))
    # the chance of the mode is at least about 1 / (1 + sqrt(2 pi) sd)
    total = good + bad
    sd = math.sqrt(n / total * good * (bad / total) * ((total - n) / max(1, total - 1)))
    q = 0.9 / (1 + math.sqrt(2 * math.pi) * sd)
    w = 1 + q / 2
    while True:
        y = rng.random() * w / q if rng.random() <= w / (1 + w) else (w + rng.exponential()) / q
        x = int(round(y)) * (1 if rng.random() < 0.5 else -1)
        if not (0 <= a[0] + x and 0 <= a[1] - x and 0 <= a[2] - x and 0 <= a[3] + x):
            continue
        log_ratio = x * lean - sum(_factorials(k, s * x) for k, s in zip(a, (1, -1, -1, 1)))
        if math.log(max(rng.random(), 1e-300)) + min(0.0, w - q * y) <= log_ratio:
            return mode + x


def shard(rows: DataFrame, n_shards: int, key: str = "doc_id", tie: tuple[str, ...] = (), seed: int = 11) -> DataFrame:
    """Add ``shard`` (0 to n_shards - 1; sizes at most one apart) and ``slot`` (gapless from 0 in the shard).

    Rows fall into blocks by a seeded hash; how many rows each block sends to each shard is drawn exactly; each block
    permutes its rows and deals them out; each shard permutes again. A shard is permuted in buckets of the hash
    range whose first slots come from counts, so that no task holds a shard. ``tie`` are more columns that order
    rows with equal keys; rows equal in all are interchangeable. Null keys are ordinary. An empty table gives no
    rows. The input must hold only narrow columns: join texts back by key."""
    spark = rows.sparkSession
    n = rows.count()
    n_blocks = min(MAX_BLOCKS, max(1, -(-n // BLOCK_ROWS)))
    names = [key, *tie]
    h = lambda k: F.xxhash64(F.lit(seed + k), *names)
    blocked = rows.withColumn("_block", F.pmod(h(0), F.lit(n_blocks)).cast("int"))
    sizes = {r["_block"]: r["count"] for r in blocked.groupBy("_block").count().collect()}  # MAX_BLOCKS rows at most
    order = sorted(sizes)
    goal = [n // n_shards + (j < n % n_shards) for j in range(n_shards)]
    ends = np.cumsum(communication_matrix([sizes[b] for b in order], goal, seed), axis=1) if order else []
    table = spark.createDataFrame([(b, [int(x) for x in e]) for b, e in zip(order, ends)], "_block int, _ends array<long>")
    local = Window.partitionBy("_block").orderBy(h(1), *names)
    dealt = blocked.withColumn("_rank", F.row_number().over(local)).join(F.broadcast(table), "_block")
    # the shard is the number of cumulative counts below the row's rank
    dealt = dealt.withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))))
    buckets = max(1, -(-n // (n_shards * BLOCK_ROWS)))
    dealt = dealt.withColumn("_bucket", F.pmod(F.shiftright(h(2), 16), F.lit(buckets)).cast("int"))
    dealt = written(dealt.drop("_ends", "_rank", "_block"), "dealt")
    counts = dealt.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("shard", "_bucket").orderBy(h(3), *names)
    out = dealt.withColumn("_at", F.row_number().over(within)).join(first, ["shard", "_bucket"])
    return out.withColumn("slot", F.col("_first") + F.col("_at") - 1).drop("_bucket", "_at", "_first")
