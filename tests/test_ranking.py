"""Row numbers and pages against plain versions, at every size of a slice."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.operators import ranking


@pytest.fixture
def many_tasks(spark):
    """Small tables lie over all partitions too."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbered(spark, many_tasks):
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 else f"k{i % 50}" if i % 7 else None, int(rng.integers(0, 10**6)), i) for i in range(3000)]
    d = spark.createDataFrame(rows, "k string, v long, id long")
    got = {r["id"]: r["n"] for r in ranking.numbered(d, ["k"], ["v", "id"], "n").collect()}
    for k in {r[0] for r in rows}:
        mine = sorted((v, i) for kk, v, i in rows if kk == k)
        assert [got[i] for _, i in mine] == list(range(1, len(mine) + 1))
    whole = ranking.numbered(d, [], ["v", "id"], "n").agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()
    assert tuple(whole) == (1, 3000, 3000) and ranking.numbered(d.limit(0), ["k"], ["id"], "n").count() == 0
    # the hot key lies over several tasks
    tasks = d.repartitionByRange("k", "v", "id").where("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct()
    assert tasks.count() > 2


def plain_pages(brands, cap, size):
    """Positions of rows in their order, page by page."""
    order, queue, here, page = [], [], Counter(), 0
    for row, brand in enumerate(brands):
        if here[brand] < cap:
            here[brand] += 1
            order.append(row)
        else:
            queue.append(row)
        if order and len(order) % size == 0 and len(order) // size != page:
            page, here, left = len(order) // size, Counter(), []
            for r in queue:
                here[brands[r]] += 1
                (order if here[brands[r]] <= cap else left).append(r)
            here, queue = Counter({b: min(n, cap) for b, n in here.items()}), left
    return order + queue


@pytest.mark.parametrize("slice_rows,heads", [(1, 2), (7, 1), (7, 3), (50, 2), (1000, 64)])
def test_pages_at_every_slice_size(spark, slice_rows, heads):
    rng = np.random.default_rng(5)
    cap, size = (1 if heads == 1 else 2), 6
    rows, want = [], {}
    n_rows = 14 if slice_rows == 1 else 60 if slice_rows == 7 else 150
    for q, n_brands in enumerate((2, 5, 1, 60)):
        # a brand with a third of all rows, and small ones
        brands = ["b0" if rng.random() < 1 / 3 else f"b{int(rng.integers(0, n_brands))}" for _ in range(n_rows)]
        scores = rng.permutation(n_rows).astype(float)
        ordered = sorted(range(n_rows), key=lambda i: -scores[i])
        want[q] = [ordered[i] for i in plain_pages([brands[i] for i in ordered], cap, size)]
        rows += [(q, i, brands[i], f"title {i}", float(scores[i])) for i in range(n_rows)]
    d = spark.createDataFrame(rows, "query_id long, id long, brand string, title string, score double")
    got = ranking.all_pages(d, cap, size, slice_rows, heads).collect()
    for q in want:
        mine = sorted((r["position"], r["id"]) for r in got if r["query_id"] == q)
        assert [p for p, _ in mine] == list(range(len(want[q]))) and [i for _, i in mine] == want[q], q


def test_pages_of_odd_rows(spark):
    rows = [(None, 1, "a", "x", 1.0), (None, 2, None, "y", None), (1, 3, "a", "Silk - red", 2.0), (1, 4, "a", "silk - blue", 3.0), (1, 5, "a", None, float("nan")), (1, 4, "a", "silk - blue", 3.0), (1, 6, None, "z", 5.0)]
    d = spark.createDataFrame(rows, "query_id long, id long, brand string, title string, score double").selectExpr("*", "1 AS n", "2 AS m", "3 AS position")
    got = {(r["query_id"], r["position"]): (r["id"], r["brand"]) for r in ranking.all_pages(d, slice_rows=2).collect()}
    assert got == {(None, 0): (1, "a"), (None, 1): (2, None), (1, 0): (6, None), (1, 1): (4, "a"), (1, 2): (5, "a")}
    assert ranking.all_pages(d.limit(0)).count() == 0
