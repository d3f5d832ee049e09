"""The metric range join against all pairs."""

import numpy as np
import pytest

from vitrine.llm import embedding_join, queries


def brute(rows, cosine=0.98):
    able = {i: np.array(v, float) for i, v, label in rows if v is not None and label is not None and None not in v and len(v) and np.isfinite(v).all() and np.any(v)}
    label = {i: x for i, _, x in rows}
    low, links = {r[0]: r[0] for r in rows}, dict.fromkeys((r[0] for r in rows), 0)

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    ids = sorted(able)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = able[a], able[b]
            if label[a] == label[b] and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= cosine:
                links[a] += 1
                links[b] += 1
                p, q = sorted((root(a), root(b)))
                low[q] = p
    return {i: (links[i], root(i), root(i) == i) for i in low}


@pytest.mark.parametrize("cell,block", [(600, 1024), (15, 8), (3, 4)])
def test_all_pairs(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embedding_join, "CELL", cell)
    monkeypatch.setattr(embedding_join, "BLOCK", block)
    rng = np.random.default_rng(cell)
    centers = rng.normal(size=(20, 12))
    rows = []
    for i in range(300):
        c = 0 if i % 3 == 0 else rng.integers(20)
        v = (centers[c] + rng.normal(size=12) * rng.choice([0, 0.1, 0.25])) * rng.choice([1, 3])
        rows.append((i * 2, [float(x) for x in v], int(c % 4) if i % 50 else None))
    rows += [(1001, None, 1), (1003, [], 1), (1005, [0.0] * 12, 1), (1007, [float("nan")] + [1.0] * 11, 1), (1009, [None] + [1.0] * 11, 1), (1011, [1e-300] * 12, 1), (1013, [1e200] * 12, 1), (1015, [1.0] * 5, 1), (1017, [1.0] * 12, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS grp", "'x' AS sig")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_join.near_duplicates(df).collect()}
    rows = [(i, [1.0] * 12 if i in (1011, 1013) else v, x) for i, v, x in rows]
    assert got == brute(rows)


def test_query_matches_sql(same):
    same("op6_embedding_join", queries.queries(), queries.oracle_sql())


def test_odd_rows(spark):
    rows = [(None, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a"), (2, [2.0, 4.0], "a"), (3, [1.0, 2.0], "b")]
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")).collect()}
    assert out == {None: (0, None), 1: (1, 1), 2: (1, 1), 3: (0, 3)}
    assert embedding_join.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
