"""The n-gram join against all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from vitrine.llm import ngram_join, queries


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs: dict) -> dict:
    sets = {d: shingles(t) for d, t in docs.items()}
    low, links = {d: d for d in docs}, dict.fromkeys(docs, 0)

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    ids = sorted(d for d in docs if sets[d])
    by = {}
    for d in ids:
        for s in sets[d]:
            by.setdefault(s, []).append(d)
    pairs = {p for ds in by.values() for p in combinations(ds, 2)}
    for a, b in pairs:
        inter = len(sets[a] & sets[b])
        if 100 * inter >= 80 * (len(sets[a]) + len(sets[b]) - inter):
            links[a] += 1
            links[b] += 1
            x, y = sorted((root(a), root(b)))
            low[y] = x
    return {d: (len(sets[d]), links[d], root(d)) for d in docs}


def made(seed: int, n: int) -> dict:
    """Families of near copies, some large, with a passage that many documents share."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["É", "ÀB", "ab cd"]
    passage = [rng.choice(vocab) for _ in range(30)]
    base, docs = [[rng.choice(vocab) for _ in range(rng.choice((3, 6, 20, 60, 90)))] for _ in range(n // 8)], {}
    for i in range(n):
        w = list(base[0] if i % 3 == 0 else rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 5))):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if i % 4 == 1:
            w += passage
        docs[i * 3 + 1] = rng.choice((" ", "\n", " \t")).join(w).swapcase() if i % 5 == 0 else " ".join(w)
    return docs | {100_000: None, 100_001: "", 100_002: " \n", 100_003: "One two", 100_004: "one  TWO", 100_005: "one", 100_006: "x " * 9000}


@pytest.mark.parametrize("small", [False, True])
def test_all_pairs(spark, monkeypatch, small):
    if small:
        for name, n in (("WIDE", 3), ("BLOCK", 4), ("BLOCK_NGRAMS", 400), ("LATE", 300), ("GATHER", 500)):
            monkeypatch.setattr(ngram_join, name, n)
    docs = made(4 + small, 500)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").selectExpr("*", "1 AS n_shingles", "'x' AS rep", "2 AS sig")
    got = {r["doc_id"]: (r["n_shingles"], r["n_links"], r["component_id"]) for r in ngram_join.join(df).collect()}
    assert got == brute(docs)


def test_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_shingles"], r["n_links"], r["component_id"]) for r in queries.op1_ngram_join(spark, sf).collect()}
    assert got == brute(docs)


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, None)]
    out = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 4 and {r["component_id"] for r in out if r["n_shingles"]} == {5}
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_id_with_two_texts(spark):
    """Each text of an id has its own links; the class of both is told by its smallest id."""
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, one), (5, two), (7, one + " x"), (9, two + " x"), (9, two + " x"), (11, "c d e f g")]
    out = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r["doc_id"], r["n_shingles"], r["n_links"], r["component_id"]) for r in out)
    assert got == [(5, 56, 1, 5), (5, 56, 2, 5), (7, 57, 1, 5), (9, 57, 2, 5), (9, 57, 2, 5), (11, 1, 0, 11)]


def test_long_texts_and_shared_passages(spark):
    """Long texts of one vocabulary that share passages, with a near copy of each: only the copies link."""
    rng = random.Random(8)
    shared = [" ".join(f"s{rng.randrange(400)}" for _ in range(80)) for _ in range(6)]
    docs = {}
    for i in range(60):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((300, 1500)))]
        docs[2 * i] = " ".join([*w, *rng.sample(shared, 3)])
        docs[2 * i + 1] = " ".join(["new", *w, *rng.sample(shared, 1)]) if i % 2 else docs[2 * i] + " end"
    got = ngram_join.join(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["n_links"], r["component_id"]) for r in got} == brute(docs)


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 50, rng.integers(1, 40)).astype(np.uint64)) for _ in range(20)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = ngram_join.overlaps(sets, 7)
    assert all(got[i, j] == want[i][j] for i in range(20) for j in range(20) if i != j)
