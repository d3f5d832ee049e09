"""Runs against the definition, word by word, and the query against a plain version."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from vitrine.llm import periodic_runs, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def smallest_period(w):
    fail = [0] * len(w)
    for i in range(1, len(w)):
        k = fail[i - 1]
        while k and w[i] != w[k]:
            k = fail[k - 1]
        fail[i] = k + (w[i] == w[k])
    return len(w) - fail[-1]


def brute(w, minimum=12):
    """Every stretch of its smallest period that no neighbouring word extends."""
    out, n = [], len(w)
    for s in range(n):
        for e in range(s + minimum, n + 1):
            q = smallest_period(w[s:e])
            if e - s >= max(minimum, 2 * q) and not (s and w[s - 1] == w[s - 1 + q]) and not (e < n and w[e] == w[e - q]):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return [x for i, x in enumerate(w) if i not in gone]


def stretches(w, minimum=12):
    """As ``brute``, by comparing the words with themselves q apart: for longer texts."""
    x, best = np.unique(np.array(w, object).astype(str), return_inverse=True)[1] if w else np.zeros(0, int), {}
    for q in range(1, len(w) // 2 + 1):
        eq = np.concatenate(([0], (x[:-q] == x[q:]).astype(int), [0]))
        for s, e in zip(np.flatnonzero(np.diff(eq) == 1), np.flatnonzero(np.diff(eq) == -1)):
            if e - s + q >= max(minimum, 2 * q):
                best.setdefault((int(s), int(e + q)), q)
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def random_texts():
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(list("ab"), n)) for n in range(0, 40)]
    for letters in (1, 2, 3, 5):
        for _ in range(25):
            q = int(rng.integers(1, 20))
            unit = rng.choice(list("abcde")[:letters], q)
            body = np.tile(unit, int(rng.integers(1, 5)))[: int(rng.integers(1, 60))]
            body = [*rng.choice(list("abc"), int(rng.integers(0, 9))), *body, *rng.choice(list("abc"), int(rng.integers(0, 9)))]
            texts.append(" ".join(body))
    return texts


@pytest.mark.parametrize("minimum", [12, 2, 30])
def test_definition(minimum):
    import pyarrow as pa

    texts = random_texts()
    words, begin = periodic_runs.split(pa.array(texts))
    codes = words.dictionary_encode().indices.to_numpy()
    for together in (1, 300, 1 << 20):
        doc, start, length, period = periodic_runs.text_runs(codes, begin, minimum, together)
        for i, t in enumerate(texts):
            got = [tuple(map(int, r)) for r in zip(start[doc == i], length[doc == i], period[doc == i])]
            assert got == brute(t.split(), minimum), t
            if minimum == 12:
                assert got == stretches(t.split())


def test_odd_rows(spark):
    again = "x y z " * 4
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, again), (4, again), (None, "a " * 12), (5, "A a " * 5 + "A"), (6, "é b c " * 12), (7, "one"), (8, "w " * 50_000), (9, " ".join(map(str, range(20_000))) + " " + again)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS runs", "2 AS start", "3 AS n_words", "4 AS collapsed")
    got = {}
    for r in periodic_runs.find(d).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]))
    assert got[1] == [(0, [], None)] and got[2] == got[3] == [(0, [], "")]
    assert got[4] == [(12, [(0, 12, 3)], "x y z")] * 2
    assert got[None] == [(12, [(0, 12, 1)], "a")]
    assert got[5] == [(11, [], "A a A a A a A a A a A")]
    assert got[6] == [(12, [(0, 12, 1)], "é b c")]
    assert got[7] == [(1, [], "one")]
    assert got[8] == [(50_000, [(0, 50_000, 1)], "w")]
    assert got[9][0][:2] == (20_012, [(20_000, 12, 3)])
    assert periodic_runs.find(d.limit(0)).count() == 0


def plain(doc_id, text):
    """The query's row by the contract."""
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [*w[:a], *(w[a + (i - a) % p] for i in range(a, n))]
    runs = stretches(w)
    s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return len(runs), s, length, q, 1000 * length // q if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(collapsed(w, runs)))


def test_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, sf).collect()}
    assert got.keys() == docs.keys()
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    for d, text in docs.items():
        if len(text or "") < 12_000 or zlib.crc32(str(d).encode()) % 10 == 0:
            assert tuple(got[d][c] for c in names) == plain(d, text), d
    assert sum(r["n_runs"] > 0 for r in got.values()) > 80
