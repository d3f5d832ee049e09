"""The audit against its definition: rows by SQL, odd rows and many sources by a plain version."""

import re
from collections import Counter, defaultdict

import numpy as np

from vitrine.llm import queries, source_divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, min_docs=30, top=50):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = Counter(TERM.findall((text or "").translate(LOWER)))
        groups.add((lang, source))
        counts[lang, source] += terms
        docs[lang].update(terms.keys())
    out = set()
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        mine = sorted(s for l, s in groups if l == lang)
        whole = Counter()
        for s in mine:
            whole.update(counts[lang, s])

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in mine}
        q = shares(whole)
        for s in mine:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in mine if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(ordered) if part == "pair" or i < top}
    return out


def same(df, rows, **k):
    got = [tuple(r) for r in source_divergence.audit(df, **k).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, **k)
    return got


def test_query(spark, sf, same):
    same("op11_source_divergence", {"op11_source_divergence": queries.op11_source_divergence}, queries.oracle_sql())


def test_query_by_definition(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "source", "text").collect()]
    assert {tuple(r) for r in queries.op11_source_divergence(spark, sf).collect()} == plain(rows)


def test_odd_rows(spark):
    rows = [("en", "a", "The the THE cat's É é x1y"), ("en", "a", "the cat"), ("en", "b", None), ("en", None, "the dog"), (None, "a", "the the dog"), ("en", "c", "1 2 ... \t"), ("en", "a", "the cat"), ("fr", "a", ""), ("en", "", "Ünï ünï")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 AS term", "2 AS n", "3 AS k", "4 AS p", "5 AS value")
    assert len(same(df, rows, min_docs=1)) > 10
    same(df, rows, min_docs=2)
    same(df, rows, min_docs=100)  # no term is kept: distances of 0
    assert source_divergence.audit(df.limit(0)).count() == 0


def test_many_sources(spark, monkeypatch):
    """Blocks of few sources, few postings at a time and counts sent on often give the same rows."""
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    rows = [(["x", "y"][i % 2], f"s{int(rng.zipf(1.6)) % 40}", " ".join(rng.choice(words, int(rng.integers(0, 60))))) for i in range(600)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    want = same(df, rows, min_docs=5, top=7)
    for k, v in {"BLOCK": 3, "PAIRS": 50, "KEPT_COUNTS": 40, "LONG": 10}.items():
        monkeypatch.setattr(source_divergence, k, v)
    assert sorted(same(df, rows, min_docs=5, top=7)) == sorted(want)
    text = "One tWo, three-four " * 9 + "É" * 50
    parts = list(source_divergence._words(text.encode()))
    assert len(parts) > 5 and [w.decode() for p in parts for w in p] == TERM.findall(text.translate(LOWER))


def test_shares_of_large_counts(spark):
    c, t, v = 3 * 10**15 + 7, 10**16 + 1, 250_001
    row = spark.createDataFrame([(c, t, v), (0, 0, 0)], "c long, t long, v long").select(source_divergence.share("c", "t", "v").alias("p")).collect()
    assert [r["p"] for r in row] == [1 + 10**9 * (c + 5) // (t + 5 * v), None]
