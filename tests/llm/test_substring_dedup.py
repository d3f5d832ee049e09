"""Repeated passages against planted ones and a plain computation of the paragraphs."""

import random
import re
from collections import defaultdict

import numpy as np

from vitrine.llm import queries, substring_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def alike(a, b):
    """Five-word shingles, or for short ones the words' edit distance."""
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    n = max(len(a), len(b))
    return 100 * len(x & y) >= 80 * len(x | y) or (n <= 64 and 32 * distance(a, b) <= n)


def test_planted_passages(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(55)]
    docs = {i: [word() for _ in range(rng.randrange(5, 300))] for i in range(120)}
    planted = set(range(10, 50))
    for i in planted:
        w = docs[i]
        at = rng.randrange(len(w))
        docs[i] = w[:at] + [x.upper() for x in passage] + w[at:]
    docs[115] = docs[116] = docs[7]
    near = list(docs[110]) + [word() for _ in range(200)]
    docs[110], docs[111] = near, [w if i % 60 else word() for i, w in enumerate(near)]
    rows = [(i, "\n".join(w)) for i, w in docs.items()] + [(900, None), (901, ""), (902, "one two"), (None, " ".join(passage))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS start", "3 AS n")
    found = substring_dedup.repeats(df)
    out = found.toPandas()
    assert set(out.doc_id) == planted | {7, 115, 116, 110, 111}
    for _, g in out.groupby("cluster_id"):
        assert g.kept.sum() == 1 and g[g.kept].doc_id.iloc[0] == g.doc_id.min()
    assert out[out.doc_id.isin([7, 115, 116])].groupby("doc_id").words.sum().nunique() == 1
    runs = substring_dedup.passages(found).toPandas()
    inside = runs[runs.doc_id.isin(planted)]
    assert (inside.words <= 60).all() and inside.doc_id.nunique() == len(planted)
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.remove(df.select("doc_id", "text"), found).collect()}
    for i, w in docs.items():
        gone = {k for r in out[(out.doc_id == i) & ~out.kept].itertuples() for k in range(r.start, r.start + r.words)}
        assert cut[i].split() == [x for k, x in enumerate(w) if k not in gone]
    assert substring_dedup.repeats(df.limit(0)).count() == 0


def test_equal_paragraphs_are_all_found(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op2_substring_dedup(spark, sf).toPandas()
    mine = {(r.doc_id, r.start, r.words): r.cluster_id for r in got.itertuples()}
    groups = defaultdict(list)
    import pyarrow as pa

    from vitrine.llm.common import word_hashes

    for i, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = substring_dedup.cuts(word_hashes(pa.array([t]))[0]).tolist()
        for a, b in zip(at, at[1:]):
            if b - a >= 7:
                groups[tuple(w[a:b])].append((i, a, b - a))
    for places in groups.values():
        if len(places) > 1:
            assert len({mine[p] for p in places}) == 1
    # what else is there is verified similarity
    words = {p: g for g, places in groups.items() for p in places}
    members = defaultdict(set)
    for p, c in mine.items():
        members[c].add(words[p])
    for texts in members.values():
        for x in texts if len(texts) > 1 else ():
            assert any(alike(x, y) for y in texts - {x})


def test_cuts_do_not_depend_on_what_stands_around():
    rng = np.random.default_rng(2)
    inner = rng.integers(0, 2**63, 80).astype(np.uint64)
    seen = []
    for n in (0, 7, 50):
        h = np.concatenate([rng.integers(0, 2**63, n).astype(np.uint64), inner, rng.integers(0, 2**63, n).astype(np.uint64)])
        c = substring_dedup.cuts(h) - n
        seen.append([x for x in c.tolist() if 6 <= x <= 75])
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) >= 2


def test_keys_that_mix_clusters_lose_no_pair(spark):
    # each pair of texts is similar; all share a phrase, so most band keys hold many pairs
    phrase = "one two three four five six seven eight"
    own = [" ".join(f"x{i}.{k}" for k in range(6)) for i in range(200)]
    texts = [t for i in range(200) for t in (f"{phrase} {own[i]}", f"{phrase} {own[i]} y{i}")]
    out = substring_dedup.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), own=True).toPandas()
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    true = [(i, j) for i in range(400) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    cluster = dict(zip(out.doc_id, out.cluster_id))
    found = [(i, j) for i, j in true if cluster.get(i, -1) == cluster.get(j, -2)]
    assert len(true) == 200 and len(found) >= 0.97 * len(true) and all((out.groupby("cluster_id").doc_id.count() == 2).tolist())


def test_own_paragraphs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    line = lambda n: [word() for _ in range(n)]
    short, long = line(9), line(100)
    edited = [word() if k in (30, 95) else w for k, w in enumerate(long)]
    texts = [[line(20), short, line(30)], [[], line(7), short], [long, line(12)], [line(6), [], edited], [line(25)]]
    rows = [(i, "\n".join(" ".join(x) for x in t)) for i, t in enumerate(texts)]
    out = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"), own=True).toPandas()
    assert {tuple(r) for r in out[["doc_id", "start", "words", "kept"]].itertuples(index=False)} == {(0, 20, 9, True), (1, 7, 9, False), (2, 0, 100, True), (3, 6, 100, False)}
    assert out.groupby("cluster_id").doc_id.apply(sorted).tolist() in ([[0, 1], [2, 3]], [[2, 3], [0, 1]])


def test_all_links_of_own_paragraphs(spark):
    """Clusters are the components of all similar pairs, but for what the bands miss."""
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocab) for _ in range(rng.choice((10, 14, 34, 60, 120)))] for _ in range(25)]
    lines = []
    for _ in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 3))):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        lines.append(w)
    rows = [(i, " ".join(w)) for i, w in enumerate(lines)]
    out = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"), own=True).toPandas()
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = [(i, j) for i in range(len(lines)) for j in range(i) if alike(lines[i], lines[j])]
    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    cluster = dict(zip(out.doc_id, out.cluster_id))
    found = [cluster.get(i, -1) == cluster.get(j, -2) for i, j in pairs]
    assert len(pairs) > 100 and np.mean(found) >= 0.95
    for _, g in out.groupby("cluster_id"):  # nothing else is joined
        assert len({find(i) for i in g.doc_id}) == 1 and g.kept.sum() == 1 and g[g.kept].doc_id.iloc[0] == g.doc_id.min()


def test_recall_of_edited_passages(spark):
    """Passages of 60 words with one to three changed words, amid other text: nine in ten are found, and clean documents
    are left alone."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, passages = [], 300
    for i in range(passages):
        p = [word() for _ in range(60)]
        q = list(p)
        for k in rng.sample(range(60), 1 + i % 3):
            q[k] = word()
        for d, w in ((2 * i, p), (2 * i + 1, q)):
            rows.append((d, " ".join([*(word() for _ in range(rng.randrange(20, 90))), *w, *(word() for _ in range(rng.randrange(20, 90)))])))
    rows += [(10_000 + i, " ".join(word() for _ in range(200))) for i in range(200)]
    out = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    of = out.groupby("cluster_id").doc_id.apply(set)
    for edits in (1, 2, 3):
        both = [any({2 * i, 2 * i + 1} <= c for c in of) for i in range(passages) if 1 + i % 3 == edits]
        assert np.mean(both) >= 0.9, edits
    words = out[out.doc_id < 10_000].groupby("doc_id").words.sum()
    print("words found", words.sum() / (2 * passages * 60))
    assert not (out.doc_id >= 10_000).any()


def test_repeated_rows_and_ids(spark):
    """Of equal rows one is kept; each text of an id counts; null ids and short texts take no part."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (1, a), (1, b), (2, b + " end"), (None, a), (3, "a b c"), (4, "long " * 60_000), (5, None), (6, "")]
    out = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"), own=True).toPandas()
    assert out[(out.doc_id == 1) & (out.words == 30)].kept.sum() == 2 and len(out[(out.doc_id == 1)]) == 3
    assert out[out.doc_id == 2].kept.tolist() == [False] and set(out.doc_id) == {1, 2}
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.remove(spark.createDataFrame(rows[3:], "doc_id long, text string"), substring_dedup.repeats(spark.createDataFrame(rows[2:], "doc_id long, text string"), own=True)).collect()}
    assert cut[2] == "" and cut[3] == "a b c" and cut[5] is None and cut[6] == ""


def test_no_pair_of_a_shared_key_is_lost(spark):
    """Each text shares a long phrase with all others and is similar to one of them alone: every such pair is found."""
    rng = random.Random(21)
    phrase = [f"p{i}" for i in range(24)]
    lines = []
    for i in range(1500):
        own = [f"x{i}.{k}" for k in range(3)]
        lines += [phrase + own, phrase + own + [f"y{i}"]]
    for i in range(100):  # one word in forty differs, so an edit links what shingles don't
        w = phrase + [f"z{i}.{k}" for k in range(16)]
        lines += [w, [*w[:30], "other", *w[31:]]]
    order = list(range(len(lines)))
    rng.shuffle(order)
    out = substring_dedup.repeats(spark.createDataFrame([(i, " ".join(lines[i])) for i in order], "doc_id long, text string"), own=True).toPandas()
    cluster = dict(zip(out.doc_id, out.cluster_id))
    want = [(i, i + 1) for i in range(0, len(lines), 2)]
    assert all(alike(lines[i], lines[j]) for i, j in want)
    lost = [(i, j) for i, j in want if cluster.get(i, -1) != cluster.get(j, -2)]
    sharing = [(i, j) for i, j in lost if set(keys(lines[i])) & set(keys(lines[j]))]
    assert not sharing and len(lost) <= 0.02 * len(want)
    # what all have in common links nothing that isn't similar
    root = {i: i // 2 for i in range(len(lines))}
    unlike = [(i, j) for i, j in zip(order, order[1:]) if root[i] != root[j] and cluster.get(i, -1) == cluster.get(j, -2)]
    assert all(chained(lines, cluster, i, j) for i, j in unlike)


def keys(words):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([" ".join(words)])], ["doc_id", "text"])
    return next(substring_dedup._paragraphs(True, True)(iter([batch]))).column("bands").to_pylist()[0]


def chained(lines, cluster, i, j):
    """Whether similar pairs of one cluster lead from ``i`` to ``j``."""
    left, seen = {k for k in cluster if cluster[k] == cluster[i]}, {i}
    while seen:
        if j in seen:
            return True
        left -= seen
        seen = {y for y in left if any(alike(lines[x], lines[y]) for x in seen)}
    return False
