"""Operators on small hand-made rows."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.functions import sizes as S
from vitrine.functions import text as T
from vitrine.functions import vector as V
from vitrine.operators import curate, ingest, profiles, ranking, recommend, search
from vitrine.sources import files
from vitrine.streaming import jobs


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text,want",
    [("Dresses and the dress", ["dresse", "dress"]), ("Ladies' berries", ["lady", "berry"]), (None, []), ("It's 90s bus", ["it", "s", "90s", "bus"]), ("ties", ["tie"])],
)
def test_tokens(spark, text, want):
    assert one(spark, T.tokens("x"), text) == want


def test_text_expressions(spark):
    assert one(spark, T.bigrams(T.tokens("x")), "red silk dress") == ["red silk", "silk dress"]
    assert one(spark, T.bigrams(T.tokens("x")), "red") == []
    assert one(spark, T.colours("x"), "Red and black, reds") == ["red", "black"]
    assert one(spark, T.strip_html("x"), "<p>A  b</p>\n<i>c</i>") == "A b c"
    assert one(spark, T.image_url("x"), "a?b") == "a?b&width=512"
    assert one(spark, T.domain("x"), " https://www.Shop.com/x/y ") == "shop.com"
    assert one(spark, T.colourway("x"), "Silk Dress - Red") == "silk dress"
    assert one(spark, T.keyword_category("x"), "that thing") == "accessory"
    assert one(spark, T.keyword_category("x"), "bike shorts") == "activewear"
    assert one(spark, T.keyword_category("x"), None) is None
    assert one(spark, T.is_junk("x"), "LINEN CARDIGAN") and not one(spark, T.is_junk("x"), "BLACK SATIN DRESS") and not one(spark, T.is_junk("x"), "Gift Card")
    assert one(spark, T.clean_traits("x"), [" Linen. ", "linen", "Cottagecore look", "a b c d e f g h i", ""], "array<string>") == ["linen"]
    for names, want in (([], ""), (["a"], "a"), (["a", "b"], "a and b"), (["a", "b", "c"], "a, b and c")):
        assert one(spark, T.joined(F.col("x")), names, "array<string>") == want
    assert one(spark, T.json_list("x"), 'Sure: ["a", "b"] ok') == ["a", "b"]
    assert one(spark, T.json_list("x"), "- a\n- b") == ["a", "b"]
    assert one(spark, T.usd("x", F.lit("GBP")), 2.0, "double") == 2.54 and one(spark, T.usd("x", F.lit("?")), 2.0, "double") == 2.0


@pytest.mark.parametrize(
    "labels,currency,title,want",
    [
        (["S/M", "XS (US 0-2)", "One Size", "odd"], "USD", "", [["S", "M"], ["XS"], ["ONE"], []]),
        (["UK 10", "8", "8-10"], "USD", "", [["S"], ["M"], ["M"]]),
        (["36", "38"], "EUR", "dress", [["S"], ["S"]]),
        (["26", "28"], "EUR", "slim jeans", [["S"], ["M"]]),
        (["0", "1", "2"], "GBP", "top", [["XS"], ["S"], ["M"]]),
        (["W27"], "USD", "", [["S"]]),
        (["26.5"], "USD", "pants", [["S"]]),
        (["38", "S"], "EUR", "leather boots", [[], []]),
        (["AU 10"], "USD", "", [["S"]]),
        ([], "USD", "", []),
    ],
)
def test_sizes(spark, labels, currency, title, want):
    got = one(spark, S.normalise(F.col("x"), F.lit(currency), F.lit(title)), labels, "array<string>")
    assert [r["canon"] for r in got] == want and [r["label"] for r in got] == labels


def test_normalise_products(spark):
    v = lambda **k: {"title": "t", "price": "10", "available": True, "option1": None, "option2": None, "option3": None} | k
    base = {"id": 1, "title": "Silk dress", "handle": "silk", "product_type": None, "vendor": "v", "body_html": "<b>x</b>", "tags": ["a"], "published_at": None, "domain": "a.com"}
    rows = [
        base | {"images": [{"src": "i.jpg"}], "options": [{"name": "Size", "position": 2, "values": ["S", "M"]}], "variants": [v(price="bad", available=False, option1="red", option2="M"), v(price="12.5", option1="red", option2="S")]},
        base | {"id": 2, "images": [], "options": [], "variants": []},
        base | {"id": 3, "title": "Gift card", "images": [{"src": "i"}], "options": [], "variants": []},
        base | {"id": 4, "images": [{"src": "i?x"}], "options": [], "variants": []},
        base | {"id": 5, "images": [{"src": "i"}], "options": None, "variants": [v(title="One Size", price="x")]},
    ]
    raw = spark.read.schema(ingest.RAW + ", domain string").json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    brands = spark.createDataFrame([("A", "a.com", None)], "name string, domain string, currency string")
    out = {r["id"]: r for r in ingest.normalise_products(raw, brands).collect()}
    assert set(out) == {"a.com#1", "a.com#4", "a.com#5"}
    r = out["a.com#1"]
    assert (r["price"], r["available"], r["sizes_in_stock"], r["sizes_offered"], r["images"]) == (12.5, True, ["S"], ["S", "M"], ["i.jpg?width=512"])
    assert out["a.com#4"]["available"] and out["a.com#4"]["price"] is None and out["a.com#4"]["images"] == ["i?x&width=512"]
    assert out["a.com#5"]["price"] is None and out["a.com#5"]["sizes_in_stock"] == ["ONE"]


def items(spark, n=60):
    rows = [(i, f"b{i % 7}", f"red dress {i}" if i % 3 else "blue top - x", "dress", float(i + 6), "USD", i % 5 > 0, [float((i * k) % 11 - 5) for k in (1, 3, 7)]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, brand string, title string, product_type string, price double, currency string, available boolean, vec array<double>").withColumn("vec", V.unit(F.col("vec")))


def test_pages_agree_and_keep_every_piece(spark):
    q = spark.createDataFrame([([0.6, 0.0, 0.8],)], "q array<double>")
    found = search.scored(items(spark), search.Query("red dress"), q)
    first = [r["id"] for r in search.first_page(found, page=8).collect()]
    full = ranking.all_pages(found.withColumn("query_id", F.lit(1)), page=8).orderBy("position").collect()
    assert [r["id"] for r in full][:8] == first
    distinct = found.select("brand", T.colourway("title")).distinct().count()
    assert len(full) == distinct and len({r["id"] for r in full}) == distinct


def test_search_filters(spark):
    q = spark.createDataFrame([([0.6, 0.0, 0.8],)], "q array<double>")
    it = items(spark)
    assert {r["brand"] for r in search.scored(it, search.Query("x", brands=("b1",)), q).collect()} == {"b1"}
    got = search.scored(it, search.Query("dress", min_usd=20.0, max_usd=40.0, exclude_brands=("b2",)), q, taste=q).collect()
    assert got and all(20 <= r["usd"] <= 40 and r["brand"] != "b2" and r["available"] for r in got)
    with pytest.raises(ValueError):
        search.category_ok("hats")
    said = search.explained(search.scored(it, search.Query("red dress"), q), ["red", "dress"]).first()
    assert len(said["why"]) == 1 and (said["why"][0].startswith("title matches ") or said["why"][0] in ("tagged as a match", "looks like what you asked for"))
    odd = spark.createDataFrame([(1, "Dress in RED", 2.0, 9.999), (2, "blue", 1.0, 0.0), (3, None, 0.0, None)], "id long, title string, text_score double, usd double")
    got = {r["id"]: (r["why"], r["price_usd"]) for r in search.explained(odd, ["red", "dress", "red"]).collect()}
    assert got == {1: (["title matches red, dress"], 10.0), 2: (["tagged as a match"], None), 3: (["looks like what you asked for"], None)}
    assert search.marked(it, it.where("id < 3")).where("saved").count() == 3
    assert search.with_details(it.limit(4), it).count() == 4


def test_higher_bars_have_fewer_matches(spark, monkeypatch):
    traits = spark.createDataFrame([(1, "red", [0.6, 0.0, 0.8], 2), (2, "long", [0.0, 1.0, 0.0], 1)], "trait_id long, text string, q array<double>, n_sources long")
    seen = []
    for floor in (0.2, 0.8, 1.2):
        monkeypatch.setattr(recommend.K, "FLOOR", floor)
        monkeypatch.setattr(recommend.K, "RELATIVE", 0.1)
        cards = recommend.score_brands(items(spark), traits).collect()
        seen.append(sum(c["n_matched"] for c in cards))
        for c in cards:
            assert all(m["text"] in c["why"] for m in c["matched"]) and not any(t in c["why"].split(" — ")[0] for t in c["missing"])
    assert seen[0] >= seen[1] >= seen[2] and seen[0] > 0


def test_feed_keeps_its_rules(spark):
    it = items(spark).withColumn("score", F.col("price")).withColumn("pid", F.col("id") % 2)
    got = recommend.rank_feed(it, limit=9, per_brand=2, dedupe=0.9).join(it.select("id", "vec"), "id").collect()
    for pid in (0, 1):
        mine = [r for r in got if r["pid"] == pid]
        assert len(mine) <= 9 and max(sum(r["brand"] == b["brand"] for r in mine) for b in mine) <= 2
        assert all(sum(x * y for x, y in zip(a["vec"], b["vec"])) <= 0.9 + 1e-9 for a in mine for b in mine if a["id"] < b["id"])


def test_masked_traits(spark):
    it = items(spark).withColumns({"category": F.when(F.col("id") % 2 == 0, "shoes").otherwise("dress"), "margin": F.col("id").cast("double")})
    traits = spark.createDataFrame([(1, "linen", [1.0, 0.0, 0.0])], "trait_id long, text string, q array<double>")
    z, _ = recommend.trait_scores(it, traits)
    rows = {r["id"]: r["z"] for r in z.collect()}
    assert rows[58] == -10 and rows[59] != -10 and rows[0] != -10


EVENTS = [(1, "p", "2024-01-01 00:00:00", "save", "a"), (2, "p", "2024-01-02 00:00:00", "unsave", "a"), (3, "p", "2024-01-02 00:00:00", "save", "b"), (4, "q", "2024-01-01 00:00:00", "save", "a"), (5, "p", "2024-01-01 12:00:00", "reset", "")]


def events(spark):
    return spark.createDataFrame(EVENTS, "event_id long, pid string, ts string, kind string, key string").withColumn("ts", F.col("ts").cast("timestamp"))


def test_profiles(spark):
    e = events(spark)
    assert {(r["pid"], r["key"]) for r in profiles.saved(e, "save", "unsave").collect()} == {("p", "b"), ("q", "a")}
    assert sorted(r["event_id"] for r in profiles.after_reset(e, "reset").collect()) == [2, 3, 4]
    table = spark.createDataFrame([("a", "x", 1), ("b", "y", 1)], "key string, value string, ts long")
    changed = spark.createDataFrame([("a", None, 2), ("c", "z", 2)], "key string, value string, ts long")
    assert {(r["key"], r["value"]) for r in profiles.upserted(table, changed, "key", "ts").collect()} == {("b", "y"), ("c", "z")}
    traits = spark.createDataFrame([("t", [("image", "1")], False), ("u", [("image", "1")], True)], "text string, sources array<struct<kind:string,ref:string>>, user_added boolean")
    merged = profiles.with_sources(traits, spark.createDataFrame([("t", "quiz", "2"), ("n", "pin", "3"), ("t", "image", "1")], "text string, kind string, ref string"))
    assert {r["text"]: len(r["sources"]) for r in merged.collect()} == {"t": 2, "u": 1, "n": 1}
    assert [r["text"] for r in profiles.without_source(traits, "image", "1").collect()] == ["u"]
    assert one(spark, profiles.valid_id(F.col("x")), "0" * 32) and not one(spark, profiles.valid_id(F.col("x")), "../x")


def test_curation(spark):
    brands = spark.createDataFrame([("A",), ("b ",), ("c",), ("d",)], "brand string")
    tiers = spark.createDataFrame([("a", "C", True), ("b", "C", True), ("c", "C", False)], "key string, tier string, verified boolean")
    review = spark.createDataFrame([("b", "keep")], "key string, decision string")
    assert {r["brand"]: r["live"] for r in curate.effective(brands, tiers, review).collect()} == {"A": False, "b ": True, "c": True, "d": True}


def test_files(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"a": {"tier": "C"}, "b": {"tier": "A"}}')
    got = files.json_map(spark, f"{tmp_path}/m.json", "struct<tier:string>")
    assert {(r["key"], r["value"]["tier"]) for r in got.collect()} == {("a", "C"), ("b", "A")}
    assert files.json_map(spark, f"{tmp_path}/none.json", "string").count() == 0
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2}\n')
    assert sorted(r["a"] for r in files.json_lines(spark, f"{tmp_path}/l.jsonl", "a int", tolerant=True).collect()) == [1, 2]
    pages = spark.createDataFrame([(1, '<img class="x" src="http://i/236x/a.jpg"> <img src="b">')], "id int, html string")
    assert [r["src"] for r in files.feed_items(pages).collect()] == ["http://i/564x/a.jpg", "b"]
    for v in (1, 2):
        files.overwrite_keys(spark.createDataFrame([("p", v)] + [("q", v)] * (v == 1), "k string, v int"), f"{tmp_path}/keys", "k")
    assert {(r["k"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/keys").collect()} == {("p", 2), ("q", 1)}


def test_streams_give_what_batches_give(spark, tmp_path):
    e = events(spark)
    e.repartition(3).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e")
    for name, job in (("folded", jobs.fold), ("metered", lambda d: jobs.cost_meter(d.withColumn("cost_usd", F.lit(1.5))))):
        got = jobs.run_to_memory(job(stream), name)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, job(e).collect()))
    # sessions close once the watermark has passed them: a last event, far later, closes all before it
    rows = [(1, 0), (1, 20), (1, 49), (1, 100), (2, 5), (2, 300), (3, 100_000), (3, 200_000)]
    log = spark.createDataFrame(rows, "pid long, m long").selectExpr("pid", "timestamp_seconds(60 * m) AS ts")
    for k, part in enumerate((log.where("m < 1000"), log.where("m = 100000"), log.where("m = 200000"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/visits/{k}")
    said = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/visits")
    got = jobs.run_to_memory(jobs.visits(said, late="1 day"), "visits", "append").selectExpr("pid", "unix_seconds(start) / 60 AS a", "unix_seconds(end) / 60 AS b", "n").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 79, 3), (1, 100, 130, 1), (2, 5, 35, 1), (2, 300, 330, 1), (3, 100_000, 100_030, 1)]
    products = spark.readStream.schema("image string").parquet(f"{tmp_path}/p") if spark.createDataFrame([("a",), ("b",), ("a",)], "image string").write.parquet(f"{tmp_path}/p") is None else None
    for k in (1, 2):
        jobs.incremental_index(products, f"{tmp_path}/cache", lambda d: d.withColumn("vec", F.array(F.lit(1.0))), f"{tmp_path}/cp{k}").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/cache").count() == 2


def test_feed_in_slices_equals_the_greedy_feed(spark):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(120, 4))
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    score = [None if i % 40 == 7 else round(float(x), 1) for i, x in enumerate(rng.normal(size=120))]
    rows = [(f"p{i % 2}", i, "AAAB"[i % 4] if i % 8 else f"C{i}", score[i], vecs[i].tolist()) for i in range(120)]
    rows += [(None, 500, "A", 9.0, vecs[0].tolist()), ("p0", 501, "A", 9.0, None)]
    frame = spark.createDataFrame(rows, "pid string, id long, brand string, score double, vec array<double>")
    want = set()
    for pid in ("p0", "p1"):
        mine = sorted((r for r in rows if r[0] == pid and r[4]), key=lambda r: (-r[3] if r[3] is not None else np.inf, r[1]))
        taken = []
        for r in mine:
            if len(taken) < 12 and sum(t[2] == r[2] for t in taken) < 2 and all(np.dot(t[4], r[4]) <= 0.9 for t in taken):
                taken.append(r)
        want |= {(pid, r[1], i) for i, r in enumerate(taken)}
    for size in (3, 17, 1024):
        got = {(r["pid"], r["id"], r["position"]) for r in recommend.rank_feed(frame, 12, 2, 0.9, size).collect()}
        assert got == want
    assert recommend.rank_feed(frame.limit(0)).count() == 0


def test_quiz_is_k_means_on_the_sample(spark):
    """Against numpy on the same rows, and for fewer pieces than clusters."""
    import hashlib

    rng = np.random.default_rng(4)
    rows = [(i, f"b{int(rng.integers(0, 9))}" if i % 13 else None, f"long title {i}", 5.0, True, rng.standard_normal(6).tolist()) for i in range(200)]
    rows += [(900, "b1", "short", 5.0, True, [1.0] * 6), (901, "b1", "SKU_12345", 5.0, True, [1.0] * 6), (902, "b1", "long title", 0.0, True, [1.0] * 6), (903, "b1", "long title", 5.0, False, [1.0] * 6)]
    df = spark.createDataFrame(rows, "id long, brand string, title string, price double, available boolean, vec array<double>").withColumn("vec", V.unit(F.col("vec")))
    x = {r["id"]: np.array(r["vec"]) for r in df.collect() if r["id"] < 900}
    brand = {i: b or "" for i, b, *_ in rows}
    draw = lambda i, k: hashlib.md5(f"{i}:{k}".encode()).hexdigest()
    ids = sorted(x)
    m = np.stack([x[i] for i in ids])
    centers = np.stack([x[i] for i in sorted(ids, key=lambda i: (draw(i, 3), i))[:7]])
    for _ in range(15):
        own = (m @ centers.T).argmax(1)
        sums = np.stack([m[own == k].mean(0) if (own == k).any() else centers[k] for k in range(7)])
        centers = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    want, taken = [], set()
    for k in range(7):
        best = sorted((i for i, o in zip(ids, own) if o == k), key=lambda i: (-(x[i] @ centers[k]), i))
        first = next((i for i in best if brand[i] not in taken), None)
        if first is not None:
            taken.add(brand[first])
            want.append((k, first))
    got = [(r["k"], r["id"]) for r in recommend.quiz(df, n=7, seed=2).collect()]
    assert sorted(got) == want and len(want) >= 6
    few = recommend.quiz(df.where("id < 3"), n=7).collect()
    assert 1 <= len(few) <= 3 and recommend.quiz(df.limit(0)).count() == 0


def test_quiz_takes_every_piece(spark):
    """Of 4,400 pieces in four heaps all count, unless a sample is asked for."""
    import hashlib

    rng = np.random.default_rng(8)
    x = np.eye(4)[np.arange(4400) % 4] + 0.3 * rng.standard_normal((4400, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, f"b{i % 50}", f"long title {i}", 5.0, True, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, brand string, title string, price double, available boolean, vec array<double>")
    centers = x[sorted(range(4400), key=lambda i: (hashlib.md5(f"{i}:1".encode()).hexdigest(), i))[:4]]
    for _ in range(5):
        own = (x @ centers.T).argmax(1)
        centers = np.stack([x[own == k].mean(0) for k in range(4)])
        centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    want = set()
    for k in range(4):
        best = sorted(np.flatnonzero(own == k).tolist(), key=lambda i: (-(x[i] @ centers[k]), i))
        want.add(next(i for i in best if i % 50 not in {j % 50 for j in want}))
    got = lambda **other: {r["id"] for r in recommend.quiz(df, n=4, iterations=5, **other).collect()}
    assert got() == want
    assert len(got(sample=40)) == 4 and got(sample=40) != want


def test_feed_slices_are_cut_before_the_shuffle(spark):
    from pyspark.sql import Window

    d = spark.range(5000).select((F.col("id") % 2).alias("pid"), "id", F.rand(1).alias("s"))
    n = F.row_number().over(Window.partitionBy("pid").orderBy("s"))
    import inspect

    slice_rows = inspect.signature(recommend.rank_feed).parameters["slice_rows"].default
    plan = d.withColumn("n", n).where(F.col("n") <= slice_rows)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_a_long_list_is_refused(spark, monkeypatch):
    it = items(spark)
    queries = it.limit(5).select(F.col("id").alias("k"), F.col("vec").alias("q"))
    assert recommend.similarities(it, queries, "k").count() == 300 and recommend.similarities(it, queries.limit(0), "k").count() == 0
    monkeypatch.setattr(recommend, "MAX_LIST", 4)
    with pytest.raises(Exception, match="5 vectors are no list"):
        recommend.similarities(it, queries, "k").collect()
