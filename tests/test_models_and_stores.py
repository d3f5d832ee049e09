"""Encoders, trait readers and taste."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.operators import encoders, profiles, taste


def test_hash_encoder_as_a_column(spark):
    df = spark.createDataFrame([(1, "red silk dress"), (2, "silk dress red"), (3, "steel anvil"), (4, None)], "id int, t string")
    got = {r["id"]: r["v"] for r in df.select("id", encoders.encoded(F.col("t"), encoders.HashEncoder(16)).alias("v")).collect()}
    assert got[4] is None and np.allclose(got[1], got[2], atol=1e-6) and abs(np.dot(got[1], got[3])) < 0.9
    assert abs(np.linalg.norm(got[3]) - 1) < 1e-5


def test_token_ids():
    tokenizers = pytest.importorskip("public_tokenizers")
    ids = encoders.token_ids(["a photo of a dress &amp;amp; hat", "x " * 200], tokenizers.path("word_bpe_49k.json"), 12)
    assert ids.shape == (2, 12) and ids[0, 0] == ids[1, 0] == 49406 and ids[1, -1] == 49407 and 49407 in ids[0].tolist()


def items(spark):
    rows = [(i, "abc"[i % 3].upper(), f"title {i}", "dress", True, [float(i % 5), 1.0, float(i % 2)]) for i in range(30)]
    return spark.createDataFrame(rows, "id long, brand string, title string, product_type string, available boolean, vec array<double>")


def test_brand_traits(spark):
    class Reader:
        def brand(self, name, titles, types, description):
            return [description] if not titles else [f"{titles[0]}.", "boho"] if name != "c" else None

    names = spark.createDataFrame([("A",), ("b ",), ("c",), ("zz",)], "brand string")
    cache = spark.createDataFrame([("b", ["linen"])], "key string, traits array<string>")
    got, new = encoders.brand_traits(names, cache, items(spark), Reader())
    assert {r["key"]: r["traits"] for r in got.collect()} == {"a": ["title 0"], "b": ["linen"], "c": None, "zz": None}
    assert [r["key"] for r in new.collect()] == ["a"]
    words = encoders.learned(spark.createDataFrame([("linen",)], "phrase string"), spark.createDataFrame([("Linen.",), ("wide legs",), ("y2k",)], "phrase string"))
    assert sorted(r["phrase"] for r in words.collect()) == ["linen", "wide legs"]


def test_taste(spark):
    it = items(spark)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    images = spark.createDataFrame([(9, [0.0, 1.0, 0.0])], "id long, vec array<double>")
    brands = spark.createDataFrame([("a",), ("none",)], "brand string")
    a = taste.anchors(it, brands, images, ids(4, 999), ids(5))
    assert {r["anchor"]: r["positive"] for r in a.collect()} == {"brand:A": True, "image:9": True, "item:4": True, "skip:5": False}
    got = taste.feed(it, a, spark.createDataFrame([("B",)], "brand string"), ids(3), "p", 5).collect()
    assert got and all(r["brand"] != "B" and r["id"] != 3 and r["because"] for r in got)
    cold = taste.feed(it, a.limit(0), brands.limit(0), ids(0).limit(0), "p").collect()
    assert sorted(r["brand"] for r in cold) == ["A", "B", "C"]
    traits = spark.createDataFrame([("x", [("image", "1")], False), ("y", [("brand", "A"), ("pin", "2")], False), ("z", [("quiz", "3")], True)], "text string, sources array<struct<kind:string,ref:string>>, user_added boolean")
    out = {r["text"]: {tuple(s) for s in r["sources"]} for r in taste.refined(traits, spark.createDataFrame([("new",), ("y",)], "text string")).collect()}
    moved = {("image", "1"), ("pin", "2"), ("quiz", "3")}
    assert out == {"new": moved, "y": moved | {("brand", "A")}, "z": set()}


def test_a_known_brand_is_read_by_its_description(spark):
    class Reader:
        def brand(self, name, titles, types, description):
            return [f"{description}!"]

    names = spark.createDataFrame([("Far",), ("none",)], "brand string")
    known = spark.createDataFrame([(" FAR ", "linen suits"), ("A", "unused")], "name string, description string")
    cache = spark.createDataFrame([], "key string, traits array<string>")
    got, new = encoders.brand_traits(names, cache, items(spark), Reader(), known)
    assert {r["key"]: r["traits"] for r in got.collect()} == {"far": ["linen suits"], "none": None} and new.count() == 1
    assert encoders.brand_traits(names, cache, items(spark))[1].count() == 0


def test_image_batches_are_read_once(spark):
    class Reader:
        def images(self, contents, captions):
            return None if contents[0] == b"9" else [f"Trait {contents[0].decode()} of {len(contents)}", f"{captions[0]}"]

        def polish(self, candidates, titles):
            return [f"{c} like {titles[0]}" for c in candidates] if titles else None

    rows = [("p", i, str(i).encode(), f"cap {i}") for i in range(10)] + [("q", i, str(i).encode(), "other") for i in range(8)] + [("r", 0, b"9", None)]
    b = encoders.image_batches(spark.createDataFrame(rows, "pid string, n int, content binary, caption string"))
    keys = {(r["pid"], r["batch"]): (r["key"], len(r["contents"])) for r in b.collect()}
    sha = lambda x: hashlib.sha1(x).hexdigest()
    want = sha("".join(sha(str(i).encode()) for i in range(8)).encode())
    assert keys["p", 0] == keys["q", 0] == (want, 8) and keys["p", 1][1] == 2 and len(keys) == 4
    cache = spark.createDataFrame([(keys["p", 1][0], ["cached"])], "key string, traits array<string>")
    got, new = encoders.image_traits(b, cache, Reader())
    found = {r["key"]: r["traits"] for r in got.collect()}
    assert found[want][0] == "trait 0 of 8" and found[keys["p", 1][0]] == ["cached"] and found[keys["r", 0][0]] is None and [r["key"] for r in new.collect()] == [want]
    c = spark.createDataFrame([("p", ["linen"], ["Silk"]), ("q", ["wool"], [])], "pid string, traits array<string>, titles array<string>")
    assert {r["pid"]: r["traits"] for r in encoders.polished(c, Reader()).collect()} == {"p": ["linen like silk"], "q": ["wool"]}
    assert {r["pid"]: r["traits"] for r in encoders.polished(c).collect()} == {"p": ["linen"], "q": ["wool"]}


def test_an_unknown_brand_has_the_vector_of_its_description(spark):
    it = items(spark)
    none = spark.createDataFrame([], "id long, vec array<double>")
    brands = spark.createDataFrame([("a",), (" Far ",), ("Near",), ("far",)], "brand string")
    known = spark.createDataFrame([("near", "red silk")], "name string, description string")
    a = {r["anchor"]: r["q"] for r in taste.anchors(it, brands, none, none, none, encoders.HashEncoder(8), known).collect()}
    assert set(a) == {"brand:A", "brand:Far", "brand:Near"} or set(a) == {"brand:A", "brand:far", "brand:Near"}
    assert np.allclose(a["brand:Near"], encoders.HashEncoder(8).texts(["red silk"])[0])


def test_unmangled():
    for text in ("café “quoted” — ŝ", "plain", "", "naïve", "日本"):
        twice = text.encode().decode("latin-1")
        assert encoders.unmangled(text) == text and encoders.unmangled(twice) == text and encoders.unmangled(twice.encode().decode("latin-1")) == text


def test_quiz_picks(spark):
    p = spark.createDataFrame([("p", [3, 1]), ("q", None), ("r", [7])], "pid string, quiz_picks array<long>")
    picked = spark.createDataFrame([("p", 0, 2), ("p", 1, 1), ("p", 2, 999), ("q", 1, 5), ("q", 0, 6), ("q", 2, 5)], "pid string, n int, id long")
    assert {r["pid"]: r["quiz_picks"] for r in profiles.with_picks(p, picked, items(spark)).collect()} == {"p": [3, 1, 2], "q": [6, 5], "r": [7]}
