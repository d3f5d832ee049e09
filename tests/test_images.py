"""Pictures as files, their traits, and what is left when one goes."""

import numpy as np
from pyspark.sql import functions as F

from vitrine.operators import images
from vitrine.operators.encoders import HashEncoder

PNG, JPG = b"\x89PNG\r\n\x1a\n" + b"p" * 40, b"\xff\xd8\xff" + b"j" * 40


def test_files(spark, tmp_path):
    files = {"a/one.png": PNG, "a/two.jpg": JPG, "a/same%20one.png": PNG, "a/words.png": b"not a picture", "a/short.png": b"\x89PNG\r\n\x1a\n", "b/one.png": PNG, "b/w.webp": b"RIFF1234WEBP" + b"w" * 30, "b/big.gif": b"GIF8" + b"x" * images.MAX_BYTES}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    found = images.files(spark, str(tmp_path))
    assert {(r["pid"], r["name"]): (r["kind"], r["error"], r["content"] is None) for r in found.collect()} == {
        ("a", "one.png"): ("png", None, False), ("a", "two.jpg"): ("jpeg", None, False), ("a", "same one.png"): ("png", None, False), ("a", "words.png"): (None, "no picture", True),
        ("a", "short.png"): ("png", None, False), ("b", "one.png"): ("png", None, False), ("b", "w.webp"): ("webp", None, False), ("b", "big.gif"): ("gif", "too large", True),
    }
    got = {(r["pid"], r["name"]): r for r in images.ingested(found, HashEncoder(8)).collect()}
    assert {k: r["error"] for k, r in got.items()} == {("a", "one.png"): None, ("a", "two.jpg"): None, ("a", "words.png"): "no picture", ("a", "short.png"): "unreadable", ("b", "one.png"): None, ("b", "w.webp"): None, ("b", "big.gif"): "too large"}
    assert np.allclose(got["a", "one.png"]["vec"], HashEncoder(8).images([PNG])[0]) and got["a", "one.png"]["image_id"] == got["b", "one.png"]["image_id"]
    assert images.ingested(found.limit(0), HashEncoder(8)).count() == 0


def test_a_picture_brings_traits_and_takes_them_along(spark):
    words = spark.createDataFrame([(f"w{i}", [float(i == k) for k in range(8)]) for i in range(8)], "phrase string, q array<double>")
    near = lambda *k: [1.0 if i in k else 0.0 for i in range(8)]
    pictures = spark.createDataFrame([("p", "i1", near(0)), ("p", "i2", near(0, 1)), ("q", "i1", near(5)), ("q", "i3", None)], "pid string, image_id string, vec array<double>")
    new = images.read_traits(pictures, words)
    assert {(r["pid"], r["text"]): [s["ref"] for s in r["sources"]] for r in new.collect()} == {("p", "w0"): ["i1", "i2"], ("p", "w1"): ["i2"], ("q", "w5"): ["i1"]}
    schema = "pid string, text string, sources array<struct<kind:string,ref:string>>, user_added boolean"
    traits = spark.createDataFrame([("p", "w0", [("quiz", "7")], False), ("p", "mine", [], True), ("q", "w5", [("pin", "x")], True)], schema)
    all_ = images.merged(traits, new)
    show = lambda df: {(r["pid"], r["text"]): ([tuple(s) for s in r["sources"]], r["user_added"]) for r in df.collect()}
    assert show(all_) == {("p", "w0"): ([("quiz", "7"), ("image", "i1"), ("image", "i2")], False), ("p", "w1"): ([("image", "i2")], False), ("p", "mine"): ([], True), ("q", "w5"): ([("pin", "x"), ("image", "i1")], True)}
    assert show(images.merged(all_, new)) == show(all_)
    gone = spark.createDataFrame([("p", "image", "i2"), ("q", "image", "i1"), ("q", "pin", "x"), ("r", "image", "i1")], "pid string, kind string, ref string")
    left, after = images.removed(pictures, all_, gone)
    assert sorted((r["pid"], r["image_id"]) for r in left.collect()) == [("p", "i1"), ("q", "i3")]
    assert show(after) == {("p", "w0"): ([("quiz", "7"), ("image", "i1")], False), ("p", "mine"): ([], True), ("q", "w5"): ([], True)}
    assert show(images.removed(pictures, all_, gone.limit(0))[1]) == show(all_) and F
