"""Store pages, feeds and versioned sinks."""

import json

import pytest
from pyspark.sql import functions as F

from vitrine.sources import feeds, sinks, stores


def lay(root, domain, pages):
    (root / domain).mkdir(parents=True, exist_ok=True)
    for k, text in pages.items():
        (root / domain / f"{k}.json").write_text(text if isinstance(text, str) else json.dumps({"products": [{"id": 1000 * k + i, "title": f"t{i}"} for i in range(text)]}))


RAW = "id long, title string, images array<struct<src: string>>"


def test_saved_pages(spark, tmp_path):
    lay(tmp_path, "a.com", {1: 250, 2: 3, "notes": "{}"})
    lay(tmp_path, "b.com", {1: 2, 2: 9})  # a short page ends the store
    lay(tmp_path, "c.com", {1: " \n", 2: 5})
    lay(tmp_path, "d.com", {1: '{"products": [{"id": 1}, {"id"'})
    lay(tmp_path, "e.com", {1: '{"items": []}', 2: '[1, 2]'})
    lay(tmp_path, "f%20g.com", {1: '{"products": [{"id": 7, "images": [{"src": "i"}]}, 5, {"id": "x"}]}'})
    lay(tmp_path, "h.com", {2: 4})  # no first page
    lay(tmp_path, "i.com", {1: 0})
    found = stores.pages(spark, str(tmp_path))
    errors = {(r["domain"], r["page"]): r["error"] for r in stores.page_errors(found).collect()}
    assert errors == {("c.com", 1): "empty", ("d.com", 1): "torn", ("e.com", 1): "no products", ("e.com", 2): "no products"}
    got = {}
    for r in stores.products(spark, str(tmp_path), RAW).collect():
        got.setdefault(r["domain"], []).append(r["id"])
    assert {d: len(x) for d, x in got.items()} == {"a.com": 120, "b.com": 2, "f g.com": 3} and got["f g.com"] == [7, None, None]
    got = stores.products(spark, str(tmp_path), RAW, limit=252).where("domain = 'a.com'").agg(F.count("*"), F.max("id")).first()
    assert tuple(got) == (252, 2001)
    status = stores.store_status(spark.createDataFrame([("a.com",), ("d.com",)], "domain string"), stores.products(spark, str(tmp_path), RAW))
    assert {r["domain"]: (r["rows"], r["status"]) for r in status.collect()} == {"a.com": (120, "ok"), "d.com": (0, "empty")}


def test_pages_that_arrive_later(spark, tmp_path):
    src, out, ck = tmp_path / "src", f"{tmp_path}/out", f"{tmp_path}/ck"
    lay(src, "a.com", {1: 3})

    def run():
        s = stores.parsed(stores.arriving(spark, str(src), 1), RAW)
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["domain"], r["id"]) for r in spark.read.parquet(out).collect())

    assert run() == [("a.com", 1000 + i) for i in range(3)]
    lay(src, "a.com", {2: 1, 3: "torn"})
    lay(src, "b.com", {1: 1})
    assert run() == [("a.com", 1000), ("a.com", 1001), ("a.com", 1002), ("a.com", 2000), ("b.com", 1000)]


def test_feeds(spark):
    item = lambda img, link: f"<item><title>t</title><description>&lt;a&gt;{img}</description>{link}</item>"
    img = lambda name: f'&lt;img alt="x" src="https://i/236x/{name}.jpg"&gt;'
    rss = lambda *items: f'<?xml version="1.0"?><rss version="2.0"><channel><title>b</title>{"".join(items)}</channel></rss>'
    rows = [
        (1, rss(item(img("a"), "<link>https://p/1</link>"), item("no image", "<link>https://p/2</link>"), item(img("b") + img("c"), ""))),
        (2, rss(item(img("a"), ""))[:-30]),
        (3, rss()),
        (4, rss(item("words", ""))),
        (5, None),
        (6, " "),
        (7, "not xml at all"),
        (8, '<rss><channel><item><description><![CDATA[<img src="u">]]></description><link> https://p/8 </link></item></channel></rss>'),
    ]
    got = {}
    for r in feeds.items(spark.createDataFrame(rows, "id int, text string")).collect():
        got.setdefault(r["id"], []).append((r["n"], r["source"], r["link"], r["error"]))
    large = "https://i/564x/{}.jpg".format
    assert sorted(got[1]) == [(0, large("a"), "https://p/1", None), (1, large("b"), large("b"), None)]
    assert [got[i] for i in (2, 5, 6, 7)] == [[(None, None, None, "unreadable")]] * 4 and [got[i] for i in (3, 4)] == [[(None, None, None, "no pins")]] * 2
    assert got[8] == [(0, "u", "https://p/8", None)]
    urls = spark.createDataFrame([("https://www.pinterest.com/me/my-board/?x=1",), ("pinterest.co.uk/u/b#f",), ("https://pinterest.com/me",), (None,)], "u string")
    assert [r["b"] and tuple(r["b"]) for r in urls.select(feeds.board("u").alias("b")).collect()] == [
        ("me", "my-board", "https://www.pinterest.com/me/my-board.rss"), ("u", "b", "https://www.pinterest.com/u/b.rss"), None, None
    ]


def test_catalogue_sink(spark, tmp_path):
    s = sinks.CatalogueSink(spark, f"{tmp_path}/c")
    rows = lambda *ids: spark.createDataFrame([(i, "t") for i in ids], "id long, title string")
    report = spark.createDataFrame([("a.com", 2)], "domain string, rows long")
    s.crawl(rows(1, 2), report)
    torn = rows(3).withColumn("title", F.when(F.col("id") == 3, F.raise_error(F.lit("torn")).cast("string")))
    with pytest.raises(Exception, match="torn"):
        s.crawl(torn, report.limit(0))
    assert s.read("products").count() == 2 and s.read("report").count() == 1
    stores_ = lambda *x: spark.createDataFrame(list(x), "name string, domain string")
    s.accept(stores_(("B", "https://www.b.com/x"), ("A", "b.com"), ("C", "c.com")))
    s.accept(stores_(("Z", "c.com"), ("D", "d.com")))
    s.signals(rows(9))
    assert sorted(tuple(r) for r in s.read("stores").collect()) == [("A", "b.com"), ("C", "c.com"), ("D", "d.com")]
    assert s.read("signals").count() == 1 and s.read("products").count() == 2 and s.versions.manifest().version == 4


def test_profile_sink_refuses_other_ids(spark, tmp_path):
    s = sinks.ProfileSink(spark, f"{tmp_path}/p", 4)
    one, two = "0123456789abcdef" * 2, "f" * 32
    rows = lambda *x: spark.createDataFrame(list(x), "pid string, currency string")
    s.put(rows((one, "USD"), (two, "EUR")))
    for bad in ("../etc/passwd", "F" * 32, "f" * 31, "f" * 32 + "\n", None):
        with pytest.raises(Exception, match="no profile id"):
            s.put(rows((one, "GBP"), (bad, "GBP")))
    assert {r["pid"]: r["currency"] for r in s.get([one, two, "a" * 32]).collect()} == {one: "USD", two: "EUR", "a" * 32: None}
    s.put(rows((one, "GBP")))
    assert {r["pid"]: r["currency"] for r in s.get([one, two]).collect()} == {one: "GBP", two: "EUR"}
