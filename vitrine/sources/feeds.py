"""Feeds of image boards: addresses, items with their links, and what is wrong with a feed, by Spark's own XML functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: a board's address, its feed, and the sizes of an image's address
BOARD = r"pinterest\.[a-z.]+/([^/?#]+)/([^/?#]+)"
FEED = "https://www.pinterest.com/%s/%s.rss"
SMALL, LARGE = "/236x/", "/564x/"
_IMAGE = r'<img[^>]+src="([^"]+)"'
_ITEMS = "struct<channel: struct<item: array<struct<description: string, link: string>>>, _torn: string>"


def board(url: Column | str) -> Column:
    """``struct<user, board, feed>`` of a board's address; null if it is none."""
    u = F.col(url) if isinstance(url, str) else url
    user, name = (F.regexp_extract(u, BOARD, i) for i in (1, 2))
    return F.when(u.rlike(BOARD), F.struct(user.alias("user"), name.alias("board"), F.format_string(FEED, user, name).alias("feed")))


def items(feeds: DataFrame, text: str = "text") -> DataFrame:
    """The pins of each feed, beside its other columns: ``n`` (order in the feed, from 0), ``source`` (an item's first image, in its
    large form), ``link`` (the item's, else the image) and ``error``.

    A feed without pins is one row with nulls and an error: ``unreadable`` (no text, or no whole XML) or ``no pins``; else
    ``error`` is null. Items without an image are none."""
    tree = F.from_xml(F.col(text), _ITEMS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_torn"})
    d = feeds.withColumn("_x", tree)
    torn = F.coalesce(F.col(text), F.lit("")).rlike(r"\A\s*\z")
    torn = torn | F.col("_x").isNull() | F.col("_x._torn").isNotNull()
    image = lambda i: F.regexp_extract(i["description"], _IMAGE, 1)
    held = F.filter(F.coalesce("_x.channel.item", F.array().cast("array<struct<description:string,link:string>>")), lambda i: F.coalesce(image(i), F.lit("")) != "")
    pins = F.transform(held, lambda i: F.struct(F.replace(image(i), F.lit(SMALL), F.lit(LARGE)).alias("source"), F.coalesce(F.nullif(F.trim(i["link"]), F.lit("")), F.replace(image(i), F.lit(SMALL), F.lit(LARGE))).alias("link")))
    d = d.withColumn("_e", F.when(torn, "unreadable").when(F.size(held) == 0, "no pins")).withColumn("_p", F.when(F.col("_e").isNull(), pins))
    kept = [c for c in feeds.columns if c != text]
    return d.select(*kept, F.posexplode_outer("_p").alias("n", "_i"), "_e").select(*kept, "n", "_i.source", "_i.link", F.col("_e").alias("error"))
