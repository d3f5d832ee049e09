"""Nested store records to flat products, index building, and growth of the store list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions import constants as K
from vitrine.functions import sizes as S
from vitrine.functions import text as T

RAW = """id long, title string, handle string, product_type string, vendor string, body_html string, tags array<string>, published_at string,
images array<struct<src:string>>, options array<struct<name:string,position:int,values:array<string>>>,
variants array<struct<title:string,price:string,available:boolean,option1:string,option2:string,option3:string>>"""


def normalise_products(raw: DataFrame, brands: DataFrame) -> DataFrame:
    """Products from raw records with a ``domain`` column; ``brands`` (``name, domain, currency``) is the store list.

    Records without images and gift cards go. The price is the first that parses; a product is available if a
    variant is, or if it has none. One select over the nested columns: no explode."""
    title = F.coalesce("title", F.lit(""))
    gift = F.lit(False)
    for w in K.SKIP_WORDS:
        gift = gift | F.contains(F.lower(title), F.lit(w))
    b = brands.select("domain", F.col("name").alias("brand"), F.coalesce("currency", F.lit("USD")).alias("currency"))
    d = raw.where((F.size("images") > 0) & ~gift).join(b, "domain")
    position = S.option_position(F.col("options"))
    label = lambda v: F.coalesce(F.when(position == 1, v["option1"]).when(position == 2, v["option2"]).when(position == 3, v["option3"]), F.when(F.size("variants") == 1, v["title"]))
    pairs = F.filter(F.transform("variants", lambda v: F.struct(label(v).alias("label"), F.coalesce(v["available"], F.lit(False)).alias("available"))), lambda p: p["label"].isNotNull())
    labels = F.array_distinct(F.transform(pairs, lambda p: p["label"]))
    d = d.withColumn("_pairs", pairs).withColumn("_canon", S.normalise(labels, F.col("currency"), title))
    sizes = F.transform("_canon", lambda c: F.struct(c["label"], c["canon"], F.exists("_pairs", lambda p: (p["label"] == c["label"]) & p["available"]).alias("available")))
    in_order = lambda a: F.transform(F.array_sort(F.transform(F.array_distinct(F.flatten(a)), lambda x: F.struct(S.order(x).alias("o"), x.alias("x")))), lambda s: s["x"])
    prices = F.filter(F.transform("variants", lambda v: v["price"].try_cast("double")), lambda x: x.isNotNull())
    return d.withColumn("sizes", sizes).select(
        F.concat("domain", F.lit("#"), F.col("id").cast("string")).alias("id"),
        "brand",
        "domain",
        title.alias("title"),
        F.concat(F.lit("https://"), "domain", F.lit("/products/"), "handle").alias("url"),
        F.slice(F.transform("images", lambda i: T.image_url(i["src"])), 1, K.MAX_IMAGES).alias("images"),
        F.get(prices, F.lit(0)).alias("price"),
        "currency",
        F.coalesce("product_type", F.lit("")).alias("product_type"),
        "vendor",
        "tags",
        (F.coalesce(F.size("variants"), F.lit(0)) <= 0).__or__(F.exists("variants", lambda v: F.coalesce(v["available"], F.lit(False)))).alias("available"),
        T.strip_html("body_html").alias("description"),
        "sizes",
        in_order(F.transform(F.filter("sizes", lambda s: s["available"]), lambda s: s["canon"])).alias("sizes_in_stock"),
        in_order(F.transform("sizes", lambda s: s["canon"])).alias("sizes_offered"),
        "published_at",
    )


def missing(products: DataFrame, cache: DataFrame, url: str = "image") -> DataFrame:
    """Products whose image has no cached vector: the work list."""
    return products.withColumn("image_key", F.sha1(F.col(url).cast("binary"))).join(cache.select("image_key"), "image_key", "left_anti")


def indexed(products: DataFrame, cache: DataFrame, url: str = "image") -> DataFrame:
    """Products with their cached vectors."""
    return products.withColumn("image_key", F.sha1(F.col(url).cast("binary"))).join(cache.select("image_key", "vec"), "image_key")


def new_candidates(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates (``name, domain``) with a plausible domain that are not ``known`` by domain or name; first per domain by name."""
    c = candidates.withColumn("domain", T.domain("domain")).where(F.contains("domain", F.lit(".")))
    c = c.join(known.select(T.domain("domain").alias("domain")).distinct(), "domain", "left_anti")
    names = known.select(F.lower(F.trim("name")).alias("_n")).distinct()
    c = c.join(names, F.lower(F.trim(c["name"])) == names["_n"], "left_anti")
    return c.groupBy("domain").agg(F.min("name").alias("name"))
