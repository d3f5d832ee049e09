"""Record shapes, brand lists and totals of the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import constants as K
from vitrine.functions import text as T

#: Columns that ranking and filters read; a scan of a lean frame reads no others.
LEAN = ["id", "brand", "domain", "title", "url", "image", "price", "currency", "product_type", "available", "sizes_in_stock", "sizes_offered"]
MAX_TAGS, SHOWN_IMAGES, MAX_DESCRIPTION = 6, 5, 400


def full(products: DataFrame) -> DataFrame:
    """The complete record of a card: no null strings, six tags, five images of which the first is ``image``, and a
    short description; a null list is empty, and without images ``image`` stays as it is. ``vendor`` and ``published_at`` go."""
    none = F.array().cast("array<string>")
    images = F.when(F.size("images") > 0, F.slice("images", 1, SHOWN_IMAGES)).otherwise(F.array_compact(F.array("image")))
    d = products.withColumns({c: F.coalesce(c, F.lit("")) for c in ("brand", "domain", "currency", "product_type")})
    d = d.withColumns({"tags": F.slice(F.coalesce("tags", none), 1, MAX_TAGS), "images": images, "description": F.left(F.coalesce("description", F.lit("")), F.lit(MAX_DESCRIPTION))})
    return d.withColumn("image", F.coalesce(F.get("images", F.lit(0)), "image")).drop("vendor", "published_at")


def lean(products: DataFrame) -> DataFrame:
    """The columns of LEAN of full records."""
    return full(products).select(*LEAN)


def brand_list(items: DataFrame, stores: DataFrame) -> DataFrame:
    """``name, domain, tags, count`` per brand of the items; brands that are not among ``stores`` (``name, domain, tags``)
    have no domain and no tags."""
    n = items.groupBy(F.col("brand").alias("name")).agg(F.count("*").alias("count"))
    known = stores.groupBy("name").agg(F.max_by(F.struct("domain", "tags"), F.coalesce("domain", F.lit(""))).alias("_m"))
    return n.join(known, "name", "left").select("name", "_m.domain", F.coalesce("_m.tags", F.array().cast("array<string>")).alias("tags"), "count")


def meta(items: DataFrame) -> DataFrame:
    """One row: items, brands, items with known sizes, and the sorted brand names (a list that grows with stores only)."""
    return items.agg(
        F.count("*").alias("items"), F.count_distinct("brand").alias("brands"), F.count_if(F.size("sizes_offered") > 0).alias("sized"), F.array_sort(F.collect_set("brand")).alias("catalog_brands")
    )


def totals(found: DataFrame, page: DataFrame, size: int = K.PAGE) -> DataFrame:
    """One row: ``total`` (cards of all pages: one per brand and colourway), ``pages``, ``brands_on_page``."""
    n = found.select("brand", T.colourway("title").alias("way")).distinct().agg(F.count("*").alias("total"))
    n = n.withColumn("pages", F.ceil(F.col("total") / size))
    return n.crossJoin(F.broadcast(page.agg(F.count_distinct("brand").alias("brands_on_page"))))


def vendors(products: DataFrame, top: int = 5) -> DataFrame:
    """Per brand the number of vendors and the ``top`` most frequent ones that are not the brand itself, ties by name.

    Counts come before the window, which so holds a row per vendor of a brand."""
    v = products.where(F.col("vendor") != "").groupBy("brand", F.trim("vendor").alias("vendor")).agg(F.count("*").alias("n"))
    other = F.lower("vendor") != F.lower("brand")
    rank = F.row_number().over(Window.partitionBy("brand", other).orderBy(F.desc("n"), "vendor"))
    shown = F.when(other & (F.col("_k") <= top), F.struct("_k", "vendor"))
    d = v.withColumn("_k", rank).groupBy("brand").agg(F.count("*").alias("vendors"), F.array_sort(F.collect_list(shown)).alias("_o"))
    known = products.select("brand").distinct().join(d, "brand", "left")
    names = F.transform(F.coalesce("_o", F.array().cast("array<struct<_k:int,vendor:string>>")), lambda s: s["vendor"])
    return known.select("brand", F.coalesce("vendors", F.lit(0)).alias("vendors"), names.alias("other_vendors"))


def listed(view: DataFrame, tier: str = "all", find: str = "") -> DataFrame:
    """The curation list: brands of a tier (``?``: ungraded, ``all``) whose name holds ``find``, letter case aside."""
    d = view if tier == "all" else view.where(F.col("tier").isNull() | (F.col("tier") == "")) if tier == "?" else view.where(F.col("tier") == tier)
    return d.where(F.contains(F.lower("brand"), F.lit(find.lower()))) if find else d


def confidence_note(traits: Column, sources: Column) -> Column:
    """The sentence beside a confidence level."""
    # fixed texts
    of = F.concat(F.lit("based on "), traits.cast("string"), F.lit(" traits from "), sources.cast("string"), F.lit(" source"))
    many = F.when(sources != 1, "s").otherwise("")
    few = F.concat(F.lit("based on only "), traits.cast("string"), F.lit(" trait"), F.when(traits != 1, "s").otherwise(""))
    return (
        F.when((traits >= 5) & (sources >= 3), F.concat(of, F.lit("s")))
        .when(traits >= 3, F.concat(of, many, F.lit(" — a couple more screenshots or brands will sharpen this")))
        .when(traits >= 1, F.concat(few, F.lit(" so far — add a few screenshots or a brand you shop")))
        .otherwise("nothing to go on yet")
    )


def budget(log: DataFrame, limit: float, switched_on: bool = True) -> DataFrame:
    """One row ``spent, remaining, allowed``: paid calls are allowed while something remains and they are switched on."""
    spent = F.coalesce(F.sum("cost_usd"), F.lit(0.0))
    d = log.agg(spent.alias("spent")).withColumn("remaining", F.greatest(F.lit(0.0), F.lit(limit) - F.col("spent")))
    return d.withColumn("allowed", (F.col("remaining") > 0) & F.lit(switched_on))


def rejects(status: DataFrame, top: int = 6) -> DataFrame:
    """The most frequent reasons (``status``) for leaving out a store, ties by name."""
    return status.groupBy("status").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status").limit(top)


def grown(existing: DataFrame, accepted: DataFrame) -> DataFrame:
    """The store list with the accepted ones after it; nothing is merged."""
    return existing.unionByName(accepted, allowMissingColumns=True)


def nearest_titles(items: DataFrame, taste, limit: int = 12) -> DataFrame:
    """Titles nearest to a taste vector (one row with ``q``), ties by id."""
    sim = F.aggregate(F.zip_with("vec", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return items.crossJoin(F.broadcast(taste.select("q").limit(1))).withColumn("sim", sim).orderBy(F.desc("sim"), "id").limit(limit).select("id", "title", "sim")


def descriptions(brands: DataFrame, known: DataFrame, read: DataFrame) -> DataFrame:
    """A text for each of ``brands`` (``name``): the known one, else what a reader said, else a sentence with the name.
    ``known`` and ``read``: ``name, description``; names are compared without case and outer spaces, empty texts are none."""
    d = brands.withColumn("_k", F.lower(F.trim("name")))
    for i, table in enumerate((known, read)):
        text = table.where(F.col("description") != "").groupBy(F.lower(F.trim("name")).alias("_k")).agg(F.min("description").alias(f"_d{i}"))
        d = d.join(text, "_k", "left")
    return d.select("name", F.coalesce("_d0", "_d1", F.concat(F.lit("clothing from the fashion brand "), "name")).alias("description"))
