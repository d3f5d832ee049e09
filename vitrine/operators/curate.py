"""Curation gate, overview, quality signals and cost roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import constants as K
from vitrine.functions import text as T
from vitrine.operators import records


def effective(brands: DataFrame, tiers: DataFrame, review: DataFrame) -> DataFrame:
    """Add ``tier, verified, decision, live`` to ``brands`` (``brand``): an owner's decision wins, else verified tier C is out."""
    key = F.lower(F.trim("brand")).alias("key")
    d = brands.withColumn("key", key).join(tiers.select("key", "tier", "verified"), "key", "left")
    d = d.join(review.select("key", "decision"), "key", "left")
    return d.withColumn("live", F.coalesce(F.col("decision") == "keep", ~((F.col("tier") == "C") & F.col("verified")), F.lit(True)))


#: Pictures and titles that a brand's row shows, and letters of a title.
PREVIEWS, SAMPLES, TITLE = 6, 4, 60


def overview(products: DataFrame) -> DataFrame:
    """One row for each brand of the full index: ``brand, key, domain, currency, items, median_usd, vendors, other_vendors, preview,
    sample_titles``.

    ``domain`` and ``currency`` are those of the first item by id; the median is over prices from 3 dollars, halves rounded to even;
    preview and titles are of the first items in stock. Only those few items of a brand pass a window, cut before the
    shuffle. A null brand is one; null titles show as empty."""
    dollars = T.usd("price", "currency")
    d = products.withColumn("brand", F.coalesce("brand", F.lit("")))
    rows = d.groupBy("brand").agg(F.count("*").alias("items"), F.bround(F.median(F.when(dollars >= 3, dollars)), 0).alias("median_usd"), F.min_by(F.struct("domain", "currency"), "id").alias("_f"))
    n = F.row_number().over(Window.partitionBy("brand").orderBy("id"))
    shown = d.where("available").withColumn("_n", n).where(F.col("_n") <= PREVIEWS)
    shown = shown.groupBy("brand").agg(F.array_sort(F.collect_list(F.struct("_n", "image", F.left(F.coalesce("title", F.lit("")), F.lit(TITLE)).alias("title")))).alias("_s"))
    out = rows.join(shown, "brand", "left").join(records.vendors(d), "brand", "left")
    s = F.coalesce("_s", F.array().cast(shown.schema["_s"].dataType))
    return out.select(
        "brand", F.lower("brand").alias("key"), "_f.domain", "_f.currency", "items", "median_usd", "vendors", "other_vendors",
        F.transform(s, lambda x: x["image"]).alias("preview"), F.transform(F.slice(s, 1, SAMPLES), lambda x: x["title"]).alias("sample_titles"),
    )


def graded(rows: DataFrame, tiers: DataFrame, review: DataFrame, traits: DataFrame) -> DataFrame:
    """The overview with each brand's research (``key, tier, reason, based_in, evidence, verified``), decision (``key, decision``) and
    cached traits (``key, traits``): texts that are missing are empty, ``verified`` is false and ``traits`` empty then."""
    d = rows.join(tiers.select("key", "tier", "reason", "based_in", "evidence", "verified"), "key", "left").join(review.select("key", "decision"), "key", "left")
    d = d.join(traits.select("key", "traits"), "key", "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("reason", "based_in", "evidence")})
    return d.withColumns({"verified": F.coalesce("verified", F.lit(False)), "traits": F.coalesce("traits", F.array().cast("array<string>"))})


def summary(view: DataFrame) -> DataFrame:
    """One row about graded brands (``tier, verified, decision``): ``brands, tiers`` (map; ``?`` for the ungraded), ``decided, live, verified``. A brand is
    live by its decision, else unless it is verified tier C."""
    tier = F.coalesce(F.nullif("tier", F.lit("")), F.lit("?"))
    decided = F.coalesce("decision", F.lit("")) != ""
    live = F.when(decided, F.col("decision") == "keep").otherwise(~((tier == "C") & F.coalesce("verified", F.lit(False))))
    by = view.groupBy(tier.alias("t")).agg(F.count("*").alias("n"), F.count_if(decided).alias("decided"), F.count_if(live).alias("live"), F.count_if(F.coalesce("verified", F.lit(False))).alias("verified"))
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "n"))))
    none = F.lit(0).cast("long")
    return by.agg(F.coalesce(F.sum("n"), none).alias("brands"), counts.alias("tiers"), *[F.coalesce(F.sum(c), none).alias(c) for c in ("decided", "live", "verified")])


def signals(products: DataFrame, stores: DataFrame | None = None) -> DataFrame:
    """Quality signals and suspicion per brand from ``brand, title, price, currency, vendor, tags`` and, where there, ``sizes_offered``; halves
    are rounded to even, and an empty vendor is the brand. With ``stores`` (``name, domain, currency, tags``) also what they say."""
    dollars, t = T.usd("price", "currency"), F.col("title")
    vendor = F.lower(F.trim(F.when(F.col("vendor") == "", F.col("brand")).otherwise(F.coalesce("vendor", "brand"))))
    share = lambda c: F.bround(F.avg(c.cast("double")), 2)
    caps = ((F.upper(t) == t) & t.rlike("(?U)\\p{Lu}")) | t.rlike(K.PLACEHOLDER)
    d = products.withColumn("_usd", F.when(dollars >= 3, dollars))
    s = d.groupBy("brand").agg(
        F.count("*").alias("items"),
        F.bround(F.median("_usd"), 0).alias("median_usd"),
        share(t.rlike(K.SEO_WORDS)).alias("seo_titles"),
        share(F.size(F.split(F.trim(t), r"\s+")) >= 8).alias("long_titles"),
        share(caps).alias("caps_titles"),
        F.bround(F.avg(F.greatest(F.coalesce(F.size("tags"), F.lit(0)), F.lit(0)).cast("double")), 1).alias("avg_tags"),
        F.count_distinct(vendor).alias("distinct_vendors"),
        share(vendor == F.lower("brand")).alias("own_vendor_share"),
        *([share(F.coalesce(F.size("sizes_offered"), F.lit(0)) > 0).alias("sized")] if "sizes_offered" in products.columns else []),
    )
    # the price at position floor(n / 10) in sorted order, by counts of equal prices
    w = Window.partitionBy("brand")
    counts = d.where("_usd IS NOT NULL").groupBy("brand", "_usd").agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_to", F.sum("_c").over(w.orderBy("_usd"))).withColumn("_all", F.sum("_c").over(w))
    p10 = counts.where(F.col("_to") > F.floor(F.col("_all") / 10)).groupBy("brand").agg(F.bround(F.min("_usd"), 0).alias("p10_usd"))
    s = s.join(p10, "brand", "left")
    if stores is not None:
        s = s.join(stores.groupBy(F.col("name").alias("brand")).agg(F.max_by(F.struct("domain", "currency", "tags"), F.coalesce("domain", F.lit(""))).alias("_m")), "brand", "left")
        s = s.withColumns({"domain": F.col("_m.domain"), "currency": F.col("_m.currency"), "tags": F.coalesce("_m.tags", F.array().cast("array<string>"))}).drop("_m")
    cheap = F.when(F.col("median_usd") < 25, 3).when(F.col("median_usd") < 40, 2).when(F.col("median_usd") < 60, 1).otherwise(0)
    many = F.when(F.col("distinct_vendors") >= 5, 2).when(F.col("distinct_vendors") >= 3, 1).otherwise(0)
    score = cheap + 3 * F.col("seo_titles") + 2 * F.col("long_titles") + many + F.when(F.col("avg_tags") >= 15, 1).otherwise(0) + F.when(F.col("caps_titles") >= 0.5, 1).otherwise(0)
    return s.withColumn("suspicion", F.bround(score, 2))


def usage(log: DataFrame) -> DataFrame:
    """Calls, tokens and cost per kind and in total (``kind`` null)."""
    return log.rollup("kind").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost_usd").alias("cost_usd"))


def costed(log: DataFrame, prices: DataFrame, fallback: tuple[float, float]) -> DataFrame:
    """Add ``cost_usd`` by model price per million tokens (``model, input, output``)."""
    d = log.join(F.broadcast(prices.select("model", F.col("input").alias("_i"), F.col("output").alias("_o"))), "model", "left")
    cost = F.col("input_tokens") * F.coalesce("_i", F.lit(fallback[0])) + F.col("output_tokens") * F.coalesce("_o", F.lit(fallback[1]))
    return d.withColumn("cost_usd", cost / 1e6).drop("_i", "_o")
